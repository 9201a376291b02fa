"""Personal data: fixed rules plus boosted trees over candidate spans (native columns).

Base spans follow fixed rules (see RULES) and always stay. Generators of high
recall propose more spans, which overlap: e-mail addresses without a top level
domain or with "[at]", and every run of up to GROUPS neighbouring groups of
digits that could be a phone or card number or an address, whatever stands
between the groups. So a number is proposed on its own even where the rules
read it and its neighbours as one number and drop both.

Gradient-boosted trees, one model a kind, score candidates by format and
context. Learning is from positive and unlabelled examples: the spans that the
rules accept are positive, and all other candidates, which may hold what the
rules missed, are unlabelled and stand in for negative ones (but parts of a
base span, which say nothing). What the rules turn on when they tell the kind
(a leading "+", the "@", dots, the separators between groups) is masked, no
feature shows it, so an accepted number looks just like one written without.
A threshold is the highest score that keeps RECALL of the held-out masked
positives; a kind adds spans only if there at least TARGET of what passes is
positive, which is a lower bound of precision as unlabelled ones count as
errors. A kind with too few examples adds nothing.

Trees are fitted on all distinct candidates, so copies count once: rows are
summed by their features, and for each level of a tree Spark adds up the
gradients by kind, node, feature and value. Only these sums, a row for each
value that a feature takes, reach the driver. Up to SINGLE rows are added up by
one task, as a shuffle for each level costs the driver more. Gradients are whole numbers of
1 / GRAIN, so a sum does not depend on the order and the trees not on how the
table is split. Everything is column expressions. Offsets are in code points,
ends exclusive.

The patterns below differ from the plain ones in README only in speed: a run
is entered at its start and never given back, which matches the same spans in
linear time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, scratch, unused

KINDS = ("email", "ip", "card", "phone")
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "number": r"[0-9]++(?:[\x20().,/-]{1,2}[0-9]++)*+",
}
#: What a text must contain before a pattern is tried on it.
NEEDS = {"email": "@", "phone": "+"}
#: Digits that a number may have, and groups of digits.
DIGITS, GROUPS = (7, 19), 6
#: Digits of a number that may pass as one of a kind.
SIZES = {1: (4, 12), 2: (12, 19), 3: (7, 15)}
CONTEXT = 24
CONTEXT_WORDS = r"(?i)(mail|contact|write|phone|tel|call|fax|mobile|card|visa|credit|account|ip|host|server|address)[^A-Za-z]{0,6}$"
LEAST = 20
ROUNDS, RATE = 16, 0.3
RECALL, TARGET = 0.9, 0.9
GRAIN = 1 << 24
BLOCK = 256
#: Rows of examples that one task adds up.
SINGLE = 1 << 16
FEATURES = ("number", "digits", "letters", "groups", "longest", "shortest", "first", "last", "head", "before", "after", "context", "luhn")
#: What no model of a kind sees: the check sum unless it is the kind's own, and how a card's digits are grouped, as any grouping will do.
HIDDEN = {0: ("luhn",), 1: ("luhn",), 2: ("groups", "longest", "shortest", "first", "last"), 3: ("luhn",)}
SPAN = "struct<start:int,kind:int,stop:int>"
CANDIDATE = f"array<struct<start:int,lead:int,stop:int,base:int,part:boolean,v:bigint,f:struct<{','.join(f'{x}:int' for x in FEATURES)}>>>"


def _offsets(text: Column, pattern: str) -> Column:
    """Array of (start, stop, hit) of all matches, leftmost and not overlapping.

    Starts are prefix sums over the pieces between matches, taken in blocks so
    that the work stays near linear in texts of very many matches.
    """
    def placed(hits: Column) -> Column:
        def summed(lens: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lens, b * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))
            until = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

            def at(u: Column) -> Column:
                def one(hit: Column, i: Column) -> Column:
                    k = 2 * i + 1  # pieces and hits take turns
                    start = F.get(u, F.floor(k / BLOCK).cast("int")) + F.aggregate(F.slice(lens, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK), F.lit(0), lambda a, x: a + x)
                    return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("stop"), hit.alias("hit"))

                return F.transform(hits, one)

            return let(until, at)

        pieces = F.split(text, pattern, -1)
        lens = F.flatten(F.zip_with(pieces, hits, lambda p, h: F.array(F.char_length(p), F.char_length(F.coalesce(h, F.lit(""))))))
        return F.when(F.size(hits) > 0, let(lens, summed)).otherwise(F.array().cast("array<struct<start:int,stop:int,hit:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """What a match of the base rule must fulfil; failing ones are dropped and not tried again."""
    n = F.char_length(_digits(hit))
    if kind == "ip":
        return hit.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (index in KINDS), stop>>, by start, then kind."""
    def of(k: int, kind: str) -> Column:
        good = F.filter(_offsets(text, RULES[kind]), lambda x: _valid(kind, x["hit"]))
        spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["stop"].alias("stop"))).cast(f"array<{SPAN}>")
        return F.when(text.contains(NEEDS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>")) if kind in NEEDS else spans

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike(r"[0-9]"), 2).when(c.rlike(r"[A-Za-z\x80-\x{10FFFF}]"), 3).when(c.rlike(r"[=:\"'#]"), 4).otherwise(5)


def _numbers(text: Column) -> Column:
    """(start, stop, groups) of all runs of up to GROUPS neighbouring groups of digits that have a number's size.

    A run costs its own groups only, so this is linear in the text.
    """
    size = lambda groups: F.aggregate(groups, F.lit(0), lambda n, g: n + F.char_length(g))

    def runs(chain: Column) -> Column:
        def of(groups: Column) -> Column:
            def begun(g: Column, i: Column) -> Column:
                def ended(n: Column) -> Column:
                    part = F.slice(groups, i + 1, n)
                    return F.struct((chain["start"] + g["start"]).alias("start"), (chain["start"] + F.element_at(part, -1)["stop"]).alias("stop"), F.transform(part, lambda p: p["hit"]).alias("groups"))

                return F.transform(F.sequence(F.lit(1), F.least(F.lit(GROUPS), F.size(groups) - i)), ended)

            return F.flatten(F.transform(groups, begun))

        return let(_offsets(chain["hit"], "[0-9]++"), of)

    def sized(run: Column) -> Column:
        quad = (F.size(run["groups"]) == 4) & F.forall(run["groups"], lambda g: F.char_length(g) <= 3)
        return quad | size(run["groups"]).between(*DIGITS)

    chains = F.filter(_offsets(text, LOOSE["number"]), lambda x: F.char_length(_digits(x["hit"])) >= 4)
    return F.filter(F.flatten(F.transform(chains, runs)), sized)


def candidates(text: Column, base: Column) -> Column:
    """Proposed spans with their features.

    `base` of a candidate has a bit for each kind as which the rules accept
    just this span, `part` tells that it is a smaller part of a base span, `v`
    hashes what it says, and `lead` is 1 where a plus or bracket stands before a
    number's first digit.
    """
    def made(kind_bits: Column, start: Column, lead: Column, stop: Column, said: Column, values: dict) -> Column:
        low = F.greatest(start - lead - CONTEXT, F.lit(0))
        before = F.when(start == lead, "").otherwise(F.substring(text, start - lead, 1))
        values = values | {
            "before": _side(before), "after": _side(F.substring(text, stop + 1, 1)),
            "context": F.substring(text, low + 1, start - lead - low).rlike(CONTEXT_WORDS).cast("int"),
        }
        f = F.struct(*(F.coalesce(values.get(n, F.lit(0)).cast("int"), F.lit(0)).alias(n) for n in FEATURES))
        part = F.exists(base, lambda s: (s["start"] <= start - lead) & (stop <= s["stop"])) & (kind_bits == 0)
        return F.struct(start.alias("start"), lead.alias("lead"), stop.alias("stop"), kind_bits.alias("base"), part.alias("part"), F.xxhash64(said).alias("v"), f.alias("f"))

    def bit(k: int, start: Column, stop: Column) -> Column:
        return F.exists(base, lambda s: (s["start"] == start) & (s["kind"] == k) & (s["stop"] == stop)).cast("int") * (1 << k)

    def email(x: Column) -> Column:
        def of(said: Column) -> Column:
            local, host = F.substring_index(said, "@", 1), F.substring_index(F.substring_index(said, "@", -1), ".", 1)
            values = {
                "digits": F.regexp_count(said, F.lit("[0-9]")), "letters": F.regexp_count(local, F.lit("[A-Za-z]")),
                "longest": F.char_length(local), "shortest": F.char_length(host), "groups": F.regexp_count(local, F.lit("[.]")),
            }
            return made(bit(0, x["start"], x["stop"]), x["start"], F.lit(0), x["stop"], said, values)

        plain = F.regexp_replace(F.regexp_replace(x["hit"], r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")
        return let(plain, of)

    def number(x: Column) -> Column:
        def of(both: Column) -> Column:
            sizes, lead = both["sizes"], both["lead"]
            joined = F.array_join(x["groups"], "")
            start, stop = x["start"], x["stop"]
            values = {
                "number": F.lit(1), "digits": F.char_length(joined), "groups": F.size(sizes), "longest": F.array_max(sizes), "shortest": F.array_min(sizes),
                "first": F.get(sizes, F.lit(0)), "last": F.element_at(sizes, -1), "head": F.substring(joined, 1, 1), "luhn": _luhn(joined),
            }
            bits = bit(1, start, stop) + bit(2, start, stop) + bit(3, start - lead, stop)
            return made(bits, start, lead, stop, joined, values)

        before = F.when(x["start"] == 0, "").otherwise(F.substring(text, x["start"], 1))
        return let(F.struct(F.transform(x["groups"], lambda g: F.char_length(g)).alias("sizes"), before.isin("+", "(").cast("int").alias("lead")), of)

    has_at = F.lower(text).rlike(r"@|[\[(]at[\])]")
    return F.concat(
        F.when(has_at, F.transform(_offsets(text, LOOSE["email"]), email)).otherwise(F.array()).cast(CANDIDATE),
        F.transform(_numbers(text), number).cast(CANDIDATE),
    )


# --- boosted trees -------------------------------------------------------------------------------


#: (feature, cut, low, high) of a node that is not cut: no value is above.
ONE_LEAF = (0, (1 << 31) - 1, 0.0, 0.0)


@dataclass(frozen=True)
class Trees:
    """Trees of two levels: (feature, cut, (feature, cut, low, high), the same for above the cut)."""

    base: float
    trees: tuple
    threshold: float

    def score(self, f: Column) -> Column:
        def leaf(node) -> Column:
            k, cut, low, high = node
            return F.when(f[FEATURES[k]] <= cut, F.lit(low)).otherwise(F.lit(high))

        parts = (F.when(f[FEATURES[k]] <= cut, leaf(below)).otherwise(leaf(above)) for k, cut, below, above in self.trees)
        return sum(parts, F.lit(self.base))


def _examples(found: DataFrame) -> DataFrame:
    """(base, held, x, n): how many distinct candidates (by what they say) have these features; a third is held out."""
    flat = found.select(F.explode("candidates").alias("c")).where(~F.col("c.part")).select("c.base", "c.f", "c.v")
    distinct = flat.groupBy("base", F.col("f.number").alias("number"), "v").agg(F.min("f").alias("f"))
    held = F.pmod(F.shiftright("v", 7), F.lit(3)) == 0
    return distinct.groupBy("base", held.alias("held"), F.array(*(F.col("f")[n] for n in FEATURES)).alias("x")).agg(F.count("*").alias("n"))


def _models(models: dict[int, Trees], roots: dict | None = None) -> Column:
    """The models as one literal array, a struct a kind, so that every round runs the same compiled code.

    f and cut are the root's that the next trees have.
    """
    names = ("f", "cut", "f0", "cut0", "low0", "high0", "f1", "cut1", "low1", "high1")
    kinds = ",".join(f"{n}:{'double' if n.startswith(('low', 'high')) else 'int'}" for n in names)

    def said(names, values) -> str:
        return f"named_struct({','.join(f'{n!r},{v!r}D' if isinstance(v, float) else f'{n!r},{v}' for n, v in zip(names, values))})"

    def one(k: int, model: Trees) -> str:
        trees = ",".join(said(names, (f, cut, *below, *above)) for f, cut, below, above in model.trees)
        hidden = f"array({','.join(str(FEATURES.index(n)) for n in HIDDEN[k])})"
        return said(("k", "base", "f", "cut", "hidden", "trees"), (k, model.base, *(roots[k, 0] if roots else ONE_LEAF)[:2], hidden, f"CAST(array({trees}) AS array<struct<{kinds}>>)"))

    return F.expr(f"array({','.join(one(k, m) for k, m in models.items())})")


def _margin(m: Column, x: Column) -> Column:
    """What a model of `_models` gives for an array of features."""
    def leaf(t: Column, i: int) -> Column:
        return F.when(F.get(x, t[f"f{i}"]) <= t[f"cut{i}"], t[f"low{i}"]).otherwise(t[f"high{i}"])

    return F.aggregate(m["trees"], m["base"], lambda s, t: s + F.when(F.get(x, t["f"]) <= t["cut"], leaf(t, 0)).otherwise(leaf(t, 1)))


def _is(k: Column) -> Column:
    """1 where the rules accept a candidate as of kind `k`."""
    return F.call_function("shiftright", F.col("base"), k).bitwiseAND(F.lit(1))


def _cuts(examples: DataFrame, models: dict[int, Trees], roots: dict | None = None) -> dict:
    """{(kind, side): (feature, cut, low, high)}: the best cut of each node by the usual second-order gain, and its leaves.

    Every observed value is a cut. Nodes are the two sides of `roots`' cuts, or
    the roots themselves (side 0). Without a cut that gains all rows are below.
    """
    import numpy as np

    m, x, n = F.col("m"), F.col("x"), F.col("n")
    units = lambda c: F.round(c * GRAIN).cast("long") * n
    side = F.when(F.get(x, m["f"]) <= m["cut"], 0).otherwise(1)
    sums = let(1 / (1 + F.exp(-_margin(m, x))), lambda p: F.struct(units(p - _is(m["k"])).alias("g"), units(p * (1 - p)).alias("h")))
    each = examples.where(~F.col("held")).withColumn("m", F.explode(_models(models, roots))).select("m.k", "m.hidden", side.alias("side"), sums.alias("e"), "x")
    values = each.select("k", "hidden", "side", "e.*", F.posexplode("x").alias("j", "value")).where(~F.array_contains("hidden", F.col("j")))
    sums = values.groupBy("k", "side", "j", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    k, side, j, value, g, h = (sums.column(c).to_numpy() for c in sums.column_names)
    order = np.lexsort((value, j, side, k))
    k, side, j, value, g, h = (c[order] for c in (k, side, j, value, g, h))
    cuts = {}
    for node in sorted({*zip(k.tolist(), side.tolist())}):
        rows = (k == node[0]) & (side == node[1])
        best, all_g, all_h = (1e-9, *ONE_LEAF[:2], None), 0.0, 0.0
        for feature in np.unique(j[rows]).tolist():
            own = rows & (j == feature)
            gs, hs = np.cumsum(g[own]) / GRAIN, np.cumsum(h[own]) / GRAIN
            all_g, all_h = gs[-1], hs[-1]
            gain = (gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1))[:-1]
            if len(gain) and gain.max() > best[0]:
                i = int(np.argmax(gain))
                best = (float(gain[i]), feature, int(value[own][i]), (gs[i], hs[i]))
        low_g, low_h = best[3] or (all_g, all_h)
        cuts[node] = (best[1], best[2], float(-RATE * low_g / (low_h + 1)), float(-RATE * (all_g - low_g) / (all_h - low_h + 1)))
    return cuts


def _thresholds(examples: DataFrame, models: dict[int, Trees]) -> dict[int, float]:
    """The highest score of each kind that keeps RECALL of the held-out positives, where it reaches TARGET.

    Rows are summed by score first, so a row for each distinct score meets in the window.
    """
    m, n = F.col("m"), F.col("n")
    each = examples.where("held").withColumn("m", F.explode(_models(models))).select("m.k", "n", _margin(m, F.col("x")).alias("score"), (_is(m["k"]) * n).alias("hits"))
    scores = each.groupBy("k", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    down, whole = W.partitionBy("k").orderBy(F.desc("score")), W.partitionBy("k")
    passing = scores.select("k", "score", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits"), F.sum("hits").over(whole).alias("all"))
    first = passing.where(F.col("hits") >= F.ceil(RECALL * F.col("all"))).groupBy("k").agg(F.max_by(F.struct("score", "n", "hits"), "score").alias("c")).select("k", "c.*")
    return {r.k: r.score for r in first.collect() if r.hits >= TARGET * r.n}


def fit(found: DataFrame) -> dict[int, Trees]:
    """Trees for each kind that has enough candidates, from a table of `candidates`.

    Newton boosting on logistic loss over all distinct candidates. A kind has
    none where examples are too few or no threshold has both RECALL and TARGET.
    """
    examples = scratch(_examples(found), "pii_examples")
    counts = {r.held: r for r in examples.groupBy("held").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), *(F.sum(_is(F.lit(k)) * F.col("n")).alias(f"k{k}") for k in range(len(KINDS)))).collect()}
    if sum(r.rows for r in counts.values()) <= SINGLE:
        examples = examples.coalesce(1)
    models = {}
    for k in range(len(KINDS)) if len(counts) == 2 else ():
        n, hits = counts[False]["n"], counts[False][f"k{k}"]
        if min(hits, n - hits, counts[True][f"k{k}"]) >= LEAST:
            models[k] = Trees(math.log(hits / (n - hits)), (), 0.0)
    for _ in range(ROUNDS if models else 0):
        roots = _cuts(examples, models)
        sides = _cuts(examples, models, roots)
        models = {k: replace(m, trees=(*m.trees, (*roots[k, 0][:2], sides.get((k, 0), ONE_LEAF), sides.get((k, 1), ONE_LEAF)))) for k, m in models.items()}
    # A little below, as column expressions may add the leaves in another order.
    return {k: replace(models[k], threshold=cut - 1e-9) for k, cut in sorted(_thresholds(examples, models).items())} if models else {}


def added_spans(found: Column, base: Column, models: dict[int, Trees]) -> Column:
    """Candidates whose score passes the threshold of their kind.

    Those that touch a base span say nothing new; of candidates that overlap
    the longest stays, the first of equally long ones.
    """
    none = F.array().cast(f"array<{SPAN}>")
    if not models:
        return none
    near = 2 * GROUPS * GROUPS  # candidates that can overlap a given one lie as close in order of their starts

    def passed(c: Column) -> Column:
        kinds = []
        for k, model in models.items():
            may = (c["f"]["number"] == 0) if k == 0 else (c["f"]["number"] == 1) & c["f"]["digits"].between(*SIZES[k])
            span = F.struct((c["start"] - c["lead"] if k == 3 else c["start"]).alias("start"), F.lit(k).alias("kind"), c["stop"].alias("stop"))
            kinds.append(F.when(may & (model.score(c["f"]) >= model.threshold), span))
        return F.coalesce(*kinds)

    def free(s: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    def best(spans: Column) -> Column:
        def beaten(s: Column, i: Column) -> Column:
            size = lambda x: x["stop"] - x["start"]
            others = F.slice(spans, F.greatest(F.lit(1), i + 1 - near), 2 * near + 1)
            return F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]) & ((size(o) > size(s)) | (size(o) == size(s)) & (o < s)))

        return F.filter(spans, lambda s, i: ~beaten(s, i))

    kept = F.filter(F.transform(F.filter(found, lambda c: c["base"] == 0), passed), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, let(F.array_sort(F.filter(kept, free)), best)).otherwise(none).cast(f"array<{SPAN}>")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _found(text: Column) -> Column:
    """(base, candidates) of a text, which is worked out once."""
    def of(t: Column) -> Column:
        return let(base_spans(t), lambda base: F.struct(base.alias("base"), candidates(t, base).alias("candidates")))

    return let(text, of)


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: counts, digest of the base spans and all spans.

    Null texts count as empty; empty ones have no spans. Repeated rows and null
    doc_ids keep a row each, an empty table gives none, and other columns are
    not read. `spans` lists base and added spans by start, then kind.
    """
    found = scratch(docs.select("doc_id", _found(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*"), "pii")
    models = fit(found)
    every = F.array_sort(F.array_distinct(F.concat("base", added_spans(F.col("candidates"), F.col("base"), models))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap joined: only starts that no earlier span covers begin one."""
    def walk(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] < last["stop"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), walk)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in brackets.

    Rows, other columns and null texts stay as they are. Spans that overlap are
    replaced as one, under the kind of the first.
    """
    own = unused("__found__", docs)
    # Written once, with the texts, so that no span is looked for twice.
    found = scratch(docs.withColumn(own, _found(F.coalesce("text", F.lit("")))), "pii_redact")
    base, proposed = F.col(own)["base"], F.col(own)["candidates"]
    models = fit(found.select(proposed.alias("candidates")))
    text = F.col("text")
    spans = F.array_sort(F.array_distinct(F.concat(base, added_spans(proposed, base, models))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuilt(m: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            since = F.when(i == 0, 0).otherwise(F.get(m, i - 1)["stop"])
            return F.concat(F.substring(text, since + 1, s["start"] - since), F.get(names, s["kind"]))

        rest = F.element_at(m, -1)["stop"]
        return F.concat(F.array_join(F.transform(m, part), ""), F.substring(text, rest + 1, F.char_length(text) - rest))

    clean = let(_merged(spans), lambda m: F.when(F.size(m) == 0, F.col("text")).otherwise(rebuilt(m)))
    return found.withColumn("text", clean).drop(own)
