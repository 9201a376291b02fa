"""Benchmark decontamination by winnowed word fingerprints (native columns).

A benchmark item of 13 or more words has every run of 13 consecutive words as
a window; a shorter item, if it has any word, is one window. A document word
that lies inside an occurrence of any window is hit.

Winnowing: every position starts a K-word gram, and of every SPAN adjacent
grams the one of least hash is kept. K + SPAN - 1 = 13, so two texts that
share 13 words keep a common gram inside them: none can be missed. Kept grams
of documents are joined with kept grams of items and each match is extended by
the words beside it, so what is reported is exact. K is as large as it may be
while grams still thin out, since an eight-word gram that is in a document and
in an item is seldom common. Grams of one item with equal surroundings are one
row, so a word that repeats a thousand times makes some two dozen.

Items of under 13 words aren't covered by that guarantee. They are anchored on
their longest gram of 8, 4, 2 or 1 words, the most that fit, which documents look
up at every position; lengths that no item has cost nothing.

Most grams of a corpus are in no benchmark. A bitmap over the hashes of the
benchmark's grams is tested inside the scan, so documents are read once and just
the few grams that pass leave the scan with the words around them. It has 16 to
32 bits a gram, up to 2**MOST_BITS; a benchmark that fills it up only makes more
grams leave the scan, as the join decides in any case.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, scratch, unused

WINDOW = 13
K = 8
SPAN = WINDOW - K + 1
#: Words of a short item's anchor, the most that fit.
ANCHORS = (8, 4, 2, 1)
LEAST_BITS, MOST_BITS = 12, 24
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A document is contaminated where 20 * n_hit >= n_words.
RATIO = 20


def words(text: Column) -> Column:
    """Words of a whole text, A-Z in lower case; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def _grams(w: Column, k: int = K) -> Column:
    """Hash of the gram of `k` words at each position (the last k - 1 are never used)."""
    words_hashed = F.transform(w, lambda x: F.xxhash64(x))
    return words_hashed if k == 1 else let(words_hashed, lambda x: F.transform(x, lambda _, i: F.xxhash64(*(F.get(x, i + j) for j in range(k)))))


def _kept(h: Column, i: Column, n: Column) -> Column:
    """Whether the gram at `i` has the least hash of some SPAN grams in a row."""
    starts = F.sequence(F.greatest(F.lit(0), i - SPAN + 1), F.least(i, n - WINDOW))
    return F.exists(starts, lambda s: F.get(h, i) == F.array_min(F.slice(h, s + 1, SPAN)))


def _left(w: Column, i: Column) -> Column:
    """The words before `i`, nearest first."""
    low = F.greatest(F.lit(0), i - WINDOW + 1)
    return F.reverse(F.slice(w, low + 1, i - low))


def _right(w: Column, i: Column, anchor: int) -> Column:
    return F.slice(w, i + anchor + 1, WINDOW - 1)


def item_fingerprints(benchmark: DataFrame) -> list[tuple[int, bool, DataFrame]]:
    """(words of a gram, whether documents need look up winnowed grams only, rows (item_id, h, i)) of long items and of each length of anchor."""
    w = words(F.col("text"))
    items = scratch(benchmark.select("item_id", w.alias("w")).where(F.size("w") > 0), "items")

    def around(i: Column, k: int) -> Column:
        return F.struct(_left(F.col("w"), i).alias("left"), _right(F.col("w"), i, k).alias("right"))

    def winnowed(h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size("w") - K), lambda i: _kept(h, i, F.size("w")))
        return F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), around(i, K).alias("i")))

    def anchored(k: int):
        def of(h: Column) -> Column:
            size = lambda i: F.char_length(F.array_join(F.slice("w", i + 1, k), ""))
            best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(size(i).alias("len"), (-i).alias("at"))))
            return let(-best["at"], lambda i: F.array(F.struct(F.get(h, i).alias("h"), around(i, k).alias("i"))))

        return of

    out = [(K, True, F.size("w") >= WINDOW, winnowed)]
    bounds = (WINDOW, *ANCHORS)
    out += [(k, False, (F.size("w") >= k) & (F.size("w") < below), anchored(k)) for below, k in zip(bounds, ANCHORS)]
    made = []
    for k, kept, chosen, of in out:
        rows = items.where(chosen).select("item_id", F.explode(let(_grams(F.col("w"), k), of)).alias("g"))
        made.append((k, kept, scratch(rows.select("item_id", "g.h", "g.i").distinct(), "item_grams")))
    return made


def _bitmap(grams: DataFrame) -> Column | None:
    """Bitmap over the hashes as a constant array of longs, a power of two of them; None if there are none."""
    n = grams.count()
    if not n:
        return None
    bits = 1 << min(max(n.bit_length() + 4, LEAST_BITS), MOST_BITS)
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = (
        grams.select(F.shiftright(slot, 6).cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("k").agg(F.bit_or("b").alias("b")).collect()
    )  # at most 2**MOST_BITS / 64 rows, whatever the benchmark's size
    longs = [0] * (bits // 64)
    for r in rows:
        longs[r.k] = r.b
    return F.from_json(F.lit(json.dumps(longs)), "array<bigint>")


def _bit(h: Column, bitmap: Column) -> Column:
    slot = h.bitwiseAND(F.size(bitmap).cast("long") * 64 - 1)
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _matched(a: Column, b: Column) -> Column:
    """Length of the common prefix of two word arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, False)
    return F.when(first_off == 0, F.size(same)).otherwise(first_off.cast("int") - 1)


def _candidates(w: Column, bitmap: Column, k: int, kept: bool) -> Column:
    """Per document: grams of `k` words that may be in the benchmark, with the words around them."""
    n = F.size(w)

    def pick(h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), n - k), lambda i: _bit(F.get(h, i), bitmap))
        if kept:
            at = F.filter(at, lambda i: _kept(h, i, n))
        around = lambda i: F.struct(i.alias("at"), _left(w, i).alias("left"), _right(w, i, k).alias("right"))
        return F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), around(i).alias("d")))

    return F.when(n >= (WINDOW if kept else k), let(_grams(w, k), pick)).cast("array<struct<h:bigint,d:struct<at:int,left:array<string>,right:array<string>>>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs` with what it shares with `benchmark`.

    Returns rid (row id), doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated. Null or blank texts have no words and are clean. Repeated
    rows and null doc_ids keep a row each (`rid`). Items without words match
    nothing; items of null item_id hit words but are not listed; items that
    share an id count once. An empty benchmark leaves all documents clean, an
    empty `docs` gives no rows. Other columns of either table are not read.
    """
    return _hits(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), benchmark)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without contaminated rows, all columns kept.

    Rows are numbered in a written table first, so repeated rows and null
    doc_ids are told apart; few rows are contaminated, and they are taken out
    by an anti-join on that number.
    """
    row = unused("__row__", docs)
    numbered = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "keep_clean")
    bad = _hits(numbered.select(F.col(row).alias("rid"), F.lit(None).cast("long").alias("doc_id"), "text"), benchmark).where("contaminated")
    return numbered.join(scratch(bad.select(F.col("rid").alias(row)), "contaminated"), row, "left_anti").drop(row)


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    levels = [(f"grams{j}", *level, _bitmap(level[-1])) for j, level in enumerate(item_fingerprints(benchmark.select("item_id", "text")))]
    levels = [x for x in levels if x[-1] is not None]
    found = let(
        words(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), *(_candidates(w, bitmap, k, kept).alias(name) for name, k, kept, _, bitmap in levels)),
    )
    slim = docs.select("rid", "doc_id", found.alias("f"))
    slim = scratch(slim.select("rid", "doc_id", "f.*"), "decontaminate")

    spans = None
    for name, k, kept, prints, _ in levels:
        pairs = slim.where(F.size(name) > 0).select("rid", F.explode(name).alias("g")).select("rid", "g.*").join(prints, "h")
        left, right = _matched(F.col("d.left"), F.col("i.left")), _matched(F.col("d.right"), F.col("i.right"))
        pairs = pairs.select("rid", "item_id", F.col("d.at").alias("at"), "i", left.alias("l"), right.alias("r"))
        whole = F.col("l") + k + F.col("r") >= WINDOW if kept else (F.col("l") == F.size("i.left")) & (F.col("r") == F.size("i.right"))
        part = pairs.where(whole).select("rid", "item_id", (F.col("at") - F.col("l")).alias("lo"), (F.col("at") + k + F.col("r") - 1).alias("hi"))
        spans = part if spans is None else spans.unionAll(part)

    if spans is None:
        hits = slim.limit(0).select("rid", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        hits = spans.groupBy("rid").agg(
            F.collect_set(F.struct("lo", "hi")).alias("s"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        ).select(
            "rid",
            F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["lo"], x["hi"]))))).cast("long").alias("n_hit"),
            "items",
        )
    out = slim.select("rid", "doc_id", "n_words").join(hits, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "rid", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * RATIO >= F.col("n_words"))).alias("contaminated"),
    )
