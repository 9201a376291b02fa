"""Quality rules: base counts and distribution divergence (native columns).

Base rules reject texts of under MIN_WORDS words and texts of which more than
half of the words lie in 3-word windows that occur twice or more.

The rest is compared with references of its language, gathered over the whole
corpus: a histogram of character classes and one of the language's most common
short words. A text is rejected if the Jensen-Shannon distance (base 2, from 0
to 1) to either is above a threshold. Guards: no verdict on texts of under
MIN_WORDS words, which fail anyway, nor against a reference of under
MIN_REFERENCE words, nor by words in a language that has no short words parted
by white space, whose reference holds "other" words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, scratch

MIN_WORDS = 50
REPEAT_PERCENT = 50
MIN_REFERENCE = 5_000
#: Common words of a language: its COMMON most frequent words of up to COMMON_CHARS characters.
COMMON, COMMON_CHARS = 24, 5
#: Slots of the hash table of a language's common words.
SLOTS = 128
MAX_CHAR_DISTANCE = 0.35
MAX_WORD_DISTANCE = 0.47
SPACE = "[\\x20\\x09-\\x0D]+"
#: Character classes as what is left after these are cut out; lower-case letters and white space follow from the totals.
CLASSES = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "symbol": "[^#*$%&|<>]+",
    "point": "[^!\"'()+,./:;=?@\\[\\\\\\]^_`{}~-]+",
    "wide": "[\\x00-\\x7F]+",
}
CLASS_NAMES = (*CLASSES, "space", "lower")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in `w`."""
    n = F.size(w)
    grams = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda _, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.sequence(x["i"], x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, starts))

    return let(grams, covered)


def _slot(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(SLOTS))


def _slots(common: Column) -> Column:
    """The common words as a hash table: for each slot those that fall into it."""
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.filter(common, lambda x: _slot(x) == s))


def _word_bins(w: Column, common: Column, slots: Column) -> Column:
    """Counts of each common word, in their order, and of all other words.

    A word is compared with those of its slot in `_slots(common)`, mostly none.
    Sorting the bin numbers with one of each added gives the counts as
    differences of first positions.
    """
    bins = F.transform(F.filter(w, lambda x: F.array_contains(F.get(slots, _slot(x)), x)), lambda x: F.array_position(common, x))
    numbers = F.sequence(F.lit(1).cast("long"), F.lit(COMMON + 1).cast("long"))
    firsts = let(F.sort_array(F.concat(bins, numbers)), lambda p: F.transform(numbers, lambda b: F.array_position(p, b)))
    counts = let(firsts, lambda f: F.zip_with(F.slice(f, 2, COMMON), F.slice(f, 1, COMMON), lambda after, at: after - at - 1))
    return let(counts, lambda c: F.concat(c, F.array(F.size(w) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common): each language's most frequent short words over all texts, ties by word."""
    short = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: (F.char_length(x) > 0) & (F.char_length(x) <= COMMON_CHARS))
    counts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(short).alias("w")).groupBy("lang", "w").count()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "w"))
    top = counts.withColumn("r", rank).where(F.col("r") <= COMMON)
    listed = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("c"))
    return listed.select("lang", F.transform("c", lambda x: x["w"]).alias("common"))


def _distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def of(pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        m = (p + q) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (half(p) + half(q)) / 2

    a, b = total(own), total(reference)
    parts = F.zip_with(own, reference, lambda x, y: F.struct((x / a).alias("p"), (y / b).alias("q")))
    sum_ = F.aggregate(F.transform(parts, of), F.lit(0.0), lambda s, x: s + x)
    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(sum_, F.lit(0.0))))


def quality(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, js_chars, js_words (distances, null where a
    guard held), kept. Null, empty and blank texts have no words and fail.
    Rows of null lang form a language of their own; repeated rows and null
    doc_ids keep a row each; an empty table gives none; other columns are not
    read. Windows are told apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    known = scratch(common_words(docs).withColumn("slots", _slots(F.col("common"))), "common_words")  # a row a language; its size decides the join
    text, none = F.col("text"), F.array().cast("array<string>")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    left = {c: F.char_length(F.regexp_replace(text, p, "")).cast("long") for c, p in CLASSES.items()}
    measured = let(
        F.array_remove(F.split(text, SPACE), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            _word_bins(w, F.coalesce("common", none), F.coalesce("slots", F.array(none))).alias("word_bins"),
        ),
    )
    slim = docs.join(known, "lang", "left").select(
        "doc_id", "lang", F.char_length(text).cast("long").alias("chars"), measured.alias("m"), *(c.alias(k) for k, c in left.items()),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    space = F.col("chars") - F.col("m.word_chars")
    lower = F.col("m.word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0))
    slim = scratch(
        slim.select("doc_id", "lang", "m.*", F.col("symbol").alias("n_symbols"), "n_dup_lines", F.array(*CLASSES, space, lower).alias("char_bins")),
        "quality",
    )
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n)))
    references = scratch(
        slim.groupBy("lang").agg(
            sums("char_bins", len(CLASS_NAMES)).alias("char_ref"), sums("word_bins", COMMON + 1).alias("word_ref"), F.sum("n_words").alias("ref_words"),
        ),
        "references",
    )
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("ref_words") >= MIN_REFERENCE)
    n, again = F.col("n_words"), F.col("n_repeat_words")
    some_common = F.exists(F.slice("word_ref", 1, COMMON), lambda x: x > 0)
    out = slim.join(references, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < MIN_WORDS) | (100 * again > REPEAT_PERCENT * n)).alias("base_failed"),
        F.when(judged, _distance(F.col("char_bins"), F.col("char_ref"))).alias("js_chars"),
        F.when(judged & some_common, _distance(F.col("word_bins"), F.col("word_ref"))).alias("js_words"),
    )
    near = (F.coalesce("js_chars", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("js_words", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & near)
