"""Duplicates: equal digests, and hashes within a Hamming radius by multi-index look-ups.

Equal hashes are one class from the start, named by its least id; only classes
are compared, so a hash that repeats costs its rows once. Classes within a
radius meet in an equi-join: the hash is cut into segments with radii of their
own that, plus one each, add up to more than the radius, so two hashes within it
agree in some segment up to that segment's radius. One side is filed under its
segments, the other looks up the Hamming ball around each of its own. How many
segments is chosen from the number of hashes (`segments`).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of ids in which a digest's rows are counted apart, so that a common digest is many tasks.
RANGES = 64
#: Most look-ups of a hash, whatever the number of hashes.
MOST_LOOKUPS = 20_000
#: Hashes that a history may list for a comparison row by row.
MOST_LISTED = 500


def exact_groups(df: DataFrame, digest: str = "sha256") -> DataFrame:
    """(digest, n, first_id) of digests that occur more than once."""
    return df.groupBy(digest).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def first_duplicates(df: DataFrame, digest: str = "sha256") -> DataFrame:
    """(id, first_id, reference of the first) for each row but the first of its digest."""
    firsts = df.groupBy(digest).agg(F.min(F.struct("id", "reference")).alias("first"))
    joined = df.select("id", digest).join(firsts, digest).where(F.col("id") > F.col("first.id"))
    return joined.select("id", F.col("first.id").alias("first_id"), F.col("first.reference").alias("first_reference"))


def earliest_matches(df: DataFrame, k: int = 5, digest: str = "sha256") -> DataFrame:
    """(digest, rank, id): the k first ids of each repeated digest."""
    w = W.partitionBy(digest)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy("id"))).where(F.col("rank") <= k)
    return ranked.join(exact_groups(df, digest).select(digest), digest, "left_semi").select(digest, "rank", "id")


def prior_counts(df: DataFrame, digest: str = "sha256") -> DataFrame:
    """(id, earlier): how many earlier rows have the same digest; each row sees only the past.

    Rows are counted in ranges of ids first, so rows of one digest are spread.
    """
    cuts = sorted(set(df.approxQuantile("id", [i / RANGES for i in range(1, RANGES)], 0.01)))  # RANGES numbers at most
    part = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    rows = df.select("id", digest, part.alias("part"))
    upto = W.partitionBy(digest).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(digest, "part").agg(F.count("*").alias("n")).select(F.col(digest).alias("d"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy(digest, "part").orderBy("id")) - 1
    counted = rows.withColumn("own", own).join(before, F.col(digest).eqNullSafe(F.col("d")) & (F.col("part") == F.col("p")))
    return counted.select("id", (F.col("own") + F.col("before")).cast("long").alias("earlier"))


def segments(bits: int, radius: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, end, radius) of segments that find every pair within `radius`, at the least expected work for `n` hashes.

    A row costs its look-ups and, for each, the hashes that a bucket holds if they are spread evenly.
    """
    best = None
    for s in range(1, min(radius + 1, bits) + 1):
        cuts, more = [round(bits * j / s) for j in range(s + 1)], radius + 1 - s
        # Of a wider segment its first 62 bits do: they differ in no more bits than all of it.
        parts = [(lo, min(hi, lo + 62), more // s + (j < more % s)) for j, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        lookups = [sum(comb(hi - lo, k) for k in range(r + 1)) for lo, hi, r in parts]
        work = sum(x * (1 + n / 2 ** (hi - lo)) for x, (lo, hi, _) in zip(lookups, parts))
        if (sum(lookups) <= MOST_LOOKUPS or s == min(radius + 1, bits)) and (best is None or work < best[0]):
            best = (work, parts)
    return best[1]


def _value(words: list[Column], lo: int, hi: int) -> Column:
    """Bits lo..hi (under 64 of them) of a hash of 64-bit words, as a long."""
    value, at = F.lit(0).cast("long"), 0
    for w, word in enumerate(words):
        a, b = max(lo, w * 64), min(hi, (w + 1) * 64)
        if a < b:
            part = F.shiftrightunsigned(word, a - w * 64)
            part = part if b - a == 64 else part.bitwiseAND(F.lit((1 << (b - a)) - 1))
            value = value.bitwiseOR(F.shiftleft(part, at))
            at += b - a
    return value


def around(value: Column, width: int, radius: int) -> Column:
    """All values of `width` bits that differ from `value` in at most `radius` of them."""
    masks = F.array(*(F.lit(sum(1 << b for b in bits)).cast("long") for r in range(radius + 1) for bits in combinations(range(width), r)))
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _struct(j: int):
    return lambda v: F.struct(F.lit(j).alias("j"), v.alias("v"))


def hash_classes(df: DataFrame, words: list[str]) -> DataFrame:
    """(words, first_id, members) for each distinct hash; rows without one belong to none."""
    known = df.where(" AND ".join(f"{w} IS NOT NULL" for w in words))
    return known.groupBy(*words).agg(F.min("id").alias("first_id"), F.count("*").alias("members"))


def _meetings(asking: DataFrame, filed: DataFrame, words: list[str], radius: int, n: int) -> DataFrame:
    """(q_id, a_id, distance): for each hash of `asking` (words, id) all others of `filed` (words, id) within the radius, each once.

    A pair meets in each segment that it agrees in; only the first such counts, so no shuffle has to tell repeats apart.
    """
    parts = segments(64 * len(words), radius, n)
    own = [F.col(w) for w in words]
    file = F.array(*(F.struct(F.lit(j).alias("j"), _value(own, lo, hi).alias("v")) for j, (lo, hi, _) in enumerate(parts)))
    look = F.concat(*(F.transform(around(_value(own, lo, hi), hi - lo, r), _struct(j)) for j, (lo, hi, r) in enumerate(parts)))
    a = filed.select(F.col("id").alias("a_id"), *(F.col(w).alias(f"a_{w}") for w in words), F.explode(file).alias("x")).select("*", "x.*").drop("x")
    q = asking.select(F.col("id").alias("q_id"), *words, F.explode(look).alias("x")).select("*", "x.*").drop("x")
    apart = [F.col(w).bitwiseXOR(F.col(f"a_{w}")) for w in words]
    total = sum((F.bit_count(x) for x in apart), F.lit(0))
    earlier = F.lit(False)
    for j, (lo, hi, r) in enumerate(parts):
        earlier = earlier | ((F.col("j") > j) & (F.bit_count(_value(apart, lo, hi)) <= r))
    met = q.join(a, ["j", "v"]).where((F.col("q_id") != F.col("a_id")) & (total <= radius) & ~earlier)
    return met.select("q_id", "a_id", total.cast("long").alias("distance"))


def near_pairs(df: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(a, b, distance): pairs of classes of different hashes within the radius, a < b; a class is named by its least id.

    Members of the classes are in `hash_members`; pairs of rows are the product of both, so they are not written out.
    """
    reps = hash_classes(df, words).select(*words, F.col("first_id").alias("id"))
    pairs = _meetings(reps, reps, words, radius, reps.count())
    return pairs.where("q_id > a_id").select(F.col("a_id").alias("a"), F.col("q_id").alias("b"), "distance")


def hash_members(df: DataFrame, words: list[str]) -> DataFrame:
    """(id, first_id): the class of each row that has a hash."""
    return df.join(hash_classes(df, words).select(*words, "first_id"), words).select("id", "first_id")


def nearest_prior(df: DataFrame, words: list[str], radius: int, asking: DataFrame | None = None) -> DataFrame:
    """(id, nearest_id, distance): the closest earlier row within the radius, ties to the least id; none beyond.

    A row whose hash came before is nearest to the first that had it. Only the
    first row of a class has to look at other classes, of which just the first
    rows matter. `asking` (id) limits whose nearest rows are searched.
    """
    members = hash_members(df, words) if asking is None else hash_members(df, words).join(asking.select("id"), "id", "left_semi")
    same = members.where("id > first_id").select("id", F.col("first_id").alias("nearest_id"), F.lit(0).cast("long").alias("distance"))
    reps = hash_classes(df, words).select(*words, F.col("first_id").alias("id"))
    open_ = reps.join(members.where("id = first_id").select("id"), "id", "left_semi")
    met = _meetings(open_, reps, words, radius, reps.count()).where("a_id < q_id")
    best = met.groupBy(F.col("q_id").alias("id")).agg(F.min(F.struct("distance", "a_id")).alias("m"))
    return same.unionByName(best.select("id", F.col("m.a_id").alias("nearest_id"), F.col("m.distance").alias("distance")))


def nearest_listed(df: DataFrame, listed: DataFrame, word: str, limit: int) -> DataFrame:
    """(id, nearest_hash, distance, within): for each row the nearest hash of a short list, ties to the first in the list.

    `listed` (pos, word) is a history as a client sends it along; beyond
    MOST_LISTED hashes it is an error, as every row is compared with all of them.
    """
    rows = [(r.pos, r.h) for r in listed.select("pos", F.col(word).alias("h")).where("h IS NOT NULL").orderBy("pos").limit(MOST_LISTED + 1).collect()]
    if len(rows) > MOST_LISTED:
        raise ValueError("a listed history is compared row by row; use nearest_prior")
    if not rows:
        return df.select("id", F.lit(None).cast("long").alias("nearest_hash"), F.lit(None).cast("long").alias("distance"), F.lit(None).cast("boolean").alias("within")).limit(0)
    options = F.array(*(F.struct(F.bit_count(F.col(word).bitwiseXOR(F.lit(h).cast("long"))).cast("long").alias("distance"), F.lit(pos).alias("pos"), F.lit(h).cast("long").alias("h")) for pos, h in rows))
    best = df.where(F.col(word).isNotNull()).select("id", F.array_min(options).alias("m"))
    return best.select("id", F.col("m.h").alias("nearest_hash"), F.col("m.distance").alias("distance"), (F.col("m.distance") <= limit).alias("within"))


def with_duplicates(df: DataFrame, phash: list[str], max_phash: int = 8, radius: int = 32) -> DataFrame:
    """Adds exact_duplicate, nearest_id, nearest_distance and near_duplicate as each row would have found them on arrival.

    Rows without a hash never match. The wide radius, which only reports, is
    searched for those rows alone that have no match within `max_phash`.
    """
    first = df.groupBy("sha256").agg(F.min("id").alias("first")).withColumnRenamed("sha256", "d")
    prior = df.join(first, F.col("sha256").eqNullSafe(F.col("d")), "left").select("id", (F.col("sha256").isNotNull() & (F.col("id") > F.col("first"))).alias("exact_duplicate"))
    close = nearest_prior(df, phash, max_phash)
    still = df.select("id").join(close, "id", "left_anti")
    near = close.unionByName(nearest_prior(df, phash, radius, still)).withColumnRenamed("distance", "nearest_distance")
    out = df.join(prior, "id").join(near, "id", "left")
    return out.withColumn("near_duplicate", ~F.col("exact_duplicate") & F.coalesce(F.col("nearest_distance") <= max_phash, F.lit(False)))
