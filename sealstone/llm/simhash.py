"""Near duplicates by SimHash and multi-index hashing.

A fingerprint has a bit for each bit position that is set in over half of the
hashes of a text's 4-word shingles. Two texts are linked if at most RADIUS of
64 bits differ, and a component holds all that links reach.

Multi-index hashing: a fingerprint is cut into segments, each with a radius of
its own, so that the radii plus one add up to more than RADIUS. Of a linked pair
some segment then differs in at most its radius. So each fingerprint is filed
under its segments' values and looks up every value in the Hamming ball of the
segment's radius around each of them; whole distances are checked on what it
finds. Of two values that differ, just one has the lowest differing bit clear:
only that side looks the other up. Wider segments serve larger tables: 21, 21
and 22 bits with radii 1, 1 and 0 while buckets hold few distinct fingerprints,
else 32 and 32 bits with radii 2 and 1; either finds every pair.

Equal fingerprints are one row from the start, so copies cost nothing. Rows come
sorted by bucket and are searched BATCH at a time, so memory does not follow the
partition. Inside a bucket pairs are checked in memory and large buckets pass on
a spanning forest of their links, never all pairs. A value that over HOT distinct
fingerprints share is split: its bucket is searched by the same method on the
bits of the other segments, which spreads it over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, unused
from .components import roots

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints up to which three segments are used: 8 to a bucket on average.
NARROW_UP_TO = 1 << 24
#: (first bit, end, radius) of the segments of small and large tables.
NARROW, WIDE = ((0, 21, 1), (21, 42, 1), (42, 64, 0)), ((0, 32, 2), (32, 64, 1))
#: Fingerprints of one segment value beyond which its bucket is split by the other bits.
HOT = 1 << 14
#: Rows searched at once; a bucket is never parted.
BATCH = 1 << 20
#: Buckets of more fingerprints are searched breadth first, smaller ones pair by pair.
SMALL = 24
CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 for one without words."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(last), CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row for each row; fp is the fingerprint as a signed long. A column __row__ goes along."""
    more = [c for c in docs.columns if c == "__row__"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
            columns = [batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64)), *(batch.column(2) for _ in more)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *more])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id bigint, fp bigint" + "".join(f", {c} bigint" for c in more))


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def _value(fp: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _filed(fp: Column, segments: tuple) -> Column:
    """Array of (j, value, exact): where a fingerprint is filed and what it looks up."""
    def segment(j: int, lo: int, hi: int, radius: int) -> Column:
        own = F.struct(F.lit(j).alias("j"), _value(fp, lo, hi).alias("value"), F.lit(True).alias("exact"))
        if not radius:
            return F.array(own)
        masks = F.array(*(F.lit(m).cast("long") for m in _ball(hi - lo, radius)))
        looked_up = F.filter(masks, lambda m: _value(fp, lo, hi).bitwiseAND(m.bitwiseAND(-m)) == 0)
        other = F.transform(looked_up, lambda m: F.struct(F.lit(j).alias("j"), _value(fp, lo, hi).bitwiseXOR(m).alias("value"), F.lit(False).alias("exact")))
        return F.concat(F.array(own), other)

    return F.concat(*(segment(j, *s) for j, s in enumerate(segments)))


def _rest(fp: Column, j: Column, segments: tuple) -> Column:
    """The bits of a fingerprint without those of segment `j`, joined (at most 43 of them)."""
    out = F.lit(None).cast("long")
    for k, (lo, hi, _) in enumerate(segments):
        low = _value(fp, 0, lo) if lo else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, hi), lo) if hi < 64 else F.lit(0).cast("long")
        out = F.when(j == k, low.bitwiseOR(high)).otherwise(out)
    return out


def filed(distinct: DataFrame, segments: tuple) -> DataFrame:
    """(bucket, fp, exact) of distinct fingerprints; buckets of hot values are split by the other bits.

    Two fingerprints of a split bucket differ in at most RADIUS of the other
    bits, so some third of these (radii 1, 1, 0) brings them together again.
    """
    rows = distinct.select("fp", F.explode(_filed(F.col("fp"), segments)).alias("x")).select("fp", "x.*")
    bucket = F.col("value").bitwiseOR(F.shiftleft(F.col("j").cast("long"), 40))
    own = F.array(*(F.struct(F.lit(j).alias("j"), _value(F.col("fp"), lo, hi).alias("value")) for j, (lo, hi, _) in enumerate(segments)))
    counts = distinct.select(F.explode(own).alias("x")).groupBy("x.j", "x.value").agg(F.count("*").alias("n"))
    hot = scratch(counts.where(F.col("n") > HOT).select("j", "value", F.lit(True).alias("hot")), "hot_buckets")
    if hot.isEmpty():
        return rows.select(bucket.alias("bucket"), "fp", "exact")
    marked = rows.join(hot, ["j", "value"], "left")
    cool = marked.where("hot IS NULL").select(F.xxhash64(bucket).alias("bucket"), "fp", "exact")
    width = 64 - min(hi - lo for lo, hi, _ in segments)
    cuts = [round(width * k / 3) for k in range(4)]
    parts = tuple((lo, hi, r) for lo, hi, r in zip(cuts, cuts[1:], (1, 1, 0)))
    split = marked.where("hot").select(bucket.alias("b"), "fp", F.explode(_filed(_rest(F.col("fp"), F.col("j"), segments), parts)).alias("x"))
    # Hashed names may meet, which only adds candidates; every pair is checked whole.
    return cool.unionAll(split.select(F.xxhash64("b", "x.j", "x.value").alias("bucket"), "fp", F.lit(True).alias("exact")))


def links(bucket, fp, exact):
    """Verified links among fingerprints that share a bucket (numpy arrays in and out).

    Buckets of up to SMALL give every link; larger ones a spanning forest.
    """
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    bucket, fp, exact = bucket[order], fp[order], exact[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    useful = (sizes > 1) & np.logical_or.reduceat(exact, starts)
    small = np.repeat(useful & (sizes <= SMALL), sizes)
    found = []
    b, f, e = bucket[small], fp[small], exact[small]
    for gap in range(1, SMALL):
        same = np.flatnonzero(b[gap:] == b[:-gap]) if len(b) > gap else np.empty(0, np.int64)
        if not len(same):
            break
        same = same[e[same] | e[same + gap]]
        near = same[np.bitwise_count(f[same] ^ f[same + gap]) <= RADIUS]
        found.append(np.stack([f[near], f[near + gap]], axis=1))
    for k in np.flatnonzero(useful & (sizes > SMALL)):
        rest = np.unique(fp[starts[k] : starts[k] + sizes[k]])
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                node = queue.pop()
                near = np.bitwise_count(rest ^ node) <= RADIUS
                if near.any():
                    reached, rest = rest[near], rest[~near]
                    found.append(np.stack([np.full(len(reached), node), reached], axis=1))
                    queue.extend(reached)
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _search(batches: Iterator) -> Iterator:
    """Links among rows (bucket, fp, exact) that come sorted by bucket."""
    import numpy as np
    import pyarrow as pa

    def found(parts: list) -> Iterator:
        bucket, fp, exact = (np.concatenate(x) for x in zip(*parts))
        pairs = np.unique(np.sort(links(bucket, fp.view(np.uint64), exact), axis=1), axis=0).view(np.int64)
        for at in range(0, len(pairs), 1 << 16):
            part = pairs[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        held.append(part)
        size += len(part[0])
        cut = int(np.searchsorted(part[0], part[0][-1]))
        if size >= BATCH and (cut or len(held) > 1 and held[-2][0][-1] != part[0][0]):  # a bucket ends in or before this batch
            held[-1] = [x[:cut] for x in part]
            yield from found(held)
            held = [[x[cut:] for x in part]]
            size = len(held[0][0])
    if held:
        yield from found(held)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of (doc_id, fp)."""
    ship(prints.sparkSession)
    distinct = scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    segments = NARROW if distinct.count() <= NARROW_UP_TO else WIDE
    edges = filed(distinct, segments).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search, "u bigint, v bigint")
    reached = distinct.join(roots(edges).withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = reached.groupBy("root").agg(F.min("first").alias("component_id"))
    return reached.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for each row of `docs`.

    Null, empty and blank texts have fingerprint zero, linked like any other.
    Texts of under four words have one shingle, the words they have. Repeated
    rows keep a row each; a null doc_id is never a component's id unless all
    of the component are null (then component_id is null). An empty table
    gives no rows and other columns are not read.
    """
    prints = scratch(fingerprints(docs), "simhash")
    out = prints.join(classes(prints), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of near duplicates.

    The row of least doc_id stays (null ids last), of those the first. Rows
    are numbered in a written table, so repeated rows differ; an empty table
    stays empty.
    """
    row = unused("__row__", docs)
    numbered = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "keep_one")
    prints = scratch(fingerprints(numbered.select("doc_id", "text", F.col(row).alias("__row__"))), "keep_one_fp")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__row__")).alias("b")
    groups = prints.join(classes(prints.select(F.col("__row__").alias("doc_id"), "fp")), "fp")
    chosen = groups.groupBy("component_id").agg(least)
    return numbered.join(chosen.select(F.col("b.__row__").alias(row)), row, "left_semi").drop(row)
