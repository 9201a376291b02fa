"""Removal of long repeated byte strings by a run-length suffix index.

Every byte goes that lies in a LENGTH-byte string which also starts anywhere
else in the corpus. The corpus is cut so that each index stays small and no
repeat is lost:

1. A window of LENGTH bytes is owned by the gram of GRAM bytes of least hash in
   it, its anchor. Equal windows have equal anchors. Adjacent windows of one
   anchor form a piece of text (all its windows' bytes).
2. Anchors that own one piece in the whole corpus can't hold a repeat. Pieces of
   the others are taken together by anchor, equal ones once with their number.
3. Per group of anchors the texts of its pieces are indexed: suffix order,
   run-length Burrows-Wheeler transform, suffix-array samples at both ends of
   each run. Common prefixes with the neighbour in suffix order are measured at
   the samples only; streaming along the text they shrink by one for each byte
   until the next sample, which gives matching statistics for all positions. A
   window is repeated where they reach LENGTH, or if its piece occurs twice.
4. Repeated windows go back to all occurrences of their piece, overlapping ones
   are joined to spans, and spans are cut from the texts.

Anchors with over HOT distinct pieces (a line that very many documents share,
in ever different surroundings) would make one group too large. Their windows
are counted one by one by a 128-bit hash, which spreads them over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch, ship

LENGTH = 200
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bits of a sort key that hold a gram's place, so that of equal grams the first wins.
PLACE = 20
#: Windows of a text hashed at once, so few that all their grams' places fit; and bytes of piece texts indexed at once.
CHUNK = (1 << PLACE) - LENGTH
INDEX = 5 << 18
HOT = 4096
PIECES = "doc_id bigint, t bigint, n int, a bigint, s bigint, start int, windows int"


def piece_cuts(text: bytes) -> tuple:
    """(start, windows, anchor) arrays of the pieces of one chunk of text."""
    import numpy as np

    n = len(text)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none
    word = np.ndarray(n - 7, "<u8", text, strides=(1,)).astype(np.uint64)
    m = n - GRAM + 1
    h = word[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : m + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += word[16 : m + 16]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    key = (h >> np.uint64(PLACE)) << np.uint64(PLACE) | (np.arange(m, dtype=np.uint64) & np.uint64((1 << PLACE) - 1))
    least, width = key, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: m - SPAN + 1], least[SPAN - width :])
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return cut, np.diff(np.r_[cut, len(least)]), (least[cut] >> np.uint64(PLACE)).astype(np.int64)


def _cut(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    def flush(rows: list) -> pa.RecordBatch:
        ids, ts, ns, counts, starts, windows, anchors, sums = zip(*rows)
        each = lambda x, kind: pa.array(np.repeat(np.array(x, kind), counts))
        ids = pa.array([i for i, c in zip(ids, counts) for _ in range(c)], pa.int64())
        cat = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
        columns = [ids, each(ts, np.int64), each(ns, np.int32), cat(anchors, np.int64), cat(sums, np.int64), cat(starts, np.int32), cat(windows, np.int32)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "a", "s", "start", "windows"])

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, held = [], 0
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, scalar in enumerate(batch.column(2)):
            text = scalar.as_py() or b""
            for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
                part = text[at : at + CHUNK + LENGTH - 1]
                starts, windows, anchors = piece_cuts(part)
                if not len(starts):
                    continue
                sums = np.fromiter((digest(part[a : a + w + LENGTH - 1]) for a, w in zip(starts.tolist(), windows.tolist())), np.uint64, len(starts)).view(np.int64)
                rows.append((ids[i], keys[i], len(text), len(starts), starts + at, windows, anchors, sums))
                held += len(starts)
            if held > 100_000:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)


# --- the index -----------------------------------------------------------------------------------


def suffix_order(symbols, ends):
    """(order, rank) of all suffixes; `ends` has for each place the separator that ends its string.

    Separators are smaller than bytes and ordered by place. Prefix doubling
    from seven symbols on; only suffixes that still tie are sorted again.
    """
    import numpy as np

    n = len(symbols)
    place = np.arange(n)
    key, alive = symbols.astype(np.int64), np.ones(n, bool)
    for j in range(1, 7):
        alive = alive & (place + j <= ends)
        nxt = np.zeros(n, np.int64)
        nxt[: n - j] = symbols[j:]
        key = (key << 9) | np.where(alive, nxt, 0)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    new |= symbols[order] == 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    width = 7
    while True:
        tied = ~(new & np.r_[new[1:], True])
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, rank
        mine = order[slots]
        second = rank[np.minimum(mine + width, ends[mine])]
        combined = rank[mine] * np.int64(n + 1) + second
        by = np.argsort(combined, kind="stable")
        mine, combined = mine[by], combined[by]
        order[slots] = mine
        new[slots] = np.r_[True, combined[1:] != combined[:-1]]
        rank[mine] = np.maximum.accumulate(np.where(new, place, 0))[slots]
        width *= 2


def _common(text, ends, p, q):
    """Lengths of the common prefixes of suffixes p and q, up to their strings' ends."""
    import numpy as np

    most = np.minimum(ends[p] - p, ends[q] - q)
    length = np.zeros(len(p), np.int64)
    word = np.ndarray(len(text) - 7, "<u8", text.tobytes(), strides=(1,))
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        x = word[p[open_] + length[open_]] ^ word[q[open_] + length[open_]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64) >> 3)
        length[open_] += same
        open_ = open_[(same == 8) & (length[open_] < most[open_])]
    return np.minimum(length, most)


def matching_statistics(strings: list[bytes]):
    """Per place of the strings' concatenation (a separator after each): the
    length of its longest prefix that also starts at another place; and the runs' number."""
    import numpy as np

    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\0".join(strings) + b"\0" + bytes(8), np.uint8)
    n = int(sizes.sum()) + len(strings)
    stop = np.cumsum(sizes + 1) - 1
    ends = np.repeat(stop, sizes + 1)
    symbols = text[:n].astype(np.int16) + 1
    symbols[stop] = 0
    order, _ = suffix_order(symbols, ends)
    last = symbols[order - 1]  # the transform; of separators each is a symbol of its own
    change = np.r_[True, (last[1:] != last[:-1]) | (last[1:] == 0)]
    first = np.flatnonzero(change)
    place = np.arange(n)

    def streamed(samples, partners):
        """Values at sampled places, one less for each place behind them."""
        value = np.zeros(n, np.int64)
        reach = np.full(n, -1)
        value[samples] = _common(text, ends, samples, partners)
        reach[samples] = samples
        reach = np.maximum.accumulate(reach)
        return np.where(reach >= 0, value[reach] - (place - reach), 0)

    heads, tails = first[first > 0], np.r_[first[1:] - 1, n - 1]
    tails = tails[tails < n - 1]
    before = streamed(np.r_[order[heads], order[0]], np.r_[order[heads - 1], stop[-1]])
    behind = streamed(np.r_[order[tails], order[-1]], np.r_[order[tails + 1], stop[-1]])
    return np.maximum(np.maximum(before, behind), 0), len(first)


def repeated_windows(pieces: list[tuple[bytes, int]]) -> list[list[tuple[int, int]]]:
    """For each distinct piece (text, number of occurrences) its runs of repeated windows (first, last)."""
    import numpy as np

    stats, _ = matching_statistics([p for p, _ in pieces])
    out, at = [], 0
    for text, count in pieces:
        windows = len(text) - LENGTH + 1
        if count > 1:
            out.append([(0, windows - 1)])
        else:
            hit = np.r_[False, stats[at : at + windows] >= LENGTH, False]
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            out.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])])
        at += len(text) + 1
    return out


def _indexed(batches: Iterator) -> Iterator:
    """Rows (a, s, count, text) in order of a: an index for every INDEX bytes or so, never parting an anchor."""
    import pyarrow as pa

    def flush(group: dict) -> pa.RecordBatch:
        keys = list(group)
        found = [(*k, lo, hi) for k, runs in zip(keys, repeated_windows([group[k] for k in keys])) for lo, hi in runs]
        columns = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "s", "lo", "hi"],
        )

    group, held, anchor = {}, 0, None
    for batch in batches:
        for a, s, count, text in zip(*(c.to_pylist() for c in batch.columns)):
            if a != anchor and held >= INDEX:
                yield flush(group)
                group, held = {}, 0
            anchor = a
            if (a, s) not in group:
                group[a, s] = (text, count)
                held += len(text) + 1
    if group:
        yield flush(group)


def _hot_windows(batches: Iterator) -> Iterator:
    """(a, s, at, count, h, g): each window of pieces of hot anchors, with its hash."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for a, s, count, text in zip(*(c.to_pylist() for c in batch.columns)):
            sums = [xxhash.xxh3_128_intdigest(text[i : i + LENGTH]) for i in range(len(text) - LENGTH + 1)]
            k = len(sums)
            half = (1 << 64) - 1
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            columns = [pa.array([a] * k, pa.int64()), pa.array([s] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([count] * k, pa.int64()),
                       pa.array([signed(x & half) for x in sums], pa.int64()), pa.array([signed(x >> 64) for x in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "s", "at", "count", "h", "g"])


def _texts(batches: Iterator) -> Iterator:
    """(a, s, count, text) of the pieces asked of each text."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        rows = []
        for text, asked in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            text = text.as_py() or b""
            rows += [(x["a"], x["s"], x["count"], text[x["start"] : x["start"] + x["windows"] + LENGTH - 1]) for x in asked.as_py()]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["a", "s", "count", "text"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["a", "s", "count", "text"])


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans (first, end) in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _kept(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            text = text.as_py() or b""
            cuts = merged([(x["lo"], x["hi"]) for x in spans.as_py() or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in cuts:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest()))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _same(x: DataFrame, y: DataFrame):
    return x.doc_id.eqNullSafe(y.y_id) & (x.t == y.y_t) & (x.n == y.y_n)


def repeats(keyed: DataFrame) -> DataFrame:
    """(doc_id, t, n, spans): texts of `keyed` (doc_id, t, n, text) that hold repeats, and where; ends exclusive.

    A text is named by doc_id, 64-bit hash and length, so rows that agree in
    all three are taken for equal (their spans are equal then).
    """
    spark = keyed.sparkSession
    ship(spark)
    pieces = scratch(keyed.select("doc_id", "t", F.col("text").cast("binary").alias("text")).mapInArrow(_cut, PIECES), "pieces")
    # Written first, so that the join's sides are plain exchanges and a hot anchor's partition can be split.
    shared = scratch(pieces.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "shared_anchors")
    some = scratch(pieces.join(shared, "a", "left_semi"), "shared_pieces")
    drop_scratch(pieces)
    one = F.min(F.struct("doc_id", "t", "n", "start", "windows")).alias("r")
    distinct = scratch(some.groupBy("a", "s").agg(F.count("*").alias("count"), one), "distinct_pieces")
    hot = scratch(distinct.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("a", F.lit(True).alias("hot")), "hot_anchors")
    asked = distinct.groupBy(F.col("r.doc_id").alias("y_id"), F.col("r.t").alias("y_t"), F.col("r.n").alias("y_n")).agg(
        F.collect_list(F.struct("a", "s", "count", F.col("r.start").alias("start"), F.col("r.windows").alias("windows"))).alias("asked")
    )
    texts = keyed.join(asked, _same(keyed, asked)).select("text", "asked").mapInArrow(_texts, "a bigint, s bigint, count bigint, text binary")
    if hot.isEmpty():
        found = texts.repartition("a").sortWithinPartitions("a").mapInArrow(_indexed, "a bigint, s bigint, lo int, hi int")
    else:
        marked = scratch(texts.join(hot, "a", "left"), "piece_texts")
        cool = marked.where("hot IS NULL").drop("hot")
        found = cool.repartition("a").sortWithinPartitions("a").mapInArrow(_indexed, "a bigint, s bigint, lo int, hi int")
        windows = marked.where("hot").drop("hot").mapInArrow(_hot_windows, "a bigint, s bigint, at int, count bigint, h bigint, g bigint").distinct()
        windows = scratch(windows, "hot_windows")
        twice = windows.groupBy("h", "g").agg(F.sum("count").alias("total")).where("total > 1").select("h", "g")
        found = found.unionAll(windows.join(twice, ["h", "g"], "left_semi").select("a", "s", F.col("at").alias("lo"), F.col("at").alias("hi")))
    runs = scratch(found.groupBy("a", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "repeated_windows")
    spot = F.struct((F.col("start") + F.col("x.lo")).alias("lo"), (F.col("start") + F.col("x.hi") + LENGTH).alias("hi"))
    placed = some.join(runs, ["a", "s"]).select("doc_id", "t", "n", "start", F.explode("runs").alias("x")).select("doc_id", "t", "n", spot.alias("x"))
    return scratch(placed.groupBy("doc_id", "t", "n").agg(F.collect_set("x").alias("spans")), "repeats")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of `docs`.

    Null texts count as empty; texts of under LENGTH bytes lose nothing. All
    copies of a repeat go, first ones too. Repeated rows are texts of their
    own, so a repeated row of LENGTH bytes or more is removed whole; null
    doc_ids keep a row each. An empty table gives no rows; other columns are
    not read.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("n"), text.alias("text"))
    spans = repeats(keyed).select(F.col("doc_id").alias("y_id"), F.col("t").alias("y_t"), F.col("n").alias("y_n"), "spans")
    out = keyed.join(spans, _same(keyed, spans), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
