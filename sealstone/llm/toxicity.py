"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the sets of its words, word pairs and skip-grams (two
words with one between), hashed into 2**BITS weights. FTRL-proximal keeps a
rate for each coordinate, and its L1 term leaves most weights at exactly zero,
so the model that executors get is a short list of (index, weight).

Only rows whose label may be learnt (see `held_out`) reach training, and of
those the SAMPLE first by hash. A bias is learnt like any other weight. The score is calibrated on a part of the sample
that training did not see (Platt scaling), so that 0.7 means what it says.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

BITS = 20
SAMPLE = 24_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
#: Weight of the belief that margins need no stretching, in held rows.
PRIOR = 4.0
THRESHOLD = 0.7
#: Characters cut from both ends of a word.
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"
CACHE_ENTRIES = 500_000
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

_HASHES: dict[bytes, int] = {}


def features(text: str):
    """Indexes of the features of a whole text, each once (numpy array, sorted)."""
    import numpy as np
    import xxhash

    if len(_HASHES) > CACHE_ENTRIES:
        _HASHES.clear()
    words, known = text.lower().encode().split(), _HASHES.get
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w.strip(EDGES), 7)
        hashes[i] = h
    mix = lambda a, b, k: (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    parts = [hashes >> np.uint64(64 - BITS), mix(hashes[:-1], hashes[1:], 1), mix(hashes[:-2], hashes[2:], 2)]
    return np.unique(np.concatenate(parts)).astype(np.int64)


def train(rows: list) -> tuple[dict[int, float], float, tuple[float, float]]:
    """(weights, bias, calibration) from (indexes, label) pairs in a fixed order.

    Every tenth row is kept for calibration. Without rows of both labels all
    scores are the share of label 1.
    """
    import numpy as np

    held, kept = rows[::10], [r for i, r in enumerate(rows) if i % 10]
    ones = sum(label for _, label in kept)
    if not kept or ones in (0, len(kept)):
        rate = (ones + 1) / (len(kept) + 2)
        return {}, 0.0, (0.0, math.log(rate / (1 - rate)))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for indexes, label in kept:
            at = np.append(indexes, size - 1)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            margin = min(30.0, max(-30.0, float(w.sum())))
            g = 1 / (1 + math.exp(-margin)) - label
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    bias, w = float(w[-1]), w[:-1]
    model = {int(i): float(w[i]) for i in np.flatnonzero(w)}
    margins = np.array([w[i].sum() + bias for i, _ in held])
    return model, bias, _platt(margins, np.array([float(y) for _, y in held]))


def _platt(margins, y) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through held margins, by damped Newton steps.

    A prior holds the slope near 1, as margins that part both labels would
    stretch it without end.
    """
    import numpy as np

    if len(y) == 0 or y.sum() in (0, len(y)):
        return 1.0, 0.0
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-4)
        grad = np.array([(d * margins).sum() + PRIOR * (a - 1), d.sum() + 0.1 * PRIOR * b])
        hess = np.array([[(h * margins**2).sum() + PRIOR, (h * margins).sum()], [(h * margins).sum(), h.sum() + 0.1 * PRIOR]])
        step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return min(max(float(a), 0.1), 3.0), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows whose label may not be learnt: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float, tuple[float, float]]:
    """Train on the SAMPLE first rows by hash of those that may be learnt.

    Labels are narrow, so the sample is drawn from them; its size has a fixed
    bound and it is broadcast, so no text is shuffled. A doc_id with two labels
    counts with the higher one; of rows that share a doc_id the one whose
    features have the least hash is learnt, so SAMPLE rows reach the driver
    however often an id repeats.
    """
    import numpy as np

    ship(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        least: dict[int, tuple] = {}
        for batch in batches:
            for i, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                x = features(text or "").astype("<i4").tobytes()
                row = (xxhash.xxh128_digest(x), x, int(toxic > 0))
                if i not in least or row < least[i]:
                    least[i] = row
        kept = [(i, *row) for i, row in least.items()]
        for at in range(0, len(kept), 1000):
            columns = zip(zip(*kept[at : at + 1000]), (pa.int64(), pa.binary(), pa.binary(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["doc_id", "k", "x", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id")
    rows = texts.select("doc_id", "text", "toxic").mapInArrow(hashed, "doc_id bigint, k binary, x binary, toxic int")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("k", "x", "toxic")).alias("r")).select("doc_id", "r.x", "r.toxic")
    # One buffer for all rows: as many small arrays would stay with the driver's allocator after they are freed.
    got, flat = [], bytearray()
    for r in rows.toLocalIterator():
        got.append((_mixed(r.doc_id), r.doc_id, len(flat), len(r.x), r.toxic))
        flat += r.x
    got.sort()
    return train([(np.frombuffer(flat, "<i4", size // 4, at).astype(np.int32, copy=False), y) for _, _, at, size, y in got])


def _mixed(doc_id: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id), 3)


def _scorer(docs: DataFrame, labels: DataFrame):
    """The learnt model as a function of a column of texts; executors get the few weights that L1 leaves."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))  # at most 2**BITS weights

    def scores() -> Callable:
        import numpy as np

        sparse, bias, (slope, offset) = model.value
        w = np.zeros(1 << BITS, np.float32)
        w[list(sparse)] = list(sparse.values())

        def of(texts):
            margins = np.array([w[features(t.as_py() or "")].sum(dtype=np.float64) + bias for t in texts])
            return 1 / (1 + np.exp(-np.clip(slope * margins + offset, -60, 60)))

        return of

    return scores


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of `docs`.

    Null texts count as empty and get the score of no features. A null doc_id
    is not held out (it has no label either). Repeated rows keep a row each, an
    empty table gives none. Of `docs` only doc_id and text are read.
    """
    scores = _scorer(docs, labels)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of = scores()
        for batch in batches:
            p = of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("h")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that `score` predicts to be toxic, all columns kept.

    Rows of null or empty texts get the score of no features; repeated rows are
    judged alike; an empty table stays empty.
    """
    scores, place = _scorer(docs, labels), docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = scores()
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(place)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
