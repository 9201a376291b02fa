import datetime as dt
import pickle
import random
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sealstone.config import Config, from_dict
from sealstone.operators import dedup, evaluate, layout, scores, workflow
from sealstone.sources import tables
from sealstone.streaming import reviews


def eval_rows(spark, y, s, codes=None):
    rows = [(i, a, "k", "o", float(b), (codes or {}).get(i, [])) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id long, label int, kind string, origin string, score double, codes array<string>")


def test_curves(spark):
    rows = eval_rows(spark, [0, 0, 1, 1, 0, 1], [0.1, 0.2, 0.9, 0.8, 0.3, 0.7])
    assert evaluate.pr_auc(rows).first().pr_auc == 1.0 and evaluate.roc_auc(rows).first().roc_auc == 1.0
    same = eval_rows(spark, [0, 1, 0, 1], [0.5] * 4)
    assert evaluate.roc_auc(same).first().roc_auc == 0.5
    none = eval_rows(spark, [0, 0], [0.1, 0.2])
    assert evaluate.pr_auc(none).first().pr_auc == 0.0 and evaluate.roc_auc(none).first().roc_auc == 0.0
    ties = evaluate.pr_curve(eval_rows(spark, [1, 0, 1], [0.9, 0.9, 0.1])).orderBy(F.desc("score")).first()
    assert (ties.precision, ties.recall, ties.score) == (0.5, 0.5, 0.9)
    best = evaluate.best_threshold(eval_rows(spark, [0, 0, 1, 1], [10, 20, 30, 40])).first()
    assert best.threshold == 30.0


def test_auc_equals_pairs(spark):
    rng = random.Random(5)
    y, s = [rng.randint(0, 1) for _ in range(80)], [float(rng.randint(0, 9)) for _ in range(80)]
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    assert evaluate.roc_auc(eval_rows(spark, y, s)).first().roc_auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-4)


def test_confusion(spark):
    r = evaluate.confusion(eval_rows(spark, [1, 1, 0, 0], [1.0, 0.0, 1.0, 0.0]), 0.5).first()
    assert (r.precision, r.recall, r.f1, r.fpr) == (0.5, 0.5, 0.5, 0.5)


def test_segments_find_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    words = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(8)] + base[:3] * 2
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(w), signed(words[-1 - i])) for i, w in enumerate(words)] + [(900, None, 1)], "id long, h long, g long")
    first = {i: words.index(w) for i, w in enumerate(words)}
    want = {(i, j): (words[i] ^ words[j]).bit_count() for i in set(first.values()) for j in set(first.values()) if i < j}
    for radius in (0, 3, 8):
        got = [(r.a, r.b, r.distance) for r in dedup.near_pairs(df, ["h"], radius).collect()]
        assert len(got) == len(set(got)) and {(a, b): d for a, b, d in got} == {k: d for k, d in want.items() if d <= radius}
    assert {r.id: r.first_id for r in dedup.hash_members(df, ["h"]).collect()} == first
    two = {(r.a, r.b): r.distance for r in dedup.near_pairs(df, ["h", "g"], 16).collect()}
    n = len(words)
    keys = [(words[i], words[n - 1 - i]) for i in range(n)]
    reps = sorted({keys.index(k) for k in keys})
    both = {(i, j): sum((x ^ y).bit_count() for x, y in zip(keys[i], keys[j])) for i in reps for j in reps if i < j}
    assert two == {k: d for k, d in both.items() if d <= 16}


def test_segments_add_up():
    for bits, radius in ((64, 6), (256, 8), (256, 32), (8, 8), (64, 0)):
        for n in (1, 1000, 10**6, 10**10):
            parts = dedup.segments(bits, radius, n)
            assert sum(r + 1 for _, _, r in parts) == radius + 1 and all(hi <= lo for (_, hi, _), (lo, _, _) in zip(parts, parts[1:])) and parts[-1][1] <= bits


def test_few_pairs_are_compared(spark):
    """100,000 hashes of 256 bits, one of them 10,000 times: compared pairs are a fraction of the rows."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-(1 << 63), (1 << 63) - 1, (90_000, 4))
    rows = np.concatenate([rows, np.repeat(rows[:1], 10_000, axis=0)])
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["w0", "w1", "w2", "w3"]).assign(id=range(len(rows))))
    words = ["w0", "w1", "w2", "w3"]
    reps = dedup.hash_classes(df, words).select(*words, F.col("first_id").alias("id"))
    parts = dedup.segments(256, 8, 90_000)
    compared = 0
    for lo, hi, radius in parts:
        v = dedup._value([F.col(w) for w in words], lo, hi)
        sizes = reps.groupBy(v.alias("v")).count()
        looked = reps.select(F.explode(dedup.around(v, hi - lo, radius)).alias("v")).groupBy("v").agg(F.count("*").alias("asks"))
        compared += sizes.join(looked, "v").agg(F.sum(F.col("count") * F.col("asks"))).first()[0]
    assert compared <= 12 * 90_000  # the hashes themselves among them, once for each of nine segments
    assert dedup.near_pairs(df, words, 8).count() == 0
    near = dedup.nearest_prior(df, words, 8)
    assert near.count() == 10_000 and near.select("nearest_id", "distance").distinct().collect() == [(0, 0)]


def test_prior_counts_of_a_common_digest(spark):
    rows = [(i * 3 % 5000, "same" if i % 3 else f"d{i % 40}") for i in range(4000)]
    rows = list({i: d for i, d in rows}.items()) + [(9999, None), (10_000, None)]
    seen, want = {}, {}
    for i, d in sorted(rows):
        want[i] = seen.get(d, 0)
        seen[d] = want[i] + 1
    assert {r.id: r.earlier for r in dedup.prior_counts(spark.createDataFrame(rows, "id long, sha256 string")).collect()} == want


def test_nearest_listed(spark):
    df = spark.createDataFrame([(1, 0), (2, 255), (3, None)], "id long, h long")
    listed = spark.createDataFrame([(0, 1), (1, 127), (2, 254)], "pos long, h long")
    assert [tuple(r) for r in dedup.nearest_listed(df, listed, "h", 0).orderBy("id").collect()] == [(1, 1, 1, False), (2, 127, 1, False)]
    assert dedup.nearest_listed(df, listed.limit(0), "h", 0).count() == 0


def test_duplicates_see_only_the_past(spark):
    rows = [(1, "a", "x", 0, 0), (2, "a", "y", 0, 0), (3, "b", "z", 7, 0), (4, "c", "z", 1 << 40, 255), (5, "d", None, None, None)]
    df = spark.createDataFrame(rows, "id long, sha256 string, reference string, p0 long, p1 long")
    got = {r.id: r for r in dedup.with_duplicates(df, ["p0", "p1"]).collect()}
    assert got[2].exact_duplicate and not got[2].near_duplicate and got[2].nearest_distance == 0
    assert not got[1].exact_duplicate and got[1].nearest_distance is None
    assert got[3].near_duplicate and got[3].nearest_distance == 3
    assert not got[4].near_duplicate and got[4].nearest_distance == 9
    assert got[5].nearest_distance is None


def test_training_and_scoring(spark):
    rng = random.Random(0)
    labels, long = [], []
    for i in range(120):
        y = int(rng.random() < 0.4)
        labels.append((i, y))
        long += [(i, "sig.a", rng.gauss(2.0 * y, 1)), (i, "sig.noise", rng.gauss(0, 1))]
        if i % 3:
            long.append((i, "sig.some", 1.0 * y))
    lab, feats = spark.createDataFrame(labels, "id long, label int"), spark.createDataFrame(long, "id long, feature string, value double")
    model = scores.fit_logistic(feats, lab, steps=400)
    table = scores.model_table(spark, model)
    out = scores.logistic(scores.contributions(lab.select("id"), feats, table))
    rows = out.join(lab, "id").select("id", "label", F.lit("k").alias("kind"), F.lit("o").alias("origin"), "score", F.array().cast("array<string>").alias("codes"))
    assert evaluate.roc_auc(rows).first().roc_auc >= 0.9
    far = scores.fit_logistic(feats, lab, local_cells=0)
    near = scores.fit_logistic(feats, lab, steps=30_000)
    assert far["coef"] == pytest.approx(near["coef"], rel=1e-3, abs=1e-3) and far["intercept"] == pytest.approx(near["intercept"], abs=1e-3)
    flat = {"model": "logistic", "features": ["f"], "mean": [0.0], "std": [0.0], "coef": [0.0], "intercept": 3.0}
    r = scores.logistic(scores.contributions(lab.limit(1).select("id"), feats, scores.model_table(spark, flat))).first()
    assert (r.score, r.probability, r.decision) == (95, 0.9526, "REVISAR")
    with pytest.raises(ValueError):
        scores.model_table(spark, {"model": "tree"})
    split = scores.holdout(lab).groupBy("label").agg(F.count_if("test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == round(r.n * 0.25) for r in split)


def test_workflow(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, "a", 80, "REVISAR", at), (2, "b", 80, "REVISAR", at + dt.timedelta(1)), (3, "c", 90, "REVISAR", at), (4, "d", 5, "BAIXO RISCO", at)]
    analyses = spark.createDataFrame(rows, "id long, reference string, score int, decision string, expires_at timestamp").withColumn("findings", F.array(F.struct(F.lit("blur").alias("code"))))
    events = [(1, at, 3, "confirmed_fraud", "n"), (2, at, 3, "legitimate", "n"), (3, at, 4, "confirmed_fraud", "n"), (4, at, 2, "legitimate", "n"), (5, at, 2, "pending", "n")]
    history = workflow.versions(spark.createDataFrame(events, "event_id long, ts timestamp, analysis_id long, status string, note string"))
    assert [r.id for r in workflow.queue(analyses, history).collect()] == [1, 2]
    assert workflow.queue(analyses, history, limit=0).count() == 0
    assert workflow.reversal_rate(analyses, history).first().rate == 1.0
    assert {(r.id, r.label) for r in workflow.labels(analyses, history).collect()} == {(3, 0), (4, 1)}
    out = workflow.purge(analyses, history, analyses, F.lit(at).cast("timestamp"))
    assert [r.id for r in out["analyses"].collect()] == [2] and out["hashes"].count() == 4 and out["history"].count() == 2
    for bad in (0, -1, 501):
        with pytest.raises(ValueError):
            workflow.history_page(history, 3, limit=bad)
    with pytest.raises(ValueError):
        workflow.floor(analyses, "?")
    old = spark.createDataFrame([(9, "legitimate", "n"), (8, "pending", "n")], "analysis_id long, status string, note string")
    once = workflow.migrate_legacy(history.select("analysis_id", "version", "status", "note"), old)
    assert once.where("analysis_id = 9").count() == 1 and workflow.migrate_legacy(once, old).count() == once.count()


def test_authorisation(spark):
    creds = spark.createDataFrame([("ana", "reviewer")], "subject string, role string").withColumn("token_sha256", F.sha2(F.lit("t"), 256))
    ask = spark.createDataFrame([(1, "t", "/queue"), (2, "t", "/purge"), (3, "x", "/queue"), (4, None, "/queue")], "request_id long, token string, route string")
    got = {r.request_id: r.status for r in workflow.authorise(ask, creds, {"/queue": ("reviewer", "admin"), "/purge": ("admin",)}).collect()}
    assert got == {1: 200, 2: 403, 3: 401, 4: 401}


def test_expected_json(spark):
    raws = ['{"valor": 0, "data": null, "codigo": " "}', "[]", "null", "true", '{"valor": [1]}', '{"valor": true}', '{"x": 1}', '{"pedido": "7"}', "{"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id long, raw string")
    got = {r.id: r.m for r in df.select("id", tables.expected_from_json(F.col("raw")).alias("m")).collect()}
    assert got[0] == {"valor": "0"} and got[7] == {"pedido": "7"} and all(got[i] is None for i in (1, 2, 3, 4, 5, 6, 8))
    assert tables.expected_from_pairs([" a = b ", "none", "c=d=e"]) == {"a": "b", "c": "d=e"}


def test_layout(spark):
    words = [(1, f"AB{i}", 90.0, 20.0, 100.0) for i in range(6)] + [(1, "9.250,00", 90.0, 40.0, 110.0), (2, "AB1", 90.0, 20.0, 100.0), (3, "ag", 90.0, 99.0, 1.0)]
    df = spark.createDataFrame(words, "line long, text string, conf double, height double, bottom double")
    assert [r.text for r in layout.typography(df).collect()] == ["9.250,00"]
    box = lambda x, y, w, h: F.struct(*(F.lit(v).alias(n) for n, v in zip("xywh", (x, y, w, h))))
    hits = spark.range(1).select(layout.box_hit(box(5, 5, 2, 2), box(0, 0, 10, 10)), layout.box_hit(box(9, 9, 9, 9), box(0, 0, 10, 10)), layout.box_hit(box(0, 0, 30, 10), box(0, 0, 10, 10))).first()
    assert tuple(hits) == (True, False, True)


def test_config():
    for bad in (0, -1, True, 1.5, "9"):
        with pytest.raises(ValueError):
            Config(max_upload_bytes=bad)
    for wrong in ({"review_threshold": 5}, {"scoring_mode": "other"}, {"ghost_qualities": (0, 50)}, {"copy_enabled": 1}, {"ela_warn": 20.0}, {"known_editors": ["x"]}):
        with pytest.raises(ValueError):
            Config(**wrong)
    with pytest.raises(TypeError):
        Config(nothing=1)
    with pytest.raises(AttributeError):
        Config().min_width = 3
    other = Config().but(min_width=3)
    assert other.min_width == 3 and Config().min_width == 700 and other != Config() and pickle.loads(pickle.dumps(other)) == other and repr(other) == "Config(min_width=3)"
    assert from_dict({"ghost_qualities": [50, 60, 70], "unknown": 1}).ghost_qualities == (50, 60, 70) and from_dict(None) == Config()


def test_stream_of_reviews(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), i % 3, "legitimate", None if i % 4 else 0) for i in range(30)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, reviews.EVENT).coalesce(1).write.parquet(source)
    for make, name, mode in ((reviews.status_counts, "counts", "complete"), (reviews.accept, "accepted", "append")):
        q = make(reviews.read(spark, source)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 30
    state, want = {}, {}
    for i, _, a, _, e in rows:
        ok = e is None or e == state.get(a, 0)
        state[a] = state.get(a, 0) + ok
        want[i] = ok
    assert {r.event_id: r.accepted for r in spark.table("accepted").collect()} == want


def test_ghost_candidate_equals_its_definition(spark):
    rng = random.Random(8)
    rows = [(i, b, q, rng.choice([0.01, 0.5, 1.0, 2.0, 4.0, None]) if i < 3 else 0.01) for i in range(5) for b in range(30) for q in range(50, 80, 5)] + [(9, 1, 50, 1.0), (9, 1, 55, 1.0)]
    errors = spark.createDataFrame(rows, "image long, block long, quality int, mse double")
    for last in (None, 63):
        want, at = {}, {(i, b, q): m for i, b, q, m in rows}
        for i in range(5):
            found = []
            for q in range(55, 75, 5):
                near = [[at[i, b, x] for x in (q - 5, q, q + 5)] for b in range(30)]
                d = [((lo + hi) / 2 - m) / (m + 0.05) for lo, m, hi in near if None not in (lo, m, hi)]
                if median([at[i, b, q] for b in range(30) if at[i, b, q] is not None]) >= 0.02 and d and (last is None or abs(q - last) >= 3):
                    found.append((median(d), -q, d))
            if found:
                md, q, d = max(found)
                mad = median([abs(x - md) for x in d])
                limit = min(0.25 * md, md - Config().ghost_mad_k * 1.4826 * mad)
                want[i] = (-q, round(md, 9), round(mad, 9), round(limit, 9), sum(x < limit for x in d), len(d))
        got = {r.image: (r.quality, round(r.median_dip, 9), round(r.mad, 9), round(r.threshold, 9), r.suspicious, r.blocks) for r in layout.ghost_candidate(errors, last).collect()}
        assert got == want and len(want) == 3
