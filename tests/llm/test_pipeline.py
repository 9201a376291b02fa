"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import os

import pytest

import corpus_pipeline

from .test_free import plain_components, plain_print
from .test_native import plain_hits, plain_pii

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
tiktoken = pytest.importorskip("tiktoken")


def test_stages(spark):
    import public_tokenizers as P

    from sealstone.llm import bpe, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, spark.createDataFrame(before, docs.schema), DATA)
        after = [tuple(r) for r in docs.collect()]
        seen.append((name, docs.columns, before, after))
        docs = spark.createDataFrame(after, docs.schema)
    assert len(seen) == 5 and all(c == columns for _, c, _, _ in seen[:-1])
    (_, _, all_, clean), (_, _, _, single), (_, _, _, own), (_, _, _, redacted), (_, _, _, tokens) = seen
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(spark.createDataFrame(all_, "doc_id long, text string, lang string, source string, n_chars long"), labels).collect() if r.predicted}
    assert {r[0] for r in clean} == {r[0] for r in all_} - rejected
    order = sorted(clean)
    parts = plain_components([plain_print(r[1]) for r in order])
    assert {r[0] for r in single} == {order[p][0] for p in parts}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {r[0] for r in own} == {r[0] for r in single if not plain_hits(r[1], items)[-1]}
    old = {r[0]: r[1] for r in own}
    assert {r[0] for r in redacted} == set(old)
    for r in redacted:
        assert sum(plain_pii(r[1])[:4]) == 0 and r[4] == len(r[1]) and (r[1] == old[r[0]] or "[" in r[1])
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary.parse(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))).ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(r[0], len(i := library.encode_ordinary(r[1])), sha(",".join(map(str, i)).encode()), sha(r[1].encode())) for r in redacted}
    assert set(tokens) == want
    run = corpus_pipeline.run(spark, DATA)
    assert {tuple(r) for r in run.collect()} == set(tokens)


def test_odd_and_empty_tables(spark, tmp_path, odd_docs):
    """The whole pipeline on nulls, empty and repeated rows and clashing columns, and on no rows at all; nothing but the last results' tables stays."""
    from sealstone.llm import common

    for name, docs in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 1), (None, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "Ünï ćödé 漢字 😀 text"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert kept == ({1, 4, 5, None} if name == "odd" else set())
        stages = [p.rsplit("/", 1)[1] for p in common._WRITTEN if "/pipeline-" in p]
        assert sum(p.startswith("pipeline-pii") for p in stages) >= 1 and not any(p.startswith(("pipeline-toxicity", "pipeline-simhash")) for p in stages)
