"""The corpus pipeline: five stages over `documents`, each written and read again.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of `documents`; the last returns the tokens'
counts and digests. What a stage decides takes effect: rows go, or their text
changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealstone.llm import bpe, decontaminate, pii, simhash, toxicity
from sealstone.llm.common import drop_scratch, drop_since, scratch, scratch_mark, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go; it learns from the rows of `docs` with labels.

    Null and empty texts have the score of no features, repeated rows are judged
    alike, rows of null doc_id are never learnt from; without labels, or of one
    kind only, all scores are the share of toxic labels. An empty table stays empty.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: that of the least doc_id, null ids last, of equal ids the first.

    Null, empty and blank texts have the same fingerprint, so one of them stays,
    as of repeated rows. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share too much with `benchmark` go.

    Null and empty texts have no words and stay; repeated rows go or stay
    together; an empty benchmark leaves all rows, an empty table stays empty.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` is replaced by its kind; `n_chars` follows.

    All rows stay. Null texts stay null, with null n_chars; empty ones stay
    empty; repeated rows change alike; an empty table stays empty.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every remaining text, a row each.

    Null texts count as empty, with no tokens; an empty table gives no rows.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("byte-level bpe", encode),
]

#: Hashing with XXH64, learnt models and BPE can't be stated in DuckDB SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's rows are a written table.

    What a stage wrote on its way is deleted once its result is written, and so
    is the result before it.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark, before = scratch_mark(), docs
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = scratch(docs, f"pipeline-{name.replace(' ', '-')}")
            drop_since(spark, mark, docs)
            drop_scratch(before)
    return docs
