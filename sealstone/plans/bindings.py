"""The engine's inputs, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FRAUD, INCONCLUSIVE, LEGITIMATE, PENDING
from ..functions import hashing
from ..operators import findings as fi
from ..operators import scores, workflow

PURGE_AT = "2024-04-04 00:00:00"
#: A small model over document features, in the form that training writes.
MODEL = {
    "model": "logistic", "features": ["at", "chars", "extra_bytes", "lines"], "mean": [0.02, 2400.0, 60.0, 9.0], "std": [0.2, 3600.0, 150.0, 0.0],
    "coef": [1.5, -0.8, 0.4, 0.05], "intercept": -1.2,
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as analysed cases, with findings of seven rules, score and decision."""
    sha = F.sha2("text", 256)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    base = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("reference"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filename"), "lang", "n_chars", "text",
        sha.alias("sha256"), (start + F.make_interval(hours=F.col("doc_id").cast("int"))).alias("created_at"),
    )
    base = base.withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 90 DAYS"))
    # Only narrow columns meet in the window; texts stay where they are read.
    text = F.col("text")
    narrow = base.select(
        "id", "reference", "filename", "lang", "n_chars", "sha256", "created_at", "expires_at",
        (text.contains("***") | text.contains("###")).alias("marks"), (F.octet_length(text) - F.char_length(text)).alias("extra_bytes"), text.contains("@").alias("at"),
        text.contains("!!").alias("shouts"), F.regexp_count(text, F.lit("\n")).alias("lines"),
    )
    narrow = narrow.withColumn("dup", F.row_number().over(W.partitionBy("sha256").orderBy("id")) > 1)
    c = F.col
    rules = [
        fi.Rule("blur", 10, "baixo", c("n_chars") < 600), fi.Rule("resolution", 8, "baixo", c("n_chars") < 300), fi.Rule("editing_software", 25, "alto", c("marks")),
        fi.Rule("nonstandard_quantization", 4, "baixo", c("extra_bytes") > 0), fi.Rule("field_email", 18, "alto", c("at")),
        fi.Rule("typography_inconsistent", 10, "médio", c("shouts")), fi.Rule("exact_duplicate", 45, "alto", c("dup")),
    ]
    return scores.additive(narrow.withColumn("findings", fi.apply_rules(rules)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", LEGITIMATE).when(kind == "error", FRAUD).when(kind == "click", INCONCLUSIVE).otherwise(PENDING)
    note = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("analysis_id"), status.alias("status"), note.alias("note"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.versions(events(spark, sf_dir))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"))
    rows = analyses(spark, sf_dir).join(labels, "id")
    return rows.select("id", "label", F.col("lang").alias("kind"), F.col("reference").alias("origin"), "score", F.transform("findings", lambda f: f["code"]).alias("codes"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (id, feature, value); documents without "@" have no feature `at`."""
    rows = analyses(spark, sf_dir).select("id", "n_chars", "extra_bytes", "lines", "at")
    pairs = F.array(
        *(F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("value")) for n, c in (("chars", "n_chars"), ("extra_bytes", "extra_bytes"), ("lines", "lines"))),
        F.struct(F.lit("at").alias("feature"), F.when(F.col("at"), 1.0).alias("value")),
    )
    return rows.select("id", F.explode(pairs).alias("f")).select("id", "f.*").where(F.col("value").isNotNull())


def hashes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(id, h): a perceptual hash of each embedding taken for an image's coefficients."""
    e = F.col("embedding")
    word = hashing.bits_to_long(hashing.median_bits(e, 64), 64) if kind == "median" else hashing.bits_to_long(hashing.gradient_bits(e, 64), 63)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), word.alias("h"))


WORDS = ("w0", "w1", "w2", "w3")
#: Places among the 63 later coefficients, in order of size, that the four words of a 256-bit hash are cut at.
RANKS = (12, 25, 38, 51)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sha256, w0..w3): three shots of each embedding taken for an image's coefficients.

    The first has its 256-bit hash, the second three bits of it turned, the third
    up to 23, none for every fifth, which is the same file sent again.
    """
    bits = lambda rest, k: hashing.bits_to_long(F.transform("embedding", lambda x: x > F.get(rest, F.lit(k))), 64)
    rest = F.array_sort(F.slice("embedding", 2, 63))
    words = F.transform(F.array(rest), lambda r: F.struct(*(bits(r, k).alias(w) for w, k in zip(WORDS, RANKS))))[0]
    v = F.col("vec_id")
    plain = read(spark, sf_dir, "embeddings").select("vec_id", words.alias("w")).select("vec_id", "w.*")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    few, many = one(v % 62).bitwiseOR(one(v * 7 % 62)), one(v % 24) - 1
    j = F.col("j")
    turned = {
        "w0": F.when(j == 1, F.col("w0").bitwiseXOR(few)).otherwise(F.col("w0")), "w1": F.when((j == 2) & (v % 5 != 0), F.col("w1").bitwiseXOR(many)).otherwise(F.col("w1")),
        "w3": F.when(j == 1, F.col("w3").bitwiseXOR(one(v % 62))).otherwise(F.col("w3")),
    }
    rows = plain.withColumn("j", F.explode(F.array(*(F.lit(k) for k in range(3)))))
    file = F.concat(F.lit("f"), F.when((j == 2) & (v % 5 == 0), v * 3).otherwise(v * 3 + j).cast("string"))
    return rows.select((v * 3 + j).alias("id"), file.alias("sha256"), *(turned.get(w, F.col(w)).alias(w) for w in WORDS))


def gradient_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h): two shots of each 64-bit gradient hash, the second with up to nine bits turned."""
    rows = hashes(spark, sf_dir, "gradient").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 10).cast("int")) - 1
    return rows.select((F.col("id") * 2 + F.col("j")).alias("id"), F.when(F.col("j") == 1, F.col("h").bitwiseXOR(mask)).otherwise(F.col("h")).alias("h"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, h): a client's short list of 64-bit hashes, one for each nation."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), hashing.from_hex(F.substring(F.md5("n_name"), 1, 16)).alias("h"))


def model(spark: SparkSession) -> DataFrame:
    return scores.model_table(spark, MODEL)
