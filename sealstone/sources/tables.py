"""Readers and writers of records: labels, results, reports, credentials, expected fields."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, FIELDS, Config, load

REGION = "struct<x:int,y:int,w:int,h:int>"
LABELS = f"file string, label int, kind string, origin string, region {REGION}, expected map<string,string>"
RESULTS = f"file string, label int, kind string, origin string, score int, decision string, codes array<string>, features map<string,string>, region {REGION}, localized boolean, errors map<string,string>, seconds double"
CREDENTIALS = "subject string, role string, token_sha256 string"
ROLES = ("operator", "reviewer", "admin")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labels; blank lines are skipped."""
    return spark.read.schema(LABELS).json(path)


def results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result lines of several files, one after another."""
    return spark.read.schema(RESULTS).json(list(paths))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row; columns that begin with an underscore (overlays) stay out."""
    kept = df.select(*(c for c in df.columns if not c.startswith("_")))
    kept.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def credentials(spark: SparkSession, path: str) -> DataFrame:
    """Strictly valid (subject, role, token_sha256) rows, else ValueError naming what is wrong."""
    raw = spark.read.option("multiLine", True).json(path)
    if set(raw.columns) != {"subject", "role", "token_sha256"}:
        raise ValueError("credentials need exactly subject, role and token_sha256")
    rows = raw.select("subject", "role", "token_sha256")
    bad = rows.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) | ~F.coalesce(F.col("token_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) | F.coalesce(F.trim("subject") == "", F.lit(True)))
    twice = rows.groupBy("token_sha256").count().where("count > 1")
    if not bad.isEmpty() or not twice.isEmpty():
        raise ValueError("credentials hold an unknown role, a bad digest, an empty subject or a digest twice")
    return rows


def expected_from_pairs(pairs: list[str]) -> dict[str, str]:
    """`key=value` items, both sides stripped; items without `=` are ignored."""
    return {k.strip(): v.strip() for k, sep, v in (p.partition("=") for p in pairs) if sep}


def expected_from_json(raw: Column, form: Column | None = None) -> Column:
    """Map of expected fields from a JSON object; null where it is invalid.

    Only known keys, only texts and finite numbers; null and blank values are
    ignored, 0 is kept, and form fields override.
    """
    parsed = F.try_parse_json(raw)
    kind = F.schema_of_variant(parsed)
    pairs = F.from_json(raw, "map<string,string>")
    clean = F.map_filter(pairs, lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))
    known = F.size(F.array_except(F.map_keys(pairs), F.array(*(F.lit(f) for f in FIELDS)))) == 0
    odd = F.exists(F.map_values(clean), lambda v: v.rlike(r"^(\[|\{|true$|false$|NaN$|-?Infinity$)"))
    merged = clean if form is None else F.map_concat(F.map_filter(clean, lambda k, v: ~F.map_contains_key(form, k)), form)
    return F.when(kind.startswith("OBJECT") & known & ~odd, merged)


def environment(config: Config = DEFAULT) -> Config:
    """Configuration that the environment names; service runs take the larger of both scores."""
    path = os.environ.get("SEALSTONE_CONFIG")
    base = load(path) if path else config
    model = os.environ.get("SEALSTONE_MODEL")
    return base.but(scoring_model=model or base.scoring_model, scoring_mode=os.environ.get("SEALSTONE_MODE", "max"))


def console_row() -> Column:
    """name (40 characters), score, decision and codes with points, or `-`."""
    codes = F.array_join(F.transform(F.filter("findings", lambda f: f["points"] != 0), lambda f: f["code"]), ",")
    return F.concat_ws(" ", F.rpad(F.substring("filename", 1, 40), 40, " "), F.lpad(F.col("score").cast("string"), 3, " "), F.rpad("decision", 12, " "), F.when(codes == "", "-").otherwise(codes))


def append_analyses(existing: DataFrame, batch: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """New analyses with ids after the largest known, expiry from retention, in order of arrival (`seq`)."""
    from pyspark.sql import Window as W

    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    number = F.row_number().over(W.orderBy("seq")) + F.lit(top)  # one batch of a service, not the corpus
    return batch.withColumn("id", number.cast("long")).withColumn("expires_at", F.col("created_at") + F.make_interval(days=F.lit(config.retention_days)))
