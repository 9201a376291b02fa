"""From image files to scored, explained cases in one plan: nine signals in a fixed order, their findings, one score."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins
from .config import DEFAULT, Config
from .functions import text
from .operators import dedup, findings, imaging, scores
from .session import ship
from .sources import images

VERSION = "3"
DISCLAIMER = "Triagem de risco: não é prova de fraude e não dispensa revisão humana."
PHASH = tuple(f"p{i}" for i in range(4))
#: Features by signal, in order; a feature is named `signal.column` and is left out where it is null.
FEATURES = {
    "quality": ("blur_variance", "width", "height", "megapixels"),
    "metadata": (
        "exif_tags", "has_camera_info", "has_gps", "jpeg_quality", "jpeg_standard_tables", "jpeg_subsampling", "software_kind", "has_software_tag", "has_capture_datetime",
        "capture_gap_days", "modified_after_capture_minutes",
    ),
    "recompression": ("ela_mean", "ela_p95", "ghost_found", "ghost_median_dip", "ghost_coverage", "ghost_largest_area"),
    "copy_move": ("keypoints", "candidate_pairs", "best_cluster", "best_correlation", "copy_move_found"),
    "duplicates": ("sha256", "perceptual_hash", "phash", "exact_duplicate", "nearest_distance"),
    "ocr": ("ocr_available", "ocr_chars", "ocr_words", "ocr_mean_conf", "fields_checked", "fields_matched", "fields_conflict", "fields_missing"),
    "typography": ("typography_checked", "typography_outliers", "typography_max_dev"),
    "deep": ("deep_enabled", "deep_score", "deep_mask_mean"),
    "vlm": ("vlm_enabled", "vlm_available", "vlm_legibility", "vlm_has_signature", "vlm_fields_matched", "vlm_fields_conflict"),
}


def namespaced(columns: list[str]) -> Column:
    """Map `signal.feature` -> value as text, of the features that are among `columns` and not null."""
    pairs = [F.struct(F.lit(f"{signal}.{name}").alias("k"), F.col(name).cast("string").alias("v")) for signal, names in FEATURES.items() for name in names if name in columns]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def expected_date(expected: Column) -> Column:
    """Date of the first expected field that is meant as one and parses."""
    dates = F.transform(F.map_entries(expected), lambda e: F.when(text.infer_kind(e["key"], e["value"]) == "date", text.parse_date(e["value"])))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def passing(spark: SparkSession, path: str, meta: DataFrame, config: Config) -> str | list[str]:
    """What to decode: the folder if all its files are within the limits, else just those that are, by name."""
    large = images.rejects(spark, path, config)
    faulty = meta.where(F.col("container.error").isNotNull())
    if large.isEmpty() and faulty.isEmpty():
        return path
    return [r.path for r in meta.where(F.col("container.error").isNull()).select("path").collect()]


def checked_fields(rows: DataFrame, body: str, config: Config) -> DataFrame:
    """(path, matches): results of `match_fields` for the expected fields of each path, in their order."""
    asked = rows.select("path", "expected", body).where((F.size("expected") > 0) & F.col(body).isNotNull())
    got = text.match_fields(asked, "path", "expected", body, config.fuzzy_threshold, config.code_threshold)
    got = got.join(asked.select("path", "expected"), "path")
    value = F.try_element_at("expected", F.col("field"))
    match = F.struct(F.array_position(F.map_keys("expected"), F.col("field")).alias("pos"), "field", value.alias("value"), "kind", "matched", "score", "method", "found", "conflict")
    return got.where(F.trim(value) != "").groupBy("path").agg(F.array_sort(F.collect_list(match)).alias("matches"))


def seen_fields(rows: DataFrame, config: Config) -> DataFrame:
    """(path, vlm_matches): expected fields against what a vision model read for the same field."""
    pairs = rows.select("path", F.explode("expected").alias("field", "value"), "vlm_fields")
    seen = plugins.read_for(F.col("field"), F.col("vlm_fields"))
    pairs = pairs.withColumn("seen", seen).where((F.trim("seen") != "") & (F.trim("value") != ""))
    keyed = pairs.select(F.to_json(F.struct("path", "field")).alias("path"), F.create_map("field", "value").alias("expected"), "seen")
    got = checked_fields(keyed, "seen", config).withColumnRenamed("path", "k").withColumn("k", F.from_json("k", "path string, field string"))
    return got.groupBy(F.col("k.path").alias("path")).agg(F.flatten(F.array_sort(F.collect_list("matches"))).alias("vlm_matches"))


def _counted(matches: Column, test) -> Column:
    return F.when(matches.isNotNull(), F.size(F.filter(matches, test)))


def analyse(
    spark: SparkSession, path: str, config: Config = DEFAULT, known: DataFrame | None = None, expected: DataFrame | None = None, words: DataFrame | None = None,
    ocr_faults: DataFrame | None = None, vlm: DataFrame | None = None, model: dict | None = None,
) -> DataFrame:
    """One row for each file of a folder: features, findings, score, decision, explanation.

    Files count as arriving in the order of their paths; each is compared with
    earlier ones and with `known` (id, sha256, reference, p0..p3). Limits on
    bytes and pixels hold before anything is decoded; files that fail them or
    can't be decoded keep a row with `error`. Text recognition is read from
    `words` (see `plugins.words`) and `ocr_faults` (path, ocr_warning), a vision
    model's answers from `vlm` (path, raw, vlm_error), what is expected from
    `expected` (path, expected as a map); without them these signals are off.
    The deep model is the callable that `config.deep_model` names, `model` a
    scoring model in place of the configured file.
    """
    ship(spark)
    files = images.with_container(images.scan(spark, path, config), config).withColumn("sha256", F.sha2("content", 256)).drop("content")
    if expected is not None:
        files = files.join(expected.select("path", "expected"), "path", "left")
    else:
        files = files.withColumn("expected", F.lit(None).cast("map<string,string>"))
    meta = images.metadata(files.withColumn("expected_date", expected_date(F.col("expected")))).persist()
    chosen = passing(spark, path, meta, config)
    if chosen:
        decoded = imaging.decoded(spark, chosen)
        pixels = imaging.features(decoded.join(meta.select("path", "jpeg_quality"), "path"), config).withColumnRenamed("error", "pixel_error")
    else:
        decoded, pixels = None, spark.createDataFrame([], imaging.SCHEMA).withColumnRenamed("error", "pixel_error")
    # Narrow rows of texts and numbers; every hash join below would otherwise decode the images again.
    pixels = pixels.persist()
    rows = meta.join(pixels, "path", "left").withColumns({p: F.get("phash", F.lit(i)) for i, p in enumerate(PHASH)})

    hashes = rows.select(F.concat(F.lit("1:"), "path").alias("id"), "sha256", F.col("path").alias("reference"), *PHASH)
    if known is not None:
        before = F.concat(F.lit("0:"), F.lpad(F.col("id").cast("string"), 20, "0"))
        hashes = hashes.unionByName(known.select(before.alias("id"), "sha256", "reference", *PHASH))
    dup = dedup.with_duplicates(hashes, list(PHASH), config.max_phash, config.near_radius).where("id LIKE '1:%'")
    dup = dup.select(F.substring("id", 3, 1 << 20).alias("path"), "exact_duplicate", "nearest_id", "nearest_distance")
    rows = rows.join(dup, "path")

    rows = _with_text(rows, words, ocr_faults, config)
    deep = plugins.deep(decoded, config.deep_model, config) if config.deep_model and decoded is not None else spark.createDataFrame([], plugins.DEEP)
    rows = rows.join(deep.withColumnRenamed("error", "deep_error"), "path", "left").withColumn("deep_enabled", F.lit(bool(config.deep_model)))
    rows = _with_vision(rows, vlm, config)

    first, last = findings.vlm_rules(config)
    fields = lambda c, seen: F.coalesce(F.filter(F.transform(c, lambda m: findings.field_finding(m, seen)), lambda f: f.isNotNull()), F.array().cast(f"array<{findings.FINDING}>"))
    found = F.concat(
        findings.apply_rules(findings.image_rules(config)), findings.apply_rules(findings.ocr_rules(config)), fields(F.col("matches"), False),
        findings.apply_rules(findings.typography_rules(config)), findings.apply_rules(findings.deep_rules(config)), findings.apply_rules(first),
        fields(F.col("vlm_matches"), True), findings.apply_rules(last),
    )
    rows = rows.withColumns({
        "findings": found, "has_software_tag": F.coalesce(F.trim("software") != "", F.lit(False)), "perceptual_hash": F.col("dhash"), "copy_move_found": F.col("copy_move_region").isNotNull(),
        "ghost_largest_area": F.coalesce(F.array_max(F.transform("ghost_regions", lambda r: r["w"] * r["h"])), F.lit(0)),
        "error": F.coalesce("container.error", "pixel_error"), "filename": F.element_at(F.split("path", "/"), -1),
    })
    rows = rows.withColumn("phash", F.array_join(F.transform("phash", lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), ""))
    rows = rows.withColumn("features", namespaced(rows.columns))
    rows = rows.withColumn("signal_errors", F.map_filter(F.create_map(F.lit("input"), F.col("error"), F.lit("deep"), F.col("deep_error")), lambda k, v: v.isNotNull()))
    return scores.configured(rows, config, model)


def _with_text(rows: DataFrame, words: DataFrame | None, faults: DataFrame | None, config: Config) -> DataFrame:
    """Columns of text recognition, of the expected fields in it, and of typography."""
    spark = rows.sparkSession
    if words is None:
        off = F.lit("OCR indisponível: nenhum texto reconhecido foi fornecido.")
        none = {"ocr_text": "string", "ocr_words": "long", "ocr_chars": "long", "ocr_mean_conf": "double", "typography_outliers": "long", "typography_max_dev": "double",
                "typography_worst": imaging.REGION, "matches": "array<struct<pos:bigint,field:string,value:string,kind:string,matched:boolean,score:double,method:string,found:string,conflict:boolean>>"}
        rows = rows.withColumns({"ocr_warning": off, **{k: F.lit(None).cast(t) for k, t in none.items()}})
    else:
        read = plugins.recognised(words)
        rows = rows.join(read, "path", "left").join(plugins.typography(words, config), "path", "left")
        rows = rows.withColumn("ocr_text", F.coalesce("ocr_text", F.lit(""))).withColumns({"ocr_words": F.coalesce("ocr_words", F.lit(0)), "ocr_chars": F.length("ocr_text"), "ocr_mean_conf": F.coalesce("ocr_mean_conf", F.lit(0.0))})
        warned = faults.select("path", "ocr_warning") if faults is not None else spark.createDataFrame([], "path string, ocr_warning string")
        rows = rows.join(warned, "path", "left")
        legible = rows.where(F.col("ocr_warning").isNull() & (F.col("ocr_chars") >= config.ocr_min_chars))
        rows = rows.join(checked_fields(legible, "ocr_text", config), "path", "left")
    m = F.col("matches")
    return rows.withColumns({
        "ocr_available": F.col("ocr_warning").isNull(), "typography_checked": F.col("typography_outliers").isNotNull(), "fields_checked": F.when(m.isNotNull(), F.size(m)),
        "fields_matched": _counted(m, lambda x: x["matched"]), "fields_conflict": _counted(m, lambda x: x["conflict"]), "fields_missing": _counted(m, lambda x: ~x["matched"] & ~x["conflict"]),
    })


def _with_vision(rows: DataFrame, vlm: DataFrame | None, config: Config) -> DataFrame:
    """Columns of a vision model's answers; null where it is off or gave none."""
    on = config.vlm_enabled and vlm is not None
    if on:
        got = vlm.select("path", plugins.vlm(F.col("raw")).alias("v"), "vlm_error")
        fault = F.when(F.col("v").isNull(), F.coalesce("vlm_error", F.lit("resposta sem os campos pedidos")))
        got = got.select("path", fault.alias("vlm_error"), F.col("v.legibility").alias("vlm_legibility"), F.col("v.has_signature").alias("vlm_has_signature"), F.col("v.edit_signs").alias("vlm_edit_signs"), F.col("v.fields").alias("vlm_fields"))
        rows = rows.join(got, "path", "left")
        rows = rows.join(seen_fields(rows.where(F.col("vlm_fields").isNotNull()), config), "path", "left")
    else:
        kinds = {"vlm_error": "string", "vlm_legibility": "string", "vlm_has_signature": "boolean", "vlm_edit_signs": "array<string>", "vlm_fields": "map<string,string>",
                 "vlm_matches": "array<struct<pos:bigint,field:string,value:string,kind:string,matched:boolean,score:double,method:string,found:string,conflict:boolean>>"}
        rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in kinds.items()})
    v = F.col("vlm_matches")
    return rows.withColumns({
        "vlm_enabled": F.lit(on), "vlm_available": F.when(F.lit(on), F.col("vlm_error").isNull()), "vlm_fields_matched": _counted(v, lambda x: x["matched"]), "vlm_fields_conflict": _counted(v, lambda x: ~x["matched"]),
    })


def report(cases: DataFrame, config: Config = DEFAULT, now: Column | None = None) -> DataFrame:
    """The audit document of each case, a row with its serialisable keys; `to_json(struct(*))` archives it."""
    at = F.date_format(F.to_utc_timestamp(now if now is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    c = F.col
    nearest = F.when(c("nearest_id").isNotNull(), F.struct(F.substring("nearest_id", 3, 1 << 20).alias("reference"), c("nearest_distance").alias("distance"), (c("nearest_distance") <= config.max_phash).alias("within")))
    matches = F.map_from_entries(F.transform("matches", lambda m: F.struct(m["field"].alias("k"), m["matched"].alias("v"))))
    by_signal = lambda name: F.map_filter("features", lambda k, v: k.startswith(f"{name}."))
    columns = {
        "analysis_version": F.lit(VERSION), "analyzed_at": at, "filename": c("filename"), "sha256": c("sha256"), "perceptual_hash": c("perceptual_hash"),
        "dimensions": F.struct("width", "height"), "format": F.coalesce("format", F.lit("desconhecido")), "blur_variance": c("blur_variance"),
        "ela": F.struct(c("ela_mean").alias("mean"), c("ela_p95").alias("p95"), F.lit(config.ela_quality).alias("quality")), "exif": c("container.exif"),
        "ocr_text": F.coalesce("ocr_text", F.lit("")), "ocr_warning": c("ocr_warning"), "field_matches": matches, "nearest_duplicate": nearest, "risk_score": c("score"), "decision": c("decision"),
        "score_model": c("model"), "score_explanation": c("explanation"), "score_details": F.struct(c("probability"), c("score_details").alias("contributions")), "findings": c("findings"),
        "features": c("features"), "signals": F.create_map(*(x for s in FEATURES for x in (F.lit(s), by_signal(s)))), "signal_errors": c("signal_errors"),
        "config": F.lit(json.dumps(config.to_dict(), ensure_ascii=False)), "disclaimer": F.lit(DISCLAIMER),
    }
    return cases.select("path", *(v.alias(k) for k, v in columns.items()))
