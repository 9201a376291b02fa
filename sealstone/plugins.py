"""Seams for outside engines: text recognition, deep models, vision models.

Each takes and returns DataFrames with documented columns; null means that the
engine is unavailable, which costs no points. Nothing here reaches a network.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .functions import text
from .operators import imaging, layout
from .session import ship

# Names of expected fields and of what outside models report, by canonical field.
FIELD_ALIASES = {
    "pedido": "pedido",
    "order": "pedido",
    "numero": "pedido",
    "order_id": "pedido",
    "data": "data",
    "date": "data",
    "destinatario": "destinatario",
    "nome": "destinatario",
    "recipient": "destinatario",
    "valor": "valor",
    "total": "valor",
    "value": "valor",
    "codigo": "codigo",
    "code": "codigo",
    "referencia": "codigo",
    "rastreio": "codigo",
}
VLM = "legibility string, has_signature boolean, edit_signs array<string>, fields map<string,string>"
DEEP = f"path string, deep_score double, deep_mask_mean double, deep_regions array<{imaging.REGION}>, error string"


def words(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """Recognised words from an engine's rows: blank texts and negative confidences drop, boxes go back to the image's scale."""
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    back = lambda c: F.bround(F.col(c) / scale, 0).cast("int").alias(c)
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in ("block_num", "par_num", "line_num"))).alias("line")
    clean = rows.withColumn("conf", conf).where((F.trim("text") != "") & (F.col("conf") >= 0))
    out = clean.select("path", F.trim("text").alias("text"), "conf", *(back(c) for c in ("left", "top", "width", "height")), line)
    return out.withColumn("bottom", F.col("top") + F.col("height"))


def recognised(found: DataFrame) -> DataFrame:
    """(path, ocr_text, ocr_words, ocr_chars, ocr_mean_conf) from words."""
    texts = layout.line_text(found.withColumnRenamed("path", "doc")).withColumnRenamed("doc", "path").withColumnRenamed("text", "ocr_text")
    counts = found.groupBy("path").agg(F.count("*").alias("ocr_words"), F.round(F.avg("conf"), 1).alias("ocr_mean_conf"))
    return texts.join(counts, "path").withColumn("ocr_chars", F.length("ocr_text"))


def typography(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, typography_outliers, typography_max_dev, typography_worst) for files with enough words."""
    keyed = found.withColumn("line", F.concat_ws("/", "path", "line"))
    enough = found.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= config.typography_min_words)
    dev = F.greatest(F.abs("height_dev"), F.abs("baseline_dev"))
    box = F.struct(F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    out = layout.typography(keyed, config).withColumn("dev", dev).groupBy("path").agg(F.count("*").alias("typography_outliers"), F.max("dev").alias("typography_max_dev"), F.max_by(box, "dev").alias("typography_worst"))
    return enough.select("path").join(out, "path", "left").withColumn("typography_outliers", F.coalesce("typography_outliers", F.lit(0)))


def skew(mask: np.ndarray, most: float = 15.0, step: float = 0.5) -> float:
    """Angle in degrees whose rotation makes the row sums of a text mask vary most; 0 under half a degree.

    Angles are tried from the smallest on and must gain 0.1 % to replace one.
    """
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return 0.0
    best, chosen = -1.0, 0.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=lambda a: (abs(a), a)):
        t = np.deg2rad(angle)
        rows = np.rint((xs - mask.shape[1] / 2) * np.sin(t) + (ys - mask.shape[0] / 2) * np.cos(t)).astype(int)
        value = float(np.bincount(rows - rows.min(), minlength=mask.shape[0]).var())
        if value > best * 1.001:
            best, chosen = value, float(angle)
    return chosen if abs(chosen) >= 0.5 else 0.0


def predictor(spec: str | None = None) -> Callable | None:
    """The callable of `package.module:attribute` (attribute `predict` if none is given), or of the environment."""
    spec = spec or os.environ.get("SEALSTONE_DEEP_MODEL")
    if not spec:
        return None
    module, _, attribute = spec.partition(":")
    return getattr(importlib.import_module(module), attribute or "predict")


def deep(images: DataFrame, spec: str, config: Config = DEFAULT) -> DataFrame:
    """Scores and masks of a deep model, loaded once a worker; faults become `error`."""
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor(spec)
        for rows in frames:
            out = []
            for path, h, w, n, data in zip(rows["path"], rows["height"], rows["width"], rows["channels"], rows["data"]):
                row = {"path": path, "deep_score": None, "deep_mask_mean": None, "deep_regions": None, "error": None}
                try:
                    got = predict(np.frombuffer(bytes(data), np.uint8).reshape(h, w, n)[..., 2::-1])
                    mask = np.asarray(got.get("mask")) if got.get("mask") is not None else np.zeros((1, 1))
                    y, x = h / mask.shape[0], w / mask.shape[1]
                    parts = sorted((c for c in imaging.components(mask >= config.deep_mask) if c[4] >= 0.001 * mask.size), key=lambda c: -c[4])[:5]
                    row |= {"deep_score": min(1.0, max(0.0, float(got["score"]))), "deep_mask_mean": float(mask.mean()), "deep_regions": [{"x": int(c[0] * x), "y": int(c[1] * y), "w": int(c[2] * x), "h": int(c[3] * y)} for c in parts]}
                except Exception as fault:  # noqa: BLE001  reported as a column
                    row["error"] = f"{type(fault).__name__}: {fault}"
                out.append(row)
            yield pd.DataFrame(out)

    return images.select("path", "height", "width", "channels", "data").mapInPandas(run, DEEP)


def canonical(name: Column) -> Column:
    """Canonical field of a name, without regard to case and accents; null if there is none."""
    aliases = F.create_map(*(F.lit(x) for pair in FIELD_ALIASES.items() for x in pair))
    return F.try_element_at(aliases, F.trim(F.lower(text.strip_accents(name))))


def read_for(name: Column, fields: Column) -> Column:
    """What an outside model read for the field that `name` means."""
    return F.try_element_at(fields, canonical(name))


def vlm(raw: Column) -> Column:
    """A vision model's JSON as a struct, its fields under canonical names (of two for one field the first); null where it is none."""
    got = F.from_json(raw, VLM)
    named = F.transform(F.map_entries(got["fields"]), lambda e: F.struct(canonical(e["key"]).alias("key"), e["value"].alias("value")))
    known = F.filter(named, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    first = F.filter(known, lambda e, i: ~F.exists(F.slice(known, 1, i), lambda o: o["key"] == e["key"]))
    return F.when(got["legibility"].isNotNull(), got.withField("fields", F.map_from_entries(first)))
