"""Image sources: file scan with pushed-down limits, container parsing, decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, FIRMWARE, KNOWN_EDITORS, Config
from ..session import ship

# The standard luminance table, row by row, and the zig-zag order of stored tables.
STD_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
SAMPLING = {(1, 1): "4:4:4", (2, 1): "4:2:2", (2, 2): "4:2:0", (1, 2): "4:4:0", (4, 1): "4:1:1"}
TAGS = {0x0110: "Model", 0x010F: "Make", 0x0131: "Software", 0x0132: "DateTime", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized"}
TYPES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
CONTAINER = "format string, width int, height int, progressive boolean, tables int, luma array<int>, subsampling string, exif map<string,string>, has_gps boolean, error string"


#: Suffixes of image files, in any case.
SUFFIXES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "false").load(path)


def scan(spark: SparkSession, path: str | list[str], config: Config = DEFAULT) -> DataFrame:
    """JPEG and PNG files of a folder, not its subfolders, or of a list of folders and files; larger ones than the limit are never read.

    The size filter reaches the file source, so contents over it stay unread. Empty files are left out too.
    """
    return _files(spark, path).where(F.col("length").between(1, config.max_upload_bytes)).select("path", "length", "content")


def rejects(spark: SparkSession, path: str | list[str], config: Config = DEFAULT) -> DataFrame:
    """(path, length, reason) of files that `scan` leaves out; only names and sizes are read."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > config.max_upload_bytes, "too many bytes")
    return _files(spark, path).select("path", "length", reason.alias("reason")).where(F.col("reason").isNotNull())


def _tiff(data: bytes) -> tuple[dict[str, str], bool]:
    """Tags of the main, photo and position directories of an Exif block."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    out, gps = {}, False

    def directory(at: int, prefix: str = "") -> None:
        nonlocal gps
        (count,) = struct.unpack_from(order + "H", data, at)
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size, spot = TYPES.get(kind, 1) * n, at + 10 + 12 * k
            if size > 4:
                (spot,) = struct.unpack_from(order + "I", data, spot)
            raw = data[spot : spot + size]
            if tag in (0x8769, 0x8825):
                gps = gps or tag == 0x8825
                directory(struct.unpack_from(order + "I", raw)[0], "GPS" if tag == 0x8825 else "")
            elif kind == 2:
                out[prefix + TAGS.get(tag, str(tag))] = raw.split(b"\0")[0].decode("latin-1").strip()
            elif kind in (3, 4) and n == 1:
                out[prefix + TAGS.get(tag, str(tag))] = str(struct.unpack_from(order + ("H" if kind == 3 else "I"), raw)[0])
            else:
                out[prefix + TAGS.get(tag, str(tag))] = f"<{len(raw)} bytes>"

    directory(struct.unpack_from(order + "I", data, 4)[0])
    return out, gps


def container(data: bytes) -> dict:
    """What an image file says about itself, without decoding it; faults become `error`."""
    out = {"format": None, "width": None, "height": None, "progressive": False, "tables": 0, "luma": None, "subsampling": "n/a", "exif": {}, "has_gps": False, "error": None}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            out["format"] = "png"
            out["width"], out["height"] = struct.unpack_from(">II", data, 16)
        elif data[:2] == b"\xff\xd8":
            out["format"], at = "jpeg", 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
                body = data[at + 4 : at + 2 + size]
                if marker == 0xE1 and body[:6] == b"Exif\0\0":
                    try:
                        out["exif"], out["has_gps"] = _tiff(body[6:])
                    except Exception:  # noqa: BLE001  a broken block is no block
                        pass
                elif marker == 0xDB:
                    while body:
                        wide, which = body[0] >> 4, body[0] & 15
                        step = 128 if wide else 64
                        values = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                        if which == 0:
                            out["luma"] = [v for _, v in sorted(zip(ZIGZAG, values))]
                        out["tables"] += 1
                        body = body[1 + step :]
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
                    out["progressive"] = marker == 0xC2
                    if body[5] == 3:
                        out["subsampling"] = SAMPLING.get((body[7] >> 4, body[7] & 15), "n/a")
                elif marker == 0xDA:
                    break
                at += 2 + size
        else:
            out["error"] = "neither JPEG nor PNG"
    except Exception as fault:  # noqa: BLE001  reported as a column, the task goes on
        out["error"] = f"{type(fault).__name__}: {fault}"
    return out


def _containers(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in CONTAINER.split(", ")]
    for contents in frames:
        yield pd.DataFrame([container(bytes(c)) if c is not None else container(b"") for c in contents], columns=names)


def with_container(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Files with a struct `container`; too many pixels are a fault before anything is decoded."""
    ship(files.sparkSession)
    kind = T.StructType.fromDDL(CONTAINER)
    parse = F.pandas_udf(_containers, kind)
    out = files.withColumn("container", parse("content"))
    pixels = F.col("container.width").cast("long") * F.col("container.height")
    fault = F.when(pixels > config.max_image_pixels, "too many pixels").otherwise(F.col("container.error"))
    return out.withColumn("container", F.col("container").withField("error", fault))


def classify_software(name: Column, editors: tuple[str, ...] = KNOWN_EDITORS) -> Column:
    """none, editor, firmware or unknown; an editor's name anywhere decides first."""
    lower = F.lower(name)
    is_editor = F.exists(F.array(*(F.lit(e) for e in editors)), lambda e: lower.contains(e))
    is_firmware = F.lit(False)
    for pattern in FIRMWARE:
        is_firmware = is_firmware | F.trim(name).rlike(pattern)
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "none").when(is_editor, "editor").when(is_firmware, "firmware").otherwise("unknown")


def exif_datetime(text: Column) -> Column:
    """Timestamp of the first 19 characters in one of four usual forms."""
    t = F.substring(text, 1, 19)
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in forms))


def scaled_table(quality: Column) -> Column:
    """The standard luminance table at a quality, as encoders scale it."""
    q = F.least(F.lit(100.0), F.greatest(F.lit(1.0), quality.cast("double")))
    scale = F.when(q < 50, 5000.0 / q).otherwise(200.0 - 2 * q)
    return F.transform(F.array(*(F.lit(float(v)) for v in STD_LUMA)), lambda v: F.least(F.lit(255.0), F.greatest(F.lit(1.0), F.floor((v * scale + 50) / 100).cast("double"))))


def estimate_quality(luma: Column) -> Column:
    ratios = F.zip_with(luma, F.array(*(F.lit(float(v)) for v in STD_LUMA)), lambda a, b: a / b)
    ratio = F.aggregate(ratios, F.lit(0.0), lambda s, x: s + x) / 64 * 100
    return F.least(F.lit(100.0), F.greatest(F.lit(1.0), F.when(ratio <= 100, (200 - ratio) / 2).otherwise(5000 / ratio)))


def is_standard(luma: Column, tolerance: int = 1) -> Column:
    gaps = F.zip_with(luma, scaled_table(F.bround(estimate_quality(luma), 0)), lambda a, b: F.abs(a - b))
    return F.array_max(gaps) <= tolerance


def metadata(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Metadata features of files with a container; `expected_date` may be a column of theirs."""
    c, exif = F.col("container"), F.col("container.exif")
    tag = lambda n: F.try_element_at(exif, F.lit(n))
    shot, changed = exif_datetime(tag("DateTimeOriginal")), exif_datetime(tag("DateTime"))
    now = now if now is not None else F.current_timestamp()
    day = F.col("expected_date") if "expected_date" in files.columns else F.lit(None).cast("date")
    minutes = (F.unix_seconds(changed) - F.unix_seconds(shot)) / 60
    return files.select(
        *files.columns, c["format"].alias("format"), c["width"].alias("width"), c["height"].alias("height"), F.size(exif).alias("exif_tags"),
        F.coalesce(tag("Make"), tag("Model")).isNotNull().alias("has_camera_info"), c["has_gps"].alias("has_gps"), tag("Software").alias("software"),
        classify_software(tag("Software")).alias("software_kind"), F.coalesce(F.bround(estimate_quality(c["luma"]), 0).cast("int"), F.lit(0)).alias("jpeg_quality"),
        F.coalesce(is_standard(c["luma"]), F.lit(True)).alias("jpeg_standard_tables"), c["subsampling"].alias("jpeg_subsampling"), shot.isNotNull().alias("has_capture_datetime"),
        F.abs(F.datediff(shot, day)).alias("capture_gap_days"), (F.datediff(shot, now) >= 1).alias("capture_future"), F.round(minutes, 1).alias("modified_after_capture_minutes"),
    )
