import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealstone.config import DEFAULT
from sealstone.operators import findings, imaging
from sealstone.sources import images


def png(pixels):
    h, w = pixels.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def paper(seed, h=384, w=512):
    rng = np.random.default_rng(seed)
    smooth = rng.normal(0, 1, (h // 8, w // 8))
    soft = np.kron(smooth, np.ones((8, 8))) * 12 + rng.normal(0, 5, (h, w)) + 170
    return np.clip(np.repeat(soft[..., None], 3, 2), 0, 255).astype(np.uint8)


def exif(tags):
    body, at, heap = b"", 8 + 2 + 12 * len(tags) + 4, b""
    for tag, text in tags:
        data = text.encode() + b"\0"
        body += struct.pack("<HHII", tag, 2, len(data), at + len(heap))
        heap += data
    return b"Exif\0\0II*\0" + struct.pack("<IH", 8, len(tags)) + body + b"\0\0\0\0" + heap


def jpeg_head(luma, tags=()):
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    out = b"\xff\xd8" + (seg(0xE1, exif(tags)) if tags else b"")
    out += seg(0xDB, b"\0" + bytes(luma[i] for i in images.ZIGZAG))
    return out + seg(0xC0, struct.pack(">BHHB", 8, 600, 900, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])) + b"\xff\xda\0\2"


def table_at(q):
    scale = 200 - 2 * q
    return [int(min(255, max(1, np.floor((v * scale + 50) / 100)))) for v in images.STD_LUMA]


def test_zigzag_order():
    assert images.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and images.ZIGZAG[-1] == 63


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(paper(1, 64, 80)))
    (tmp_path / "b.JPG").write_bytes(jpeg_head(table_at(75), [(0x0131, "GIMP 2.10"), (0x9003, "2026:09:01 10:00:00"), (0x0132, "2026:09:01 12:30:00")]))
    odd = table_at(75)
    odd[5] += 7
    (tmp_path / "c.jpeg").write_bytes(jpeg_head(odd))
    (tmp_path / "d.png").write_bytes(b"not an image")
    (tmp_path / "e.txt").write_bytes(b"x")
    files = images.scan(spark, str(tmp_path))
    assert "length" in files._jdf.queryExecution().executedPlan().toString()
    meta = images.metadata(images.with_container(files).withColumn("expected_date", F.to_date(F.lit("2026-09-04"))))
    got = {r.path.rsplit("/", 1)[1]: r for r in meta.collect()}
    assert set(got) == {"a.png", "b.JPG", "c.jpeg", "d.png"}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].jpeg_standard_tables) == (80, 64, True)
    b = got["b.JPG"]
    assert (b.width, b.height, b.jpeg_quality, b.jpeg_standard_tables, b.jpeg_subsampling) == (900, 600, 75, True, "4:2:0")
    assert (b.software_kind, b.capture_gap_days, b.modified_after_capture_minutes, b.exif_tags) == ("editor", 3, 150.0, 3)
    assert not got["c.jpeg"].jpeg_standard_tables
    assert got["d.png"].container.error


@pytest.mark.parametrize(("name", "kind"), [("", "none"), ("GIMP 2.10", "editor"), ("17.5.1", "firmware"), ("S918BXXU3CWL1", "firmware"), ("HDR+ 1.0.345", "firmware"), ("Google", "firmware"), ("NX3000-1.05", "firmware"), ("MeuApp Fotos 2.0", "unknown")])
def test_software(spark, name, kind):
    assert spark.range(1).select(images.classify_software(F.lit(name))).first()[0] == kind


def test_ghost_finds_an_edit_and_spares_a_double_save():
    fresh = paper(2)
    once = imaging.recompress(fresh, 60)
    edited = once.copy()
    edited[128:256, 160:352] = paper(3)[128:256, 160:352]
    for image, want in ((edited, True), (once, False)):
        again = imaging.recompress(image, 90)
        g = imaging.ghost(again, imaging.gray_of(again), DEFAULT, 90)
        assert g["found"] == want
    assert g["quality"] == 60


def test_copy_move_finds_a_pasted_region():
    image = paper(4)
    gray = imaging.gray_of(image)
    assert imaging.copy_move(gray, DEFAULT)["region"] is None
    pasted = gray.copy()
    pasted[200:296, 300:420] = gray[40:136, 60:180]
    r = imaging.copy_move(pasted, DEFAULT)["region"]
    assert r and abs(r["x"] - 300) <= 8 and abs(r["y"] - 200) <= 8
    flat = np.full((300, 300), 128.0)
    assert imaging.copy_move(flat, DEFAULT)["region"] is None


@pytest.mark.parametrize("shift", [(240, 160), (241, 161), (242, 162), (243, 161), (-237, 162), (3, 201)])
def test_copy_move_finds_any_shift(shift):
    dx, dy = shift
    gray = imaging.gray_of(paper(4))
    x = 60 if dx > 0 else 320
    pasted = gray.copy()
    pasted[40 + dy : 136 + dy, x + dx : x + dx + 120] = gray[40:136, x : x + 120]
    r = imaging.copy_move(pasted, DEFAULT)["region"]
    ends = [(x, 40), (x + dx, 40 + dy)]  # either may be taken for the copy
    assert r and any(abs(r["x"] - a) <= 8 and abs(r["y"] - b) <= 8 for a, b in ends)


def test_copy_move_looks_past_frequent_repeats():
    gray = imaging.gray_of(paper(7, 600, 800))
    for k in range(6):  # six shifts of more blocks than the paste, in parts that are too small
        a, b = 48 * k, 48 * (11 - k)
        for y in range(0, 384, 48):
            gray[y : y + 28, b : b + 28] = gray[y : y + 28, a : a + 28]
    assert imaging.copy_move(gray, DEFAULT)["region"] is None
    gray[480:520, 401:449] = gray[420:460, 20:68]
    r = imaging.copy_move(gray, DEFAULT)["region"]
    assert r and abs(r["x"] - 401) <= 8 and abs(r["y"] - 480) <= 8


def test_copy_move_spares_what_occurs_often():
    gray = imaging.gray_of(paper(8, 600, 800))
    gray[61:121, 500:580] = logo = gray[40:100, 40:120]
    assert imaging.copy_move(gray, DEFAULT)["region"]
    gray[401:461, 302:382] = logo
    assert imaging.copy_move(gray, DEFAULT)["region"] is None


def test_response_equals_correlation():
    gray = imaging.gray_of(paper(9, 64, 80))
    gray[40:, :30] = 128
    got, patch = imaging._response(gray, gray[5:22, 9:30]), gray[5:22, 9:30]
    want = [[imaging._ncc(gray[j : j + 17, i : i + 21], patch) for i in range(80 - 20)] for j in range(64 - 16)]
    assert np.allclose(got, want, atol=1e-6)


def test_hashes_survive_a_save_and_part_images():
    a, b = imaging.gray_of(paper(5)), imaging.gray_of(paper(6))
    again = imaging.gray_of(imaging.recompress(paper(5), 70))
    gap = lambda x, y: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(imaging.phash(x), imaging.phash(y)))
    assert gap(a, again) <= 8 and gap(a, b) > 20


def test_pixels_through_spark(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(png(paper(i, 128, 160)))
    got = imaging.features(imaging.decoded(spark, str(tmp_path))).collect()
    assert len(got) == 3 and all(r.error is None and r.blur_variance > 80 and len(r.phash) == 4 for r in got)
    bad = spark.createDataFrame([("x", 5, 5, 3, b"123")], "path string, height int, width int, channels int, data binary")
    assert imaging.features(bad).first().error.startswith("ValueError")


def test_rule_table(spark):
    row = {"blur_variance": 10.0, "width": 500, "height": 900, "software_kind": "editor", "software": "gimp", "format": "jpeg", "exif_tags": 0, "jpeg_standard_tables": False,
           "capture_gap_days": 3, "capture_future": False, "modified_after_capture_minutes": 11.0, "ela_mean": 14.0, "ela_p95": 20.0, "ghost_quality": 70, "ghost_coverage": 0.2, "exact_duplicate": True, "nearest_distance": 0}
    df = spark.createDataFrame([row]).withColumn("ghost_regions", F.array(F.struct(*(F.lit(1).alias(n) for n in "xywh")))).withColumn("copy_move_region", F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"))
    out = df.select(findings.apply_rules(findings.image_rules()).alias("f")).select(F.transform("f", lambda x: x["code"]).alias("c"), findings.additive_score(F.col("f")).alias("s")).first()
    assert out.c == ["blur", "resolution", "editing_software", "no_exif", "nonstandard_quantization", "exif_date_mismatch", "exif_modified_later", "ela_high", "ghost_local", "exact_duplicate"]
    assert out.s == 100
