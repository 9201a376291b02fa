import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealstone import cli, plugins
from sealstone.analyzer import analyse, report
from sealstone.config import Config
from sealstone.operators import findings, scores
from sealstone.sources import images

from .test_imaging import paper, png


def test_cases(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(png(paper(1, 128, 160)))
    (tmp_path / "b.png").write_bytes(png(paper(1, 128, 160)))
    (tmp_path / "c.png").write_bytes(png(np.full((128, 160, 3), 99, np.uint8)))
    (tmp_path / "d.png").write_bytes(b"broken")
    (tmp_path / "empty.png").write_bytes(b"")
    got = {r.filename: r for r in analyse(spark, str(tmp_path)).collect()}
    codes = {k: [f.code for f in r.findings] for k, r in got.items()}
    assert codes["a.png"] == ["resolution", "ocr_unavailable"] and "exact_duplicate" in codes["b.png"] and codes["c.png"][:2] == ["blur", "resolution"]
    assert got["b.png"].decision == "REVISAR" and got["b.png"].score == 53 and got["d.png"].error
    assert cli.main(["analyze", str(tmp_path), "--json", str(tmp_path / "out")]) == 0
    assert "exact_duplicate" in capsys.readouterr().out
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 4


def test_limits_hold_before_decoding(spark, tmp_path, monkeypatch):
    for name, pixels in (("small", paper(3, 64, 80)), ("many", np.full((400, 400, 3), 9, np.uint8)), ("heavy", paper(3, 64, 80))):
        (tmp_path / f"{name}.PnG").write_bytes(png(pixels) + (b"x" * 200_000 if name == "heavy" else b""))
    asked = []
    from sealstone.operators import imaging

    whole = imaging.decoded
    monkeypatch.setattr(imaging, "decoded", lambda spark, path: asked.append(path) or whole(spark, path))
    got = {r.filename: r for r in analyse(spark, str(tmp_path), Config(max_image_pixels=100_000, max_upload_bytes=150_000)).collect()}
    assert [[p.rsplit("/", 1)[1] for p in a] for a in asked] == [["small.PnG"]]
    assert set(got) == {"small.PnG", "many.PnG"} and got["many.PnG"].error == "too many pixels" and got["small.PnG"].error is None
    assert [r.reason for r in images.rejects(spark, str(tmp_path), Config(max_upload_bytes=150_000)).collect()] == ["too many bytes"]


@pytest.mark.skipif(not os.environ.get("SEALSTONE_SLOW"), reason="over two minutes")
def test_all_signals(spark, tmp_path):
    """Every finding that text recognition, typography and outside models can make, and the report's keys."""
    for i, name in enumerate("abcd"):
        (tmp_path / f"{name}.png").write_bytes(png(paper(20 + i, 128, 160)))
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in images.scan(spark, str(tmp_path)).collect()}
    words = [(paths["a.png"], w, "90", 100 + 60 * i, 100, 50, 40, 1, 1, 1) for i, w in enumerate(["Pedido", "12345", "ABC", "DEF", "GHK"])]
    words += [(paths["a.png"], "R$9.250,00", "95", 700, 330, 240, 120, 1, 1, 1), (paths["b.png"], "ab", "90", 0, 0, 9, 9, 1, 1, 1)]
    schema = "path string, text string, conf string, left int, top int, width int, height int, block_num int, par_num int, line_num int"
    expected = [(paths["a.png"], {"pedido": "12345", "valor": "R$ 10,00", "destinatario": "Zyxwv Uts", "data": ""}), (paths["d.png"], {"Código": "AB-12", "valor": "R$ 10,00"})]
    vlm = [(paths["d.png"], '{"legibility": "ok", "has_signature": false, "edit_signs": ["borda", " "], "fields": {"code": "XX-99", "Total": "10,00"}}', None), (paths["c.png"], None, "timeout")]
    config = Config(vlm_enabled=True, vlm_require_signature=True, deep_model="tests.test_analyzer:suspicious")
    cases = analyse(
        spark, str(tmp_path), config, words=plugins.words(spark.createDataFrame(words, schema)), expected=spark.createDataFrame(expected, "path string, expected map<string,string>"),
        ocr_faults=spark.createDataFrame([(paths["c.png"], "motor ausente")], "path string, ocr_warning string"), vlm=spark.createDataFrame(vlm, "path string, raw string, vlm_error string"),
    ).persist()
    got = {r.filename: r for r in cases.collect()}
    codes = {k: [(f.code, f.points) for f in r.findings if f.code not in ("resolution", "blur", "near_duplicate")] for k, r in got.items()}
    assert codes["a.png"] == [("field_valor", 18), ("field_destinatario", 8), ("typography_inconsistent", 10), ("deep_suspect", 12)]
    assert codes["b.png"] == [("ocr_empty", 5), ("deep_suspect", 12)] and codes["c.png"] == [("ocr_unavailable", 0), ("deep_suspect", 12), ("vlm_unavailable", 0)]
    assert codes["d.png"] == [("ocr_empty", 5), ("deep_suspect", 12), ("vlm_field_Código", 18), ("vlm_edit_signs", 12), ("vlm_no_signature", 5)]
    a = got["a.png"].features
    assert (a["ocr.fields_checked"], a["ocr.fields_matched"], a["ocr.fields_conflict"], a["ocr.fields_missing"]) == ("3", "1", "1", "1") and a["deep.deep_score"] == "0.6"
    assert a["typography.typography_outliers"] == "1" and len(a["duplicates.phash"]) == 64 and got["d.png"].features["vlm.vlm_fields_matched"] == "1"
    assert all(f.region for f in got["a.png"].findings if f.code == "typography_inconsistent")
    document = report(cases, config).where("filename = 'a.png'").first()
    assert len(document.asDict()) == 26 and document.dimensions.width == 160 and document.analyzed_at.endswith("+00:00") and document.field_matches["pedido"]
    assert set(document.signals) == {"quality", "metadata", "recompression", "copy_move", "duplicates", "ocr", "typography", "deep", "vlm"} and json.loads(document.config)["vlm_enabled"]
    cases.unpersist()


def suspicious(rgb):
    return {"score": 0.6, "mask": np.zeros((4, 4))}


def test_configured_scorer(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"quality.blur_variance": "20.0", "metadata.software_kind": "editor", "duplicates.exact_duplicate": "true"}), (2, {})], "id long, features map<string,string>")
    rows = rows.withColumn("findings", findings.apply_rules([findings.Rule("blur", 40, "alto", F.col("id") == 1)]))
    model = {"model": "logistic", "features": ["quality.blur_variance", "metadata.software_kind=editor", "duplicates.exact_duplicate"], "mean": [10.0, 0.5, 0.0], "std": [5.0, 0.0, 1.0], "coef": [0.1, 2.0, 1.0], "intercept": -1.0}
    (tmp_path / "m.json").write_text(json.dumps(model))
    margin = 0.1 * 2 + 2.0 * 0.5 + 1.0 - 1.0
    want = round(100 / (1 + np.exp(-margin)))
    base = Config(scoring_model=str(tmp_path / "m.json"))
    one = scores.configured(rows, base).orderBy("id").collect()
    assert one[0].score == want and one[0].model == "logistic:m.json" and [p.feature for p in one[0].score_details][:2] == ["duplicates.exact_duplicate", "metadata.software_kind=editor"]
    assert one[1].score == round(100 / (1 + np.exp(1.0))) and one[1].score_details == []
    both = scores.configured(rows, base.but(scoring_mode="max", review_threshold=90, attention_threshold=40)).orderBy("id").collect()
    assert both[0].score == max(40, want) and both[0].decision == "ATENÇÃO" and both[1].score == 27
    rules = scores.configured(rows, base.but(scoring_model="nowhere")).orderBy("id").collect()
    assert [r.score for r in rules] == [40, 0] and rules[0].model == "additive"


def test_evaluate_and_train(spark, tmp_path, capsys):
    lines = [{"file": f"f{i}", "label": i % 2, "kind": "k", "origin": "o", "score": 40 * (i % 2) + i % 7, "codes": ["blur"] * (i % 2), "features": {"a": str(i % 2 + i % 3), "b": "true", "k": "xyz"[i % 3]}} for i in range(40)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    assert cli.main(["evaluate", str(tmp_path / "r.jsonl")]) == 0 and "| blur |" in capsys.readouterr().out
    assert cli.main(["train", str(tmp_path / "r.jsonl"), "--out", str(tmp_path / "m" / "model.json")]) == 0
    model = json.loads((tmp_path / "m" / "model.json").read_text())
    assert model["features"] == ["a", "b", "k=x", "k=y", "k=z"] and model["positives"] == 20


def test_plugins(spark):
    rows = [("f", w, "90", 100 + 60 * i, 100, 50, 40, 1, 1, 1) for i, w in enumerate(["Pedido", "12345", "ABC", "DEF", "GHK"])] + [("f", "9.250,00", "95", 700, 330, 240, 120, 1, 1, 1), ("f", " ", "90", 0, 0, 1, 1, 1, 1, 2), ("f", "x", "-1", 0, 0, 1, 1, 1, 1, 2), ("f", "END", "oops", 0, 0, 1, 1, 1, 1, 2)]
    df = spark.createDataFrame(rows, "path string, text string, conf string, left int, top int, width int, height int, block_num int, par_num int, line_num int")
    found = plugins.words(df, 2.0)
    assert found.count() == 6 and found.orderBy("left").first().left == 50
    assert plugins.recognised(found).first().ocr_text == "Pedido 12345 ABC DEF GHK 9.250,00"
    t = plugins.typography(found).first()
    assert t.typography_outliers == 1 and t.typography_worst.w == 120
    mask = np.zeros((200, 300), bool)
    for y in range(20, 180, 20):
        for x in range(20, 280):
            mask[int(y + (x - 150) * np.tan(np.deg2rad(4))) % 200, x] = True
    assert abs(abs(plugins.skew(mask)) - 4) <= 0.5 and plugins.skew(np.zeros((9, 9), bool)) == 0.0
    raws = ['{"legibility": "ok", "has_signature": true, "edit_signs": [], "fields": {"Order_ID": "7", "zzz": "1"}}', "nope"]
    got = [r.v for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i").select(plugins.vlm(F.col("r")).alias("v")).collect()]
    assert got[0].fields == {"pedido": "7"} and got[1] is None
    assert plugins.predictor() is None
