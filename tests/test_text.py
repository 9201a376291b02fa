import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sealstone.functions import text as t
from sealstone.session import ship

BODY = "Pedido 12345\nData 04/09/2026\nDestinatário JOAO CLAUDIO\nValor R$ 1.250,00\nCódigo 001-A8Z\nTelefone (11) 5555"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["04/09/2026", "4/9/26", "2026-09-04", "04.09.2026", "4 de setembro de 2026", "04 set 2026", "2026-09-04T10:15:00", "O4/O9/2026"])
def test_dates(spark, text):
    assert one(spark, t.parse_date(F.lit(text))) == dt.date(2026, 9, 4)


@pytest.mark.parametrize(("text", "want"), [("4/9/026", dt.date(2026, 9, 4)), ("  4 De SET. de 26 ", dt.date(2026, 9, 4)), ("04/09/2026 10:15", dt.date(2026, 9, 4)), ("2026-09-04 10:15:59", dt.date(2026, 9, 4)), ("1/1/0099", dt.date(2099, 1, 1))])
def test_other_dates(spark, text, want):
    assert one(spark, t.parse_date(F.lit(text))) == want


@pytest.mark.parametrize("text", ["31/02/2026", "sem data", "", "entregue em 04/09/2026 ok", "04/09/2026 25:15", "2026-09-04T10:15", "4 foo 2026"])
def test_no_date(spark, text):
    assert one(spark, t.parse_date(F.lit(text))) is None


@pytest.mark.parametrize(("text", "want"), [("R$ 1.250,00", "1250.00"), ("R$1250,00", "1250.00"), ("1250.00", "1250.00"), ("1.250", "1250.00"), ("1,250.00", "1250.00"), ("12,5", "12.50"), ("abc", None), ("", None)])
def test_money(spark, text, want):
    assert one(spark, t.parse_money(F.lit(text))) == (want and Decimal(want))


def test_kind_of_a_text_with_a_date(spark):
    assert one(spark, t.infer_kind(F.lit("campo"), F.lit("entregue em 04/09/2026 ok"))) == "text"
    assert one(spark, t.infer_kind(F.lit("campo"), F.lit("04/09/026"))) == "date"
    assert one(spark, t.find_dates(F.lit("em 4/9/026"))) == [dt.date(2026, 9, 4)]
    assert one(spark, t.find_money(F.lit("R$ 0,00 e R$ 5 e 7"))) == [Decimal("5.00")]


def test_found_in_noise(spark):
    noisy = F.lit("ligue 5555-1234, total R$ 1.250,00 em 04/09/2026 e troco 12,50")
    assert one(spark, t.find_dates(noisy)) == [dt.date(2026, 9, 4)]
    assert one(spark, t.find_money(noisy)) == [Decimal("1250.00"), Decimal("12.50")]


def test_confusions(spark):
    assert one(spark, t.fix_digit_confusions(F.lit("Pedido 1O0O5 OLIVEIRA"))) == "Pedido 10005 OLIVEIRA"
    assert one(spark, t.normalize_code(F.lit("ó1-qz|b"))) == "010218"
    assert one(spark, t.normalize_text(F.lit("  São  João, nº 5 ßx"))).startswith("sao joao")


def test_folding_of_all_latin_letters(spark):
    df = spark.createDataFrame([("ﬁm é Việt Ｎ° ǄĲ ß",), (None,)], "s string")
    assert [r[0] for r in df.select(t.strip_accents("s")).collect()] == ["fim e Viet N° DZIJ ß", None]
    assert one(spark, t.normalize_text(F.lit("Việt ﬁm Straße"))) == "viet fim strasse"


def test_ratios():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert t._lcs(a, b) == lcs(a, b)
    assert t.ratio_of("abcd", "abxd") == 75.0
    assert t.partial_ratio_of("joao", "xx joao yy") == 100.0
    assert t.token_set_ratio_of("claudio joao", "joao claudio silva") == 100.0


def test_field_matching(spark):
    asked = {"pedido": "12345", "data": "04-09-2026", "destinatario": "João Cláudio", "valor": "R$ 1.250,00", "codigo": "001-A8Z", "data de entrega": "05/09/2026", "total": "R$ 9.250,00", "numero": "12399"}
    rows = spark.createDataFrame([(1, BODY, asked), (2, "texto sem numeros", {"valor": "R$ 10,00"}), (3, None, {"valor": "R$ 10,00"}), (4, BODY, None)], "id long, body string, expected map<string,string>")
    ship(spark)
    got = {(r.id, r.field): r for r in t.match_fields(rows, "id", "expected", "body").collect()}
    assert all(got[1, f].matched for f in ("pedido", "data", "destinatario", "valor", "codigo"))
    assert all(got[1, f].conflict and not got[1, f].matched for f in ("data de entrega", "total", "numero"))
    assert got[1, "data de entrega"].found == "2026-09-04" and got[1, "total"].found == "1250.00"
    assert not got[2, "valor"].matched and not got[2, "valor"].conflict
    assert (4, "valor") not in got
