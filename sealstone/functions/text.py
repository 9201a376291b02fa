"""Text functions: normalisation, dates, money, field kinds and field matching.

Everything is a column expression but the fuzzy ratios, for which Spark has no
operator; those are Arrow-batched. An expression that uses a cleaned text more
than once binds it first (`let`), or it would be worked out again at each use.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bare(c: int) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))


#: All letters of the Latin blocks, Latin ligatures and full-width forms whose compatibility decomposition, without marks, is something else.
_FOLDED = {chr(c): _bare(c) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)) for c in range(lo, hi) if _bare(c) not in ("", chr(c))}
ACCENTED, BARE = ("".join(x) for x in zip(*((k, v) for k, v in _FOLDED.items() if len(v) == 1)))
#: Those that unfold to several letters; few texts have any.
LIGATURES = {k: v for k, v in _FOLDED.items() if len(v) > 1}
MARKS = "[\\u0300-\\u036f]+"

# Portuguese month names and abbreviations, look-alike characters of codes.
MONTHS = {
    "jan": 1, "janeiro": 1,
    "fev": 2, "fevereiro": 2,
    "mar": 3, "marco": 3,
    "abr": 4, "abril": 4,
    "mai": 5, "maio": 5,
    "jun": 6, "junho": 6,
    "jul": 7, "julho": 7,
    "ago": 8, "agosto": 8,
    "set": 9, "setembro": 9,
    "out": 10, "outubro": 10,
    "nov": 11, "novembro": 11,
    "dez": 12, "dezembro": 12,
}
LOOKALIKES, DIGITS = "OQIL|ZSB", "00111258"

# The forms of dates, amounts and digit-like tokens.
ISO_DATE = r"(?<!\d)(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})(?!\d)"
NUMERIC_DATE = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})(?!\d)"
WRITTEN_DATE = r"(?<!\d)(\d{1,2})\s*(?:de\s+)?([a-z]{3,9})\.?\s*(?:de\s+)?(\d{2,4})(?!\d)"
TIMESTAMP = r"(\d{4})-(1[0-2]|0?[1-9])-(3[01]|[12]\d|0?[1-9])(?:t|\s+)(?:2[0-3]|[01]?\d):[0-5]?\d:(?:6[01]|[0-5]?\d)"
DAY_AND_TIME = r"(3[01]|[12]\d|0?[1-9])/(1[0-2]|0?[1-9])/(\d{4})\s+(?:2[0-3]|[01]?\d):[0-5]?\d"
MONEY = r"(?:r\$\s*)?(?<![\d,])(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{2}))?(?!\d|\.\d)"
DIGIT_LIKE = r"[0-9OoIl|][0-9OoIl|/.,:\-]*[0-9OoIl|]"
KIND_NAMES = (
    ("date", ("data", "date", "dt", "emissao", "entrega")),
    ("money", ("valor", "value", "total", "preco", "amount", "montante")),
    ("code", ("codigo", "code", "ref", "referencia", "chave", "rastreio", "tracking", "nf", "nota", "lote", "serie")),
    ("number", ("pedido", "order", "numero", "id", "cpf", "cnpj", "telefone")),
)
KIND_FORMS = (
    ("money", r"(?i)^r\$|^\d{1,3}(\.\d{3})*,\d{2}$"),
    ("number", r"^\d[\d.\-/ ]*$"),
    ("code", r"^(?=.*\d)[A-Za-z0-9\-./]+$"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, with `value` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def strip_accents(c: Column) -> Column:
    """Letters of the Latin blocks without accents, ligatures unfolded, and no combining marks; `ß` and `œ` stay. No Python worker."""
    def unfolded(t: Column) -> Column:
        for k, v in LIGATURES.items():
            t = F.replace(t, F.lit(k), F.lit(v))
        return t

    folded = F.regexp_replace(F.translate(c, ACCENTED, BARE), MARKS, "")
    return F.when(folded.rlike(f"[{''.join(LIGATURES)}]"), unfolded(folded)).otherwise(folded)


def normalize_text(c: Column) -> Column:
    folded = F.replace(F.lower(strip_accents(c)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, "[^0-9a-z]+", " "))


def normalize_code(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(strip_accents(c)), r"[^0-9A-Z|]", ""), LOOKALIKES, DIGITS)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(fix_digit_confusions(c), r"\D", "")


def digit_runs(c: Column) -> Column:
    """Runs of three digits or more; shorter ones never count."""
    return F.regexp_extract_all(c, F.lit(r"\d{3,}"), F.lit(0))


def fix_digit_confusions(c: Column) -> Column:
    """In digit-like tokens, O/o become 0 and I/l/| become 1.

    A token has two digits at least, and as many digits as letters. Tokens and
    the text between them are taken apart and put together again in order.
    """
    pattern = DIGIT_LIKE

    def fixed(t: Column) -> Column:
        digits, letters = F.regexp_count(t, F.lit("[0-9]")), F.regexp_count(t, F.lit("[OoIl|]"))
        return F.when((digits >= 2) & (digits >= letters), F.translate(t, "OoIl|", "00111")).otherwise(t)

    tokens = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)
    joined = F.zip_with(between, F.transform(tokens, fixed), lambda b, t: F.concat(b, F.coalesce(t, F.lit(""))))
    return F.array_join(joined, "")


def _date(y: Column, m: Column, d: Column) -> Column:
    """Date of a year, month and day in digits; years under 100 are of this century, however many digits they have."""
    year = F.when(y.try_cast("int") < 100, y.try_cast("int") + 2000).otherwise(y.try_cast("int"))
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    table = F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(table, name)


def _found(c: Column, pattern: str, order: tuple[int, int, int], named: bool = False) -> Column:
    y, m, d = order
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    group = lambda x, k: F.regexp_extract(x, pattern, k)
    month = lambda x: _month(group(x, m)) if named else group(x, m)
    dates = F.transform(hits, lambda x: _date(group(x, y), month(x), group(x, d)))
    return F.filter(dates, lambda x: x.isNotNull())


def find_dates(c: Column) -> Column:
    """All valid dates: ISO ones first, then day/month/year, then written ones; each in text order."""
    def found(plain: Column) -> Column:
        return F.concat(_found(plain, ISO_DATE, (1, 2, 3)), _found(plain, NUMERIC_DATE, (3, 2, 1)), _found(plain, WRITTEN_DATE, (3, 2, 1), named=True))

    return let(fix_digit_confusions(F.lower(strip_accents(c))), found)


def parse_date(c: Column) -> Column:
    """Date of a text that is one as a whole, in any of the forms that `find_dates` knows or as a timestamp; else null."""
    def parsed(t: Column) -> Column:
        def whole(pattern: str, order: tuple[int, int, int], named: bool = False) -> Column:
            y, m, d = (F.regexp_extract(t, rf"\A(?:{pattern})\z", k) for k in order)
            return F.when(d != "", _date(y, _month(m) if named else m, d))

        return F.coalesce(whole(ISO_DATE, (1, 2, 3)), whole(NUMERIC_DATE, (3, 2, 1)), whole(WRITTEN_DATE, (3, 2, 1), True), whole(TIMESTAMP, (1, 2, 3)), whole(DAY_AND_TIME, (3, 2, 1)))

    return let(F.regexp_replace(fix_digit_confusions(F.lower(strip_accents(c))), r"\A\s+|\s+\z", ""), parsed)


def _amount(t: Column) -> Column:
    """Decimal of a clean amount (digits, dots and commas); null where the text is none."""
    comma, dot = F.instr(t, ","), F.instr(t, ".")
    last_comma = F.length(t) - F.instr(F.reverse(t), ",")
    last_dot = F.length(t) - F.instr(F.reverse(t), ".")
    two = F.when(last_comma > last_dot, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    one_dot = F.when(t.rlike(r"^\d*\.\d{2}$"), t).otherwise(F.replace(t, F.lit("."), F.lit("")))
    last_of_commas = F.replace(F.call_function("substring_index", t, F.lit(","), F.regexp_count(t, F.lit(",")).cast("int")), F.lit(","), F.lit(""))
    commas = F.concat(last_of_commas, F.lit("."), F.substring_index(t, ",", -1))
    plain = F.when((comma > 0) & (dot > 0), two).when(comma > 0, commas).when(dot > 0, one_dot).otherwise(t)
    return let(plain, lambda p: F.when(t.rlike(r"^[\d.,]*\d[\d.,]*$") & p.rlike(r"^\d*(\.\d{1,2})?$"), p.try_cast("decimal(18,2)")))


def _unsigned(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("r$"), F.lit("")), F.lit(" "), F.lit(""))


def parse_money(c: Column) -> Column:
    """Decimal of a Brazilian or plain amount; null where the text is none.

    Of two kinds of separators the last is the decimal one; a lone comma is
    decimal; a lone dot is decimal only once and before two digits.
    """
    return let(_unsigned(F.lower(fix_digit_confusions(strip_accents(c)))), _amount)


def find_money(c: Column) -> Column:
    """Amounts in a text; bare whole numbers without R$, cents or thousands mark are none, and neither is zero."""
    def found(plain: Column) -> Column:
        hits = F.filter(F.regexp_extract_all(plain, F.lit(MONEY), F.lit(0)), lambda x: ~x.rlike(r"^\d+$"))
        return F.filter(F.transform(F.transform(hits, _unsigned), _amount), lambda x: x != 0)

    return let(F.lower(fix_digit_confusions(strip_accents(c))), found)


def infer_kind(name: Column, value: Column) -> Column:
    """date, money, code, number or text: from parts of the field's name, else from the value's form."""
    def by_form(v: Column) -> Column:
        kind = F.lit("text")
        for k, form in reversed(KIND_FORMS):
            kind = F.when(v.rlike(form), k).otherwise(kind)
        return F.when(parse_date(v).isNotNull(), "date").otherwise(kind)

    def by_name(n: Column) -> Column:
        kind = F.lit(None).cast("string")
        for k, parts in reversed(KIND_NAMES):
            kind = F.when(n.rlike("|".join(parts)), k).otherwise(kind)
        return kind

    return F.coalesce(let(normalize_text(name), by_name), let(F.regexp_replace(value, r"\A\s+|\s+\z", ""), by_form))


# --- fuzzy ratios (Arrow batches) ----------------------------------------------------------------


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each character of `a`."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio_of(a: str, b: str) -> float:
    """Best ratio of the shorter text with any part of the longer one as long, also where it overhangs an end."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio_of(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_set_ratio_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio_of(one, two), ratio_of(both, one) if both else 0.0, ratio_of(both, two) if both else 0.0)


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


ratio, partial_ratio, token_set_ratio = map(_pairwise, (ratio_of, partial_ratio_of, token_set_ratio_of))


@F.pandas_udf(T.DoubleType())
def fuzzy_score(kind: pd.Series, value: pd.Series, text: pd.Series, runs: pd.Series) -> pd.Series:
    """Score of a value that no exact comparison settled; null for the others (kind null)."""
    def one(k, v, t, rs):
        if k is None or v is None:
            return None
        if k == "number":
            return max((ratio_of(v, r) for r in (rs if rs is not None else ())), default=0.0)
        return partial_ratio_of(v, t) if k == "code" else max(partial_ratio_of(v, t), token_set_ratio_of(v, t))

    return pd.Series([one(*x) for x in zip(kind, value, text, runs)], dtype="float64")


def match_fields(df: DataFrame, key: str, expected: str, text: str, fuzzy: int = 85, code: int = 90) -> DataFrame:
    """(key, field, kind, matched, score, method, found, conflict) for each entry of the map `expected`.

    A document's dates, amounts and number runs are found once; each expected
    field is a row. Only rows that exact comparison leaves open are scored in
    Python, all in one pass.
    """
    t = F.col(text)
    read = df.select(
        F.col(key), F.col(expected).alias("_expected"), find_dates(t).alias("_dates"), find_money(t).alias("_amounts"), digit_runs(fix_digit_confusions(t)).alias("_runs"),
        normalize_code(t).alias("_code"), normalize_text(t).alias("_text"),
    )
    rows = read.select(key, "_dates", "_amounts", "_runs", "_code", "_text", F.explode("_expected").alias("field", "_value"))
    v = F.col("_value")
    rows = rows.select(
        "*", infer_kind(F.col("field"), v).alias("_asked"), parse_date(v).alias("_date"), parse_money(v).alias("_money"), digits_only(v).alias("_digits"),
        normalize_code(v).alias("_code_v"), normalize_text(v).alias("_text_v"),
    )
    c = F.col
    kind = (
        F.when((c("_asked") == "date") & c("_date").isNotNull(), "date").when((c("_asked") == "money") & c("_money").isNotNull(), "money")
        .when((c("_asked") == "number") & (c("_digits") != ""), "number").when(c("_asked") == "code", "code").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    in_run = F.array_contains("_runs", c("_digits")) | ((F.length("_digits") >= 4) & F.exists("_runs", lambda r: r.contains(c("_digits"))))
    exact = (
        F.when(c("kind") == "date", F.array_contains("_dates", c("_date"))).when(c("kind") == "money", F.array_contains("_amounts", c("_money")))
        .when(c("kind") == "number", in_run).when(c("kind") == "code", c("_code").contains(c("_code_v"))).otherwise((c("_text_v") == "") | c("_text").contains(c("_text_v")))
    )
    rows = rows.withColumn("_exact", F.coalesce(exact, F.lit(False)))
    open_ = F.when(~c("_exact") & c("kind").isin("number", "code", "text"), c("kind"))
    asked = F.when(c("kind") == "number", c("_digits")).when(c("kind") == "code", c("_code_v")).otherwise(c("_text_v"))
    body = F.when(c("kind") == "code", c("_code")).otherwise(c("_text"))
    rows = rows.withColumn("_fuzzy", fuzzy_score(open_, asked, body, c("_runs")))
    close = (
        F.when(c("kind") == "number", (F.length("_digits") >= 6) & (c("_fuzzy") >= code)).when(c("kind") == "code", c("_fuzzy") >= code)
        .when(c("kind") == "text", c("_fuzzy") >= fuzzy).otherwise(False)
    )
    matched = c("_exact") | F.coalesce(close, F.lit(False))
    found = F.when(c("kind") == "date", F.get("_dates", F.lit(0)).cast("string")).when(c("kind") == "money", F.get("_amounts", F.lit(0)).cast("string")).when(c("kind") == "number", F.get("_runs", F.lit(0)))
    method = F.when((c("kind") == "text") & (c("_text_v") == ""), "empty").when(c("_exact") | c("kind").isin("date", "money"), c("kind")).otherwise(F.concat("kind", F.lit("_fuzzy")))
    return rows.select(
        key, "field", "kind", matched.alias("matched"), F.when(c("_exact"), 100.0).otherwise(F.coalesce("_fuzzy", F.lit(0.0))).alias("score"), method.alias("method"), found.alias("found"),
        (~matched & c("kind").isin("date", "money", "number") & found.isNotNull()).alias("conflict"),
    )
