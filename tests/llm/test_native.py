"""Operators in column expressions: against plain Python, and on odd and empty input."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sealstone.llm import chat, decontaminate, pii, quality, sharding

DOCS = "doc_id long, text string"
RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def empty(spark, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([], schema)


# --- decontamination ---


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, body in items:
        v = plain_words(body)
        m = min(13, len(v))
        grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ä", "é", "漢"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(13, 60))) for i in range(8)] + [(20, text(5)), (21, "w3 W4"), (22, "w7"), (23, ""), (24, None), (None, text(20)), (25, text(12)), (20, text(14))]
    docs = [(i, text(rng.randint(0, 120))) for i in range(60)]
    for i in range(60, 120):
        body = rng.choice([b for _, b in items if b]).split()
        a = rng.randint(0, max(0, len(body) - 3))
        part = " ".join(body[a : a + rng.randint(1, 40)])
        docs.append((i, f"{text(rng.randint(0, 30))}, {part.upper()}! {text(rng.randint(0, 200))}"))
    for benchmark in (items, items[:8], items[8:11], []):
        b = spark.createDataFrame(benchmark, "item_id long, text string")
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), b).drop("rid").collect()}
        assert got == {i: plain_hits(t, benchmark) for i, t in docs}


def test_decontamination_odd(spark, odd_docs):
    bench = spark.createDataFrame([(1, "same row", "z"), (2, "word " * 13, "z")], "item_id long, text string, doc_id string")
    got = decontaminate.decontaminate(odd_docs, bench).collect()
    assert len(got) == 10 and sorted(r.doc_id for r in got if r.contaminated) == [4, 5, 5, 7]
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    kept = decontaminate.keep_clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 6


# --- PII ---


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in hit.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain_pii(text):
    spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(RULES) for m in re.finditer(p, text or "") if valid(kind, m[0]))
    return (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())


def test_pii_equals_brute_force(spark):
    rng = random.Random(9)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (269) 555-3296", "+1 2", "é", "😀", " ", ".", "-", "7", "12", "word", "_", "+", "(", "\n", "5500000000000004"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000, "+12345678 " * 900 + "4111111111111111," * 700), (1001, "1" * 9000 + ".2.3.4 a.b@c" + ".d" * 4000), (1002, None)]
    got = {r.doc_id: tuple(r)[1:6] for r in pii.find(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: plain_pii(t) for i, t in docs}


def test_pii_trees_add_numbers_without_plus(spark):
    rng = random.Random(1)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    docs = [(i, f"call me +1 {number()} now, {chr(97 + i % 26)}") for i in range(300)] + [(i, f"total {rng.randint(10**8, 10**9)} units") for i in range(300, 600)] + [(900, "or 1 (269) 555-3296 today"), (901, "item 20260904 x")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[900] == "phone:3:19" and got[901] == ""
    assert not any(got[i] for i in range(300, 600))


@pytest.fixture(scope="module")
def planted_pii():
    """(documents, spans planted in forms that the rules miss, one for some thirty known ones); half of the numbers are decoys."""
    rng = random.Random(4)
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    words = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(2, 9)))

    def card():
        body = "4" + digits(14)
        return next(body + str(c) for c in range(10) if valid("card", body + str(c)))

    phone = lambda: f"1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    email = lambda: f"{words().split()[0]}.{digits(2)}@mail{rng.randint(0, 9)}.example.com"
    decoys = (lambda: digits(16), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: digits(9), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}")
    known = (email, ip, card, lambda: "+" + phone())
    masked = (
        ("email", lambda: email().replace("@", " [at] ")), ("email", lambda: email().replace("@", "(at)").replace(".example", " [dot] example")), ("email", lambda: email().split(".example")[0]),
        ("ip", lambda: ip().replace(".", ",")), ("card", lambda: re.sub("(....)", r"\1. ", card()).strip(". ")), ("phone", phone), ("phone", lambda: phone().replace("(", "").replace(") ", "-")),
        ("card", card), ("phone", lambda: "+" + phone()),
    )
    docs, planted = [], {}
    for i in range(3000):
        docs.append((i, f"{words()} {rng.choice(known)() if i % 2 else rng.choice(decoys)()} {words()}."))
    for i in range(4000, 4045):
        kind, make = masked[i % len(masked)]
        value, head = make(), words()
        # The last two forms are whole, but a number stands beside them, so the rules read both as one and drop them.
        whole = i % len(masked) >= len(masked) - 2
        beside, behind = digits(9) + " " if whole and kind == "card" else "", f" {ip()}" if whole and kind == "phone" else ""
        docs.append((i, f"{head} {beside}{value}{behind} {words()}."))
        planted[i] = (kind, len(head) + 1 + len(beside), len(head) + 1 + len(beside) + len(value))
    return docs, planted


def test_pii_trees_find_planted_variants(spark, planted_pii):
    docs, planted = planted_pii
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, DOCS)).collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: plain_pii(t) for i, t in docs}
    added = {}
    for i, t in docs:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)]
        base = {(k, m.start(), m.end()) for k, p in RULES for m in re.finditer(p, t) if valid(k, m[0])}
        assert base <= set(spans)
        added[i] = set(spans) - base
    hits = sum(planted[i] in added[i] for i in planted)
    total = sum(map(len, added.values()))
    assert hits / len(planted) >= 0.9 and hits / total >= 0.9, (hits, len(planted), total)
    assert sum(map(len, (added[i] for i in range(3000)))) <= 0.01 * 3000


def test_pii_copies_count_once(spark):
    """One candidate a hundred thousand times leaves room in the sample for the others."""
    rng = random.Random(2)
    docs = [(i, "item 123456789 sold") for i in range(20_000)] + [(i, f"call +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} now, or item {rng.randint(10**8, 10**9)} x") for i in range(20_000, 20_300)]
    found = spark.createDataFrame(docs, DOCS).select(pii._found(F.col("text")).alias("x")).select("x.*")
    assert 3 in pii.fit(found)


def test_pii_trees_learn_from_all_candidates(spark):
    """2,800 known numbers to 200 without a plus are a share of 0.93; the first 1,500 of them were one of 0.88."""
    rng = random.Random(5)
    number = lambda: f"1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    docs = [(i, f"call me {'+' * (i >= 200)}{number()} now") for i in range(3000)]
    found = spark.createDataFrame(docs, DOCS).select(pii._found(F.col("text")).alias("x")).select("x.*")
    held = pii._examples(found).groupBy("held").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("base") == 8, F.col("n"))).alias("hits")).orderBy("held").collect()
    assert sum(r.n for r in held) >= 3000 and sum(r.hits for r in held) == len({t for _, t in docs[200:]})
    models = pii.fit(found)
    assert 3 in models and pii.fit(found.repartition(7)) == models


def test_pii_few_examples_need_no_shuffle(spark, monkeypatch):
    """Sums over few examples are one task's work; more are dealt out, with the same trees."""
    rng = random.Random(8)
    docs = [(i, f"call me {'+' * (i >= 20)}1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} now, item {rng.randint(1, 10**6)}") for i in range(600)]
    found = spark.createDataFrame(docs, DOCS).repartition(3).select(pii._found(F.col("text")).alias("x")).select("x.*")
    parts, cuts = [], pii._cuts
    monkeypatch.setattr(pii, "ROUNDS", 2)
    monkeypatch.setattr(pii, "_cuts", lambda examples, *a: parts.append(examples.rdd.getNumPartitions()) or cuts(examples, *a))
    monkeypatch.setattr(pii, "scratch", lambda df, name: df.repartition(3))
    models = pii.fit(found)
    assert models and set(parts) == {1}
    parts.clear()
    monkeypatch.setattr(pii, "SINGLE", 0)
    assert pii.fit(found) == models and set(parts) == {3}


def test_pii_odd(spark, odd_docs):
    assert pii.find(odd_docs).count() == 10 and pii.find(empty(spark)).count() == 0
    assert pii.redact(odd_docs).columns == odd_docs.columns
    docs = spark.createDataFrame([(1, "é a@b.cd, +1 (269) 555-3296!"), (2, None), (3, "")], DOCS)
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["é [EMAIL], [PHONE]!", None, ""]


# --- quality ---


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {p for at in grams.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice(["a", "b", "c ", " ", "\n", "\t", "#", "é", " d", "\x0b", " ", "<"]) for _ in range(rng.randint(0, 400))), "en") for i in range(200)] + [(900, "a b c " * 200, "en"), (901, None, None)]
    rows = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {i: plain_quality(t) for i, t, _ in docs}


def test_quality_rejects_what_diverges(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "to", "in"] * 8 + [f"word{chr(97 + i)}" for i in range(26)] * 2
    clean = lambda: " ".join(rng.choice(vocabulary) for _ in range(200))
    docs = [(i, clean(), "en") for i in range(100)] + [(500, "".join(f"X{i}##Y " for i in range(200)), "en"), (501, clean(), "qq")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(100)) and not got[500].kept and not got[500].base_failed
    assert got[501].kept and got[501].js_chars is None  # too small a reference


def test_word_bins_count_every_word(spark):
    """Bins through the hash table equal plain counts, words beyond the common ones and long ones included; each common word is in its slot only."""
    rng = random.Random(12)
    vocabulary = [f"{chr(97 + i % 26)}{'é' * (i % 3)}{i % 7}" for i in range(40)] + ["longer-word", "verylongword", "漢字漢字漢字", "#"]
    docs = [(i, " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randint(0, 300))), "en" if i % 2 else None) for i in range(60)] + [(60, "severalletters " * 9, "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("lang", F.coalesce("lang", F.lit("")))
    known = quality.common_words(df).withColumn("slots", quality._slots(F.col("common")))
    listed = {r.lang: (r.common, r.slots) for r in known.collect()}
    assert all(sorted(x for s in slots for x in s) == sorted(common) and max(map(len, slots)) < quality.COMMON for common, slots in listed.values()) and set(listed) == {"", "en"}
    none = F.array().cast("array<string>")
    bins = quality._word_bins(F.array_remove(F.split("text", " "), ""), F.coalesce("common", none), F.coalesce("slots", F.array(none)))
    got = {r.doc_id: r.b for r in df.join(known, "lang", "left").select("doc_id", bins.alias("b")).collect()}
    for i, text, lang in docs:
        w, common = text.split(), listed.get(lang or "", ([],))[0]
        counts = [w.count(x) for x in common] + [0] * (quality.COMMON - len(common))
        assert got[i] == counts + [len(w) - sum(counts)] and sum(got[i]) == len(w)
    for lang in ("", "en"):
        short = Counter(x for _, t, g in docs if (g or "") == lang for x in t.split() if len(x) <= quality.COMMON_CHARS)
        assert listed[lang][0] == sorted(short, key=lambda x: (-short[x], x.encode()))[: quality.COMMON]


def test_quality_odd(spark, odd_docs):
    got = quality.quality(odd_docs).collect()
    assert len(got) == 10 and quality.quality(empty(spark)).count() == 0
    assert not any(r.kept for r in got)


# --- sharding ---


def test_fill_takes_turns():
    shards = sharding.names(7)
    table = sharding.fill(shards, 101)
    counts = [table.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1 and -1 not in table
    fewer = sharding.fill(shards[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 101 * 0.35
    # the same by its definition: whole preference lists, one claim a turn
    prefs = []
    for s in shards:
        h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
        prefs.append([(h(f"offset:{s}") % 101 + j * (h(f"skip:{s}") % 100 + 1)) % 101 for j in range(101)])
    want, turn = {}, 0
    while len(want) < 101:
        slot = next(x for x in prefs[turn % 7] if x not in want)
        want[slot] = turn % 7
        turn += 1
    assert table == [want[i] for i in range(101)]
    for bad in ([], sharding.names(200)):
        with pytest.raises(ValueError):
            sharding.fill(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill(shards, 100)


def test_placement(spark, odd_docs):
    table = sharding.fill(sharding.names())
    for r in sharding.place(odd_docs, sharding.names()).collect():
        key = str(r.doc_id) if r.doc_id is not None else f"text:{r.text or ''}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:04d}")
    assert sharding.place(empty(spark), sharding.names()).count() == 0
    spread = sharding.place(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), sharding.names()).groupBy("shard").count().collect()
    assert len(spread) == 64 and max(r["count"] for r in spread) < 1.35 * 20_000 / 64


# --- chat ---


def plain_chat(turns):
    convs = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append((-math.inf if t is None else t, "\0" if r is None else r, "\0" if x is None else x))
    lists = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, v in lists.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in lists.values())
        same = [k for k, w in lists.items() if w == v]
        if not longer and c == min(same, key=lambda k: (k is None, k or 0)):
            kept[c] = (len(v), len(same))
    return kept


def test_chat_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(chat, "BLOCK", 3)
    turns = []
    for c in range(80):
        seed = rng.randint(0, 9)
        own = random.Random(seed)
        full = [("user" if i % 2 == 0 else "assistant", own.choice(["a", "b", None, ""])) for i in range(12)]
        turns += [(c, i, r, x) for i, (r, x) in enumerate(full[: rng.randint(1, 12)])]
    turns += [(None, 0, "user", "z"), (200, None, "user", "q"), (200, 1, None, "q"), (201, 0, "user", "t"), (201, 0, "user", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("total", F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.render(df).collect()}
    assert got == plain_chat(turns)
    assert chat.segments(df).count() == sum(n for n, _ in got.values())


def test_chat_rendering(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat.render(df).first().rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<| im_end |><|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0
