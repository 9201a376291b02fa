"""Operators with Python workers: against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sealstone.llm import bpe, components, secrets, simhash, suffix, toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- repeated strings ---


def plain_repeats(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen, out = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1)), []
    for (d, _), t in zip(rows, texts):
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~mark].tobytes()
        out.append((d, len(t), int(mark.sum()), int(np.r_[mark[:1], mark[1:] & ~mark[:-1]].sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(40):
        strings = list(dict.fromkeys(bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 10))))
        strings += [s + s for s in strings[:2] if s + s not in strings]
        stats, runs = suffix.matching_statistics(strings)
        assert runs <= sum(map(len, strings)) + len(strings)
        at = 0
        for i, b in enumerate(strings):
            for p in range(len(b)):
                best = 0
                for j, c in enumerate(strings):
                    for q in range(len(c)):
                        k = 0
                        while (i, p) != (j, q) and p + k < len(b) and q + k < len(c) and b[p + k] == c[q + k]:
                            k += 1
                        best = max(best, k)
                assert stats[at + p] == best
            at += len(b) + 1


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randint(150, 500)) for _ in range(8)]
    rows = [(i, text(rng.randint(0, 300)) + rng.choice(shared)[: rng.randint(100, 500)] + text(rng.randint(0, 300))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 777), (103, "xyz" * 100), (104, "é" * 150), (None, shared[0]), (None, shared[0]), (105, "q" * 199), (106, rows[0][1]), (106, rows[0][1])]
    got = sorted(map(tuple, suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == plain_repeats(rows)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = {a + i for a, w, _ in zip(*suffix.piece_cuts(data)) for i in range(w)}
    assert whole == set(range(5000 - 199))


def test_runs_across_chunk_borders(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("cdefgh", k=n))
    borders = (1 << 20, suffix.CHUNK)
    rows = [(i, text(border - 150) + mark * 300 + text(500)) for i, (border, mark) in enumerate(zip(borders, "ab"))]
    got = sorted(map(tuple, suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert [r[2] for r in got] == [300, 300] and got == plain_repeats(rows)


def test_repeats_odd(spark, odd_docs):
    got = suffix.remove_repeats(odd_docs).collect()
    assert len(got) == 10 and {r.doc_id for r in got if r.n_removed} == {4} and suffix.remove_repeats(empty(spark)).count() == 0


# --- BPE ---


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_for(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


ALPHABETS = ["aabbcd ", "the ing ", " \n\t\x1c\x85\xa0 ​", "éèçü漢字かな", "0123٣½", "!?$%", "'s't're"]


def random_text(rng, most=40):
    return "".join(rng.choice(rng.choice([*ALPHABETS, chr(rng.randint(1, 0xD7FF))])) for _ in range(rng.randint(0, most)))


def test_encoding_equals_the_library(encoder, library):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(4000)] + ["a" * 3000 + "ab" * 2000 + " " * 2000, "<|endoftext|>"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_appends_and_edits(encoder, library):
    rng = random.Random(2)
    for _ in range(200):
        table = bpe.PrefixTable(encoder.vocabulary)
        data = b""
        for _ in range(4):
            more = random_text(rng, 12).encode()
            table.append(more)
            data += more
            assert table.last == bpe.PrefixTable(encoder.vocabulary, data).last
        at = rng.randint(0, len(data))
        gone, new = rng.randint(0, min(4, len(data) - at)), random_text(rng, 4).encode()
        table.edit(at, gone, new)
        assert table.last == bpe.PrefixTable(encoder.vocabulary, data[:at] + new + data[at + gone :]).last
    for _ in range(100):
        doc = encoder.document(random_text(rng, 200))
        for _ in range(4):
            a = rng.randint(0, len(doc.text))
            doc.edit(a, min(len(doc.text), a + rng.randint(0, 6)), random_text(rng, 5))
            assert doc.ids() == library.encode_ordinary(doc.text)
        doc.append(" more\n")
        assert doc.ids() == library.encode_ordinary(doc.text)
    long = bpe.PrefixTable(encoder.vocabulary, b"ab cd " * 3000)
    assert long.edit(10, 1, b"x") < 2000  # near the edit only


def test_bpe_query(spark, odd_docs, library):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    got = bpe.digests(odd_docs, path, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(d, len(i := library.encode_ordinary(t or "")), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in texts}
    assert len(got) == 10 and set(map(tuple, got)) == want
    assert bpe.digests(empty(spark), path, P.PATTERN).count() == 0
    assert sum(len(r.ids) for r in bpe.encode(odd_docs, path, P.PATTERN).collect()) == sum(r.n_tokens for r in got)


# --- near duplicates ---


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize(("narrow", "hot"), [(1 << 24, 1 << 14), (0, 1 << 14), (1 << 24, 3), (0, 3)])
def test_near_duplicates_equal_brute_force(spark, odd_docs, monkeypatch, narrow, hot):
    monkeypatch.setattr(simhash, "NARROW_UP_TO", narrow)
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(150)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One Two"), (204, "one two"), (205, "É a b c d"), (206, "é a b c d")]
    prints = [plain_print(t) for _, t in rows]
    parts = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {rows[i][0]: (f"{prints[i]:016x}", rows[parts[i]][0]) for i in range(len(rows))}
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[p][0] for p in parts})


def near_prints(rng, n, shared=0):
    """Random fingerprints, each with one to four bits of an earlier one turned in half of the cases; low bits `shared`."""
    prints = [rng.getrandbits(64)]
    while len(prints) < n:
        p = rng.choice(prints) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p >> shared << shared)
    return sorted(set(prints))


@pytest.mark.parametrize("segments", [simhash.NARROW, simhash.WIDE])
def test_every_linked_pair_meets(spark, monkeypatch, segments):
    """Whole buckets and split ones: each pair within the radius shares a bucket that one of it is filed in."""
    rng = random.Random(12)
    for hot, shared in ((1 << 14, 0), (5, 24)):
        monkeypatch.setattr(simhash, "HOT", hot)
        prints = near_prints(rng, 300, shared)
        signed = lambda p: p - (1 << 64) if p >> 63 else p
        rows = simhash.filed(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), segments).collect()
        met, buckets = set(), {}
        for r in rows:
            buckets.setdefault(r.bucket, []).append((r.fp % (1 << 64), r.exact))
        for b in buckets.values():
            met |= {frozenset((p, q)) for p, e in b for q, f in b if p != q and (e or f)}
        assert all(frozenset((p, q)) in met for i, p in enumerate(prints) for q in prints[:i] if (p ^ q).bit_count() <= 4)
        # A fingerprint is filed once a segment and looks half of each ball up, on average.
        most = (2 + 2 + 1 + 21) * 1.1 if segments == simhash.NARROW else (2 + (32 + 496) / 2 + 16) * 1.1
        assert hot == 5 or len(rows) <= most * len(prints)


def test_hot_bucket_is_spread(spark, monkeypatch):
    """Twenty thousand fingerprints of one segment value: no bucket holds over a fiftieth of the rows."""
    rng = random.Random(13)
    monkeypatch.setattr(simhash, "HOT", 1 << 10)
    prints = spark.createDataFrame([(rng.getrandbits(42) << 21,) for _ in range(20_000)], "fp long")
    rows = simhash.filed(prints.distinct(), simhash.NARROW)
    sizes = rows.groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert sizes <= rows.count() / 50


def test_search_keeps_buckets_whole(monkeypatch):
    import pyarrow as pa

    rng = random.Random(14)
    monkeypatch.setattr(simhash, "BATCH", 40)
    rows = sorted((rng.randint(0, 12), rng.getrandbits(6), rng.random() < 0.5) for _ in range(500))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 7]), (pa.int64(), pa.int64(), pa.bool_()))], names=["bucket", "fp", "exact"]) for i in range(0, 500, 7)]
    monkeypatch.setattr(simhash, "SMALL", 1 << 20)
    got = {(u, v) for b in simhash._search(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    want = {(min(p, q), max(p, q)) for b, p, e in rows for c, q, f in rows if b == c and p != q and (e or f) and (p ^ q).bit_count() <= 4}
    assert got == want


def test_near_duplicates_odd(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id is None} == {None}
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.u: r.root for r in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_need_no_round_when_small(spark, monkeypatch):
    """Few edges are finished by one task; rounds run while there are more, and give the same."""
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(a) or star(*a))
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randint(-150, 150), rng.randint(-150, 150)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1040)], "u long, v long").repartition(5)
    got = sorted(components.roots(edges).collect())
    assert not rounds and len(got) > 100
    for single in (100, 0):
        monkeypatch.setattr(components, "SINGLE", single)
        assert sorted(components.roots(edges).collect()) == got and rounds
        rounds.clear()


# --- secrets ---


SECRET_RULES = [
    (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
]


def test_secret_rules_equal_brute_force():
    rng = random.Random(3)
    parts = ["token", "PassWord", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "AKIA", "A1B2C3D4", "0a1b2c3d", "deadbeef", "x", "\n", "ſecret", "é", "hunter2=="]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = sorted((m.start(), k, m.end()) for k, (p, f, ok) in enumerate(SECRET_RULES) for m in re.finditer(p, t, f) if ok(m))
        assert [s[:3] for s in secrets.base_spans(t)] == want


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(n))


def hexes(rng, n=18):
    return "".join(rng.choice("abcdef0123456789") for _ in range(n))


@pytest.fixture(scope="module")
def secret_docs():
    """(documents, secrets planted in forms that the rules miss)."""
    rng = random.Random(11)
    docs = [(i, f"{prose(rng, 40)} password={hexes(rng)} {prose(rng, 30)} token = \"{hexes(rng, 36)}\" {prose(rng, 10)}") for i in range(200)]
    docs += [(i, prose(rng, rng.randint(20, 200)) + f", page {rng.randint(1, 999)}, call +{rng.randint(1, 10**9)} or a.b{i}@mail.example.com!") for i in range(200, 500)]
    forms = (
        lambda: ("passcode = \"", hexes(rng), "\""), lambda: ("", hexes(rng, 36).upper(), ""), lambda: ("key ", hexes(rng), ","),
    )
    planted = {}
    for i in range(1000, 1040):
        before, value, behind = forms[i % len(forms)]()
        head = f"{prose(rng, 25)} {before}"
        docs.append((i, f"{head}{value}{behind} {prose(rng, 25)}"))
        planted[i] = (len(head), len(head) + len(value))
    return docs + [(1901, None), (1902, "")], planted


def test_field_adds_what_rules_miss(spark, secret_docs):
    docs, planted = secret_docs
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secrets.find(spark.createDataFrame(docs, DOCS)).collect()}
    base = {i: {(s[0], s[2]) for s in secrets.base_spans(t or "")} for i, t in docs}
    hits = sum(any(a == p[0] and e >= p[1] for a, e in set(got[i]) - base[i]) for i, p in planted.items())
    extra = sum(len(set(got[i]) - base[i]) for i, _ in docs)
    assert hits >= 0.9 * len(planted) and hits >= 0.9 * extra, (hits, len(planted), extra)
    assert all(base[i] <= set(got[i]) for i, _ in docs) and not any(got[i] for i in [*range(200, 500), 1901, 1902])


def test_pruned_decoding_is_exact(secret_docs):
    """Against Viterbi over all tokens, in texts with short, long and symbol tokens too; no form of token is left out."""
    docs, _ = secret_docs
    rng = random.Random(6)
    sequences = [w[2:] for i, t in docs[:300] if t for w in secrets.windows(t, i < 200)]
    field = secrets.train(sequences)
    offset = dict(field.weights)
    offset["bias"] = (offset["bias"][0] - 3.0, *offset["bias"][1:])  # so that much is tagged
    odd = [f"token = \"x7q\" für {hexes(rng, 70)} %%% {prose(rng, 9)} {rng.choice(['a', '7', '=', 'A1#'])} é" for _ in range(30)]
    for f in (field, secrets.Field(offset, field.moves)):
        for text in [t for _, t in docs[:40] + docs[480:]] + odd:
            marks = list(secrets.TOKEN.finditer(text or ""))
            tokens = [m[0] for m in marks]
            if tokens:
                whole = f.score(secrets.file_features(text))
                rows = [[a + b for a, b in zip(whole, f.score(secrets.own_features(t) + secrets.near_features(tokens, i)))] for i, t in enumerate(tokens)]
                want, at = [], None
                for i, tag in enumerate(f.viterbi(rows)):
                    if tag == secrets.INSIDE and at == i - 1:
                        want[-1] = (want[-1][0], marks[i].end())
                        at = i
                    elif tag != secrets.OUT:
                        want.append((marks[i].start(), marks[i].end()))
                        at = i
                assert f.tag(text) == want


def test_secret_windows_and_sample(spark, monkeypatch):
    rng = random.Random(8)
    many = " ".join(f"{prose(rng, 3)} token={hexes(rng, 30)}" for _ in range(50))
    assert len(secrets.windows(many, True)) == 50  # each value, however many
    tokens, tags, _ = secrets.tagged("token = \"" + "a1" * 35 + "\" x7q9z0 " + "Ab3" * 6)
    assert tags[tokens.index("a1" * 35)] == secrets.BEGIN and tags[tokens.index("Ab3" * 6)] == secrets.UNKNOWN
    assert secrets.own_features("a1" * 35) != secrets.own_features("a1" * 30 + "-" * 10)  # the whole token counts
    trained = []
    monkeypatch.setattr(secrets, "train", lambda sequences: trained.append(sequences) or secrets.Field({}, [[0.0] * 3] * 3))
    docs = spark.createDataFrame([(i, f"the same token={'ab12' * 9} again") for i in range(100_000)] + [(i, f"{prose(rng, 5)} token={hexes(rng, 30)}") for i in range(40)], DOCS)
    secrets.fit(docs)
    assert 25 <= len(trained[0]) <= 41  # the text that stands a hundred thousand times is one


def test_secrets_odd(spark, odd_docs):
    got = secrets.find(odd_docs).collect()
    assert len(got) == 10 and all(r.spans == "" for r in got) and secrets.find(empty(spark)).count() == 0


# --- toxicity ---


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.2)
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vile", "Scum,", "moron"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(d, lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit / sum(truth[r.doc_id] for r in held) > 0.85 and hit / sum(r.predicted for r in held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score(d, flipped).collect()} == {r.doc_id: r.score for r in rows}
    assert toxicity.clean(d, lab).count() == sum(not r.predicted for r in rows)


def plain_ftrl(rows, epochs=toxicity.EPOCHS):
    """FTRL-proximal by its definition, a weight at a time: z, n and w of each index."""
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((b + n[i] ** 0.5) / a + l2)

    for _ in range(epochs):
        for indexes, label in rows:
            at = [*map(int, indexes), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()))))) - label
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_the_definition():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(300):
        toxic = rng.random() < 0.3
        words = rng.choices(vocabulary, k=12) + (["vile", "scum"] if toxic else [])
        rng.shuffle(words)
        rows.append((toxicity.features(" ".join(words)), int(toxic)))
    weights, bias, _ = toxicity.train(rows)
    want = plain_ftrl([r for i, r in enumerate(rows) if i % 10])
    assert bias == pytest.approx(want.pop("bias", 0.0), abs=1e-9)
    assert weights.keys() == want.keys() and all(weights[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_toxicity_features_equal_brute_force():
    def plain(text):
        words = [w.strip(toxicity.EDGES.decode()) for w in text.lower().split()]
        return {(w,) for w in words} | set(zip(words, words[1:])) | {("skip", *p) for p in zip(words, words[2:])}

    rng = random.Random(4)
    seen = {}
    for _ in range(300):
        text = " ".join(rng.choice(["One,", "two", "THREE!", "é", "(x)", "y"]) for _ in range(rng.randint(0, 9)))
        index = toxicity.features(text)
        assert len(index) == len(plain(text)) and seen.setdefault(frozenset(plain(text)), index.tolist()) == index.tolist()


def test_repeated_ids_are_learnt_once(spark, monkeypatch):
    got = []
    monkeypatch.setattr(toxicity, "train", lambda rows: got.append(rows) or ({}, 0.0, (1.0, 0.0)))
    docs = spark.createDataFrame([(4, f"text {i % 7} of one id") for i in range(30_000)] + [(5, "a b " * 40 + x) for x in "cd"], DOCS).repartition(7)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (4, 5)], "doc_id long, quality int, toxic int")
    toxicity.score(docs, labels).count()
    toxicity.score(docs.repartition(3), labels).count()
    assert [len(r) for r in got] == [len(got[0])] * 2 and len(got[0]) <= 2 and [x.tolist() for x, _ in got[0]] == [x.tolist() for x, _ in got[1]]


def test_toxicity_odd(spark, odd_docs):
    labels = spark.createDataFrame([(4, None, 1), (4, None, 0), (None, 1, 1), (5, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd_docs, labels).count() == 10
    assert toxicity.score(empty(spark), labels).count() == 0 and toxicity.score(odd_docs, labels.limit(0)).count() == 10
    assert toxicity.clean(odd_docs, labels).columns == odd_docs.columns
