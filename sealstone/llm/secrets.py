"""Secrets: fixed rules plus a linear-chain conditional random field over tokens.

Base spans follow three fixed rules and always stay. The field tags each token
as begin of a secret, inside one or outside, from the token's shape, the words
around it and features of the whole file; Viterbi finds the best tags. Runs
tagged as secret are added unless a base span of their kind covers them.

It is trained here on positive and unlabelled tokens. The values that the rules
find are positive, plain tokens are outside, and long tokens of letters and
digits that no rule accepts are unlabelled: they may take any tag, so training
sums over their tags (a field with partly known tags). Half of the positive
windows are masked: the keyword before the value is taken out, and the value is
put in capitals or shortened in two of three, so that the field can't lean on
what the rules look for. An offset of "outside" is then set on held-out masked
windows: the one nearest to none that finds RECALL of the values (or as many as
any offset does) while TARGET of what it tags is positive; if there is none, the
field adds nothing.

Training reads at most SAMPLE distinct texts of each sort (with and without a
base match), the first by hash, and at most WINDOWS distinct windows of 2 *
WINDOW + 1 tokens of each sort, again the first by hash; no other step is
bounded.

Most words of a corpus can't be tagged as secret whatever stands around them:
their own score for "outside" leads by more than quiet neighbours, file and
transitions can add. Such words are known after one look-up; Viterbi runs on
the others and on tokens near words that push for a secret, with the same
result as on all.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEXLIKE = re.compile(r"[0-9A-Fa-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = {"assign": 6, "access": 20, "hex": 24}
TOKEN = re.compile(r"\w+(?:[+/.-]+\w+)*|[^\s\w]")
WORD = re.compile(r"\S+")
#: What no rule may have told about: letters and digits in one long token.
UNLABELLED = re.compile(r"(?=.*[A-Za-z].*[A-Za-z])(?=.*[0-9].*[0-9])[A-Za-z0-9+/_=-]{12,}")
#: What a secret could be taken for: tokens with digits, inner capitals or of great length.
ODD = re.compile(r"[0-9]|[a-z][A-Z]|\w{16}")
OUT, BEGIN, INSIDE = range(3)
UNKNOWN = -1
SAMPLE = 1_000
WINDOWS = 1_500
WINDOW = 12
ITERATIONS = 80
L2 = 0.0003
RECALL, TARGET = 0.95, 0.9
OFFSETS = [x / 2 for x in range(-6, 17)]
#: A neighbour that pushes for a secret by more than this makes its surroundings worth decoding.
QUIET = 0.1
#: Names of neighbours count as features if they occur so often in training.
LEAST_SEEN = 8
#: Of the tokens beside a name, the share that must be secret for the name of a word to be a feature; symbols always are.
TELLING = 0.5
#: Words whose margins a worker keeps, and tokens whose scores it keeps.
CACHE_WORDS, CACHE_TOKENS = 1_200_000, 150_000

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def has_keyword(text: str) -> bool:
    lower = text.lower()
    return any(k in lower for k in KEYWORDS)


def base_spans(text: str, keyword: bool | None = None, words: list[str] | None = None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of all base spans, by start, then kind."""
    out = []
    if has_keyword(text) if keyword is None else keyword:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if max(map(len, text.split() if words is None else words), default=0) >= LEAST["hex"]:
        for word in WORD.finditer(text):
            if word.end() - word.start() >= LEAST["hex"]:
                out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text, word.start(), word.end()) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


# --- features ------------------------------------------------------------------------------------


RUN = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7f]+|[\x00-\x7f]")
DIGIT = re.compile(r"[0-9]")


def _shape(token: str) -> str:
    """Classes of characters in order of first sight, and how often they change (as a power of two)."""
    marks = ["X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" else "9" if "0" <= c <= "9" else c if c < "\x80" else "w" for c in (run[0] for run in RUN.findall(token))]
    return f"{''.join(dict.fromkeys(marks))}{len(marks).bit_length()}"


def _size(n: int) -> int:
    return min(n.bit_length(), 8)


def own_features(token: str) -> list[str]:
    digits, upper, lower = DIGIT.search(token) is not None, token != token.lower(), token != token.upper()
    kinds = f"{digits:d}{upper or lower:d}{upper:d}{lower:d}"
    variety = round(4 * len(set(token)) / max(1, len(token)))
    out = ["bias", f"shape={_shape(token)}", f"size={_size(len(token))}", f"kinds={kinds}/{_size(len(token))}", f"variety={variety}/{_size(len(token))}"]
    if len(token) <= 12 and not digits:
        out.append(f"word={token.lower()}")
    if len(token) >= 16 and HEXLIKE.fullmatch(token):
        out.append("hexlike")
    return out


def _name(token: str) -> str:
    return token.lower() if len(token) <= 10 and not DIGIT.search(token) else _shape(token)


PLACES = {"p1": -1, "p2": -2, "p3": -3, "n1": 1}


def near_features(tokens: list[str], i: int) -> list[str]:
    """The names of the three tokens before and the one behind; each has its own group."""
    at = lambda j: _name(tokens[j]) if 0 <= j < len(tokens) else "-"
    return [f"{place}={at(i + by)}" for place, by in PLACES.items()]


def file_features(text: str, keyword: bool | None = None) -> list[str]:
    keyword = has_keyword(text) if keyword is None else keyword
    return [f"file_size={_size(len(text) >> 8)}", f"file_key={keyword:d}", f"file_lines={_size(text.count(chr(10)))}"]


class _Cache(dict):
    """What `work` gives for words, found at first sight; a bounded number of short ones is kept."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, word: str):
        value = self.work(word)
        if len(self) > self.most:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


# --- the field -----------------------------------------------------------------------------------


NO_PUSHES = (0.0,) * len(PLACES), ((0.0, 0.0, 0.0),) * len(PLACES)


class Field:
    """Weights of a linear-chain field with tags OUT, BEGIN, INSIDE."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self._own: dict[str, list[float]] = {}
        self._forms: dict[tuple, list[float]] = {}
        #: How far every token of a white-space word is from any tag but OUT among quiet words, file features aside.
        self.margins = _Cache(lambda word: min((self.tokens[t][0] for t in TOKEN.findall(word)), default=math.inf), CACHE_WORDS)
        #: Of a token: the same, -inf if it pushes its neighbours; its own lead; the push on the neighbour at each place; and their weights.
        self.tokens = _Cache(self._token, CACHE_TOKENS)
        turns = [max(moves[a][y] + moves[y][b] - moves[a][OUT] - moves[OUT][b] for a in range(3) for b in range(3)) for y in (BEGIN, INSIDE)]
        ends = [max(max(moves[a][y] - moves[a][OUT], moves[y][a] - moves[OUT][a]) for a in range(3)) for y in (BEGIN, INSIDE)]
        #: The most that transitions can add to BEGIN and INSIDE.
        self.slack = [max(turns[k], ends[k], 0.0) for k in range(2)]
        self.named = {name.partition("=")[2] for name in weights if name.partition("=")[0] in PLACES}
        self.edge = self._pushes("-")

    def score(self, names: list[str]) -> list[float]:
        total = [0.0, 0.0, 0.0]
        for name in names:
            w = self.weights.get(name)
            if w:
                total = [a + b for a, b in zip(total, w)]
        return total

    def own(self, token: str) -> list[float]:
        """Score of a token's own features. Plain letter words that carry no weight of their own
        score by their form, so most words of a corpus need no features."""
        n = len(token)
        if token.isascii() and token.isalpha() and (n > 12 or f"word={token.lower()}" not in self.weights):
            form = 0 if token.islower() else 1 if token.istitle() else 2 if token.isupper() else 3
            if form < 3 and not (n >= 16 and HEXLIKE.fullmatch(token)):
                key = (form, _size(n), round(4 * len(set(token)) / n))
                known = self._forms.get(key)
                if known is None:
                    known = self._forms[key] = self.score(own_features(token))
                return known
        known = self._own.get(token)
        if known is None:
            if len(self._own) > CACHE_TOKENS:
                self._own.clear()
            known = self.score(own_features(token))
            if n <= 40:
                self._own[token] = known
        return known

    def _pushes(self, name: str) -> tuple[tuple[float, ...], tuple]:
        if name not in self.named:
            return NO_PUSHES
        rows = tuple(self.weights.get(f"{place}={name}", (0.0, 0.0, 0.0)) for place in PLACES)
        return tuple(max(w[BEGIN], w[INSIDE]) - w[OUT] for w in rows), rows

    def _token(self, token: str) -> tuple:
        pushes, rows = self._pushes(_name(token))
        own = self.own(token)
        lead = min(own[OUT] - own[k + 1] - self.slack[k] for k in range(2))
        return -math.inf if max(pushes) > QUIET else lead - len(PLACES) * QUIET, lead, pushes, rows

    def viterbi(self, scores: list[list[float]]) -> list[int]:
        """Best tags of tokens with given scores; ties go to the earlier tag."""
        best, back = scores[0], []
        for row in scores[1:]:
            came = [max(range(3), key=lambda a, y=y: (best[a] + self.moves[a][y], -a)) for y in range(3)]
            best = [best[a] + self.moves[a][y] + row[y] for y, a in enumerate(came)]
            back.append(came)
        tag = max(range(3), key=lambda y: (best[y], -y))
        tags = [tag]
        for came in reversed(back):
            tag = came[tag]
            tags.append(tag)
        return tags[::-1]

    def tag(self, text: str, keyword: bool | None = None, words: list[str] | None = None) -> list[tuple[int, int]]:
        """(start, end) of the runs of tokens tagged as secret."""
        whole = self.score(file_features(text, keyword))
        gain = max(whole[BEGIN], whole[INSIDE]) - whole[OUT]
        if min(map(self.margins.__getitem__, text.split() if words is None else words), default=math.inf) > gain:
            return []
        marks = list(TOKEN.finditer(text))
        tokens = [m[0] for m in marks]
        known = [self.tokens[t] for t in tokens]
        n, edge = len(tokens), (0.0, 0.0, *self.edge)
        near = lambda i: [known[i + by] if 0 <= i + by < n else edge for by in PLACES.values()]
        closer = {j for i, x in enumerate(known) if x[0] <= gain for j in range(i - 1, i + 4) if 0 <= j < n}
        open_ = [i for i in sorted(closer) if known[i][1] - sum(x[2][k] for k, x in enumerate(near(i))) <= gain]
        runs: list[list[int]] = []
        for i in open_:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        outside, found = [0.0, -math.inf, -math.inf], []
        for run in runs:
            rows = [list(map(sum, zip(whole, self.own(tokens[i]), *(x[3][k] for k, x in enumerate(near(i)))))) for i in run]
            before, behind = run[0] > 0, run[-1] + 1 < len(tokens)
            tags = self.viterbi([outside] * before + rows + [outside] * behind)[before : before + len(run)]
            for i, tag in zip(run, tags):
                if tag == INSIDE and found and found[-1][2] == i - 1:
                    found[-1] = (found[-1][0], marks[i].end(), i)
                elif tag != OUT:
                    found.append((marks[i].start(), marks[i].end(), i))
        return [(a, b) for a, b, _ in found]


def tagged(text: str) -> tuple[list[str], list[int], list[int]]:
    """(tokens, tags, for each token the place of the first token of its assignment or -1) of a whole text."""
    marks = list(TOKEN.finditer(text))
    # Values that overlap (an assignment of a hex string) are one.
    values: list[list[int]] = []
    for a, _, e, v in sorted(base_spans(text), key=lambda s: s[3]):
        if values and v < values[-1][2]:
            values[-1] = [min(a, values[-1][0]), values[-1][1], max(e, values[-1][2])]
        else:
            values.append([a, v, e])
    tags, heads, k, open_ = [], [], 0, None
    first: dict[int, int] = {}
    for i, m in enumerate(marks):
        while k < len(values) and values[k][2] <= m.start():
            k += 1
        hit = k if k < len(values) and values[k][1] < m.end() else None
        if k < len(values) and values[k][0] < m.end():
            first.setdefault(k, i)
        if hit is None:
            tags.append(UNKNOWN if UNLABELLED.fullmatch(m[0]) else OUT)
        else:
            tags.append(INSIDE if hit == open_ else BEGIN)
        heads.append(-1 if hit is None else first[k])
        open_ = hit
    return [m[0] for m in marks], tags, heads


def _mark(*parts) -> int:
    return int(hashlib.md5("\t".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def _masked(tokens: list[str], tags: list[int], at: int, head: int, by: int) -> tuple[list[str], list[int], int]:
    """Tokens and tags without what stands before the value at `at` in its assignment; the value as it is, in capitals, or half of it."""
    value = (tokens[at], tokens[at].upper(), tokens[at][: max(12, len(tokens[at]) // 2)])[by % 3]
    return tokens[:head] + [value] + tokens[at + 1 :], tags[:head] + tags[at:], head


def centres(text: str, positive: bool) -> Iterator[tuple[int, bool, list[str], list[int], int]]:
    """(hash, masked, tokens, tags, place of the centre) of the stretches around a text's values, or around two tokens chosen by hash, one of them ODD."""
    tokens, tags, heads = tagged(text)
    if positive:
        chosen = [i for i, t in enumerate(tags) if t == BEGIN]
    else:
        odd = [i for i, t in enumerate(tokens) if ODD.search(t)]
        chosen = sorted({some[_mark(j, text) % len(some)] for j, some in enumerate((range(len(tokens)), odd)) if some})
    for c in chosen:
        lo, hi = max(0, c - 2 * WINDOW), min(len(tokens), c + 2 * WINDOW)
        near, tag, at = tokens[lo:hi], tags[lo:hi], c - lo
        by = _mark(at, *near)
        masked = positive and by % 4 < 2
        if masked:
            near, tag, at = _masked(near, tag, at, max(0, heads[c] - lo), by >> 4)
        yield by, masked, near, tag, at


def window(whole: list[str], near: list[str], tag: list[int], at: int) -> tuple[list[str], list[int]]:
    """Names of features of each token around the centre (joined by tabs), and its tags."""
    part = range(max(0, at - WINDOW), min(len(near), at + WINDOW + 1))
    return ["\t".join(own_features(near[i]) + near_features(near, i) + whole) for i in part], [tag[i] for i in part]


def windows(text: str, positive: bool) -> list[tuple[int, bool, list[str], list[int]]]:
    """All training windows of a text: (hash, masked, rows, tags)."""
    whole = file_features(text)
    return [(by, masked, *window(whole, near, tag, at)) for by, masked, near, tag, at in centres(text, positive)]


def _lse(a, axis):
    import numpy as np

    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _marginals(e, moves, mask):
    """(marginals of tags, sums over windows of those of tag pairs) of padded windows with scores `e`."""
    import numpy as np

    length = e.shape[1]
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, length):
        forward[:, t] = np.where(mask[:, t, None], _lse(forward[:, t - 1, :, None] + moves, 1) + e[:, t], forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        backward[:, t] = np.where(mask[:, t + 1, None], _lse(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0.0)
    z = _lse(forward[:, -1], 1)
    both = mask[:, 1:] & mask[:, :-1]
    pair = np.exp(forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])[both].sum(axis=0)
    return np.exp(forward + backward - z[:, None, None]), pair


def train(sequences: list[tuple[list[str], list[int]]]) -> Field:
    """Maximum likelihood of the known tags with an L2 penalty, by full-batch Adagrad over padded windows.

    The gradient is the difference of two marginals: with all tags free, and with
    known tags held (tokens of tag UNKNOWN stay free).
    """
    import numpy as np

    seen, secret = Counter(), Counter()
    for rows, tags in sequences:
        for row, tag in zip(rows, tags):
            seen.update(row.split("\t"))
            if tag > OUT:
                secret.update(row.split("\t"))

    def counts(name: str) -> bool:
        place, _, value = name.partition("=")
        if place not in PLACES:
            return seen[name] > 1
        return seen[name] >= LEAST_SEEN and (not value.isalnum() or secret[name] >= TELLING * seen[name])

    names = {name: i for i, name in enumerate(filter(counts, sorted(seen)))}
    n, length = len(sequences), max((len(tags) for _, tags in sequences), default=1)
    pad = len(names)
    width = max((row.count("\t") + 1 for rows, _ in sequences for row in rows), default=1)
    x, y, mask = np.full((n, length, width), pad), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for s, (rows, tags) in enumerate(sequences):
        for t, row in enumerate(rows):
            ids = [names[k] for k in row.split("\t") if k in names]
            x[s, t, : len(ids)] = ids
        y[s, : len(tags)], mask[s, : len(tags)] = tags, True
    held = np.where((y[..., None] == np.arange(3)) | (y[..., None] == UNKNOWN) | ~mask[..., None], 0.0, -1e4)
    w, moves = np.zeros((pad + 1, 3)), np.zeros((3, 3))
    gw, gm = np.full_like(w, 1e-3), np.full_like(moves, 1e-3)
    flat = x[mask]
    for _ in range(ITERATIONS if n else 0):
        e = w[x].sum(axis=2)
        free, free_pairs = _marginals(e, moves, mask)
        known, known_pairs = _marginals(e + held, moves, mask)
        change = (free - known)[mask]
        grad = np.zeros_like(w)
        for k in range(width):
            for tag in range(3):
                grad[:, tag] += np.bincount(flat[:, k], change[:, tag], pad + 1)
        grad, pair = grad / n + L2 * w, (free_pairs - known_pairs) / n + L2 * moves
        grad[pad] = 0
        gw += grad**2
        gm += pair**2
        w -= 0.5 * grad / np.sqrt(gw)
        moves -= 0.5 * pair / np.sqrt(gm)
    return Field({k: tuple(w[i].tolist()) for k, i in names.items()}, moves.tolist())


def calibrated(field: Field, held: list[tuple[list[str], list[int]]]) -> tuple[Field, dict]:
    """`field` with the offset of OUT set on held-out masked windows, and what it reaches there.

    Recall counts values found (their first token tagged), precision the tagged
    tokens whose tag is known. Without such windows the field stays as it is;
    where TARGET can't be reached it tags nothing.
    """
    scores = [([field.score(row.split("\t")) for row in rows], tags) for rows, tags in held]
    if not sum(BEGIN in tags for _, tags in held):
        return field, {}
    reached = []
    for offset in OFFSETS:
        found = values = right = wrong = 0
        for rows, tags in scores:
            got = field.viterbi([[r[0] + offset, r[1], r[2]] for r in rows])
            values += tags.count(BEGIN)
            found += sum(t == BEGIN and g != OUT for t, g in zip(tags, got))
            right += sum(t > OUT and g != OUT for t, g in zip(tags, got))
            wrong += sum(t == OUT and g != OUT for t, g in zip(tags, got))
        reached.append({"offset": offset, "recall": found / values, "precision": right / max(1, right + wrong), "windows": len(held)})
    most = max(r["recall"] for r in reached)
    good = [r for r in reached if r["recall"] >= min(RECALL, most) and r["precision"] >= TARGET]
    best = min(good, key=lambda r: (abs(r["offset"]), r["offset"])) if good else {"offset": 1e4, "recall": 0.0, "precision": 0.0, "windows": len(held)}
    weights = dict(field.weights)
    bias = weights.get("bias", (0.0, 0.0, 0.0))
    weights["bias"] = (bias[0] + best["offset"], bias[1], bias[2])
    return Field(weights, field.moves), best


ROUGH = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|akia[a-z0-9]{16}|[0-9a-f]{24}"


def fit(docs: DataFrame) -> Field:
    """Train and calibrate on windows of the SAMPLE first distinct texts by hash of each sort.

    The texts are chosen by their hashes alone, so a text that stands a
    million times is one of them and no text is shuffled; then of each sort the
    WINDOWS first distinct windows by hash are fetched.
    """
    ship(docs.sparkSession)
    h = F.xxhash64("text", F.lit("sample")).alias("h")
    texts = docs.where(F.col("text").isNotNull())
    distinct = scratch(texts.select(h, F.lower("text").rlike(ROUGH).alias("hit")).groupBy("h").agg(F.max("hit").alias("hit")), "secret_texts")
    first = [r for hit in (True, False) for r in distinct.where(F.col("hit") == hit).orderBy("h").limit(SAMPLE).collect()]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in first], "h bigint, hit boolean")  # 2 * SAMPLE rows at most

    def cut(batches: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa

        kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()))
        seen, heaps, held = set(), {True: [], False: []}, set()
        for batch in batches:
            for i, mark in enumerate(batch.column(0).to_pylist()):
                if mark in seen:
                    continue
                seen.add(mark)
                text, hit = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                whole, heap = file_features(text), heaps[hit]
                for by, *stretch in centres(text, hit):
                    if (hit, by) in held or len(heap) == WINDOWS and -heap[0][0] <= by:
                        continue
                    held.add((hit, by))
                    if len(heap) == WINDOWS:
                        held.discard((hit, -heapq.heapreplace(heap, (-by, whole, stretch))[0]))
                    else:
                        heapq.heappush(heap, (-by, whole, stretch))
        rows = [(-by, hit, masked, *window(whole, *around)) for hit, heap in heaps.items() for by, whole, (masked, *around) in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["by", "hit", "masked", "rows", "tags"])

    cuts = texts.select(h, "text").join(F.broadcast(chosen), "h").mapInArrow(cut, "by bigint, hit boolean, masked boolean, rows array<string>, tags array<int>")
    cuts = scratch(cuts, "secret_windows")
    kept = []
    for hit in (True, False):
        mine = cuts.where(F.col("hit") == hit).dropDuplicates(["by"]).orderBy("by").limit(WINDOWS).collect()
        kept += sorted((r.by, r.masked, list(r.rows), list(r.tags)) for r in mine)
    held = [(rows, tags) for by, masked, rows, tags in kept if (by >> 8) % 5 == 0 and (masked or BEGIN not in tags)]
    return calibrated(train([(rows, tags) for by, _, rows, tags in kept if (by >> 8) % 5]), held)[0]


def _kind(value: str) -> int:
    """The kind of an added span, by its form: hex digits in either case, an access key, else as of an assignment."""
    return 2 if len(value) >= LEAST["hex"] and HEXLIKE.fullmatch(value) else 1 if value.startswith("AKIA") else 0


def scan(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text as (start, kind, end), by start, then kind.

    A run that the field tags is added unless it touches a base span of its own
    kind. So a hex key in capitals counts as hex even as the value of an
    assignment.
    """
    keyword, words = has_keyword(text), text.split()
    base = [(a, k, e) for a, k, e, _ in base_spans(text, keyword, words)]
    added, at, reach = [], 0, [0, 0, 0]
    for a, e in field.tag(text, keyword, words):
        while at < len(base) and base[at][0] < e:
            reach[base[at][1]] = max(reach[base[at][1]], base[at][2])
            at += 1
        kind = _kind(text[a:e])
        if reach[kind] <= a:
            added.append((a, kind, e))
    return base, sorted(base + added)


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: counts, digest of the base spans, and all spans.

    Null texts count as empty; empty ones have no spans. Repeated rows and null
    doc_ids keep a row each, an empty table gives none, other columns are not
    read. Without any base match in the corpus the field learns that nothing
    is secret.
    """
    field = fit(docs)
    model = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))  # bounded by WINDOWS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        field = Field(*model.value)
        listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = scan(text.as_py() or "", field)
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
