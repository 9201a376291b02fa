"""Byte-level BPE by dynamic programming over prefixes.

For byte-pair merging every prefix of a piece has exactly one encoding, hence
one last token. `PrefixTable` stores that token for each prefix: the token
ending at byte i is the only vocabulary entry t for which the prefix before it
ends in a token u such that merging the bytes of u and t leaves them apart.
Whether two tokens stay apart is decided by undoing their merges step by step
and asking at each step if a merge across the border would have come first.

The table needs nothing but the prefix, so appending bytes keeps all entries
(exact appends), and after an edit only entries from the edit on change, and
only until as many entries as the longest token has bytes agree with the old.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from .common import ship

#: Distinct pieces, and token pairs, that a worker keeps; past that it starts anew.
CACHE_ENTRIES = 400_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary, with the splits that its merges imply."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for piece, rank in ranks.items():
            self.token_bytes[rank] = piece
        self.text = [str(i) for i in range(self.size)]
        self.longest = max(map(len, ranks))
        self._splits: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        #: The tokens that merging their own bytes gives; only these can end a prefix.
        self.usable = {piece: rank for piece, rank in ranks.items() if len(piece) == 1 or self.split(rank)[0] != rank}

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From the text of a rank file: base64 of a token and its rank on each line."""
        pairs = (line.split() for line in content.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made `token`; (token, token) for what isn't made by merges."""
        known = self._splits.get(token)
        if known is None:
            known = self._splits[token] = self._last_merge(token)
        return known

    def _last_merge(self, token: int) -> tuple[int, int]:
        parts = [self.token_bytes[token][i : i + 1] for i in range(len(self.token_bytes[token]))]
        while len(parts) > 2:
            rank, i = min(((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1)))
            if rank >= token:
                return token, token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged together, come out as these two tokens."""
        key = left * self.size + right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > CACHE_ENTRIES:
                self._apart.clear()
            known = self._apart[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        first = self.size  # merges of this rank and later can't have happened yet
        while True:
            joined = self.ranks.get(self.token_bytes[left] + self.token_bytes[right])
            if joined is not None and joined < first:
                return False
            # Undo the later of the two sides' last merges; among equal ranks the left one happened first.
            undo_left = left > right
            for side in (undo_left, not undo_left):
                if side and len(self.token_bytes[left]) > 1:
                    first, left = left, self.split(left)[1]
                    break
                if not side and len(self.token_bytes[right]) > 1:
                    first, right = right + 1, self.split(right)[0]
                    break
            else:
                return True


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def _fill(self, piece: bytes, last: list[int], end: int) -> None:
        """Add the entry of piece[:end]; those of all shorter prefixes are there."""
        v = self.vocabulary
        get, known, size = v.usable.get, v._apart.get, v.size
        for start in range(end - v.longest if end > v.longest else 0, end):
            token = get(piece[start:end])
            if token is not None:
                if start:
                    before = last[start - 1]
                    stays = known(before * size + token)
                    if stays is None:
                        stays = v.apart(before, token)
                    if not stays:
                        continue
                last.append(token)
                return
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Add bytes; entries of the old prefixes stay as they are."""
        start = len(self.piece)
        self.piece += more
        for end in range(start + 1, len(self.piece) + 1):
            self._fill(self.piece, self.last, end)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace bytes; returns how many entries were computed."""
        piece = self.piece[:at] + inserted + self.piece[at + removed :]
        last, shift, agree, done = self.last[:at], len(inserted) - removed, 0, 0
        for end in range(at + 1, len(piece) + 1):
            self._fill(piece, last, end)
            old = end - 1 - shift
            done += 1
            agree = agree + 1 if end > at + len(inserted) and 0 <= old < len(self.last) and self.last[old] == last[-1] else 0
            if agree >= self.vocabulary.longest:
                last += self.last[old + 1 :]
                break
        self.piece, self.last = piece, last
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.token_bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts: split by the pattern, then encode each match on its own."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        # White space as Unicode has it, the same for any regular-expression library.
        spaces = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pattern = pattern.replace(r"[^\s", f"[^{spaces}").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
        self.vocabulary, self.find = vocabulary, regex.compile(pattern)
        self._known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        known = self._known.get(text)
        if known is None:
            if len(self._known) > CACHE_ENTRIES:
                self._known.clear()
            data = text.encode()
            token = self.vocabulary.ranks.get(data)
            known = (token,) if token is not None else tuple(PrefixTable(self.vocabulary, data).tokens())
            if len(data) <= 64:
                self._known[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.find.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids))

    def document(self, text: str) -> EncodedText:
        return EncodedText(self, text)


class EncodedText:
    """A text with its pieces' tokens, kept up to date under edits."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.ends, self.pieces = [], []
        for m in encoder.find.finditer(text):
            self.ends.append(m.end())
            self.pieces.append(encoder.piece(m[0]))

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; returns how many pieces were split anew.

        Splitting starts a piece before the one that the edit touches (the
        pattern looks one character ahead) and stops at the first old border
        behind the edit where both splits meet.
        """
        first = max(0, bisect_right(self.ends, max(0, start - 1)) - 1)
        begin = self.ends[first - 1] if first else 0
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        old = {e: i for i, e in enumerate(self.ends) if e > end}
        ends, pieces, rest = [], [], len(self.ends)
        for m in self.encoder.find.finditer(text, begin):
            ends.append(m.end())
            pieces.append(self.encoder.piece(m[0]))
            if m.end() > start + len(new) and m.end() - shift in old:
                rest = old[m.end() - shift] + 1
                break
        self.ends = self.ends[:first] + ends + [e + shift for e in self.ends[rest:]]
        self.pieces = self.pieces[:first] + pieces + self.pieces[rest:]
        self.text = text
        return len(pieces)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.pieces))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(content: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary.parse(content), pattern)
    return _ENCODERS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text, ids: the tokens of every whole text (a row for each row).

    The rank file is read on the driver and broadcast: its size is that of the
    vocabulary. Null texts count as empty, and empty ones have no tokens.
    """
    return _map(docs, ranks_path, pattern, "doc_id bigint, ids array<int>", False)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_tokens and the digests of the ids and of the decoded bytes.

    Null texts count as empty; an empty text has no tokens and the digests of
    the empty string. Repeated rows and null doc_ids keep a row each, an empty
    table gives none, and other columns are not read.
    """
    return _map(docs, ranks_path, pattern, SCHEMA, True)


def _map(docs: DataFrame, ranks_path: str, pattern: str, schema: str, digest: bool) -> DataFrame:
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_for(content.value, pattern)
        text_of = encoder.vocabulary.text.__getitem__
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows: list[list] = [[] for _ in range(3)]
            for scalar in batch.column(1):
                ids = encoder.encode(scalar.as_py() or "")
                if digest:
                    for column, value in zip(rows, (len(ids), sha(",".join(map(text_of, ids)).encode()), sha(encoder.decode(ids))), strict=True):
                        column.append(value)
                else:
                    rows[0].append(ids)
            kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.list_(pa.int32()),)
            names = ("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids",)
            columns = [pa.array(r, k) for r, k in zip(rows, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
