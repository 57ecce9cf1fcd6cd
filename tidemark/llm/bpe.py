"""Byte-level BPE by dynamic programming over prefixes.

Let last[i] be the last token of the encoding of the first i bytes of a piece. The encoding of a prefix is the encoding
of a shorter prefix followed by last[i], and last[i] is the only token that ends at i and whose pair with the token
before it survives merging (merging the bytes of the pair gives the pair back). So a table of one token id per byte
encodes a piece; appending bytes extends the table without touching it, and an edit keeps the table up to the edit.

Null text counts as empty: no tokens. Empty text has no tokens. Repeated rows are encoded alike. Any text length works;
time is linear in the bytes of a piece, up to the vocabulary's longest token. What a worker remembers is bounded by bytes.
An empty table gives an empty result; columns besides key and text play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Bytes of pieces that a worker remembers at most, in two generations; and for how many of these bytes it remembers a
#: pair of tokens, of some 130 bytes.
REMEMBERED, PER_PAIR = 64 << 20, 220
#: Bytes that Python takes for a remembered piece besides its text and ids.
ENTRY = 190
#: Bytes of a piece's head, and heads whose tables a worker remembers at most, of some 200 bytes each.
HEAD, HEADS = 5, 100_000
#: Characters of a piece from which on it isn't remembered.
LONGEST = 200
#: Above every rank.
NEVER = 1 << 60


class Bpe:
    """ranks: bytes of each token -> its id, lower ids merging first; all single bytes are among them."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        self._most, self._most_pairs = remembered, remembered // PER_PAIR
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, tuple] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0
        self._alone: dict[int, bool] = {}
        self._heads: dict[bytes, tuple[int, ...]] = {}
        #: By the last four bytes, the lengths from four on of tokens that end so; by the last three and two bytes, if they
        #: are a token, that length. Shorter lengths follow where they are tokens too, so the longest comes first.
        four: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                four.setdefault(token[-4:], set()).add(len(token))
        short = lambda end: {n for n in range(1, len(end) + 1) if end[-n:] in ranks}
        ordered = lambda lengths: tuple(sorted(lengths, reverse=True))
        self._four = {end: ordered(lengths | short(end[-3:])) for end, lengths in four.items()}
        self._three = {token: ordered(short(token)) for token in ranks if len(token) == 3}
        self._two = {token: ordered(short(token)) for token in ranks if len(token) == 2}

    @classmethod
    def from_file(cls, path: str, remembered: int = REMEMBERED) -> Bpe:
        """A file of lines: base64 of the token's bytes, a space, its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, remembered)

    def _merged(self, piece: bytes, least: int = 1) -> list[int]:
        """Encoding by its definition: merge the adjacent pair of lowest rank, leftmost first, down to `least` parts.

        Only for the bytes of a token.
        """
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spines(self, token: int) -> tuple[list[bytes], list[int], list[bytes], list[int]]:
        """What touches the token's right and its left end while its bytes merge, from a byte up to the whole, with ranks."""
        if (known := self._edges.get(token)) is None:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                known = ([whole], [token, NEVER], [whole], [token, NEVER])
            else:
                a, b = self._merged(whole, 2)
                rights, right_ranks, _, _ = self._spines(b)
                _, _, lefts, left_ranks = self._spines(a)
                known = ([*rights, whole], [*right_ranks[:-1], token, NEVER], [*lefts, whole], [*left_ranks[:-1], token, NEVER])
            self._edges[token] = known
        return known

    def _fits(self, before: int, token: int) -> bool:
        """Whether token may follow before: no merge across their boundary comes before those within them.

        before < 0: whether it may begin a piece. Merges come by rank, at equal ranks leftmost first.
        """
        if before < 0:
            if (ok := self._alone.get(token)) is None:
                ok = self._alone[token] = self._merged(self.bytes_of[token]) == [token]
            return ok
        if (ok := self._pairs.get(before << 32 | token)) is not None:
            return ok
        xs, x_ranks, _, _ = self._spines(before)
        _, _, ys, y_ranks = self._spines(token)
        i = j = 0
        while True:
            across, x_next, y_next = self.ranks.get(xs[i] + ys[j], NEVER), x_ranks[i + 1], y_ranks[j + 1]
            if across < x_next and across <= y_next:
                ok = False
                break
            if x_next == y_next == NEVER:
                ok = self._fits(-1, token)
                break
            if x_next <= y_next:
                i += 1
            else:
                j += 1
        if len(self._pairs) > self._most_pairs:
            self._pairs.clear()
        self._pairs[before << 32 | token] = ok
        return ok

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Adds to last, which covers a prefix of piece, the last token of each longer prefix."""
        pairs, fits, one = self._pairs.get, self._fits, (1,)
        four, three, two, of = self._four.get, self._three.get, self._two.get, self.ranks.get
        for end in range(len(last) + 1, len(piece) + 1):
            lengths = (end > 3 and four(piece[end - 4 : end])) or (end > 2 and three(piece[end - 3 : end])) or (end > 1 and two(piece[end - 2 : end])) or one
            for n in lengths:
                if n < end:
                    token = of(piece[end - n : end])
                    if token is None:
                        continue
                    before = last[end - n - 1]
                    ok = pairs(before << 32 | token)
                    if fits(before, token) if ok is None else ok:
                        last.append(token)
                        break
                elif n == end and (token := of(piece[:end])) is not None and fits(-1, token):
                    last.append(token)
                    break
            else:
                raise ValueError("no token of the vocabulary ends here; single bytes are missing")
        return last

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix that ends at end, from the table."""
        out, end = [], len(last) if end is None else end
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, as in the usual encoders.

        Tables of the first HEAD bytes are remembered: a piece that begins like one before it goes on from there.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= HEAD:
            return self.walk(self.extend(piece, []))
        head = piece[:HEAD]
        if (table := self._heads.get(head)) is None:
            if len(self._heads) > HEADS:
                self._heads.clear()
            table = self._heads[head] = tuple(self.extend(head, []))
        return self.walk(self.extend(piece, list(table)))

    def encode_packed(self, text: str, split) -> bytes:
        """The ids of a text's pieces as split gives them, as unsigned 32-bit integers of this machine.

        Pieces are remembered, packed, in two generations: when the young one is full it becomes the old one, and what
        is asked for again comes back from there.
        """
        if self._held > self._most // 2:
            self._young, self._old, self._held = {}, self._young, 0
        young, old, pieces = self._young, self._old, split(text)
        found = list(map(young.get, pieces))
        if None in found:
            for k, piece in enumerate(pieces):
                if found[k] is None:
                    packed = young.get(piece) or old.get(piece)
                    if packed is None:
                        packed = array("I", self.encode_piece(piece.encode())).tobytes()
                    if len(piece) <= LONGEST:
                        if piece not in young:
                            self._held += ENTRY + len(piece) + len(packed)
                        young[piece] = packed
                    found[k] = packed
        return b"".join(found)

    def encode(self, text: str, split) -> list[int]:
        return array("I", self.encode_packed(text, split)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


class Encoded:
    """A text, its pieces and their prefix tables; it can grow at its end and change inside without a fresh encoding.

    The pattern looks ahead but never behind, so pieces depend only on where the piece before them ended. A change can
    move at most the last two pieces before it ("'" and "r" become "'re"), and once a piece begins where one began
    before the change, beyond the changed part, all later pieces are the old ones.
    """

    def __init__(self, bpe: Bpe, pattern: str, text: str = ""):
        self.bpe, self.pattern, self.text = bpe, regex.compile(pattern), ""
        self.starts: list[int] = []
        self.tables: list[tuple[str, list[int]]] = []
        self.reused = self.computed = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """text[start:end] becomes new."""
        text, moved = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        k = max(0, sum(s < start for s in self.starts) - 3)
        old = {s + moved: i for i, s in enumerate(self.starts) if s >= end}
        at, starts, tables, tail = self.starts[k] if k < len(self.starts) else 0, self.starts[:k], self.tables[:k], len(self.starts)
        k0 = k
        for m in self.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in old:
                tail = old[m.start()]
                break
            before = self.tables[k0] if k0 < len(self.tables) and self.starts[k0] == m.start() else None
            k0 += 1
            starts.append(m.start())
            tables.append((m[0], self._table(m[0], before)))
        self.starts = starts + [s + moved for s in self.starts[tail:]]
        self.tables = tables + self.tables[tail:]
        self.text = text

    def _table(self, piece: str, before: tuple[str, list[int]] | None) -> list[int]:
        raw, last = piece.encode(), []
        if before:
            was = before[0].encode()
            same = next((i for i, (x, y) in enumerate(zip(raw, was, strict=False)) if x != y), min(len(raw), len(was)))
            last = before[1][:same]
        self.reused += len(last)
        self.computed += len(raw) - len(last)
        return self.bpe.extend(raw, last)

    def ids(self) -> list[int]:
        out = []
        for piece, table in self.tables:
            whole = self.bpe.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.bpe.walk(table)
        return out


@lru_cache(maxsize=2)
def _loaded(path: str, remembered: int = REMEMBERED) -> Bpe:
    """Kept with what it remembers for as long as the worker lives."""
    return Bpe.from_file(path, remembered)


def encoder(path: str, pattern: str):
    """The vocabulary, and a function from a text to its ids."""
    bpe, split = _loaded(path), regex.compile(pattern).findall
    return bpe, lambda text: bpe.encode(text, split)


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit integers from their bytes, without an object for each."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))]))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of each whole text, in a map over the rows: no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        bpe, split = _loaded(path), regex.compile(pattern).findall
        return lambda keys, texts: (keys, _lists([bpe.encode_packed(t or "", split) for t in texts]))

    return map_rows(docs, [key, text], make, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, the decoded text's bytes."""
    kind = tokens.schema[key].dataType.simpleString()

    def make():
        bpe = _loaded(path)
        return lambda keys, rows: (keys, [bpe.decode(r or []) for r in rows])

    return map_rows(tokens, [key, ids], make, f"`{key}` {kind}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each whole text (and its ids): encoded, then decoded from the ids.

    One map over the rows. Without the ids, they leave the worker only as digests. remembered: bytes of pieces that a worker
    keeps at most; less costs time, not results.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        bpe, split = _loaded(path, remembered), regex.compile(pattern).findall
        decimal, of = {i: b"%d" % i for i in bpe.bytes_of}, bpe.bytes_of

        def run(keys, texts):
            counts, shas, decoded, every = [], [], [], []
            for t in texts:
                packed = bpe.encode_packed(t or "", split)
                ids = memoryview(packed).cast("I")
                counts.append(len(ids))
                shas.append(hashlib.sha256(b",".join([decimal[i] for i in ids])).hexdigest())
                decoded.append(hashlib.sha256(b"".join([of[i] for i in ids])).hexdigest())
                if with_ids:
                    every.append(packed)
            return (keys, counts, shas, decoded, _lists(every)) if with_ids else (keys, counts, shas, decoded)

        return run

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, [key, text], make, schema + ", ids array<int>" * with_ids)
