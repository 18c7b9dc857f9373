"""Byte-level BPE encoding and decoding of whole texts by a file of ranks.

Bytes are mapped to the Latin-1 characters of the same numbers, so that an Aho-Corasick automaton of strings finds every
token that begins anywhere in a piece in one pass. A sequence of tokens is what merging by ranks gives if and only if
every two neighbours are what merging gives of their joint bytes: merges within a token don't depend on what stands beside
it, and the first merge across a border would also happen between these two alone. So a piece is encoded by taking the
longest token that can follow the one before, a shorter one where none can, and by going back where a place has no
token left. Places found to lead nowhere are remembered and each is left once, so time is linear in the piece's length.
Whether two tokens can be neighbours is told by merging their bytes, once for each pair that a worker meets.

Tokens that merging never makes from their own bytes are only used where they are a whole piece, as the library does.
Each match of the pattern is a piece; special strings are ordinary text. Pieces that a worker has seen are remembered.

Null text counts as empty and has no ids; decoding null or no ids gives no bytes. Empty tables give empty results, repeated rows
repeated results; very long texts are read piece by piece. Other columns are passed through if asked for by name. Bytes
that no token stands for can't be encoded, and ids without a token can't be decoded: both raise an error.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .token_counts import LONG_TEXT, PATTERN

#: So many pieces, of so many characters at most, and so many pairs of tokens are remembered by a worker; then it starts anew.
REMEMBERED, LONG_PIECE, PAIRS = 250_000, 64, 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings: a line has one in base64, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Ranks:
    """The vocabulary as workers need it: token bytes, and what is made of them."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)

    @functools.cached_property
    def token(self) -> dict[int, bytes]:
        return {i: raw for raw, i in self.ranks.items()}

    @functools.cached_property
    def merged(self) -> Callable[[bytes], list[int]]:
        """Ids of a short byte string by merging: the leftmost of the neighbours with the lowest rank, until none has one."""
        ranks = self.ranks

        def merge(raw: bytes) -> list[int]:
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if rank == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]

        return merge

    @functools.cached_property
    def made(self) -> list[bytes]:
        """Tokens that merging makes of their own bytes, in the order of their lengths."""
        return sorted((raw for raw, i in self.ranks.items() if self.merged(raw) == [i]), key=len)


class Encoder:
    """Ids of pieces, as bytes: four a token, least first."""

    def __init__(self, ranks: Ranks, made: list[bytes]):
        import ahocorasick

        self.ranks, self.merged = ranks.ranks, ranks.merged
        self.automaton = ahocorasick.Automaton()
        #: The next shorter token that begins as this one does, or -1.
        self.shorter: dict[int, int] = {}
        self.length: dict[int, int] = {}
        known = set(made)
        for raw in made:
            i = self.ranks[raw]
            self.length[i] = len(raw)
            self.shorter[i] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in known), -1)
            self.automaton.add_word(raw.decode("latin-1"), (len(raw) - 1, i))
        self.automaton.make_automaton()
        self.raw = {i: raw for raw, i in self.ranks.items() if raw in known}
        self.pairs: dict[int, bool] = {}

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether a and b are what merging gives of their joint bytes: worked out, and remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        told = self.pairs[a << 32 | b] = self.merged(self.raw[a] + self.raw[b]) == [a, b]
        return told

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, known, out = piece.decode("latin-1"), self.pairs.get, []
        # Most pieces are the longest matches one after the other.
        before = covered = 0
        for end, (back, token) in self.automaton.iter_long(text):
            if end - back != covered:
                break
            if covered:
                told = known(before << 32 | token)
                if told is None:
                    told = self._neighbours(before, token)
                if not told:
                    break
            out.append(token)
            before, covered = token, end + 1
        return out if covered == len(piece) else self._search(text, out, covered)

    def _search(self, text: str, out: list[int], at: int) -> list[int]:
        """Ids of a piece whose first tokens (out, up to `at`) are the longest, each a neighbour of the one before."""
        n, known = len(text), self.pairs.get
        longest = [-1] * n
        for end, (back, i) in self.automaton.iter(text):
            longest[end - back] = i  # later ends are longer tokens
        dead = bytearray(n + 1)
        token = longest[at] if at < n else -1
        while at < n:
            while token >= 0:
                if not dead[at + self.length[token]]:
                    if not out:
                        break
                    told = known(out[-1] << 32 | token)
                    if told is None:
                        told = self._neighbours(out[-1], token)
                    if told:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < n else -1
            elif out:
                # Nothing can follow: the token before goes, and a shorter one is tried in its place.
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
            else:
                raise ValueError("bytes that no sequence of tokens stands for")
        return out


class _Pieces(dict):
    """Packed ids of pieces, made on first sight."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encoder.ids(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


def packer(encoder: Encoder, pattern: str = PATTERN) -> Callable[[str], bytes]:
    """A function from text to its packed ids."""
    import regex

    find, pieces = regex.compile(pattern), _Pieces(encoder)

    def pack(text: str) -> bytes:
        if len(text) > LONG_TEXT:
            return b"".join(pieces[m.group()] for m in find.finditer(text))
        return b"".join(map(pieces.__getitem__, find.findall(text)))

    return pack


def _mapped(df: DataFrame, column: str, keep: tuple[str, ...], out: str, convert: Callable[[], Callable[[object], bytes]]) -> DataFrame:
    """keep columns, and `out`: bytes that the function made by convert (once a task) gives for the column's values."""
    kept = df.select(*keep, F.col(column).alias("__value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = convert()
        for batch in batches:
            made = [one(v.as_py()) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.binary())], [*keep, out])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[: len(keep)], StructField(out, BinaryType())]))


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep columns and ids of every row: its text's token ids as unsigned 32-bit integers, least byte first.

    The file of ranks is read and its tokens are tried on the driver; ranks and tokens (some 2 MB) are broadcast.
    """
    ranks = Ranks(ranks_path)
    told = docs.sparkSession.sparkContext.broadcast((ranks.ranks, ranks.made))

    name = uuid.uuid4().hex

    def convert() -> Callable[[object], bytes]:
        pack = packer(_encoder(name, told), pattern)
        return lambda value: pack(value or "")

    return _mapped(docs, text, keep, ids, convert)


#: The last encoder that this worker has made; its tasks share what it has remembered of pairs.
_LAST: dict[str, Encoder] = {}


def _encoder(name: str, told) -> Encoder:
    if name not in _LAST:
        own = Ranks.__new__(Ranks)
        own.ranks, made = told.value
        _LAST.clear()
        _LAST[name] = Encoder(own, made)
    return _LAST[name]


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "bytes") -> DataFrame:
    """keep columns and the bytes that the packed ids of every row stand for (valid UTF-8 if they encode a text)."""
    told = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def convert() -> Callable[[object], bytes]:
        token = {i: raw for raw, i in told.value.items()}
        return lambda value: b"".join(map(token.__getitem__, np.frombuffer(value or b"", "<u4").tolist()))

    return _mapped(rows, ids, keep, out, convert)
