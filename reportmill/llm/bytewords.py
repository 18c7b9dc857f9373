"""Words of an Arrow string column as numpy arrays: their places and 64-bit hashes, without Python strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text goes alone).
BLOCK_BYTES = 2 << 20
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 48

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x + _K1
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def byte_table(word_bytes) -> np.ndarray:
    """For each byte 0 if it parts words, else the byte, A-Z as a-z."""
    table = np.zeros(256, np.uint8)
    for b in word_bytes:
        table[b] = b + 32 if 65 <= b <= 90 else b
    return table


#: Anything but the six ASCII spaces makes words.
NOT_SPACE = byte_table(b for b in range(256) if b not in (9, 10, 11, 12, 13, 32))
#: ASCII letters and digits and everything outside ASCII.
WORD_CHARS = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: As WORD_CHARS without digits.
LETTERS = byte_table([*range(65, 91), *range(97, 123), *range(128, 256)])

_SCATTER = mix(np.arange(1, 257, dtype=np.uint64) * _K3)


@dataclass
class Words:
    """Words of a block of texts. row_start[i]:row_start[i + 1] are the words of text i; start and end are bytes from the text's block."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_start: np.ndarray
    prefix: dict[int, np.ndarray] = field(default_factory=dict)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_start) - 1), np.diff(self.row_start))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], (at - at[0] if len(at) else np.zeros(1, np.int64))


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about BLOCK_BYTES."""
    if not batch.num_rows:
        return
    data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the texts data[at[i]:at[i + 1]]. prefixes: also hashes of the first so many bytes (0 for shorter words)."""
    low = table[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    cut = np.zeros(len(low) + 1, bool)
    cut[at] = True
    begins = inside[1:] & (~inside[:-1] | cut)
    ends = inside[:-1] & (~inside[1:] | cut)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    length = end - start
    h = np.zeros(len(start), np.uint64)
    live = np.flatnonzero(length <= LONG_WORD)
    out = Words(start, end, h, np.searchsorted(start, at))
    at_byte, state, n = start[live], np.zeros(len(live), np.uint64), length[live]
    wanted = {k: np.zeros(len(start), np.uint64) for k in prefixes}
    for j in range(LONG_WORD + 1):
        if j in wanted:
            wanted[j][live] = mix(state ^ np.uint64(j << 56))
        done = n == j
        if done.any():
            h[live[done]] = state[done]
            keep = ~done
            live, at_byte, state, n = live[keep], at_byte[keep], state[keep], n[keep]
        if not len(live):
            break
        state = state * _BASE + _SCATTER[low[at_byte + j]]
    for i in np.flatnonzero(length > LONG_WORD):
        word = low[start[i] : end[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        for k in prefixes:
            state1 = np.zeros(1, np.uint64)
            for b in word[:k]:
                state1 = state1 * _BASE + _SCATTER[b : b + 1]
            wanted[k][i] = mix(state1 ^ np.uint64(k << 56))[0]
    out.hash = mix(h ^ (length.astype(np.uint64) << np.uint64(48)))
    out.prefix = wanted
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
