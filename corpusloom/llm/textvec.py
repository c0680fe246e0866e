"""Vectorised text primitives shared by the Python-side operators.

An Arrow string column is one byte buffer plus row offsets, so words, word hashes and
n-gram hashes of a whole batch are array expressions over that buffer.

Words are told apart by their bytes, eight at a time (`Words.distinct`). Their hashes have
two halves of 64 bits: a word of up to seven bytes is spread by a bijection, so two of them
never meet, and a longer one gets a BLAKE2 digest. Sequences of words are hashed step by step
(`sequence_hashes`), where whoever writes the texts can't make sums agree. Only `rolling_hashes`
are sums, modulo 2**64; they may pick places, but equality is never taken from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; one longer text is handled alone.
CHUNK_BYTES = 512 << 10

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits (a bijection)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Bytes of a word that are looked at as numbers; what lies behind them is compared as bytes.
LONG = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


@lru_cache(1 << 15)
def _kept_digest(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=16).digest()


def _digest(word: bytes) -> bytes:
    return _kept_digest(word) if len(word) <= LONG else hashlib.blake2b(word, digest_size=16).digest()


def forget() -> None:
    """Let go of digests, and of powers that a long text called for."""
    _kept_digest.cache_clear()
    for base, have in list(_powers.items()):
        if len(have) > CHUNK_BYTES + (CHUNK_BYTES >> 2):
            del _powers[base]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] from prefix_sums(values)."""
    return (sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts]


def byte_class(outside: bytes) -> np.ndarray:
    """Lookup table: True for the bytes that words consist of, all but `outside`."""
    table = np.ones(256, dtype=bool)
    table[list(outside)] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r")


class Words:
    """The words of a batch of texts: `starts`, `ends` in `data`, `ptr` the first word of each row."""

    def __init__(self, column: pa.Array, inside: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None):
        self.data, self.offsets = buffer_of(column)
        data = self.data if fold is None else fold[self.data]
        self.data = data
        word = inside[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        firsts = self.offsets[:-1]
        firsts = firsts[firsts < len(data)]
        begin[firsts] |= word[firsts]
        finish = word.copy()
        finish[:-1] &= ~word[1:]
        lasts = self.offsets[1:] - 1
        lasts = lasts[lasts >= 0]
        finish[lasts] |= word[lasts]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.ptr = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.ptr)
        self._distinct: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def _eights(self, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which of them reach so far, their eight bytes there) from byte 0, 8, ... on; zeros behind a word's end."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        starts, size, out = self.starts[which], (self.ends - self.starts)[which], []
        for j in range(0, LONG, 8):
            here = np.flatnonzero(size > j) if j else np.arange(len(which))
            if not len(here):
                break
            out.append((here, at[starts[here] + j] & _LOW[np.minimum(size[here] - j, 8)]))
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct word, each word's number among them), by their bytes."""
        if self._distinct is None:
            size, every = self.ends - self.starts, np.arange(len(self))
            eights = self._eights(every)
            quick = mix(size.astype(np.uint64))
            for here, value in eights:
                quick[here] = mix((quick[here] ^ value) * np.uint64(_BASE))
            first, back = numbered(quick)
            # Whatever shares a hash with an unlike word is looked at by itself.
            other = size != size[first[back]]
            for here, value in eights:
                held = np.zeros(len(self), np.uint64)
                held[here] = value
                other |= held != held[first[back]]
            number: dict[bytes, int] = {}
            places = first.tolist()
            for i in np.flatnonzero(other | (size > LONG)).tolist():
                word = self.data[self.starts[i] : self.ends[i]].tobytes()
                if not other[i] and word == self.data[self.starts[first[back[i]]] : self.ends[first[back[i]]]].tobytes():
                    continue
                if word not in number:
                    number[word] = len(places)
                    places.append(i)
                back[i] = number[word]
            self._distinct = np.array(places, dtype=np.int64), back
        return self._distinct

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word, 128 bits together."""
        first, back = self.distinct()
        size = (self.ends - self.starts)[first]
        eights = self._eights(first)
        one = mix((eights[0][1] if eights else np.zeros(0, np.uint64)) | size.astype(np.uint64) << np.uint64(56))
        two = mix(one ^ np.uint64(_INVERSE))
        longer = np.flatnonzero(size > 7)
        if len(longer):
            raw = self.data.tobytes()
            spelt = [raw[a:b] for a, b in zip(self.starts[first[longer]].tolist(), self.ends[first[longer]].tolist(), strict=True)]
            halves = np.frombuffer(b"".join(map(_digest, spelt)), "<u8").reshape(-1, 2)
            one[longer], two[longer] = halves[:, 0], halves[:, 1]
        return one[back], two[back]

    def hashes(self) -> np.ndarray:
        return self.digests()[0]

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct hash, each hash's number among them), without sorting: equal hashes
    find the same place of a table, and those that find it taken try another."""
    n, bits = len(hashes), max(4, 2 * len(hashes)).bit_length()
    chosen, rest, key = np.empty(n, np.int64), np.arange(n), hashes * np.uint64(_BASE)
    table = np.empty(1 << bits, np.int64)
    while len(rest):
        slot = (key >> np.uint64(64 - bits)).astype(np.int64)
        table[slot] = rest
        holder = table[slot]
        same = hashes[holder] == hashes[rest]
        chosen[rest[same]] = holder[same]
        rest, key = rest[~same], (key[~same] ^ key[~same] >> np.uint64(17)) * np.uint64(_INVERSE)
    own = chosen == np.arange(n)
    return np.flatnonzero(own), (np.cumsum(own) - 1)[chosen]


def sequence_hashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of values[start : start + n] for each start, and of n."""
    out = np.full(len(starts), n, np.uint64)
    for k in range(n):
        out = mix((out ^ values[starts + k]) * np.uint64(_BASE))
    return out


def window_hashes(word_hashes: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one row: (index of its first word, hash)."""
    at = window_starts(ptr, n)
    return at, sequence_hashes(word_hashes, at, n)


def rolling_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, rows apart or not, in time that does not grow with n. Equal
    runs hash alike, but others can be made to; it may pick places, and no more."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(word_hashes) - n + 1)
    return mix(slice_hashes(prefix_sums(word_hashes), at, at + n))


def window_starts(ptr: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words from which n words follow in the same row, itself included."""
    fit = np.maximum(np.diff(ptr) - n + 1, 0)
    return ranges(ptr[:-1], fit)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated start, start + 1, ... of each length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def covered(n: int, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Flags of the positions below n inside any [start, start + length)."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks[:-1]) > 0


def runs(flags: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the runs of flagged words, counted inside their rows."""
    first = np.zeros(len(flags) + 1, bool)
    first[ptr] = True
    before = np.concatenate([[False], flags[:-1]])
    begin = np.flatnonzero(flags & (~before | first[:-1]))
    row = np.searchsorted(ptr, begin, side="right") - 1
    stops = np.append(np.flatnonzero(~flags), len(flags))
    end = np.minimum(stops[np.searchsorted(stops, begin)], ptr[row + 1])
    return row, begin - ptr[row], end - ptr[row]


def span_lists(row: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: int) -> pa.Array:
    """The runs as a list of (begin, end) for each row."""
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (begin, end)], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), spans)


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most `most` bytes together, or one row."""
    if not batch.num_rows:
        return
    sizes = np.diff(buffer_of(batch.column(text))[1])
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total + size > most and i > begin:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    yield batch.slice(begin)


def crc32_mod4(column: pa.Array) -> np.ndarray:
    """crc32 of each id as text, modulo 4."""
    import zlib

    return np.array([zlib.crc32(str(x).encode()) % 4 for x in column.to_pylist()], dtype=np.int64)
