"""Batch encoder for a word-end BPE vocabulary file of the `tokenizers` library.

White space never reaches a token, so a text's ids are its words' ids in turn. Words are
made distinct per batch and kept between batches by their bytes; those of ASCII and Latin-1 letters, digits and signs are
merged all at once as arrays, any other word goes to the tokenizer itself. The ids equal
`Tokenizer.encode(text, add_special_tokens=False).ids`. Ids are kept in 16 bits, so a
vocabulary of more than 65,536 is refused.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa

from corpusloom.llm import textvec

NO_RANK = np.int32(2**31 - 1)
#: A table's place that holds no pair.
EMPTY = np.uint64(2**64 - 1)
#: Distinct words whose ids a worker keeps between batches.
KEPT_WORDS = 200_000
#: Longer words go to the tokenizer itself.
LONGEST = 64


def _byte_symbols() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    spare = iter(range(256, 512))
    return [out.get(b) or chr(next(spare)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids are kept in 16 bits; the vocabulary has more")
        symbols = _byte_symbols()
        self.byte_id = np.array([[vocab[s] for s in symbols], [vocab[s + end] for s in symbols]], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.uint32)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self._index(keys, np.arange(len(keys), dtype=np.int32), made)
        self._latin()
        self.forget()

    def _index(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """A table by multiplicative hash; a pair whose place is taken goes to the next table."""
        self.made, self.tables = made, []
        while len(keys):
            slot = self._slot(keys, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << 19, EMPTY)
            table[slot[first]] = keys[first].astype(np.uint64) << np.uint64(32) | ranks[first].astype(np.uint64)
            self.tables.append(table)
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        return (keys * np.uint32((2654435761 + 0x61C88646 * level) & 0xFFFFFFFF | 1)) >> np.uint32(13)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        found = self.tables[0][self._slot(keys, 0)]
        other = (found >> np.uint64(32)) != keys
        out = (found & np.uint64(NO_RANK)).astype(np.int32)
        out[other] = NO_RANK
        # Only a pair whose place another has taken may be in the next table.
        rest = np.flatnonzero(other & (found != EMPTY))
        for level in range(1, len(self.tables)):
            found = self.tables[level][self._slot(keys[rest], level)]
            hit = (found >> np.uint64(32)) == keys[rest]
            out[rest[hit]] = (found[hit] & np.uint64(NO_RANK)).astype(np.int32)
            rest = rest[~hit & (found != EMPTY)]
        return out

    def _ranks_at(self, at: np.ndarray, symbol: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place."""
        out = np.full(len(at), NO_RANK, np.int32)
        after = np.minimum(at + 1, len(symbol) - 1)
        joint = np.flatnonzero((piece[at] == piece[after]) & (after > at))
        out[joint] = self._rank(symbol[at[joint]], symbol[after[joint]])
        return out

    def _latin(self) -> None:
        """Class of each character below 256: 0 left to the tokenizer, 1 letter, 2 digit, 3 sign."""
        kind, lower = np.zeros(256, np.uint8), np.arange(256)
        for c in range(33, 256):
            category, low = unicodedata.category(chr(c)), chr(c).lower()
            if c in (0x27, 0x3C, 0x3E, 0x7F) or 0x80 <= c <= 0xA0 or len(low) != 1 or ord(low) > 255:
                continue  # apostrophes may open a suffix, and < a special token
            kind[c], lower[c] = 1 if category[0] == "L" else 2 if category[0] == "N" else 3, ord(low)
        self.kind, self.lower = kind, lower

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets into them)."""
        words = textvec.Words(column)
        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(len(column) + 1, np.int64)
        first, back = words.distinct()
        place = self._learn(words, first)
        size = self.size[place][back]
        ids = self.flat[textvec.ranges(self.begin[place][back], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[words.ptr]

    def _learn(self, words: textvec.Words, first: np.ndarray) -> np.ndarray:
        """Where the ids of these words are kept."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        raw = words.data.tobytes()
        spelt = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        place = np.fromiter(map(self.known.get, spelt, repeat(-1)), np.int64, len(spelt))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip([spelt[i] for i in new.tolist()], place[new].tolist(), strict=True))
            ids, size = self._encode_words(words.data, words.starts[first[new]], words.ends[first[new]])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])
        return place

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = ends - starts
        at = textvec.ranges(starts, length)
        raw, owner = data[at].astype(np.int64), np.repeat(np.arange(len(starts)), length)
        # Two-byte sequences of Latin-1 become one character each.
        lead = (raw == 0xC2) | (raw == 0xC3)
        char = raw.copy()
        char[:-1][lead[:-1]] = ((raw[:-1] & 3) << 6 | raw[1:] & 63)[lead[:-1]]
        tail = np.zeros(len(raw), bool)
        tail[1:] = lead[:-1]
        odd = (raw >= 0x80) & ~lead & ~tail
        plain = np.ones(len(starts), bool)
        plain[owner[odd | (self.kind[np.minimum(char, 255)] == 0) & ~tail]] = False
        plain[length > LONGEST] = False
        keep = ~tail & plain[owner]
        ids, size = self._merge(char[keep], owner[keep], len(starts))
        slow = np.flatnonzero(~plain)
        if not len(slow):
            return ids, size
        texts = [bytes(data[starts[i] : ends[i]]).decode("utf-8", "replace") for i in slow]
        own = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        flat = np.concatenate([ids, *(np.array(x, np.int64) for x in own)])
        begin = np.cumsum(size) - size
        size[slow] = [len(x) for x in own]
        begin[slow] = len(ids) + np.cumsum(size[slow]) - size[slow]
        return flat[textvec.ranges(begin, size)], size

    def _merge(self, char: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(char):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        kind, low = self.kind[char], self.lower[char]
        cut = np.ones(len(char), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        piece = np.cumsum(cut) - 1
        two = low >= 0x80
        width = 1 + two
        last = np.ones(len(char), bool)
        last[:-1] = cut[1:]
        place = np.cumsum(width) - width
        symbol = np.empty(int(width.sum()), np.int64)
        symbol[place] = self.byte_id[(last & ~two).astype(int), np.where(two, 0xC0 | low >> 6, low)]
        symbol[place[two] + 1] = self.byte_id[last[two].astype(int), 0x80 | low[two] & 63]
        piece = np.repeat(piece, width)
        owners = owner[cut]
        symbol, piece = symbol.astype(np.int32), piece.astype(np.int32)
        rank = self._ranks_at(np.arange(len(symbol)), symbol, piece)
        done_symbol, done_piece = [], []
        while len(symbol):
            heads = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.concatenate([heads, [len(symbol)]]))
            ended = least == NO_RANK
            if ended.any():
                rest = np.repeat(ended, sizes)
                done_symbol.append(symbol[rest])
                done_piece.append(piece[rest])
                rest = ~rest
                symbol, piece, rank, sizes, least = symbol[rest], piece[rest], rank[rest], sizes[~ended], least[~ended]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # In a run of overlapping hits every other one counts, from the left.
            close = (np.diff(at) == 1) & (piece[at[1:]] == piece[at[:-1]])
            if close.any():
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~close]), np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, piece, rank = symbol[left], piece[left], rank[left]
            at -= np.arange(len(at))
            rank[at] = self._ranks_at(at, symbol, piece)
            before = at[at > 0] - 1
            rank[before] = self._ranks_at(before, symbol, piece)
        symbol, piece = np.concatenate(done_symbol), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return symbol[order], np.bincount(owners[piece], minlength=n).astype(np.int64)


_made: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """The encoder of a file, read once by a worker."""
    if path not in _made:
        _made.clear()
        _made[path] = WordBPE(path)
    return _made[path]


def forget() -> None:
    """Let go of the words that the encoder keeps."""
    for made in _made.values():
        made.forget()
