"""Operator 6, benchmark decontamination: document words run through a suffix automaton.

The automaton holds every word sequence of every normalised test item. Running a document
through it keeps, at each word, the longest sequence ending there that some item contains:
where that is a whole window's length, the window is hit; where a short item's end state is
on the suffix links within that length, the short item is hit. Words that no item has reset
the automaton, as do word pairs that no item has, so those are found by array look-ups first
and only the stretches between them are stepped through, all of a batch side by side.

Items are put into automata of at most BLOCK_WORDS words each. The driver builds one at a
time and lays it out as flat arrays (some 50 bytes a word). Up to PASS_WORDS words of items
are one broadcast, whose automata a task runs one after the other over each batch; a larger
benchmark takes a written pass of the documents for each further PASS_WORDS. A word is met by
its hash and, where it may be hit, compared byte by byte with the item's.

Defined results: a null text has no words (a null document is clean and stays null, a null
item is no window); items that share an item_id count once; a null item_id is written as an
empty string; rows that repeat have equal results; an empty benchmark hits nothing; other
columns, whatever their names, are carried in the struct `carried`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm import storage, textvec, workers

WINDOW = 10
#: Words of items in one automaton, and in all that a task holds.
BLOCK_WORDS = 100_000
PASS_WORDS = 2_000_000

#: Lower-cases A-Z and turns all that `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` excludes into spaces.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_INSIDE = textvec.byte_class(b" ")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD.tobytes()).split()


class Builder:
    """Generalised suffix automaton of word sequences, with the items that its states stand for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        #: Items whose sequences end in a state of a window's length or more, and short whole ones.
        self.own: dict[int, set[int]] = {}
        self.whole: dict[int, set[int]] = {}
        pairs = set()
        for name, words in items:
            state, ids = 0, [self.ids.setdefault(w, len(self.ids)) for w in words]
            pairs.update(zip(ids, ids[1:], strict=False))
            for w in ids:
                state = self._extend(state, w)
                if self.length[state] >= window:
                    self.own.setdefault(state, set()).add(number[name])
            if 0 < len(ids) < window:
                self.whole.setdefault(state, set()).add(number[name])
        # An item that holds a state's longest sequence holds that of every suffix link.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if state in self.own and self.length[up] >= window:
                self.own.setdefault(up, set()).update(self.own[state])
        self.pairs = np.array(sorted(a * len(self.ids) + b for a, b in pairs), dtype=np.int64)
        self.least = min([window, *(len(words) for _, words in items if words)])

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.length.append(length)
        self.link.append(self.link[state])
        return len(self.next) - 1

    def _redirect(self, p: int, w: int, old: int, new: int) -> None:
        while p != -1 and self.next[p].get(w) == old:
            self.next[p][w] = new
            p = self.link[p]

    def _extend(self, last: int, w: int) -> int:
        have = self.next[last].get(w)
        if have is not None:
            if self.length[have] == self.length[last] + 1:
                return have
            clone = self._clone(have, self.length[last] + 1)
            self.link[have] = clone
            self._redirect(last, w, have, clone)
            return clone
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, p = len(self.next) - 1, last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            if self.length[q] != self.length[p] + 1:
                clone = self._clone(q, self.length[p] + 1)
                self._redirect(p, w, q, clone)
                self.link[q] = clone
                q = clone
            self.link[new] = q
        return new


def _grouped(sets: dict[int, set[int]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by state, values) of a few states' sets."""
    size = np.zeros(states + 1, np.int64)
    for state, found in sets.items():
        size[state + 1] = len(found)
    return np.cumsum(size).astype(np.int32), np.array([x for state in sorted(sets) for x in sorted(sets[state])], dtype=np.int32)


class Automaton:
    """A built automaton as arrays, which runs many word sequences side by side."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        made = Builder(items, window)
        self.window, self.names, self.least, self.pairs, self.words = window, made.names, made.least, made.pairs, len(made.ids)
        self.length, self.link = np.array(made.length, dtype=np.int32), np.array(made.link, dtype=np.int32)
        count = len(made.next)
        key = np.array([state * max(1, self.words) + w for state, out in enumerate(made.next) for w in out], dtype=np.int64)
        to = np.array([t for out in made.next for t in out.values()], dtype=np.int32)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        # The state on the suffix links that stands for a window, and the nearest that is a short item.
        self.top, self.near = np.zeros(count, np.int32), np.zeros(count, np.int32)
        for state in np.argsort(self.length, kind="stable")[1:].tolist():
            up = made.link[state]
            self.top[state] = state if made.length[up] < window else self.top[up]
            self.near[state] = state if state in made.whole else self.near[up]
        self.item_at, self.items = _grouped({s: x for s, x in made.own.items() if self.top[s] == s}, count)
        self.short_at, self.shorts = _grouped(made.whole, count)
        raw = list(made.ids)
        self.size = np.array([len(w) for w in raw], dtype=np.int64)
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)
        hashes = textvec.Words(pa.array(raw, pa.binary()), _INSIDE).hashes() if raw else np.zeros(0, np.uint64)
        self.word_id = np.argsort(hashes)
        self.word_hash = hashes[self.word_id]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number by its hash, -1 if no item has it."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.word_hash) or not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.word_hash, hashes), len(self.word_hash) - 1)
        hit = self.word_hash[at] == hashes
        out[hit] = self.word_id[at[hit]]
        return out

    def unlike(self, words: textvec.Words, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the words at these places whose bytes are not their item word's."""
        size = words.ends[at] - words.starts[at]
        bad = size != self.size[ids[at]]
        same, number = np.flatnonzero(~bad), ids[at]
        mine = words.data[textvec.ranges(words.starts[at[same]], size[same])]
        theirs = self.bytes[textvec.ranges(self.begin[number[same]], size[same])]
        bad[np.repeat(same, size[same])[mine != theirs]] = True
        return at[bad]

    def stretches(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[begin, end) of the runs of words in which each word and pair is some item's."""
        known = ids >= 0
        joint = np.zeros(len(ids), bool)
        if len(ids) > 1 and len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1])
            codes = ids[both] * self.words + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joint[both[self.pairs[at] == codes] + 1] = True
        joint[ptr[ptr < len(ids)]] = False
        begin = np.flatnonzero(known & ~joint)
        breaks = np.append(np.flatnonzero(~joint), len(ids))
        end = breaks[np.searchsorted(breaks, begin, side="right")]
        fit = end - begin >= self.least
        return begin[fit], end[fit]

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where each state goes by its word, -1 if nowhere."""
        wanted = state.astype(np.int64) * self.words + word
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.to[at], -1)

    def run(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, state) of every window and short item in the stretches [begin, end);
        the state tells of the items, one of a window's length for windows, else a short one."""
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step))  # stretches that go on
            at, s, held = begin[:n] + step, state[:n], length[:n]
            to = self._step(s, ids[at])
            while len(lost := np.flatnonzero((to < 0) & (s > 0))):
                s[lost] = self.link[s[lost]]
                held[lost] = self.length[s[lost]]
                to[lost] = self._step(s[lost], ids[at[lost]])
            state[:n], length[:n] = np.maximum(to, 0), np.where(to >= 0, held + 1, 0)
            s, held = state[:n], length[:n]
            hit = np.flatnonzero(held >= self.window)
            if len(hit):
                found.append((at[hit] + 1 - self.window, np.full(len(hit), self.window), self.top[s[hit]]))
            # Short items on the suffix links: fewer than a window's length of them.
            up, live = self.near[s], np.arange(n)
            while len(live := live[up[live] > 0]):
                words = self.length[up[live]]
                fits = words <= held[live]
                found.append((at[live][fits] + 1 - words[fits], words[fits], up[live][fits]))
                up[live] = self.near[self.link[up[live]]]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))

    def hits(self, words: textvec.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words) of every hit, and (hit, item) of every item of each."""
        ids = self.word_ids(hashes)
        begin, end = self.stretches(ids, words.ptr)
        if len(begin):
            other = self.unlike(words, ids, textvec.ranges(begin, end - begin))
            if len(other):
                ids[other] = -1
                begin, end = self.stretches(ids, words.ptr)
        first, size, state = self.run(ids, begin, end)
        out = []
        for mine, at, items in ((size >= self.window, self.item_at, self.items), (size < self.window, self.short_at, self.shorts)):
            which = np.flatnonzero(mine)
            many = (at[state[which] + 1] - at[state[which]]).astype(np.int64)
            out.append((np.repeat(which, many), items[textvec.ranges(at[state[which]].astype(np.int64), many)]))
        return first, size, *(np.concatenate(x) for x in zip(*out, strict=True))


def _pass(shared, names: list[str]):
    """Adds the hit spans and items of some automata to those that earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                words = textvec.Words(part.column("text"), _INSIDE, FOLD)
                n, hashes = len(words), words.hashes() if len(words) else np.zeros(0, np.uint64)
                earlier = part.column("spans")
                row = np.repeat(np.arange(part.num_rows), earlier.value_lengths().to_numpy(zero_copy_only=False))
                begin, end = (earlier.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                hit = textvec.covered(n, words.ptr[row] + begin, end - begin)
                named: dict[int, set[str]] = {}
                for automaton in shared.value:
                    first, size, which, item = automaton.hits(words, hashes)
                    if not len(first):
                        continue
                    hit |= textvec.covered(n, first, size)
                    owner = np.searchsorted(words.ptr, first, side="right") - 1
                    for r, k in np.unique(np.stack([owner[which], item.astype(np.int64)]), axis=1).T.tolist():
                        named.setdefault(r, set()).add(automaton.names[k])
                items = part.column("items")
                if named:
                    known = items.to_pylist()
                    items = pa.array([sorted({*old, *named.get(r, ())}) for r, old in enumerate(known)], pa.list_(pa.string()))
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.ptr])
                out = {"doc_id": part.column("doc_id"), "text": part.column("text"), "n_words": pa.array(words.counts), "n_hit": pa.array(n_hit)}
                out |= {"spans": textvec.span_lists(*textvec.runs(hit, words.ptr), part.num_rows), "items": items}
                out |= {c: part.column(c) for c in names}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def automata(benchmark: DataFrame, window: int, block_words: int, pass_words: int) -> Iterator[list[Automaton]]:
    """The automata of each pass. The items come one partition at a time; the driver holds one
    block of them as text, and one pass as arrays."""
    made: list[Automaton] = []
    block: list[tuple[str, list[bytes]]] = []
    size = whole = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        words = normal_words(row.text)
        if block and size + len(words) > block_words:
            made.append(Automaton(block, window))
            block, size = [], 0
            if whole + len(words) > pass_words:
                yield made
                made, whole = [], 0
        if words:
            block.append((row.item_id or "", words))
            size, whole = size + len(words), whole + len(words)
    if block or not made:
        made.append(Automaton(block, window))
    yield made


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: bool = False, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans (hit words), items (ids as text, sorted) of each row."""
    df, run, schema = _scanned(docs, benchmark, window, carry, block_words, pass_words)
    return df.mapInArrow(workers.tidy(run), schema)


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, carry: bool, block_words: int, pass_words: int) -> tuple[DataFrame, workers.Run, StructType]:
    """The rows before the last pass, that pass, and what it gives."""
    span = "array<struct<begin:int,end:int>>"
    df = docs.select("doc_id", "text", *(storage.carried(docs) if carry else []), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))
    names = ["carried"] if "carried" in df.columns else []
    schema = storage.schema(f"doc_id long, text string, n_words long, n_hit long, spans {span}, items array<string>", df)
    run = None
    for made in automata(benchmark, window, block_words, pass_words):
        if run is not None:
            # One pass's automata are in memory at a time.
            kept = storage.written(df.mapInArrow(workers.tidy(run), schema).select(*df.columns), "scanned")
            storage.drop(df)
            df = kept
        run = _pass(docs.sparkSession.sparkContext.broadcast(made), names)
    return df, run, schema


#: Share of hit words above which a whole document goes.
MOST_COVERAGE = 0.5


def _cut(names: list[str], most_coverage: float):
    """Takes the hit spans out of each text, with the signs inside them, and the texts of which more is hit out of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_words = (batch.column(c).to_numpy() for c in ("n_hit", "n_words"))
            for part in textvec.chunks(batch.filter(pa.array(n_hit <= n_words * most_coverage))):
                hit = np.flatnonzero(pa.compute.list_value_length(part.column("spans")).fill_null(0).to_numpy(zero_copy_only=False))
                text = part.column("text")
                if len(hit):
                    rows = text.take(pa.array(hit)).cast(pa.binary())
                    words = textvec.Words(rows, _INSIDE, FOLD)
                    cleaned = {}
                    for k, i in enumerate(hit.tolist()):
                        raw, base, first, out, at = rows[k].as_py(), int(words.ptr[k]), int(words.offsets[k]), [], 0
                        for span in sorted(part.column("spans")[i].as_py(), key=lambda s: (s["begin"], s["end"])):
                            begin, end = int(words.starts[base + span["begin"]]) - first, int(words.ends[base + span["end"] - 1]) - first
                            if begin > at:
                                out.append(raw[at:begin])
                            at = max(at, end)
                        cleaned[i] = b"".join([*out, raw[at:]]).decode()
                    text = pa.array([cleaned.get(i, t) for i, t in enumerate(text.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, *(part.column(n) for n in names)], ["doc_id", "text", *names])

    return run


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """docs without the texts' hit spans, and without the documents of which more is hit."""
    df, run, schema = _scanned(docs, benchmark, window, True, BLOCK_WORDS, PASS_WORDS)
    names = ["carried"] if "carried" in df.columns else []
    # One worker finds and cuts, so that a text goes there and back once.
    cut = df.mapInArrow(workers.tidy(workers.chained(run, _cut(names, most_coverage))), storage.schema("doc_id long, text string", df))
    return storage.unpacked(cut, docs)
