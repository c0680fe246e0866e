"""Operator 8, SimHash near-dedup: fingerprints compared bit-sliced, linked documents grouped.

A fingerprint's bit is the majority of its shingles' XXH64 bits. Equal fingerprints are one
node. A pair within the radius agrees in at least `blocks - radius` of `blocks` bit blocks,
so nodes meet by every choice of so many blocks; the number of blocks grows with the number
of nodes, which keeps the meeting places small at any size. There, 64 fingerprints at a time
stand as bit planes in machine words: the differing bits of one plane are one XOR, and
carry-save counters hold 64 distances side by side. Words whose counters all exceed the
radius are abandoned. A crowded meeting place is dealt out as pairs of tiles. Only a
spanning forest of each place's links leaves it; components() joins the forests.

`similar` groups by Jaccard similarity of word shingles instead: a fingerprint of WIDE bits
estimates it, so nodes meet by agreeing in drawn bits, are compared bit-sliced on a part of
the fingerprint, and the nearest pairs that span a place's components leave it. Pairs whose
whole fingerprints are clearly near are linked; those near the limit are linked if their
shingles' exact similarity reaches it. What is drawn grows with the number of nodes.
Texts of FEW shingles or less estimate worse, so they also meet by more draws and a wider
limit, and their pairs are always decided exactly.

A spanning pair may fail where another would not, so where a place has more pairs than span
it, these pairs are marked. Nodes that marked pairs connect are a crowd; a crowd that links
leave apart is compared once more, bit-sliced on whole fingerprints and then by exact
shingles inside the task, every node with every node of another group. It is dealt as pairs
of tiles of bounded size, of which those inside its largest group are left out.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a
null doc_id stays null, and its group's id is the smallest known one (null if none is);
repeated rows have equal results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import components, storage, textvec, workers
from corpusloom.llm.components import spanned

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints that are compared as one block.
TILE = 1024
#: Fingerprints, as a power of two, that a meeting place may have on average. Up to a tile,
#: comparing them costs less than meeting by more choices of blocks.
CROWD = 7

#: Nodes, and shingles of them together, that a tile of a crowd has on average at most.
CROWD_TILE = 256
CROWD_SHINGLES = 1 << 17

_WHOLE = np.uint64(2**64 - 1)

PLACE = ["band", "key", "i", "j"]

#: Bit j of a byte as byte j of a word.
_SPREAD = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], dtype=np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: the bits that over half of the run have."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    # Sums of at most 255 hashes fit the bytes of a word, then those sums are added up.
    parts = -(-counts[rows] // 255)
    first = (np.cumsum(counts) - counts)[rows]
    begins = np.repeat(first, parts) + 255 * textvec.ranges(np.zeros(len(rows), np.int64), parts)
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, begins, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    ones = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
    out[rows] = np.packbits(2 * ones > counts[rows, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _shingle_hashes(text: bytes, n: int) -> list[int]:
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                each = [np.array(_shingle_hashes(t or b"", shingle), np.uint64) for t in texts]
                fps = majority(np.concatenate(each), np.array([len(x) for x in each], np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(workers.tidy(run), "doc_id long, fp long")


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fingerprints, of one word or several, that differ in at most `radius` bits."""
    fps = fps.reshape(len(fps), -1)
    n, depth = len(fps), 64 * fps.shape[1]
    width = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((depth, width * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64).reshape(depth, width)
    asked = np.where(bits.T, _WHOLE, np.uint64(0))
    own = np.arange(n) // 64
    query = np.repeat(np.arange(n), width - own)
    word = textvec.ranges(own, width - own)
    valid = np.full(len(query), _WHOLE)
    valid[word == width - 1] = _WHOLE >> np.uint64(width * 64 - n)
    mine = word == own[query]
    at = (query[mine] % 64).astype(np.uint64)
    valid[mine] &= (_WHOLE << at) << np.uint64(1)
    digits = max(1, radius.bit_length())
    count = [np.zeros(len(query), np.uint64) for _ in range(digits)]
    over = np.zeros(len(query), np.uint64)
    live = valid
    for k in range(depth):
        carry = planes[k][word] ^ asked[k][query]
        for digit in count:
            both = digit & carry
            digit ^= carry
            carry = both
        over |= carry
        if k != depth - 1 and (k % 4 != 3 or k <= radius):
            continue
        equal, more = _WHOLE, over
        for b in range(digits - 1, -1, -1):
            if radius >> b & 1:
                equal = equal & count[b]
            else:
                more, equal = more | equal & count[b], equal & ~count[b]
        live = valid & ~more
        keep = live != 0
        if k == depth - 1 or 2 * np.count_nonzero(keep) < len(keep):
            query, word, valid, over, live = query[keep], word[keep], valid[keep], over[keep], live[keep]
            count = [digit[keep] for digit in count]
            if not len(query):
                break
    row, bit = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[row], word[row] * 64 + bit


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its component's first) that span the near pairs' components."""
    label = spanned(len(fps), *near_pairs(fps, radius))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def nearest_forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Which pairs make a spanning forest of the nearest ones, each index's nearest included."""
    order = np.lexsort((j, i, far))
    label, chosen = np.arange(n), np.zeros(len(i), bool)
    rest = order
    while len(rest):
        # Every component takes its nearest pair that leads out of it.
        a, b = label[i[rest]], label[j[rest]]
        rest, a, b = rest[a != b], a[a != b], b[a != b]
        first = np.full(n, len(rest))
        np.minimum.at(first, a, np.arange(len(rest)))
        np.minimum.at(first, b, np.arange(len(rest)))
        take = np.unique(first[first < len(rest)])
        if not len(take):
            break
        chosen[rest[take]] = True
        label = spanned(n, np.concatenate([np.arange(n), i[rest[take]]]), np.concatenate([label, j[rest[take]]]))
    return np.flatnonzero(chosen)


def block_masks(nodes: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of blocks in which a pair within the radius may agree."""
    wanted = math.log2(max(nodes, 1)) - CROWD
    blocks = radius + 1
    while 64 * (blocks - radius) / blocks < wanted and blocks < 2 * radius + 4:
        blocks += 1
    edges = [64 * b // blocks for b in range(blocks + 1)]
    part = [(1 << edges[b + 1]) - (1 << edges[b]) for b in range(blocks)]
    return [sum(part[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tiled(met: DataFrame, node: str) -> DataFrame:
    """met(band, key, node, ...) with crowded places dealt out as pairs (i, j) of tiles."""
    crowd = met.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    crowd = storage.small(storage.written(crowd, "crowd"))
    values = [c for c in met.columns if c not in PLACE]
    met = met.join(crowd, ["band", "key"], "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int"))
    met = met.withColumn("tile", F.pmod(F.xxhash64(node), F.col("tiles")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("tile"))
    met = met.withColumn("other", F.explode(F.when(F.col("tiles") > 1, others).otherwise(F.array(F.lit(0)))))
    return met.select("band", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), *values)


def links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all nodes(fp) within the radius; distinct fps are expected."""
    masks = block_masks(count, radius)
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    met = tiled(nodes.select("fp", F.explode(keys).alias("x")).select("fp", "x.band", "x.key"), "fp")

    def linked(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.unique(found["fp"].view(np.uint64)), radius)

    return compared(met, linked)


def compared(met: DataFrame, linked: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...]], out: tuple[str, ...] = ("a", "b"), sets: str | None = None, most: int = TILE) -> DataFrame:
    """Distinct rows, by default links (a, b), that `linked` finds among those of each place, several
    places at once up to `most` rows; the lists in a column `sets` count by their lengths too."""
    values = [c for c in met.columns if c not in PLACE]

    def size_of(part: dict[str, np.ndarray]) -> int:
        rows = len(part[values[0]])
        return rows if sets is None else max(rows, sum(map(len, part[sets])) * CROWD_TILE // CROWD_SHINGLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if sum(len(p[values[0]]) for p in parts) > 1:
                got = linked({c: np.concatenate([p[c] for p in parts]) for c in values})
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in got], list(out))

        ready: list[dict[str, np.ndarray]] = []  # whole places
        open_: list[dict[str, np.ndarray]] = []  # the place being read
        last, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in PLACE]
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in values}
            change = np.zeros(batch.num_rows, bool)
            change[0] = tuple(c[0] for c in columns) != last
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            last = tuple(c[-1] for c in columns)
            at = 0
            for begin in [*np.flatnonzero(change).tolist(), batch.num_rows]:
                if begin > at:
                    open_.append({c: x[at:begin] for c, x in rows.items()})
                if begin < batch.num_rows:
                    length = sum(map(size_of, open_))
                    if ready and size + length > most:
                        yield from emit(ready)
                        ready, size = [], 0
                    ready += open_
                    size += length
                    open_ = []
                at = begin
        yield from emit(ready)
        yield from emit(open_)

    dealt = met.repartition(*PLACE).sortWithinPartitions(*PLACE)
    return dealt.mapInArrow(workers.tidy(run), ", ".join(f"{c} long" for c in out)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of each row of docs."""
    prints = storage.written(fingerprints(docs, shingle), "fingerprints")
    nodes = storage.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    settled = components.settled(links(nodes.select("fp"), nodes.count(), radius), "found")
    found = settled.withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = storage.written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = storage.written(rooted.join(least, "root").select("fp", "component_id"), "named")
    storage.drop(nodes, settled, rooted)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bits, shingle words and least similarity of `similar`.
WIDE = 1024
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Chance that a pair at the least similarity never meets.
MISS = 0.005
#: Words of the wide fingerprint that a place compares, and deviations that it allows there.
PART = 2
DEVIATIONS = 3.0
#: Shingles up to which estimates are not trusted, and the most that a partner of such a text has.
FEW = 32
FEW_PARTNER = 40
#: Share of differing bits that texts of few shingles may come to at the least similarity: of
#: five shingles four are shared at 0.8, and then 3/16 of the bits differ.
FEW_SHARE = 0.1875


def bit_share(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of equally large sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distinct_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each lower-cased row, ascending, and their number; fewer than
    n words are one shingle."""
    words = textvec.Words(column, textvec.NOT_SPACE, _LOWER)
    hashes = words.hashes()
    at, shingles = textvec.window_hashes(hashes, words.ptr, n)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    whole = np.zeros(len(few), np.uint64)
    for size in range(1, n):
        these = words.counts[few] == size
        whole[these] = textvec.sequence_hashes(hashes, words.ptr[few[these]], size)
    counts = np.maximum(words.counts - n + 1, 0)
    counts[few] = 1
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    out[(ends - counts)[few]] = whole
    mine = np.ones(len(out), bool)
    mine[(ends - counts)[few]] = False
    out[mine] = shingles
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(ends - counts)[counts > 0]] = True
    owner = np.repeat(np.arange(len(counts)), counts)
    return out[new], np.bincount(owner[new], minlength=len(counts))


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def wide_fingerprints(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, wide: array of WIDE / 64 longs, shingles: how many distinct ones) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                shingles, counts = distinct_shingles(part.column("text"), shingle)
                words = WIDE // 64
                each = [majority(textvec.mix(shingles + textvec.mix(np.array([k + 1], np.uint64))), counts) for k in range(words)]
                flat = pa.array(np.stack(each, axis=1).reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat), pa.array(counts.astype(np.int64))], ["doc_id", "wide", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(workers.tidy(run), "doc_id long, wide array<long>, shingles long")


def _drawn(count: int, share: float, seed: int) -> np.ndarray:
    """(bands, size) places of the bits by which nodes meet; a pair that differs in that share
    of bits meets nowhere with chance MISS."""
    size = max(14, math.ceil(math.log2(max(count, 1))) - 5)
    bands = math.ceil(math.log(MISS) / math.log(1 - (1 - share) ** size))
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.permutation(WIDE) for _ in range(-(-bands * size // WIDE))])[: bands * size].reshape(bands, size)


def _meetings(nodes: DataFrame, count: int, similarity: float) -> DataFrame:
    """(band, key, node, few, p0, ...) of every node(node, wide, shingles) at every set of drawn bits.

    Bands of texts with few shingles are counted downwards from -1.
    """
    usual, more = _drawn(count, bit_share(similarity), 64), _drawn(count, max(FEW_SHARE, bit_share(similarity)), 65)
    words = WIDE // 64
    names = ["band", "key", "node", "few", *(f"p{p}" for p in range(PART))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                whole = part.column("wide").flatten().to_numpy().view(np.uint64).reshape(-1, words)
                every, size = part.column("node").to_numpy(), part.column("shingles").to_numpy()
                for few, drawn, some in ((0, usual, size > FEW), (1, more, size <= FEW_PARTNER)):
                    node, wide = every[some], whole[some]
                    if not len(node):
                        continue
                    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
                    power = 1 << np.arange(drawn.shape[1], dtype=np.int64)
                    band = np.arange(len(drawn), dtype=np.int32)
                    out = [np.repeat(-1 - band if few else band, len(node)), np.concatenate([bits[:, d].astype(np.int64) @ power for d in drawn]), np.tile(node, len(drawn)), np.full(len(node) * len(drawn), few, np.int64)]
                    # Another part in each band, so that a pair's chance differs between them.
                    out += [np.concatenate([wide[:, (k * PART + p) % words] for k in band]).view(np.int64) for p in range(PART)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return nodes.mapInArrow(workers.tidy(run), "band int, key long, node long, few long, " + ", ".join(f"p{p} long" for p in range(PART)))


def _limit(bits: int, share: float) -> int:
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def candidate_pairs(nodes: DataFrame, count: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b, marked) of nodes(node, wide, shingles) that may reach the similarity
    and span what a place holds; marked where other pairs there may as well."""
    radius = [_limit(64 * PART, bit_share(similarity)), _limit(64 * PART, max(FEW_SHARE, bit_share(similarity)))]

    def linked(found: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        out = []
        for few in np.unique(found["few"]):
            mine = found["few"] == few
            # A node may stand here for several places of one block, with other parts; each is compared.
            node, which = np.unique(found["node"][mine], return_inverse=True)
            fps = np.stack([found[f"p{p}"][mine] for p in range(PART)], axis=1).view(np.uint64)
            i, j = near_pairs(fps, radius[few])
            far = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
            a, b, n = which[i], which[j], len(node)
            other = a != b
            a, b, far = a[other], b[other], far[other]
            some = nearest_forest(a, b, far, n)
            root = spanned(n, a, b)
            # A pair may be found for several places; distinct ones count.
            known = np.unique(np.minimum(a, b) * n + np.maximum(a, b)) // n
            more = np.bincount(root[known], minlength=n) > np.bincount(root[a[some]], minlength=n)
            out.append((node[a[some]], node[b[some]], more[root[a[some]]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    found = compared(tiled(_meetings(nodes, count, similarity), "node"), linked, ("a", "b", "marked"))
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("marked").alias("marked"))


def far_limits(similarity: float) -> tuple[float, float]:
    """Differing bits of whole fingerprints below which a pair is linked, and above which it is not."""
    share = bit_share(similarity)
    slack = DEVIATIONS * math.sqrt(WIDE * share * (1 - share))
    return WIDE * share - slack, WIDE * share + slack


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, s) of the wanted(doc_id): the distinct shingle hashes of its text, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                shingles, counts = distinct_shingles(part.column("text"), shingle)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))], ["doc_id", "s"])

    sets = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(workers.tidy(run), "doc_id long, s array<long>")
    # Of rows that share a doc_id, the same one whatever the order.
    return sets.groupBy("doc_id").agg(F.min("s").alias("s"))


def exact_similarity(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """pairs(a, b, doc_a, doc_b) with the Jaccard similarity of the two documents' shingles."""
    asked = storage.written(pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select(F.col("doc_b").alias("doc_id"))).distinct(), "asked")
    sets = storage.written(shingle_sets(docs, storage.small(asked), shingle), "shingles")
    one, other = (sets.select(F.col("doc_id").alias(f"doc_{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(one, "doc_a").join(other, "doc_b")
    shared, whole = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    # Two texts without words are alike.
    found = both.select("a", "b", F.when(whole == 0, 1.0).otherwise(shared / (whole - shared)).alias("similarity"))
    found = storage.written(found, "similarity")
    storage.drop(asked, sets)
    return found


def _joined(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) by the links among pairs(a, b, marked): sure ones, and of those near the
    limit that are not marked and not joined by sure ones the exactly similar ones."""
    one, other = (nodes.select(F.col("node").alias(x), F.col("rep").alias(f"doc_{x}"), F.col("wide").alias(f"w{x}"), F.col("shingles").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one, "a").join(other, "b")
    differing = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    low, high = far_limits(similarity)
    few = F.least("na", "nb") <= FEW
    judged = both.select("a", "b", "marked", "doc_a", "doc_b", few.alias("few"), differing.alias("far")).where(F.col("few") | (F.col("far") <= high))
    judged = storage.written(judged, "judged")
    clear = ~F.col("few") & (F.col("far") < low)
    sure = judged.where(clear).select("a", "b")
    # Pairs near the limit matter only between groups that are not joined yet.
    first = components.settled(sure, "first")
    open_ = judged.where(~clear & (F.col("marked") == 0))
    for x in "ab":
        open_ = open_.join(first.withColumnsRenamed({"node": x, "component": f"c{x}"}), x, "left")
    open_ = storage.written(open_.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "doc_a", "doc_b"), "open")
    near = exact_similarity(docs, open_, shingle)
    found = components.extended(first, near.where(F.col("similarity") >= similarity), "found")
    storage.drop(judged, first, open_, near)
    return found


def similar_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (i, j) of distinct shingle sets reach the similarity, exactly."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    number = np.cumsum(new) - 1
    # Shingles that one set alone has count for no pair; the rest in blocks of columns.
    often = np.bincount(number) > 1
    column = np.cumsum(often) - 1
    kept = often[number]
    row, column = owner[order][kept], column[number[kept]]
    left, right = np.unique(i), np.unique(j)
    shared = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(sets), np.int64)
    block = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, block):
        some = slice(*np.searchsorted(column, [begin, begin + block]))
        has = np.zeros((len(sets), block), np.float32)
        has[row[some], column[some] - begin] = 1
        shared += has[left] @ has[right].T
    at = [np.searchsorted(x, y) for x, y in ((left, i), (right, j))]
    both = shared[at[0], at[1]].astype(np.float64)
    whole = size[i] + size[j] - both
    return (both >= similarity * whole) | (whole == 0)


def crowd_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, found: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the similar nodes of different components(node, component) inside
    the crowds that marked pairs make."""
    held = pairs.where("marked = 1").select("a", "b")
    for x in "ab":
        held = held.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    held = storage.written(held, "held")
    # A crowd is found among components, of which there are fewer than nodes.
    crowds = components.settled(held.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "crowds")
    members = held.select(F.col("a").alias("node"), F.col("ca").alias("component")).union(held.select("b", "cb")).distinct()
    inside = storage.written(members.join(crowds.select(F.col("node").alias("component"), F.col("component").alias("crowd")), "component"), "inside")
    main = inside.groupBy("crowd", "component").count().groupBy("crowd").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    apart = inside.join(main, "crowd").select("crowd", "node", "component", (F.col("component") == F.col("main")).alias("settled"))
    apart = storage.written(apart.join(nodes.select("node", "rep", "wide", "shingles"), "node"), "apart")
    sized = apart.groupBy("crowd", "settled").agg(F.greatest(F.ceil(F.count("*") / CROWD_TILE), F.ceil(F.sum("shingles") / CROWD_SHINGLES), F.lit(1)).cast("int").alias("n"))
    tiles = sized.groupBy("crowd").agg(F.coalesce(F.max(F.when(~F.col("settled"), F.col("n"))), F.lit(0)).alias("open"), F.coalesce(F.max(F.when(F.col("settled"), F.col("n"))), F.lit(0)).alias("closed"))
    dealt = apart.join(tiles, "crowd")
    tile = F.when(F.col("settled"), F.col("open") + F.pmod(F.xxhash64("node"), F.greatest("closed", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("open", F.lit(1)))).cast("int")
    # Tiles from `open` on lie in the crowd's largest component; no two of them meet.
    others = F.sequence(F.lit(0), F.col("open") + F.when(F.col("settled"), F.lit(0)).otherwise(F.col("closed")) - 1)
    dealt = dealt.withColumn("tile", tile).withColumn("other", F.explode(others))
    wanted = storage.written(apart.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = shingle_sets(docs, storage.small(wanted), shingle).withColumnRenamed("doc_id", "rep")
    met = dealt.select(
        F.lit(0).alias("band"), F.col("crowd").alias("key"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "component", "rep", *[F.col("wide")[p].alias(f"p{p}") for p in range(WIDE // 64)],
        F.least("shingles", F.lit(FEW + 1)).alias("few"),
    ).join(sets, "rep")
    high = math.floor(far_limits(similarity)[1])

    def linked(found: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        node, first = np.unique(found["node"], return_index=True)
        own, few = found["component"][first], found["few"][first] <= FEW
        fps = np.stack([found[f"p{p}"][first] for p in range(WIDE // 64)], axis=1).view(np.uint64)
        i, j = near_pairs(fps, high)
        # Texts of few shingles are not judged by their fingerprints: all of them are compared.
        some = np.flatnonzero(few)
        x, y = np.triu_indices(len(some), 1)
        i, j = np.concatenate([i, some[x]]), np.concatenate([j, some[y]])
        apart = own[i] != own[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return i, j
        good = similar_links([found["s"][k] for k in first], i, j, similarity)
        i, j = i[good], j[good]
        label = spanned(len(node), i, j)
        moved = np.flatnonzero(label != np.arange(len(node)))
        return node[moved], node[label[moved]]

    out = storage.written(compared(met.drop("rep"), linked, sets="s", most=2 * CROWD_TILE), "crowded")
    storage.drop(crowds, held, inside, apart, wanted)
    return out


def similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of each row of docs, by word-shingle similarity."""
    prints = storage.written(wide_fingerprints(docs, shingle).withColumn("node", F.xxhash64("wide")), "wide")
    nodes = storage.written(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("wide").alias("wide"), F.min("shingles").alias("shingles")), "nodes")
    pairs = storage.written(candidate_pairs(nodes.select("node", "wide", "shingles"), nodes.count(), similarity), "pairs")
    joined = _joined(docs, nodes, pairs, shingle, similarity)
    more = crowd_links(docs, nodes, pairs, joined, shingle, similarity)
    found = components.extended(joined, more, "found")
    found = found.withColumnsRenamed({"component": "root"})
    rooted = storage.written(nodes.select("node", "rep").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = storage.written(rooted.join(least, "root").select("node", "component_id"), "named")
    storage.drop(nodes, pairs, joined, more, found, rooted)
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group, that of least doc_id, and the rows without doc_id.

    Of rows that share that doc_id, the one of least text stays, and of those any one.
    """
    groups = storage.written(similar(docs.where("doc_id is not null"), shingle, similarity), "groups")
    later = storage.written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "later")
    kept = docs.join(storage.small(later), "doc_id", "left_anti").select(*storage.columns(docs))
    again = storage.written(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    storage.drop(groups)
    if again.isEmpty():
        return kept
    again = storage.small(again)
    # Any type of column may be carried, so a row is taken by its text and not compared itself.
    first = F.min_by(F.struct(*storage.columns(docs)), F.coalesce("text", F.lit(""))).alias("row")
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*storage.columns(docs)).union(once)
