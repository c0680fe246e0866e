"""Operator 9, URL filters: host and path rules, and boosted trees on lexical features.

The longest rule that fits a URL decides it. The rest is decided by gradient-boosted trees,
fitted on the driver to at most TRAIN_ROWS labelled URLs (those of least hash, whatever the
table's order) and carried to the executors as a few kilobytes. A URL's features are its
lengths, depth, ratios of digits and other characters, entropy, parameter counts and, of its
host's suffixes, the smoothed share of blocked URLs among the labelled ones. Every UNKNOWNth
training URL stands there as if its suffixes were unknown, so that the trees learn to judge
such URLs by the rest. Both labels weigh alike, and a URL is blocked only where the trees are
surer than SURE, so one that is like none of the labelled ones is let through. Features are column expressions; only URLs that no rule decides
go through Python, which scores a batch of them as arrays.

Defined results: a null URL, or one without `://`, has empty host and path, fits no rule and
is judged on the features of an empty URL; a null page_id stays null; repeated rows have
equal results; with no labelled URL, or with one kind only, that kind (or allow) is the
method's verdict; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 32
RIDGE = 1.0
#: Labelled URLs that a suffix's share is weighed against.
PRIOR_WEIGHT = 20.0
UNKNOWN = 5
#: Probability from which on a URL is blocked.
SURE = 0.8

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> dict[str, Column]:
    return {
        "host": F.translate(F.regexp_extract(url, _PARTS, 1), _CAPITALS, _SMALL),
        "path": F.regexp_extract(url, _PARTS, 2),
    }


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else null."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    """Characters that a one-character pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _share(text: Column, pattern: str) -> Column:
    return _count(text, pattern) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character: the characters are sorted, and where a run of equal ones ends gives its count."""

    def runs(chars: Column) -> Column:
        n = F.size(chars)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & F.coalesce(F.get(chars, i) != F.get(chars, i - 1), F.lit(True)))
        return _let(ends, lambda e: F.aggregate(F.transform(e, lambda x, k: (x - F.coalesce(F.get(e, k - 1), F.lit(0))) / n), F.lit(0.0), lambda sum_, p: sum_ - p * F.log2(p)))

    return _let(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), runs)


def features(url: Column, host: Column, path: Column) -> Column:
    """A URL's figures, as an array of doubles; those of its suffixes come later."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    longest = lambda parts: F.coalesce(F.array_max(F.transform(parts, lambda x: F.length(x))), F.lit(0))

    def listed(segments: Column) -> Column:
        last = F.coalesce(F.get(segments, F.size(segments) - 1), F.lit(""))
        each = [
            F.length(url), F.length(host), F.length(path), F.length(query), F.size(segments), longest(segments),
            F.when(host == "", 0).otherwise(_count(host, r"\.") + 1), longest(F.split(host, r"\.")), _share(url, "[0-9]"), _share(host, "[0-9]"), _share(path, "[0-9]"),
            _share(url, r"[^\p{L}\p{N}]"), _count(host, "-"), _count(path, "[-_]"), _entropy(host), _entropy(path), _count(query, "="), _count(query, "&"),
            url.contains("#").cast("int"), last.contains(".").cast("int"), F.lower(url).startswith("https:").cast("int"), _share(url, r"\p{Lu}"), _share(host, "[aeiou]"),
        ]
        return F.array(*[c.cast("double") for c in each])

    return _let(F.filter(F.split(path, "/"), lambda x: x != ""), listed)


#: The host's last label and its last two.
SUFFIXES = {"last": 1, "last_two": 2}


def described(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, ...) with its features and suffixes."""
    return urls.withColumns({"x": features(F.col("url"), F.col("host"), F.col("path"))} | {name: F.substring_index("host", ".", -n) for name, n in SUFFIXES.items()})


@dataclass
class Trees:
    """Logistic boosting over binned features; each tree is a full one of fixed depth."""

    base: float
    edges: list[np.ndarray]
    split: np.ndarray  # (trees, 2**DEPTH - 1): feature
    cut: np.ndarray  # (trees, 2**DEPTH - 1): least bin of the right side
    leaf: np.ndarray  # (trees, 2**DEPTH)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        if not len(x):
            return np.zeros(0)
        bins, total = self.binned(x), np.full(len(x), self.base)
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(x)), split[node]] >= cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y (1 block) on features x, both labels weighing alike; second-order gains on histograms."""
    inner = 2**DEPTH - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    share = 0.5 if 0 < y.sum() < len(y) else 0.999 if len(y) and y.all() else 0.001
    model = Trees(float(np.log(share / (1 - share))), edges, np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, inner + 1)))
    if not 0 < y.sum() < len(y):
        return model
    bins, raw = model.binned(x), np.full(len(y), model.base)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    splits, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        split, cut, leaf = np.zeros(inner, int), np.full(inner, BINS + 1), np.zeros(inner + 1)
        for level in range(DEPTH):
            first = 2**level - 1
            best = np.zeros(2**level)
            for f in range(x.shape[1]):
                at = (node - first) * (BINS + 1) + bins[:, f]
                g, h = (np.bincount(at, w, minlength=2**level * (BINS + 1)).reshape(2**level, -1) for w in (grad, hess))
                left, below = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                whole, total = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = left**2 / (below + RIDGE) + (whole - left) ** 2 / (total - below + RIDGE) - whole**2 / (total + RIDGE)
                c = gain.argmax(1)
                gain = gain[np.arange(2**level), c]
                better = gain > best + 1e-9
                best[better] = gain[better]
                split[first : first + 2**level][better] = f
                cut[first : first + 2**level][better] = c[better] + 1
            node = 2 * node + 1 + (bins[np.arange(len(y)), split[node]] >= cut[node])
        place = node - inner
        g, h = (np.bincount(place, w, minlength=inner + 1) for w in (grad, hess))
        leaf = RATE * g / (h + RIDGE)
        raw += leaf[place]
        splits.append(split)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(model.base, edges, np.array(splits), np.array(cuts), np.array(leaves))


@dataclass
class Judge:
    trees: Trees
    shares: dict[str, dict[str, float]]
    prior: float

    def block(self, x: np.ndarray, suffixes: dict[str, pa.Array]) -> np.ndarray:
        """Whether each row of described URLs is to be blocked."""
        return self.trees.score(np.concatenate([x, *(self.shares_of(name, suffixes[name])[:, None] for name in SUFFIXES)], axis=1)) >= SURE

    def shares_of(self, name: str, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        known = self.shares[name]
        each = np.array([known.get(s, self.prior) for s in coded.dictionary.to_pylist()])
        return each[coded.indices.to_numpy()] if len(column) else np.zeros(0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def train(labelled: pa.Table) -> Judge:
    """From described URLs with blocked (1 or 0), in an order of no meaning."""
    y = labelled.column("blocked").to_numpy().astype(float)
    judge = Judge(fit(np.zeros((0, 1)), np.zeros(0)), {name: {} for name in SUFFIXES}, float(y.mean()) if len(y) else 0.0)
    if not len(y):
        return judge
    x = [matrix(labelled.column("x").combine_chunks())]
    for name in SUFFIXES:
        coded = labelled.column(name).combine_chunks().dictionary_encode()
        at = coded.indices.to_numpy()
        share = (np.bincount(at, y) + judge.prior * PRIOR_WEIGHT) / (np.bincount(at) + PRIOR_WEIGHT)
        judge.shares[name] = dict(zip(coded.dictionary.to_pylist(), share.tolist(), strict=True))
        seen = share[at]
        seen[::UNKNOWN] = judge.prior
        x.append(seen[:, None])
    judge.trees = fit(np.concatenate(x, axis=1), y)
    return judge


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict. labelled: (url, blocked); by default the URLs that rules decide."""
    rule, verdict = ruled(rules)
    url = F.coalesce("url", F.lit(""))
    known = pages.select("page_id", url.alias("url")).withColumns(host_and_path(F.col("url"))).withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        given = known.where("ruled is not null").withColumn("blocked", (F.col("ruled") == "block").cast("int"))
    else:
        given = labelled.where("blocked is not null").select(url.alias("url"), F.col("blocked").cast("int")).withColumns(host_and_path(F.col("url")))
    shared = pages.sparkSession.sparkContext.broadcast(learnt(given.select("url", "host", "path", "blocked"), train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                block = shared.value.block(matrix(part.column("x")), {name: part.column(name) for name in SUFFIXES})
                out = {c: part.column(c) for c in ("page_id", "host", "path", "rule")} | {"verdict": pa.array(np.where(block, "block", "allow").astype(object), pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    open_ = described(known.where("ruled is null")).select("page_id", "host", "path", "rule", "x", *SUFFIXES)
    rest = open_.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
    return known.where("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")).union(rest)


def learnt(given: DataFrame, train_rows: int = TRAIN_ROWS) -> Judge:
    """The judge that labelled URLs (url, host, path, blocked) teach."""
    # The same rows whatever their order in the table. A draw by hash of about twice as many
    # comes first, so that no task hands more than its share of them to the top-k.
    scale = 1_000_000
    given = given.distinct()
    share = min(scale, int(scale * 2 * train_rows / max(1, given.count())) + 1)
    drawn = given.where(F.pmod(F.xxhash64("url"), F.lit(scale)) < share)
    chosen = drawn.orderBy(F.xxhash64("url"), "url", "blocked").limit(train_rows)
    return train(described(chosen).select("x", *SUFFIXES, "blocked").toArrow())


def left_out(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> list[tuple[str, int, float]]:
    """(rule, URLs, share judged as the rule would) of each rule, by a method that never saw its
    URLs; a report on TRAIN_ROWS URLs of each at most."""
    rule, verdict = ruled(rules)
    known = pages.select(F.coalesce("url", F.lit("")).alias("url")).withColumns(host_and_path(F.col("url"))).withColumns({"rule": rule, "ruled": verdict}).where("rule is not null")
    out = []
    for kind, host, path in rules:
        mine = F.col("rule") == host + path
        judge = learnt(known.where(~mine).select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("blocked")))
        asked = described(known.where(mine).limit(TRAIN_ROWS)).select("x", *SUFFIXES).toArrow().combine_chunks()
        if asked.num_rows:
            block = judge.block(matrix(asked.column("x").combine_chunks()), {name: asked.column(name).combine_chunks() for name in SUFFIXES})
            out.append((host + path, asked.num_rows, float(np.mean(block == (kind == "block")))))
    return out
