"""Operator 7, language ID: a bidirectional gated recurrent network over bytes.

Both directions read the bytes of a text as they stand, white space included, in windows of
WINDOW bytes; each direction begins WARM bytes before its window (behind it, for the
backward one), so that its state is warm where labels begin, and is cold at a text's own
ends alone. So every byte position of a text is labelled in its context, whatever the script
and however long its words. A document's probabilities are the pooled log-probabilities of
all its positions, averaged and normalised. The windows of many texts run side by side.

The network is trained in numpy by backpropagation through time, on the driver, from a
bounded sample: of each value of lang PER_LANG documents, and of each of these at most
PER_DOC windows, drawn from the whole text and cut out where the text is, so that the driver
receives less than PER_LANG * PER_DOC * (WINDOW + 2 * WARM) bytes for each language. Every
value of lang that a row which is not held out has can be predicted.

Defined results: `und`, score 0, for a null text or one without a letter; a null doc_id
counts as not held out; repeated rows have equal results; with nothing to learn from, all
are `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusloom.llm import sampling, textvec, workers

PER_LANG = 150
PER_DOC = 40
#: Bytes that a window labels, and that each direction reads before them.
WINDOW = 64
WARM = 16
HIDDEN = 16
EMBED = 12
STEPS = 400
BATCH = 64
RATE = 0.01
#: Windows that run side by side.
TILE = 2048
UNKNOWN = "und"
#: A place outside of a text, in place of a byte, and its update gate's input, which leaves the state as it is.
OUTSIDE = np.intp(256)
SHUT = -1e9


@dataclass
class Network:
    """Byte embedding, one gated layer per direction, and a softmax over both states."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": (rng.normal(size=(256, EMBED)) * 0.5).astype(np.float32), "O": draw(2 * HIDDEN, len(langs)), "o": np.zeros(len(langs), np.float32)}
        for d in "fb":
            p |= {f"{d}W": draw(EMBED, 3 * HIDDEN), f"{d}U": draw(HIDDEN, 3 * HIDDEN), f"{d}c": np.zeros(3 * HIDDEN, np.float32)}
        return cls(langs, p)

    def _direction(self, d: str, data: np.ndarray, mask: np.ndarray, warm: int) -> tuple[np.ndarray, list]:
        """States (time, window, unit) of the labelled times, and what gradients need of each time; data and mask are (time, window) with `warm` times on either side."""
        w, u, c = self.p[f"{d}W"], self.p[f"{d}U"], self.p[f"{d}c"]
        table = self.p["E"] @ w + c  # what each byte value adds to the gates
        # sigmoid(x) = (1 + tanh(x / 2)) / 2
        half = table.copy()
        half[:, : 2 * HIDDEN] *= 0.5
        gates, inner = u[:, : 2 * HIDDEN] * 0.5, u[:, 2 * HIDDEN :]
        steps, n = data.shape
        h, out, saved = np.zeros((n, HIDDEN), table.dtype), np.zeros((steps - 2 * warm, n, HIDDEN), table.dtype), [None] * steps
        for t in range(steps - warm) if d == "f" else range(steps - 1, warm - 1, -1):
            x = half[data[t]]
            zr = h @ gates
            zr += x[:, : 2 * HIDDEN]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            cand = (r * h) @ inner
            cand += x[:, 2 * HIDDEN :]
            np.tanh(cand, out=cand)
            saved[t] = (h, z, r, cand)
            new = cand - h
            new *= z
            new *= mask[t][:, None]
            new += h
            h = new
            if warm <= t < steps - warm:
                out[t - warm] = h
        return out, saved

    def _states(self, d: str, data: np.ndarray, warm: int) -> np.ndarray:
        """_direction's states of the labelled times, for labelling alone: data holds OUTSIDE where a
        text has no byte. Each gate has its own arrays, written in place, as their halves' products
        over slices and copies cost more than the network itself."""
        w, u, c = self.p[f"{d}W"], self.p[f"{d}U"], self.p[f"{d}c"]
        # sigmoid(x) = (1 + tanh(x / 2)) / 2; the candidate's half is taken off its weights.
        table = (self.p["E"] @ w + c) * np.repeat(np.array([0.5, 0.5, 1], w.dtype), HIDDEN)
        tables = [np.ascontiguousarray(np.vstack([part, np.full(HIDDEN, fill, w.dtype)])) for part, fill in zip(np.split(table, 3, axis=1), (SHUT, 0, 0), strict=True)]
        update, reset, inner = (np.ascontiguousarray(part) * w.dtype.type(0.5) for part in np.split(u, 3, axis=1))
        steps, n = data.shape
        out = np.empty((steps - 2 * warm, n, HIDDEN), w.dtype)
        h, z, r, cand, add = (np.zeros((n, HIDDEN), w.dtype) for _ in range(5))
        for t in range(steps - warm) if d == "f" else range(steps - 1, warm - 1, -1):
            for x, part in zip((z, r, cand), tables, strict=True):
                np.take(part, data[t], axis=0, out=x, mode="clip")
            z += np.matmul(h, update, out=add)
            np.tanh(z, out=z)
            r += np.matmul(h, reset, out=add)
            np.tanh(r, out=r)
            r += 1
            r *= h
            cand += np.matmul(r, inner, out=add)
            np.tanh(cand, out=cand)
            cand -= h
            z += 1
            z *= 0.5
            z *= cand
            h = np.add(h, z, out=out[t - warm] if warm <= t < steps - warm else h)
        return out

    def log_probs(self, data: np.ndarray, warm: int = WARM) -> np.ndarray:
        """(language, time, window) log-probabilities; data as `framed` gives it."""
        parts = zip("fb", np.split(self.p["O"], 2), strict=True)
        scores = sum(np.ascontiguousarray(part.T) @ self._states(d, data, warm).reshape(-1, HIDDEN).T for d, part in parts) + self.p["o"][:, None]
        scores -= scores.max(axis=0)
        scores -= np.log(np.exp(scores).sum(axis=0))
        return scores.reshape(len(self.langs), -1, data.shape[1])

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray, warm: int = WARM) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the labelled positions and its gradients, backwards through time in each direction."""
        runs = {d: self._direction(d, data, mask, warm) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        scores = both @ self.p["O"] + self.p["o"]
        scores -= scores.max(axis=2, keepdims=True)
        prob = np.exp(scores)
        prob /= prob.sum(axis=2, keepdims=True)
        inside = mask[warm : len(mask) - warm]
        weight = inside / inside.sum()
        n = np.arange(data.shape[1])
        loss = -float((weight * np.log(prob[:, n, label] + 1e-9)).sum())
        delta = prob.copy()
        delta[:, n, label] -= 1
        delta *= weight[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["O"], g["o"] = np.einsum("tnh,tnl->hl", both, delta), delta.sum((0, 1))
        back = delta @ self.p["O"].T
        for k, d in enumerate("fb"):
            w, u = self.p[f"{d}W"], self.p[f"{d}U"]
            above, saved = back[:, :, k * HIDDEN : (k + 1) * HIDDEN], runs[d][1]
            dh = np.zeros((data.shape[1], HIDDEN), above.dtype)
            gates = np.zeros((256, 3 * HIDDEN), np.float32)
            steps = data.shape[0]
            for t in range(steps - warm - 1, -1, -1) if d == "f" else range(warm, steps):
                h, z, r, cand = saved[t]
                if warm <= t < steps - warm:
                    dh = dh + above[t - warm]
                m = mask[t][:, None] * dh
                dcand = m * z * (1 - cand**2)
                drh = dcand @ u[:, 2 * HIDDEN :].T
                dzr = np.concatenate([m * (cand - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                g[f"{d}U"][:, : 2 * HIDDEN] += h.T @ dzr
                g[f"{d}U"][:, 2 * HIDDEN :] += (r * h).T @ dcand
                np.add.at(gates, data[t], np.concatenate([dzr, dcand], axis=1))
                dh = dh - m * z + drh * r + dzr @ u[:, : 2 * HIDDEN].T
            g[f"{d}c"] = gates.sum(0)
            g[f"{d}W"] = self.p["E"].T @ gates
            g["E"] += gates @ w.T
        return loss, g


def windows(offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the windows that cover each text [offsets[k], offsets[k + 1])."""
    size = np.diff(offsets)
    parts = -(-size // width)
    row = np.repeat(np.arange(len(size)), parts)
    first = offsets[row] + textvec.ranges(np.zeros(len(size), np.int64), parts) * width
    return row, first, np.minimum(first + width, offsets[row + 1])


def framed(data: np.ndarray, low: np.ndarray, first: np.ndarray, high: np.ndarray, width: int = WINDOW, warm: int = WARM) -> np.ndarray:
    """(time, window) bytes around the windows that begin at `first` in texts [low, high); OUTSIDE where
    the text has none."""
    at = first[None, :] + np.arange(-warm, width + warm)[:, None]
    return np.where((at >= low) & (at < high), data[np.clip(at, 0, len(data) - 1)], OUTSIDE)


def sampled(docs: DataFrame, per_lang: int) -> list:
    """Training rows (lang, low, high, raw): a window's bytes with its surroundings, of which
    [low, high) are the text's; of the same documents whatever the table's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                data, offsets = textvec.buffer_of(part.column("text"))
                row, first, _ = windows(offsets)
                out = []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    mine = first[slice(*np.searchsorted(row, [k, k + 1]))]
                    for at in np.random.default_rng(abs(doc_id)).permutation(mine)[:PER_DOC].tolist():
                        a, b = max(at - WARM, offsets[k]), min(at + WINDOW + WARM, offsets[k + 1])
                        out.append((k, int(a) - at + WARM, int(b) - at + WARM, data[a:b].tobytes()))
                which, low, high, raw = zip(*out, strict=True) if out else ([],) * 4
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(which, pa.int64())), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(raw, pa.binary())], ["lang", "low", "high", "raw"])

    drawn = sampling.training_table(docs, "lang", per_lang)
    return [] if drawn is None else sorted(drawn.mapInArrow(workers.tidy(run), "lang string, low int, high int, raw binary").collect())


def train(rows: list, steps: int = STEPS, seed: int = 7) -> Network:
    """From (lang, low, high, raw); Adam on batches of windows, of each language as many."""
    langs = sorted({row[0] for row in rows})
    net = Network.new(langs, seed)
    if len(langs) < 2:
        return net
    rng = np.random.default_rng(seed)
    data, mask = np.zeros((len(rows), WINDOW + 2 * WARM), np.uint8), np.zeros((len(rows), WINDOW + 2 * WARM), np.float32)
    for k, (_, low, high, raw) in enumerate(rows):
        data[k, low:high], mask[k, low:high] = np.frombuffer(raw, np.uint8), 1
    label = np.array([langs.index(row[0]) for row in rows])
    by_lang = [np.flatnonzero(label == k) for k in range(len(langs))]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        # More languages than a batch has windows take turns.
        turn = rng.permutation(len(by_lang))[:BATCH]
        some = np.concatenate([rng.choice(by_lang[k], max(1, BATCH // len(turn))) for k in turn])
        _, g = net.gradients(np.ascontiguousarray(data[some].T), np.ascontiguousarray(mask[some].T), label[some])
        rate = RATE * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for k, grad in g.items():
            a, b = moment[k]
            a += 0.1 * (grad - a)
            b += 0.01 * (grad**2 - b)
            net.p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """(text, language) mean position log-probabilities; zero for a text without bytes."""
    data, offsets = textvec.buffer_of(column)
    row, first, end = windows(offsets)
    sums = np.zeros((len(column), len(net.langs)))
    for at in range(0, len(first), TILE):
        some = slice(at, at + TILE)
        logs = net.log_probs(framed(data, offsets[row[some]], first[some], offsets[row[some] + 1]))
        logs *= np.arange(WINDOW)[:, None] < (end - first)[some]
        np.add.at(sums, row[some], logs.sum(axis=1).T)
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def predict(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(train([tuple(r) for r in sampled(docs, per_lang)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part in textvec.chunks(batch):
                text = part.column("text")
                lettered = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
                prob, lang = np.zeros(part.num_rows), np.full(part.num_rows, len(net.langs))
                if net.langs:
                    mean = pooled(net, text)
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    prob[lettered], lang[lettered] = p.max(1)[lettered], p.argmax(1)[lettered]
                out = {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(names[lang], pa.string()), "score": pa.array(prob)}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    picked = docs.select("doc_id", "text", sampling.held_out().alias("held_out"))
    return picked.mapInArrow(workers.tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
