"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network is trained by backpropagation through time on windows of a bounded sample of labelled texts. It gives
every byte position a probability for each language; a document's probabilities are the mean over all its positions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.words import buffers, ranges
from lexgrid.runtime import durable

HIDDEN = 8
#: The bounded training sample: labelled rows (those of the least hashes), windows of each, and characters in a window.
TRAIN_ROWS, WINDOWS, WINDOW_CHARS = 3000, 3, 64
#: Training: rows and bytes in a batch, batches, learning rate.
BATCH, LENGTH, STEPS, RATE = 192, 48, 260, 0.02
#: Whole texts are cut into segments of so many bytes, run side by side.
SEGMENT, GROUP = 128, 1 << 20
HELD_OUT = 5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """One gated layer in each direction over byte embeddings that are held as input projections, and a linear output.

    Parameters of a direction: w (256, 3H) for the byte, u (H, 3H) for the state, with parts z, r, n:
    z, r = sigmoid(w + h u), n = tanh(w + r * (h u)), h' = h + z * (n - h).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        self.p["v"] = rng.normal(0, 1 / np.sqrt(hidden), (2 * hidden, len(labels)))
        self.p["c"] = np.zeros(len(labels))

    def _forward(self, x: np.ndarray, d: str) -> list[tuple]:
        """x: (time, rows) bytes in the direction's order. One (h, z, r, n, state part of n, next h) for each time."""
        w, u, k = self.p[f"w{d}"], self.p[f"u{d}"], self.hidden
        h, steps = np.zeros((x.shape[1], k)), []
        for row in x:
            i, a = w[row], h @ u
            g = _sigmoid(i[:, : 2 * k] + a[:, : 2 * k])
            z, r, an = g[:, :k], g[:, k:], a[:, 2 * k :]
            n = np.tanh(i[:, 2 * k :] + r * an)
            after = h + z * (n - h)
            steps.append((h, z, r, n, an, after))
            h = after
        return steps

    def _backward(self, x: np.ndarray, d: str, steps: list[tuple], out: np.ndarray, grad: dict) -> None:
        """Backpropagation through time. out: (time, rows, H), the gradient of each state from the output."""
        u, k = self.p[f"u{d}"], self.hidden
        dh, du, dx = np.zeros_like(steps[0][0]), np.zeros_like(u), np.empty((*x.shape, 3 * k))
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n, an, _ = steps[t]
            dh = dh + out[t]
            pre_n = dh * z * (1 - n * n)
            pre_z = dh * (n - h) * z * (1 - z)
            pre_r = pre_n * an * r * (1 - r)
            da = np.concatenate([pre_z, pre_r, pre_n * r], 1)
            dx[t] = np.concatenate([pre_z, pre_r, pre_n], 1)
            du += h.T @ da
            dh = dh * (1 - z) + da @ u.T
        one = np.zeros((x.size, 256))
        one[np.arange(x.size), x.ravel()] = 1
        grad[f"w{d}"], grad[f"u{d}"] = one.T @ dx.reshape(x.size, -1), du

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and the gradients. x: (time, rows) bytes; y: a label for each row."""
        fwd, bwd = self._forward(x, "f"), self._forward(x[::-1], "b")
        state = np.concatenate([np.stack([s[5] for s in fwd]), np.stack([s[5] for s in bwd])[::-1]], 2)
        logits = state @ self.p["v"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        picked = prob[:, np.arange(len(y)), y]
        d = prob.copy()
        d[:, np.arange(len(y)), y] -= 1
        d /= x.size
        grad = {"v": np.tensordot(state, d, ([0, 1], [0, 1])), "c": d.sum((0, 1))}
        ds = d @ self.p["v"].T
        self._backward(x, "f", fwd, ds[:, :, : self.hidden], grad)
        self._backward(x[::-1], "b", bwd, ds[::-1, :, self.hidden :], grad)
        return float(-np.log(picked + 1e-12).mean()), grad

    def fit(self, windows: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 1) -> "BiGRU":
        """Adam over random crops; each batch has its labels in equal shares."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(y == c) for c in range(len(self.labels))]
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            label = np.arange(BATCH) % len(by_label)
            rows = [windows[rng.choice(by_label[c])] for c in label]
            x = np.full((LENGTH, BATCH), 32, np.uint8)
            for i, row in enumerate(rows):
                start = rng.integers(0, max(1, len(row) - LENGTH + 1))
                part = np.frombuffer(row[start : start + LENGTH], np.uint8)
                x[: len(part), i] = part
            _, grad = self.loss(x, label)
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _run(self, x: np.ndarray, d: str, v: np.ndarray) -> np.ndarray:
        """(time, rows, labels): a direction's share of the logits, in single precision.

        Signs and factors are folded into the weights so that each gate is 1 / (1 + exp(.)).
        """
        k = self.hidden
        fold = np.concatenate([np.full(2 * k, -1.0), np.full(k, -2.0)])
        w, u = (self.p[f"w{d}"] * fold).astype(np.float32), (self.p[f"u{d}"] * fold).astype(np.float32)
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((*x.shape, v.shape[1]), np.float32)
        with np.errstate(over="ignore"):
            for t, row in enumerate(x):
                i, a = w.take(row, 0), h @ u
                g = i[:, : 2 * k]
                g = g + a[:, : 2 * k]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                n = g[:, k:] * a[:, 2 * k :]
                n += i[:, 2 * k :]
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                n -= h
                n *= g[:, :k]
                h += n
                np.matmul(h, v, out=out[t])
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(time, rows, labels): the probabilities at each position of byte rows."""
        v = self.p["v"].astype(np.float32)
        logits = self._run(x, "f", v[: self.hidden])
        logits += self._run(x[::-1], "b", v[self.hidden :])[::-1]
        logits += self.p["c"].astype(np.float32)
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        return logits

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean probabilities of each text, (texts, labels); zeros for an empty one."""
        lengths = np.diff(offsets)
        number = -(-lengths // SEGMENT)
        if not number.sum():
            return np.zeros((len(lengths), len(self.labels)))
        owner = np.repeat(np.arange(len(lengths)), number)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * SEGMENT
        have = np.minimum(SEGMENT, offsets[owner + 1] - start)
        by_segment = np.empty((len(owner), len(self.labels)))
        for lo in range(0, len(owner), GROUP // SEGMENT):  # a long text is run in parts
            part = slice(lo, lo + GROUP // SEGMENT)
            at = start[None, part] + np.arange(SEGMENT)[:, None]
            inside = np.arange(SEGMENT)[:, None] < have[None, part]
            prob = self.positions(np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(32)))
            prob *= inside[:, :, None]
            by_segment[part] = prob.sum(0, dtype=np.float64)
        sums = np.stack([np.bincount(owner, by_segment[:, c], len(lengths)) for c in range(len(self.labels))], 1)
        return sums / np.maximum(lengths, 1)[:, None]

    def label_positions(self, text: str) -> list[str]:
        """The likeliest language at each byte of a text."""
        if not text:
            return []
        data = np.frombuffer(text.encode(), np.uint8)
        x = np.full(-(-len(data) // SEGMENT) * SEGMENT, 32, np.uint8)
        x[: len(data)] = data
        best = self.positions(x.reshape(-1, SEGMENT).T.copy()).argmax(2).T.ravel()[: len(data)]
        return [self.labels[i] for i in best]


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT


def train(df: DataFrame, rows: int = TRAIN_ROWS) -> BiGRU | None:
    """A network for the languages of a bounded sample of the labelled rows that are not held out; None without any.

    Each language gets an equal part of `rows`, its rows with the least hashes of their id; with more languages than
    rows the most frequent ones are learned. WINDOWS windows of each row come to the driver.
    """
    length = F.length("text")
    start = lambda i: (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(length - WINDOW_CHARS, F.lit(1))) + 1).cast("int")
    windows = F.array(*[F.substring(F.col("text"), start(i), F.lit(WINDOW_CHARS)) for i in range(WINDOWS)])
    usable = df.where((remainder() != 0) & F.col("lang").isNotNull() & (length > 0)).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return None
    part = rows // len(counts)
    # Cut by hash before sorting: else each task would send as many rows as the whole sample has.
    cut = {r["lang"]: int(min(1.0, 1.3 * part / r["count"] + 30 / r["count"]) * (1 << 30)) for r in counts}
    shares = durable(df.sparkSession.createDataFrame(list(cut.items()), "lang string, cut long"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = usable.join(shares, "lang").where(h < F.col("cut")).select("lang", h.alias("h"), "doc_id", windows.alias("windows"))
    sample, taken = [], dict.fromkeys(cut, 0)
    for r in sorted(near.collect(), key=lambda r: (r.h, r.doc_id is None, r.doc_id or 0, r.lang, r.windows)):
        if taken[r.lang] < part:
            taken[r.lang] += 1
            sample.append(r)
    labels = sorted({r.lang for r in sample})
    pairs = [(w.encode(), labels.index(r.lang)) for r in sample for w in r.windows if _LETTER.search(w)]
    pairs += [(b" ", i) for i in range(len(labels)) if i not in {y for _, y in pairs}]
    return BiGRU(labels).fit([w for w, _ in pairs], np.array([y for _, y in pairs]))


def predict(df: DataFrame, model: BiGRU | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of df (doc_id, text).

    score is the document's probability of lang_pred; of equally likely languages the first by code point is taken. A
    null text, one without a letter, and every text when nothing was learned, is `und` with score 0. A null doc_id is
    neither learned from nor held out. A text of any length is run in parts of bounded size.
    """

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for lo, hi in ranges(offsets, GROUP):
                texts = batch.column(2).slice(lo, hi - lo).to_pylist()
                known = [model is not None and t is not None and _LETTER.search(t) is not None for t in texts]
                labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if any(known):
                    prob = model.texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    best = prob.argmax(1)
                    for i, k in enumerate(known):
                        if k:
                            labels[i], scores[i] = model.labels[best[i]], min(1.0, float(prob[i, best[i]]))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")
    return df.select("doc_id", held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame) -> DataFrame:
    """Trains on the rows that are not held out and predicts every row."""
    return predict(df, train(df))
