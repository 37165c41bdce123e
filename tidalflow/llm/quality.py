"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its potential is linear in features of its own and of the lines before and after it; a 2 x 2
table ties neighbours. Forward-backward gives each line's probability of being good; their mean, weighted by length, is
turned into a score by a logistic curve fitted on the training documents. Features are counts of characters and words:
neither labels nor language, source or id take part in a score.

Training: labels of documents, read as those of all their lines, from at most SAMPLE labelled documents (the smallest by a
hash of the id) while these have LINES lines together; rows whose crc32(id as text) mod 3 is 1 are held out. Fitting is on the driver, as
the sample is bounded; every document is scored, whole.

Defined cases: null and empty texts are one empty line and get its score; without training labels of both kinds every score
is the share of good ones (0.5 without any); null labels aren't used; of several labels for an id the smallest counts;
repeated rows each get a row; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered, per_text, texts

SAMPLE, LINES, PASSES, RATE, RIDGE = 3000, 120_000, 160, 0.08, 1e-3
_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL = range(6)
_KIND = np.array([_SPACE if c in b" \t\n\r\x0b\x0c" else _UPPER if 65 <= c <= 90 else _LOWER if 97 <= c <= 122 or c >= 128 else _DIGIT if 48 <= c <= 57 else _STOP if c in b".,;:?'\"()-" else _SYMBOL for c in range(256)], np.uint8)
FEATURES = 12


def line_features(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: features, lengths in bytes; and the number of lines of each text."""
    whole = np.frombuffer(b"\n".join(batch) + b"\n", np.uint8)
    kind = _KIND[whole]
    ends = np.flatnonzero(whole == 10)
    starts = np.append(0, ends[:-1] + 1)
    flags = [kind == k for k in range(6)]
    begins = ~flags[_SPACE] & np.append(True, flags[_SPACE][:-1])  # of words
    after = np.append(False, flags[_SYMBOL][:-1])
    flags += [begins, flags[_SYMBOL] & after, flags[_SYMBOL] & ~after & np.append(False, ~flags[_SPACE][:-1])]
    total = np.stack([np.add.reduceat(f, starts, dtype=np.int64) for f in flags], 1).astype(np.float64)
    total[:, _SPACE] -= 1  # the line end
    size = (ends - starts).astype(np.float64)
    count, distinct, again = [], [], []
    for text in batch:
        lines = text.split(b"\n")
        same = Counter(lines)
        count.append(len(lines))
        distinct += [len(set(x.split())) for x in lines]
        again += [(same[x] - 1) / len(lines) for x in lines]
    n, words = np.maximum(size, 1), total[:, 6]
    letters = np.maximum(total[:, _UPPER] + total[:, _LOWER], 1)
    x = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            total[:, _UPPER] / letters,
            total[:, _SYMBOL] / n,
            total[:, _DIGIT] / n,
            total[:, _STOP] / n,
            total[:, _SPACE] / n,
            letters / np.maximum(words, 1),
            np.array(distinct) / np.maximum(words, 1),
            np.array(again),
            total[:, 7] / n,
            total[:, 8] / np.maximum(words, 1),
        ],
        1,
    )
    return x, size, np.array(count, np.int64)


def with_neighbours(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (none: zeros), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first = np.cumsum(count) - count
    before[first], after[first + count - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


class Crf:
    """Two states (bad, good); weights of the good one's potential; ``table`` of log potentials between neighbours."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.weights, self.table, self.curve = np.zeros(3 * len(mean) + 1), np.zeros((2, 2)), np.array([0.0, 1.0])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def marginals(self, odds: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the summed P(state, next state) of each text, and log Z of each text."""
        order = np.argsort(-count, kind="stable")
        first = (np.cumsum(count) - count)[order]
        length, longest = count[order], int(count.max())
        live = np.searchsorted(-length, -np.arange(1, longest + 1), "right")  # texts that have so many lines
        node = np.exp(np.stack([np.zeros_like(odds), np.clip(odds, -40, 40)], 1))
        move = np.exp(self.table)
        forward, log_z = np.empty((len(odds), 2)), np.zeros(len(count))
        state = np.ones((len(count), 2))
        for t in range(longest):
            k = live[t]
            at = first[:k] + t
            state = node[at] * (state[:k] @ move if t else state[:k])
            total = state.sum(1)
            log_z[:k] += np.log(total)
            state = state / total[:, None]
            forward[at] = state
        backward = np.ones((len(odds), 2))
        both = np.zeros((len(count), 2, 2))
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            at = first[:k] + t
            ahead = node[at + 1] * backward[at + 1]
            joint = forward[at][:, :, None] * move * ahead[:, None, :]
            both[:k] += joint / joint.sum((1, 2))[:, None, None]
            b = ahead @ move.T
            backward[at] = b / b.sum(1)[:, None]
        good = forward * backward
        good = good[:, 1] / good.sum(1)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return good, both[back], log_z[back]

    def fit(self, x: np.ndarray, count: np.ndarray, label: np.ndarray, size: np.ndarray) -> None:
        """Adam on the penalised likelihood, each text weighted by one over its lines and both labels alike; then the curve."""
        x = with_neighbours(self.standard(x), count)
        owner = np.repeat(np.arange(len(count)), count)
        y = label[owner]
        share = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9)) / len(label)
        weight = share / count
        params, m, v = np.zeros(len(self.weights) + 4), 0.0, 0.0
        for step in range(1, PASSES + 1):
            self.weights, self.table = params[:-4], params[-4:].reshape(2, 2)
            good, both, _ = self.marginals(x @ self.weights, count)
            seen = np.zeros_like(both)
            seen[np.arange(len(count)), label, label] = count - 1
            slope = np.append(x.T @ ((good - y) * weight[owner]), ((both - seen) * weight[:, None, None]).sum(0).ravel()) + RIDGE * params
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        self.weights, self.table = params[:-4], params[-4:].reshape(2, 2)
        raw = self._raw(x, count, size)
        a, b = 0.0, 1.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(a + b * raw, -40, 40)))
            error = (p - label) / len(label)
            a, b = a - 2.0 * error.sum(), max(0.05, b - 0.5 * (error * raw).sum())
        self.curve = np.array([a, b])

    def _raw(self, x: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' marginals."""
        good, _, _ = self.marginals(x @ self.weights, count)
        first = np.cumsum(count) - count
        weight = size + 1e-6
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        return np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1 - 1e-6))

    def scores(self, batch: list[bytes]) -> np.ndarray:
        if not batch:
            return np.zeros(0)
        x, size, count = line_features(batch)
        raw = self._raw(with_neighbours(self.standard(x), count), count, size)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * raw, -40, 40)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def scores(self, batch: list[bytes]) -> np.ndarray:
        return np.full(len(batch), self.value)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = LINES):
    """A model from the first labelled documents that aren't held out, by a hash of the id: at most ``sample``, whole ones, until they have ``most_lines`` lines."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def make():
        def run(_, batch):
            x, size, count = line_features(batch)
            cut = np.cumsum(count)[:-1]
            return {"x": [a.astype(np.float32).tobytes() for a in np.split(x, cut)], "size": [a.astype(np.float32).tobytes() for a in np.split(size, cut)]}

        return run

    ids = F.broadcast(chosen)  # at most ``sample`` rows
    mine = docs.join(ids.select(F.col("doc_id").alias("of")), F.col("doc_id") == F.col("of"), "left_semi")
    lines = mine.groupBy("doc_id").agg(F.max(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1).alias("lines"))
    fit, taken = [], 0
    for row in lines.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").collect():  # two numbers a document
        if taken < most_lines:
            fit.append(row.doc_id)
            taken += row.lines
    if not fit:
        return Constant(0.5)
    # of rows that repeat an id, one
    found = per_text(texts(mine.where(F.col("doc_id").isin(fit))), make, "x binary, size binary").groupBy("doc_id").agg(F.min(F.struct("x", "size")).alias("f")).select("doc_id", "f.*")
    rows = sorted(found.join(ids, "doc_id").collect(), key=lambda r: r.doc_id)
    label = np.array([r.quality for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return Constant(float(label.mean()) if len(label) else 0.5)
    x = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    size = np.concatenate([np.frombuffer(r.size, np.float32) for r in rows]).astype(np.float64)
    lines, count = np.concatenate(x).astype(np.float64), np.array([len(a) for a in x])
    model = Crf(lines.mean(0), np.maximum(lines.std(0), 1e-3))
    model.fit(lines, count, label, size)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def make():
        def run(_, batch):
            s = model.value.scores(batch)
            return {"score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}

        return run

    out = per_text(texts(docs), make, "score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted good, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    return filtered(docs, lambda: lambda batch: (model.value.scores(batch) >= 0.5).tolist())
