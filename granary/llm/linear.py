"""Multinomial logistic regression on hashed TF-IDF n-grams, trained with follow-the-regularised-leader (FTRL-Proximal).

Feature counts, document frequencies and predictions are made where the texts are, in tasks, over whole texts; only the
bounded training sample comes to the driver, which fits the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, giving_back, in_small_batches, slices, text_bytes

#: log2 of the number of hashed features.
WIDTH = 13
#: Texts are counted in groups of about so many bytes and at most so many rows: a count matrix has a row for each document.
GROUP_BYTES, GROUP_ROWS = 1 << 20, 64


def gram_counts(part: pa.RecordBatch, orders: tuple[int, ...] = (1, 2, 3), width: int = WIDTH, lower: bool = True) -> np.ndarray:
    """For each document of a slice the number of its character n-grams in each of 2**width classes."""
    raw, off = text_bytes(part.column("text"))
    if lower:
        import pyarrow.compute as pc

        raw, off = text_bytes(pc.utf8_lower(part.column("text")))
    points, ends, _ = code_points(raw, off)
    n, size = len(ends) - 1, 1 << width
    doc = np.repeat(np.arange(n, dtype=np.int64) * size, np.diff(ends))
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(points))  # code points up to the document's end
    counts = np.zeros(n * size, np.int64)
    h = np.zeros(len(points), np.uint64)
    for k in range(max(orders)):
        m = len(points) - k
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + points[k:].astype(np.uint64) + np.uint64(1)
        if k + 1 in orders:
            at = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - width)).astype(np.int64) + doc[:m]
            counts += np.bincount(at[left[:m] > k], minlength=n * size)
    return counts.reshape(n, size).astype(np.float32)


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, budget=GROUP_BYTES):
        for a in range(0, part.num_rows, GROUP_ROWS):
            yield part.slice(a, min(GROUP_ROWS, part.num_rows - a))


def document_frequencies(docs: DataFrame, counts=gram_counts, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """In how many documents (column text, not null) each feature is, and how many documents there are.

    Tasks send sums of their documents; the driver gets one row of 2**width numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << width, np.int64), 0
        for batch in batches:
            for part in groups(batch):
                seen += (counts(part) > 0).sum(axis=0)
                n += part.num_rows
        at = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen[at[:-1]], n))], ["feature", "n"])

    rows = in_small_batches(docs).select("text").mapInArrow(giving_back(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(1 << width), 0
    for r in rows:
        if r.feature < 0:
            total = r.n
        else:
            df[r.feature] = r.n
    return df, total


def idf(df: np.ndarray, total: int) -> np.ndarray:
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


def features(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, each row of length 1."""
    x = np.log1p(counts) * weight
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


#: A row of features: the places of those that aren't 0, and their values.
Sparse = tuple[np.ndarray, np.ndarray]


def sparse(x: np.ndarray) -> list[Sparse]:
    return [(at := np.flatnonzero(row), row[at]) for row in x]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Weights, bias and temperature; learned from rows x and class numbers y."""

    def __init__(self, classes: list, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 6):
        self.classes, self.alpha, self.beta, self.l1, self.l2, self.epochs = classes, alpha, beta, l1, l2, epochs
        self.temperature = 1.0

    def fit(self, x: list[Sparse], y: np.ndarray, width: int, seed: int = 7) -> Model:
        """FTRL-Proximal, one row at a time, with an elastic-net penalty; every fifth row only serves to set the temperature."""
        held = np.arange(len(x)) % 5 == 4
        k = len(self.classes)
        z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))  # one more place for the bias
        rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(x))
        rng = np.random.default_rng(seed)
        one = np.eye(k)
        for _ in range(self.epochs):
            for i in rng.permutation(rows):
                at, v = np.append(x[i][0], width), np.append(x[i][1], 1.0).astype(np.float64)
                w = self._weights(z[at], n[at])
                error = softmax((v @ w)[None])[0] - one[y[i]]
                g = v[:, None] * error
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - sigma * w
                n[at] += g * g
        w = self._weights(z, n)
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1].astype(np.float32)
        check = np.flatnonzero(held) if held.any() else rows
        logits = np.array([x[i][1] @ self.weights[x[i][0]] + self.bias for i in check], np.float64)
        grid = np.exp(np.linspace(np.log(0.3), np.log(20), 121))
        loss = [-np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax((x @ self.weights + self.bias).astype(np.float64) / self.temperature)


def share_of(h: Column) -> Column:
    """A 64-bit hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def least(df: DataFrame, label: str, most: int, h: Column) -> DataFrame:
    """About so many rows of each label, those of the least hashes h; all rows of a label that has no more.

    df's rows are different. Only the rows of each label are counted, which tasks do for themselves first; no task ranks or holds a label's rows.
    The share of hashes that is chosen follows from the count, so the number of rows varies by its square root.
    """
    shares = {r[label]: min(1.0, most / r.n) for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    limit = F.element_at(F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v)))), F.col(label)) if shares else F.lit(0.0)
    return df.filter(share_of(h) < limit)


def sample(docs: DataFrame, label: str, most: int) -> DataFrame:
    """About so many different texts of each label (columns text and label), by a hash of the text.

    Different hashes are counted by label first, so only chosen texts are shuffled, copies of a text as one.
    """
    hashed = docs.select("text", label, F.xxhash64("text").alias("h"))
    chosen = least(hashed.select(label, "h").distinct(), label, most, F.col("h"))
    few = hashed.join(F.broadcast(chosen), [label, "h"], "left_semi")
    return few.groupBy(label, "h").agg(F.min("text").alias("text")).select("text", label)
