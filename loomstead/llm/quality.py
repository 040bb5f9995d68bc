"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy.

The statistics of a text are taken over the whole of it: shares of kinds of bytes, lengths of words and lines, and
repetition of words and lines. Trees are learned on the driver from a bounded sample of labelled documents (``LEARN_FROM``);
they are complete binary trees of one depth, so a batch walks a tree in as many array steps as it has levels.

Defined cases: null and empty texts have all statistics 0 and get the score of those; without any labels, or with only
one class, the score is the (smoothed) share of label 1. Repeated rows score alike. Extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import LEARN_FROM, held_out, learn_from
from .runtime import need, ship, table
from .text import pieces, utf8, words

#: Documents with a lower score are rejected.
KEEP_FROM = 0.3
NAMES = (
    "bytes", "words", "lines", "word_length", "line_words", "space", "upper", "lower", "digit", "wide", "full_stop", "comma", "exclaim", "question", "pipe",
    "symbol", "bracket", "quote", "other", "byte_entropy", "distinct_words", "top_word", "repeated_lines", "top_line", "long_words", "short_words",
)


def _bytes_of(s: str) -> list[int]:
    return [ord(c) for c in s]


_KINDS = [
    _bytes_of(" \t\n\r\f\v"), list(range(65, 91)), list(range(97, 123)), _bytes_of("0123456789"), list(range(128, 256)), _bytes_of("."), _bytes_of(",;:"), _bytes_of("!"),
    _bytes_of("?"), _bytes_of("|"), _bytes_of("#$%&*+=@^_~"), _bytes_of("()[]{}<>/\\"), _bytes_of("\"'`-"), [b for b in range(32) if not 9 <= b <= 13],
]


def _repetition(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its number of distinct values and how often the most frequent one occurs."""
    kinds, most = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for r in np.flatnonzero(np.diff(off)):
        own = np.sort(values[off[r] : off[r + 1]])
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        kinds[r], most[r] = len(ends), np.diff(ends, prepend=-1).max()
    return kinds, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    buf, off = utf8(column)
    n, size = len(off) - 1, np.diff(off).astype(float)
    counts = np.bincount(np.repeat(np.arange(n) * 256, np.diff(off)) + buf, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)
    share = np.stack([counts[:, k].sum(1) / some for k in _KINDS], 1)
    p = counts / some[:, None]
    entropy = -(p * np.log2(p, where=p > 0, out=np.zeros_like(p))).sum(1)
    hashes, woff, starts = words(buf, off)
    many = np.diff(woff).astype(float)
    some_words = np.maximum(many, 1)
    kinds, top = _repetition(hashes, woff)
    newline = np.flatnonzero(buf == 10)
    first = np.unique(np.concatenate([off[:-1][size > 0], newline + 1]))
    first = first[first < len(buf)]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
        at = np.searchsorted(starts, np.append(first, len(buf)))
        lines = total[at[1:]] - total[at[:-1]]
    full = np.diff(at) > 0
    loff = np.searchsorted(first[full], off)
    line_kinds, line_top = _repetition(lines[full], loff)
    many_lines = np.diff(loff).astype(float)
    some_lines = np.maximum(many_lines, 1)
    gap = np.diff(np.append(starts, len(buf)))
    over = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[woff]) / some_words
    return np.column_stack([
        np.log1p(size), np.log1p(many), np.log1p(many_lines), size / some_words, many / some_lines, share, entropy, kinds / some_words, top / some_words,
        1 - line_kinds / some_lines * (many_lines > 0) - (many_lines == 0), line_top / some_lines, over(gap > 16), over(gap <= 4)])


@dataclass
class Trees:
    """Complete trees of one depth: ``feature`` and ``above`` (go right if the statistic is over it) by tree and node."""

    base: float
    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, bins: int = 48, rate: float = 0.15, ridge: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss; the splits come from histograms of gradients over quantile bins."""
    p0 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p0 / (1 - p0)))
    inner = 2**depth - 1
    shape = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth))
    if len(np.unique(y)) < 2:
        return Trees(base, *shape)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: over edge b - 1, not over edge b
    z, out = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node, feature, above = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = (((node - first)[:, None] * m + np.arange(m)) * bins + binned).ravel()
            hist = [np.bincount(cell, np.repeat(v, m), wide * m * bins).reshape(wide, m, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(v, 2) for v in hist)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < 1e-2) | (all_h - left_h < 1e-2)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for k in range(wide):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6:
                    feature[first + k], above[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > above[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        z = z + leaf[at]
        for o, v in zip(out, (feature, above, leaf), strict=True):
            o.append(v)
    return Trees(base, *map(np.array, out))


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_FROM) -> Trees:
    """Trees for ``labels.quality`` from at most ``most`` documents of ``docs`` (id, text)."""

    def measured(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("id").cast(pa.int64()), part.column("label")], ["x", "id", "label"])

    got = learn_from(docs, labels, "quality", most).mapInArrow(measured, "x array<double>, id long, label int").toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return grow(x, got["label"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` and a new last one, ``quality_score``; without ``keep_text`` the text isn't carried back."""
    kept = [f for f in docs.schema if keep_text or f.name != text_col]

    def scored(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(trees.score(statistics(part.column(text_col))))], [*(f.name for f in kept), "quality_score"])

    return docs.mapInArrow(scored, T.StructType([*kept, T.StructField("quality_score", T.DoubleType())]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = need(table(spark, sf_dir, "documents"), id="doc_id", text="text")
    scores = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_FROM).cast("int").alias("predicted"))
