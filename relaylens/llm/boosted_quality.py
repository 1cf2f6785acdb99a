"""Quality scores by histogram gradient-boosted trees over statistics of a document's text.

``STATISTICS`` are shares and averages of characters, words and lines of the whole text.  Each is cut
into at most ``BINS`` bins at its quantiles.  A tree grows level by level: the sums of gradients and of second
derivatives of the logistic loss per node, statistic and bin are one histogram, and a node splits
where the histogram promises the largest gain.  The trees are flattened into arrays; a batch of
documents walks all trees at once, one level a step, by numpy indexing.

* Statistics are computed by Spark, in Arrow batches, for the training rows and for all documents.
* The trees learn from at most ``TRAINING_ROWS`` labelled documents, drawn by the hash of their ids; ids are
  drawn before texts are read.  Of equal statistics (copies) one row stays, with the mean label.
  That sample is small by its bound, so it is fitted in the driver.
* The model, a few thousand numbers, goes to every task; scoring is row-local, without a shuffle.

Defined cases: a null or empty text has statistics of zero and a score like any other; without a label the
score is 0.5; with labels of one kind only it is that kind's smoothed share; a null label is none; labels
of one id are averaged; rows of one id are scored each by its own text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_ROWS = 20_000
TREES, DEPTH, RATE = 80, 4, 0.12
BINS = 64
RIDGE = 1.0
LEAST_WEIGHT = 5.0  # second derivatives in a leaf
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = b"!?.,;:|#*@$%&/=<>{}[]()-_\"'\\~^+"

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "deviation_word", "upper", "digit", "space",
    "high", "control", *(f"mark_{m:02x}" for m in _MARKS), "distinct_words", "top_word", "top_three",
    "distinct_lines", "top_line", "mean_line", "short_lines", "long_words", "upper_words", "digit_words",
    "word_ends", "sentences", "entropy", "compressed", "single_words", "distinct_pairs")


def statistics(data: bytes) -> list[float]:
    """The STATISTICS of a text in UTF-8."""
    if not data:
        return [0.0] * len(STATISTICS)
    size = len(data)
    count = np.zeros(256, np.int64)
    for low in range(0, size, 1 << 20):
        count += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, size - low), low), minlength=256)
    share = count / size
    parts = data.split()
    n = max(1, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    kinds = Counter(parts)
    top = [c for _, c in kinds.most_common(3)]
    lines = [line for line in data.split(b"\n") if line.strip()]
    of_lines = Counter(lines)
    m = max(1, len(lines))
    some = share[share > 0]
    pairs = len(set(zip(parts, parts[1:], strict=False)))
    return [
        float(np.log1p(size)), float(np.log1p(len(parts))), float(np.log1p(len(lines))),
        float(lengths.mean()) if len(parts) else 0.0, float(lengths.std()) if len(parts) else 0.0,
        float(share[65:91].sum()), float(share[48:58].sum()), float(share[_SPACE].sum()),
        float(share[128:].sum()), float(share[:9].sum() + share[14:32].sum()),
        *share[list(_MARKS)].tolist(),
        len(kinds) / n, (top[0] if top else 0) / n, sum(top) / n,
        len(of_lines) / m, max(of_lines.values(), default=0) / m, size / m,
        sum(len(line) < 20 for line in lines) / m, float((lengths > 15).sum()) / n,
        sum(map(bytes.isupper, parts)) / n, sum(map(bytes.isdigit, parts)) / n,
        sum(p[-1] in b".!?" for p in parts) / n, len(re.findall(rb"[.!?](?:\s|$)", data)) / n,
        float(-(some * np.log2(some)).sum()), len(zlib.compress(data, 1)) / size,
        sum(c == 1 for c in kinds.values()) / n, pairs / n]


def cuts(x: np.ndarray) -> list[np.ndarray]:
    """Of each statistic the borders of its bins: middles between neighbouring values at quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) >= BINS:
            ranks = np.quantile(column, np.arange(1, BINS) / BINS)
            middles = np.unique(middles[np.minimum(np.searchsorted(middles, ranks), len(middles) - 1)])
        out.append(middles)
    return out


@dataclass
class Trees:
    """All trees in flat arrays; the children of node ``k`` are ``child[k]`` and ``child[k] + 1``.

    A leaf is its own child and no value lies above its threshold.
    """

    statistic: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values, rows walking down all trees at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = self.child[node] + (x[rows, self.statistic[node]] > self.threshold[node])
        return self.base + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _split(gradient, hessian, node, nodes, binned, borders):
    """Best statistic and border of each of ``nodes`` open nodes; -1 where no split gains."""
    wide = BINS
    columns = binned.shape[1]
    at = (node[:, None] * columns + np.arange(columns)) * wide + binned
    size = nodes * columns * wide
    g = np.bincount(at.ravel(), np.repeat(gradient, columns), size).reshape(nodes, columns, wide)
    h = np.bincount(at.ravel(), np.repeat(hessian, columns), size).reshape(nodes, columns, wide)
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = (left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE)
            - all_g ** 2 / (all_h + RIDGE))
    possible = (left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT) & (
        np.arange(wide) < np.asarray([len(b) for b in borders])[:, None])
    gain = np.where(possible, gain, 0.0).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(nodes), best] > 1e-9, best // wide, -1), best % wide


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for rows of statistics and labels from 0 to 1."""
    prior = (float(y.sum()) + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    borders = cuts(x) if len(x) else []
    statistic, threshold, child, value, roots = [], [], [], [], []
    margin = np.full(len(y), base)
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(borders, x.T, strict=True)], axis=1) \
        if len(x) else np.zeros((0, 0), np.int64)
    for _ in range(TREES if len(x) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        roots.append(len(child))
        open_ = [len(child)]  # tree nodes of this level
        statistic.append(0), threshold.append(np.inf), child.append(len(child)), value.append(0.0)
        node = np.zeros(len(y), np.int64)  # of each row its place in open_, or -1 in a leaf
        leaf = np.full(len(y), open_[0])
        for _ in range(DEPTH):
            live = node >= 0
            if not live.any():
                break
            best, border = _split(gradient[live], hessian[live], node[live], len(open_), binned[live], borders)
            following, moved = [], np.full(len(y), -1)
            for k, tree_node in enumerate(open_):
                if best[k] < 0:
                    continue
                statistic[tree_node] = int(best[k])
                threshold[tree_node] = float(borders[best[k]][border[k]])
                child[tree_node] = len(child)
                own = np.flatnonzero(node == k)
                right = binned[own, best[k]] > border[k]
                for side in (0, 1):
                    moved[own[right == bool(side)]] = len(following)
                    leaf[own[right == bool(side)]] = len(child)
                    following.append(len(child))
                    statistic.append(0), threshold.append(np.inf), child.append(len(child)), value.append(0.0)
            node, open_ = moved, following
            if not open_:
                break
        sums = np.bincount(leaf, gradient, len(child)), np.bincount(leaf, hessian, len(child))
        step = RATE * sums[0] / (sums[1] + RIDGE)
        for k in range(roots[-1], len(child)):
            value[k] = float(step[k]) if child[k] == k else 0.0
        margin += step[leaf]
    return Trees(np.asarray(statistic or [0], np.int64), np.asarray(threshold or [np.inf]),
                 np.asarray(child or [0], np.int64), np.asarray(value or [0.0]),
                 np.asarray(roots or [0], np.int64), base)


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the array ``statistics`` of each row; no shuffle."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "statistics"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")).mapInArrow(
        measure, "doc_id long, statistics array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
          doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees fitted to the labelled documents for whose ``doc_id`` the condition ``usable`` holds."""
    drawn = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                          F.col(f"`{label}`").cast("double").alias("label")).where(
        usable & F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(
        F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    known = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # At most TRAINING_ROWS rows of 16 bytes; rows of equal statistics are one.
    rows = with_statistics(known.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")).join(
        F.broadcast(drawn), "doc_id").groupBy("statistics").agg(F.avg("label").alias("label")).orderBy(
        F.xxhash64("statistics")).limit(TRAINING_ROWS).collect()
    x = np.asarray([r["statistics"] for r in rows], np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.asarray([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of each row."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray([statistics(t) for t in batch.column(1).to_pylist()], np.float64)
            found = trees.scores(x.reshape(batch.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")).mapInArrow(
        walk, "doc_id long, score double")
