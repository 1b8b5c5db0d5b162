"""Quality classifier: histogram gradient-boosted trees over document statistics.

The model is fitted here, in numpy, on at most max_rows labelled rows (those of least hash of their doc_id). Its trees
are flattened into arrays, and a batch of documents walks all trees at once. Documents are scored where they are read:
no shuffle. Inputs of a score are statistics of the text alone.

Defined results: null and empty texts are scored like a text of zero bytes; null ids are never held out; without labels
of both kinds all scores are the share of label 1 (0.5 without any labels). Rows that repeat are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestlake.llm.common import binary_lists, without, words

MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 3, 60, 0.2, 1.0, 10
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "newline", "sentence_marks", "quotes_brackets", "other_symbols",
    "control", "non_ascii", "log_words", "word_bytes", "distinct_words", "same_word_again", "bytes_per_line",
    "distinct_lines", "symbols_per_word", "upper_per_letter", "longest_word",
)
_KIND = np.full(256, 7)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?!", b"\"'()[]-")):
    _KIND[list(_set)] = _k
_KIND[[*range(9), 11, 12, *range(14, 32), 127]] = 8
_KIND[128:] = 9


def statistics(text: bytes | None) -> list[float]:
    """FEATURES of one text."""
    text = text or b""
    n = len(text)
    counts = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=10)
    w = words(text)
    nw = len(w)
    lines = text.split(b"\n")
    letters = counts[0] + counts[1]
    return [
        np.log1p(n), *(counts / max(n, 1)), np.log1p(nw), sum(map(len, w)) / max(nw, 1), len(set(w)) / max(nw, 1) ** 0.8,
        sum(map(eq, w, w[1:])) / max(nw, 1), n / len(lines), len(set(lines)) / len(lines), (counts[5] + counts[6] + counts[7]) / max(nw, 1),
        counts[1] / max(letters, 1), np.log1p(max(map(len, w), default=0)),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Arrays feature, cut, child (left; right is the next), value of all nodes; a leaf is its own child."""

    def __init__(self, base: float, depth: int = DEPTH) -> None:
        self.base, self.depth = base, depth
        self.feature, self.cut, self.child, self.value, self.roots = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        offset = np.arange(x.shape[1]) * BINS
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            self.roots.append(self._node())
            todo = [(self.roots[-1], np.arange(len(y)), 0)]
            while todo:
                node, rows, level = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                self.value[node] = -RATE * gs / (hs + L2)
                if level == self.depth or len(rows) < 2 * LEAST:
                    continue
                flat = (binned[rows] + offset).ravel()
                size = BINS * x.shape[1]
                hist = [np.bincount(flat, np.repeat(v, x.shape[1]), size).reshape(-1, BINS).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                self.feature[node], self.cut[node] = int(f), float(cuts[f][b])
                left, right = self._node(), self._node()
                self.child[node] = left
                go = binned[rows, f] <= b
                todo += [(left, rows[go], level + 1), (right, rows[~go], level + 1)]
            raw += self._raw(x, self.roots[-1:])
        return self

    def _node(self) -> int:
        self.feature.append(0), self.cut.append(np.inf), self.child.append(len(self.child)), self.value.append(0.0)
        return len(self.child) - 1

    def _raw(self, x: np.ndarray, roots: list[int]) -> np.ndarray:
        feature, cut, child, value = map(np.asarray, (self.feature, self.cut, self.child, self.value))
        at = np.tile(np.array(roots, np.int64), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = child[at] + (x[rows, feature[at]] > cut[at])
        return value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self._raw(x, self.roots)))) if self.roots else np.full(len(x), 1 / (1 + np.exp(-self.base)))


def held_out(doc_id: object) -> object:
    """crc32 of the id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> BoostedTrees:
    """Fits on labelled rows that are not held out; max_rows bounds what reaches the driver (160 bytes a row)."""
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id"))
        .groupBy("__id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(binary_lists(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).toArrow()  # rows may share an id
    y = rows.column("quality").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y])  # the rows' order in the result is not fixed
    x, y = x[order], y[order]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = BoostedTrees(float(np.log(share / (1 - share))))
    return model.fit(x, y) if 0 < y.sum() < len(y) else model


def score(docs: DataFrame, model: BoostedTrees, threshold: float = THRESHOLD, made: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the two columns made, which replace columns so named; the model, a few kB, travels with the task."""
    docs = without(docs, *made)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(matrix(binary_lists(batch, "text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, {made[0]} double, {made[1]} int")
