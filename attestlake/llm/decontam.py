"""Benchmark decontamination: windows of benchmark words, looked up in every document.

Windows are n consecutive words of an item (an item of fewer words, but not none, is one window of all its words).
The set of windows is broadcast when it has at most max_windows of them, and documents are then not shuffled. A larger
set is split by hash into parts of about that size. Each is looked up by a job of its own, which writes the hits alone
and ends before the next part is read, so neither the driver nor an executor ever holds more than a part; documents meet
their hits last. A document is mapped to ids of benchmark words, positions whose window has benchmark words only are
hashed at once, and hash hits are confirmed word by word.

Null or empty texts have no words, so no hits and no windows. Repeated rows, null ids and ties are rows of their own.
Windows of a benchmark item without an id are hit like others; such an item has no place among the item ids.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestlake.llm.common import Scratch, binary_lists, fresh, row_hashes, words

#: Windows in one broadcast, about 150 MB in a Python worker.
MAX_WINDOWS = 500_000


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, gram (words joined by a space, as bytes): each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for item, text in zip(batch.column(0).to_pylist(), binary_lists(batch, "text"), strict=True):
                w = words(text)
                for gram in {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else ():
                    ids.append(item)
                    grams.append(gram)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.binary())], ["item_id", "gram"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, gram binary")


class WindowIndex:
    """Word ids, and for each window length sorted hashes and the items of each window."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, gram in rows:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in gram.split()], np.uint32)
            by_length[len(w)][w.tobytes()].append(item)
        self.lengths = {}
        for n, found in sorted(by_length.items()):
            grams = np.frombuffer(b"".join(found), np.uint32).reshape(-1, n)
            self.lengths[n] = (np.unique(self.hashes(grams)), dict(found))

    @staticmethod
    def hashes(grams: np.ndarray) -> np.ndarray:
        h = np.zeros(len(grams), np.uint64)
        for k in range(grams.shape[1]):
            h = (h ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, number of words) of each window found, and their items."""
        get = self.vocabulary.get
        ids = np.array([get(x, 0) for x in w], np.uint32)
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        spans, items = [], set()
        for n, (keys, found) in self.lengths.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            grams = np.lib.stride_tricks.sliding_window_view(ids, n)[at]
            h = self.hashes(grams)
            p = np.searchsorted(keys, h)
            for i in np.flatnonzero(keys[np.minimum(p, len(keys) - 1)] == h):
                if (own := found.get(grams[i].tobytes())) is not None:
                    spans.append((int(at[i]), n))
                    items.update(x for x in own if x is not None)
        return spans, items


def _parts(benchmark: DataFrame, n: int, max_windows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The windows with their part, and the number of parts."""
    grams = scratch.save(benchmark_windows(benchmark, n))
    parts = max(1, -(-grams.count() // max_windows))
    return grams.withColumn("part", F.pmod(F.xxhash64("gram", "item_id"), F.lit(parts))), parts


def _broadcast(grams: DataFrame, part: int) -> Broadcast:
    """The index of one part, on all executors."""
    rows = grams.where(F.col("part") == part).select("item_id", "gram").collect()
    return grams.sparkSession.sparkContext.broadcast(WindowIndex([(r.item_id, bytes(r.gram)) for r in rows]))


def _words_hit(spans: list[tuple[int, int]]) -> list[int]:
    return sorted({i for s, n in spans for i in range(s, s + n)})


def _scan(docs: DataFrame, index: Broadcast) -> DataFrame:
    """docs' doc_id and text with n_words, hit_words (sorted positions), item_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hit_words, item_ids = [], [], []
            for text in binary_lists(batch, "text"):
                w = words(text)
                spans, items = index.value.hits(w)
                n_words.append(len(w))
                hit_words.append(_words_hit(spans))
                item_ids.append(sorted(items))
            made = [pa.array(n_words, pa.int64()), pa.array(hit_words, pa.list_(pa.int64())), pa.array(item_ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc_id", "text", "n_words", "hit_words", "item_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n_words long, hit_words array<long>, item_ids array<long>")


def _hits(docs: DataFrame, grams: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """k1, k2 (the row's hashes), hit_words, item_ids of the documents with hits, part after part."""
    found = None
    for k in range(parts):
        index = _broadcast(grams, k)

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, hit_words, item_ids = [], [], []
                for i, text in enumerate(binary_lists(batch, "text")):
                    spans, items = index.value.hits(words(text))
                    if spans:
                        rows.append(i), hit_words.append(_words_hit(spans)), item_ids.append(sorted(items))
                keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(hit_words, pa.list_(pa.int64())), pa.array(item_ids, pa.list_(pa.int64()))], ["k1", "k2", "hit_words", "item_ids"])

        rows = docs.select(*row_hashes(docs), F.col("text").cast("string").alias("text"))
        own = scratch.save(rows.mapInArrow(run, "k1 long, k2 long, hit_words array<long>, item_ids array<long>"))
        index.destroy()
        found = own if found is None else found.unionByName(own)
    # Rows that repeat have the same hits, so the union over rows is that of each.
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return found.groupBy("k1", "k2").agg(merged("hit_words"), merged("item_ids"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs' columns doc_id and text with n_words, hit_words (positions of words inside a window found) and item_ids."""
    scratch = Scratch(docs.sparkSession)
    grams, parts = _parts(benchmark, n, max_windows, scratch)
    if parts == 1:
        return _scan(docs, _broadcast(grams, 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_hashes(docs))
    joined = rows.join(_hits(docs, grams, parts, scratch).hint("shuffle_hash"), ["k1", "k2"], "left")
    none = F.array().cast("array<long>")
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.size(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    return joined.select("doc_id", "text", n_words.alias("n_words"), F.coalesce("hit_words", none).alias("hit_words"), F.coalesce("item_ids", none).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the documents in which a benchmark window occurs; all columns and their order stay.

    Documents are looked up by content, not by id, so null and repeated ids are safe.
    """
    scratch = Scratch(docs.sparkSession)
    grams, parts = _parts(benchmark, n, max_windows, scratch)
    if parts > 1:
        k1, k2 = fresh(docs, "k1", "k2")
        gone = _hits(docs, grams, parts, scratch).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
        return docs.select("*", *row_hashes(docs, k1, k2)).join(gone.hint("shuffle_hash"), [k1, k2], "left_anti").select(*docs.columns)
    index = _broadcast(grams, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not index.value.hits(words(t))[0] for t in binary_lists(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id and text without the words inside windows found, and what stands between two such words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, hit in zip(binary_lists(batch, "text"), batch.column(2).to_pylist(), strict=True):
                if not hit:
                    out.append(text)
                    continue
                at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
                kept, end, last = [], 0, None
                for h in hit:
                    if last is None or h != last + 1:
                        kept.append(text[end : at[h][0]])
                    end, last = at[h][1], h
                out.append(b"".join([*kept, text[end:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    found = find_leaks(docs, benchmark, n, max_windows)
    return found.select("doc_id", "text", "hit_words").mapInArrow(run, "doc_id long, text string")
