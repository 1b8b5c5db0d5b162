"""Line dedup by range-partitioned line hashes and per-document keep bitmaps.

Each non-empty line key (line stripped of ASCII white space, A-Z lower-cased) becomes a 128-bit hash with its document
and position. These rows are written, then range-partitioned by (hash, document) and sorted by (hash, document,
position): a line that a third of all documents hold is spread over many partitions, and a partition is read as a stream. Runs of a hash that
end inside a partition are decided there; runs at its two ends are summed over partitions first. What leaves this
stage is positions, gathered to one zlib-compressed keep bitmap for each document that loses a line; texts meet the
bitmaps last.

A null or empty text is one empty line, which stays. A document is a row, known by its doc_id and a hash of its text (by
two hashes of it where the id is null): rows that repeat both count as one document and get the same result. The first
occurrence of a line is that in the document of least id, rows without an id standing anywhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestlake.llm.common import Scratch, binary_lists, fresh, partitions, without

STRIPPED = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def row_key(docs: DataFrame) -> list:
    """u1, u2: the doc_id and a hash of the text, or two hashes of it."""
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return [F.coalesce(own, F.xxhash64(F.lit(3), text)).alias("u1"), F.xxhash64(own.isNull(), text).alias("u2")]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, u1, u2, pos of every line whose key has at least min_chars code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, pos = [], [], []
            for row, text in enumerate(binary_lists(batch, "text")):
                for i, line in enumerate((text or b"").translate(LOWER).split(b"\n")):
                    key = line.strip(STRIPPED)
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        pos.append(i)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(np.asarray(batch.column(i))[at], pa.int64()) for i in (0, 1)), pa.array(pos, pa.int32())], ["h1", "h2", "u1", "u2", "pos"])

    return docs.select(*row_key(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, u1 long, u2 long, pos int")


def _stream(min_docs: int, keep_first: bool):
    """Reads a partition in order; gives decided drops (h1 null) and, for the runs at its ends, rows still open.

    kind 0: drop this line. kind 1: an open run's line. kind 2: an open run's number of documents in this partition
    (and, as u1, u2 and pos, its first line). A document is a row (u1, u2) of an array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h1", "h2", "u1", "u2", "pos", "n"]
        part = TaskContext.get().partitionId()

        def made(kind: int, h: tuple[int, int] | None, uid: np.ndarray, pos: np.ndarray, n: int = 0) -> pa.RecordBatch:
            k = len(uid)
            hs = [pa.nulls(k, pa.int64())] * 2 if h is None else [pa.array(np.full(k, x, np.int64)) for x in h]
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *hs, pa.array(uid[:, 0]), pa.array(uid[:, 1]), pa.array(pos, pa.int32()), pa.array(np.full(k, n, np.int64))], names)

        class Run:
            def __init__(self, h: tuple[int, int], at_edge: bool) -> None:
                self.h, self.at_edge, self.n, self.last, self.first, self.held, self.over = h, at_edge, 0, None, None, [], False

            def add(self, uid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
                if self.first is None:
                    self.first = (uid[:1], pos[:1])
                self.n += int(np.count_nonzero((uid[1:] != uid[:-1]).any(1))) + (self.last is None or bool((self.last != uid[0]).any()))
                self.last = uid[-1]
                if self.over or (self.n >= min_docs and not (keep_first and self.at_edge)):
                    for u, p in [*self.held, (uid, pos)]:
                        yield from self.drops(u, p)
                    self.held, self.over = [], True
                else:
                    self.held.append((uid, pos))

            def drops(self, uid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
                if keep_first:
                    stay = (uid == self.first[0][0]).all(1) & (pos == self.first[1][0])
                    uid, pos = uid[~stay], pos[~stay]
                if len(uid):
                    yield made(0, None, uid, pos)

            def end(self, last: bool) -> Iterator[pa.RecordBatch]:
                if last or self.at_edge:
                    yield made(2, self.h, *self.first, n=self.n)
                    for u, p in self.held:
                        yield made(1, self.h, u, p)
                elif keep_first and self.n >= min_docs and not self.over:
                    for u, p in self.held:
                        yield from self.drops(u, p)

        open_run, seen = None, False
        for batch in batches:
            h1, h2, u1, u2, pos = (np.asarray(batch.column(i)) for i in range(5))
            uid = np.stack([u1, u2], 1)
            if not len(uid):
                continue
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(uid)]))
            whole = np.ones(len(starts), bool)
            whole[[0, -1]] = False
            # runs wholly inside this batch, all at once
            new_doc = np.concatenate(([True], (uid[1:] != uid[:-1]).any(1)))
            new_doc[starts] = True
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            drop = np.repeat(whole & (n_docs >= min_docs), ends - starts)
            if keep_first:
                drop[starts] = False
            if drop.any():
                yield made(0, None, uid[drop], pos[drop])
            for i in (0, len(starts) - 1) if len(starts) > 1 else (0,):
                h = (int(h1[starts[i]]), int(h2[starts[i]]))
                if open_run is None or open_run.h != h:
                    if open_run is not None:
                        yield from open_run.end(False)
                    open_run, seen = Run(h, not seen), True
                yield from open_run.add(uid[starts[i] : ends[i]], pos[starts[i] : ends[i]])
        if open_run is not None:
            yield from open_run.end(True)

    return run


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """u1, u2, pos of the lines that go: of keys found in at least min_docs documents, all, or all but the first one."""
    scratch = Scratch(docs.sparkSession)
    n = partitions(docs.sparkSession)
    hashed = scratch.save(line_hashes(docs, min_chars))  # the sample for the bounds and the sort read this, not the texts
    rows = hashed.repartitionByRange(n, "h1", "h2", "u1", "u2").sortWithinPartitions("h1", "h2", "u1", "u2", "pos")
    # Saved, as the three kinds must come from one and the same dealing out of ranges, whose bounds are sampled.
    found = scratch.save(rows.mapInArrow(_stream(min_docs, keep_first), "kind int, h1 long, h2 long, u1 long, u2 long, pos int, n long"))
    scratch.drop(hashed)
    # Runs at the ends of partitions: two a partition at most, so these sums are small whatever the input.
    sums = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min(F.struct("u1", "u2", "pos")).alias("first")).where(F.col("n") >= min_docs)
    late = found.where("kind = 1").drop("n").join(F.broadcast(sums), ["h1", "h2"])
    if keep_first:
        late = late.where(F.struct("u1", "u2", "pos") != F.col("first"))
    return found.where("kind = 0").select("u1", "u2", "pos").unionByName(late.select("u1", "u2", "pos"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """u1, u2, n_dropped, keep: zlib-compressed bits (1: the line stays; lines after the last bit stay). Only documents that lose lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keep = [], []
            for pos in batch.column(2).to_pylist():
                p = np.unique(np.array(pos, np.int64))
                bits = np.ones(int(p[-1]) + 1, np.uint8)
                bits[p] = 0
                n.append(len(p))
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(keep, pa.binary())], ["u1", "u2", "n_dropped", "keep"])

    gone = frequent_lines(docs, min_docs, min_chars, keep_first).groupBy("u1", "u2").agg(F.collect_set("pos").alias("pos"))
    return gone.mapInArrow(run, "u1 long, u2 long, n_dropped long, keep binary")


def apply_bitmaps(text: bytes | None, n_dropped: int | None, keep: bytes | None) -> bytes:
    """The text without the lines whose bit is 0."""
    if not n_dropped:
        return text or b""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    lines = text.split(b"\n")
    stays = np.ones(len(lines), bool)
    # packbits pads with zeros; the last bit kept is that of the last dropped line
    stays[np.flatnonzero(bits == 0)[:n_dropped]] = False
    return b"\n".join(compress(lines, stays.tolist()))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, made: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_sha256")) -> DataFrame:
    """docs with text cut, plus the columns made (lines before, lines dropped, hash of what is kept), which replace columns so named.

    A text that loses all its lines is empty.
    """
    docs = without(docs, *made)
    names = docs.columns
    u1, u2, n_gone, bits = fresh(docs, "u1", "u2", "n_gone", "keep_bits")
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first).toDF(u1, u2, n_gone, bits)
    own = [c.alias(n) for c, n in zip(row_key(docs), (u1, u2), strict=True)]
    joined = docs.select("*", *own).join(bitmaps, [u1, u2], "left").select(*names, n_gone, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped, sha = [], [], [], []
            for text, n, keep in zip(binary_lists(batch, "text"), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                kept = apply_bitmaps(text, n, keep)
                texts.append(None if text is None else kept)
                n_lines.append((text or b"").count(b"\n") + 1)
                n_dropped.append(n or 0)
                sha.append(hashlib.sha256(kept).hexdigest())
            at = names.index("text")
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], [*names, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{kinds}, {made[0]} long, {made[1]} long, {made[2]} string")
