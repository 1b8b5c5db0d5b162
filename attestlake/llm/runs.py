"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends. One of
at least 4 p words with period p covers three grid points jp, (j+1)p, (j+2)p that each equal the next one; points where that
fails hold no run and are left out. At the others the longest common extension of jp and (j+1)p, forward by the suffix
array and backward by that of the reversed words, gives the stretch, maximal on both sides; both are minima over the
arrays of common prefixes, read from sparse tables. Periods ascend, so a stretch is first met with its smallest one.

Everything is in numpy within one document; a document of n words needs O(n log n) memory where points are left, about
16 n log2(r) bytes for a longest repetition of r words, and O(n) else. Documents are looked at where they are read: no shuffle.

Defined results: null and empty texts have no words and no runs; white space is ASCII's; repeated rows are treated alike;
columns named like those made are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestlake.llm.common import binary_lists, without

#: Grid points looked at together.
BLOCK = 1 << 20


class Extensions:
    """Longest common extensions of positions of a sequence of small integers, by suffix array and range minima."""

    def __init__(self, x: np.ndarray) -> None:
        n = self.n = len(x)
        ranks = [x.astype(np.int32)]  # equal ranks of level i: the same 2^i words
        while int(ranks[-1].max(initial=0)) < n - 1:
            r, h = ranks[-1].astype(np.int64), 1 << len(ranks) - 1
            pair = (r + 1) * (n + 2)
            pair[: n - h] += r[h:] + 1
            ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        self.rank = ranks[-1].astype(np.int64)  # all differ: the inverse of the suffix array
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            r = ranks[level]
            both = np.flatnonzero(np.maximum(a, b) < n)
            both = both[r[a[both]] == r[b[both]]]
            for v in (a, b, common):
                v[both] += 1 << level
        self.minima = [common.astype(np.int32)]
        while len(self.minima[-1]) > (step := 1 << len(self.minima) - 1):
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-step], low[step:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of positions i < j; 0 where j is the end."""
        out = np.zeros(len(i), np.int64)
        fine = np.flatnonzero(j < self.n)
        u, v = self.rank[i[fine]], self.rank[j[fine]]
        u, v = np.minimum(u, v), np.maximum(u, v)
        level = np.frexp((v - u).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            m = self.minima[k]
            out[fine[at]] = np.minimum(m[u[at]], m[v[at] - (1 << int(k))])
        return out


def periodic_runs(x: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """start, length, period of all runs of at least max(least, times * period) words (times >= 4), by start and period."""
    n, points = len(x), []
    top = n // times
    p = 1
    while p <= top:
        per = np.arange(p, top + 1)
        size = np.cumsum((n - 1) // per)
        stop = max(1, int(np.searchsorted(size, BLOCK)))
        per = per[:stop]
        each = (n - 1) // per - 2  # j, so that (j + 3) p is a word
        ps = np.repeat(per, each)
        at = (np.arange(len(ps)) - np.repeat(np.cumsum(each) - each, each)) * ps
        for i in range(3):
            same = x[at + i * ps] == x[at + (i + 1) * ps]
            at, ps = at[same], ps[same]
        points.append(np.stack([at, ps]))
        p += stop
    at, ps = np.concatenate(points, 1) if points else np.zeros((2, 0), np.int64)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    end = at + ps + Extensions(x).of(at, at + ps)
    start = at - Extensions(x[::-1]).of(n - at - ps, n - at)
    fine = end - start >= np.maximum(least, times * ps)
    found = np.stack([start, end - start, ps], 1)[fine]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


MADE = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, keep_text: bool = True) -> DataFrame:
    """docs (without text, if asked) with n_runs, the longest run, all runs and the text without repetitions (words joined by a space)."""
    docs = without(docs, *_NAMES)
    names = [c for c in docs.columns if keep_text or c != "text"]
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, best, flat, short = [], [], [], []
            for text in binary_lists(batch, "text"):
                words = (text or b"").split()
                known: dict[bytes, int] = {}
                x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                runs = periodic_runs(x, least, times)
                counts.append(len(runs))
                flat.append(runs)
                if len(runs):
                    top = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    best.append([*top, 1000 * top[1] // top[2]])
                    words = [words[i] for i in np.flatnonzero(collapsed(len(words), runs))]
                else:
                    best.append([None] * 4)
                short.append(b" ".join(words))
            rows = np.concatenate(flat) if flat else np.zeros((0, 3), np.int64)
            ends = np.concatenate(([0], np.cumsum(counts)))
            structs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(run_type))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in names), pa.array(counts, pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(4)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(short, pa.binary()).cast(pa.string()),
            ], [*names, *_NAMES])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.mapInArrow(run, kinds + MADE)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, runs_sha256, collapsed_sha256."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, in which a tenth of the documents repeats a stretch to its end, as told by crc32 of the id.

    With h = crc32(decimal doc_id) and g = h div 10: if h % 10 = 0, word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id leaves the text as it is.
    """
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.when(h % 10 == 0, words).alias("w"), F.expr("crc32(encode(cast(doc_id as string), 'UTF-8')) div 10").alias("g"))
    a, n = F.col("a"), F.size("w")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    p = F.expr("1 + (size(w) - a) div (3 + g % 8)").cast("int")
    head, unit = F.slice("w", 1, a), F.slice("w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))
