"""URL filter by a sorted digest array.

Rules (host, path, verdict) are stored as "host/path" strings: their 64-bit xxhash keys in one sorted array, their
offsets, their verdicts and their UTF-8 strings. The four arrays are one file that Spark ships to every node
(SparkContext.addFile) and each worker memory-maps. A batch of urls is probed at once: every suffix of the host at a
label boundary, joined to every prefix of the path that has the length of some rule's path, is hashed and looked up by
binary search; a key found is confirmed against the stored string. Only suffixes and prefixes of lengths that rules have
are built, so a host of very many labels costs no more than the rules. The longest rule wins. Without a rule the verdict is
the method's: allow, as the url is not in the array.

Null urls and urls without :// have empty host and path and so match no rule. Map-only: hot hosts cost nothing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from attestlake.llm.common import without

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(LOWER), "") if slash < 0 else (rest[:slash].translate(LOWER), rest[slash:])


class DigestArray:
    """File layout: n (int64), keys uint64[n], offsets int64[n+1], verdicts uint8[n], strings."""

    @staticmethod
    def write(rules: list[tuple[str, str, str]], path: str) -> None:
        """rules: (host, path, verdict); of equal rules the last counts."""
        last = {(h + p).encode(): (len(p), v) for h, p, v in rules}
        rows = sorted((xxhash.xxh64_intdigest(s), s, n, v) for s, (n, v) in last.items())
        keys = np.array([r[0] for r in rows], np.uint64)
        offsets = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int64)
        lengths = np.array([r[2] for r in rows], np.int64)
        with open(path, "wb") as f:
            for x in (np.array([len(rows)], np.int64), keys, offsets, lengths, np.array([r[3] == "block" for r in rows], np.uint8)):
                f.write(x.tobytes())
            f.write(b"".join(r[1] for r in rows))

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, mode="r")
        n = int(data[:8].view(np.int64)[0])
        at = [8, 8 + 8 * n, 16 + 16 * n, 16 + 24 * n, 16 + 25 * n]
        self.keys, self.offsets, self.lengths = data[at[0] : at[1]].view(np.uint64), data[at[1] : at[2]].view(np.int64), data[at[2] : at[3]].view(np.int64)
        self.block, self.strings = data[at[3] : at[4]], data[at[4] :]
        self.path_lengths = sorted({int(x) for x in np.unique(self.lengths)})
        #: Code points of the rules' hosts.
        self.host_lengths = sorted({len(self.string(k).decode()) - int(self.lengths[k]) for k in range(n)})

    def probe(self, hosts: list[str], paths: list[str]) -> list[int]:
        """The index of the longest rule that fits each url, or -1."""
        rows, cands = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            suffixes = [host[len(host) - n :] for n in self.host_lengths if n == len(host) or 0 < n < len(host) and host[len(host) - n - 1] == "."]
            for n in self.path_lengths:
                if n <= len(path):
                    for s in suffixes:
                        rows.append(i)
                        cands.append((s + path[:n]).encode())
        best, length = [-1] * len(hosts), [-1] * len(hosts)
        if not cands or not len(self.keys):
            return best
        h = np.array(list(map(xxhash.xxh64_intdigest, cands)), np.uint64)
        p = np.searchsorted(self.keys, h)
        for c in np.flatnonzero(self.keys[np.minimum(p, len(self.keys) - 1)] == h):
            k = int(p[c])
            while k < len(self.keys) and self.keys[k] == h[c]:  # keys that collide stand side by side
                if self.string(k) == cands[c] and len(cands[c]) > length[rows[c]]:
                    best[rows[c]], length[rows[c]] = k, len(cands[c])
                k += 1
        return best

    def string(self, k: int) -> bytes:
        return self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes()


_open: dict[str, DigestArray] = {}
#: Applications and the rule files sent to their nodes.
_sent: set[tuple[str, str]] = set()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule ("host/path" of the longest rule that fits, or null) and verdict, which replace columns so named."""
    spark: SparkSession = pages.sparkSession
    pages = without(pages, "host", "path", "rule", "verdict")
    body = repr(sorted(set(rules))).encode()
    name = f"url-rules-{xxhash.xxh64_hexdigest(body)}.bin"
    app = spark.sparkContext.applicationId
    if (app, name) not in _sent:  # a session takes a file name once
        kept = Path(tempfile.mkdtemp(prefix="url-rules-"), name)  # the driver's; addFile serves it to every node
        DigestArray.write(rules, str(kept))
        spark.sparkContext.addFile(str(kept))
        _sent.add((app, name))
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = SparkFiles.get(name)
        if file not in _open:
            _open[file] = DigestArray(file)
        a = _open[file]
        at = names.index(url)
        for batch in batches:
            hosts, paths = map(list, zip(*map(split_url, batch.column(at).to_pylist()), strict=True)) if batch.num_rows else ([], [])
            best = a.probe(hosts, paths)
            rule = [None if k < 0 else a.string(k).decode() for k in best]
            verdict = ["block" if k >= 0 and a.block[k] else "allow" for k in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*names, "host", "path", "rule", "verdict"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")
