"""MinHash near-duplicates by BagMinHash: weighted Jaccard of five-word shingle multisets.

Sketch. A shingle of multiplicity w owns the weight levels 0..w-1. Levels are cut into dyadic intervals [0,1), [1,2),
[2,4), ...; each (shingle, interval) drives a Poisson process whose rate is its length, and each arrival falls on a
uniform level of its interval (all binary digits of the halvings at once) and on a uniform signature component.
Arrivals on levels below w count; a component keeps the earliest arrival. Two components agree with probability
sum(min)/sum(max). Arrivals are generated only up to the time by which all components are full. A byte of each stays.

Search. Rows of equal multisets are one node, known by a 128-bit hash of the multiset, never by doc_id.
1. BANDS bands of ROWS components put nodes in buckets. The rows (bucket, node) are range-partitioned and read as a
   stream, so a bucket that a third of all nodes share lies over many tasks.
2. The nodes of a bucket of at most BLOCK nodes are screened against each other by their signatures; larger ones, and
   those that a range bound cuts, are taken for linked. The connected sets of these links are clusters.
3. Only nodes of clusters fetch their texts. All pairs of a cluster that pass the screen are verified on the whole
   multisets inside tasks, and a link leaves a task only if it joins two classes. A large cluster is dealt into blocks
   of about BLOCK / 2 nodes that all hold PIVOTS nodes more; then blocks of different classes meet.

Defined results: every row is a document of its own, whatever its doc_id; texts of one to four words are one shingle;
null, empty or wordless texts are classes of their own; null doc_ids sort last. A link is a verified similarity of at
least THRESHOLD. Tables are written to the shared folder and removed as soon as the next one stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestlake.llm.common import Scratch, binary_lists, fresh, grouped, partitions, row_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**6)**32, about 6e-5.
BANDS, ROWS = 32, 6
COMPONENTS = BANDS * ROWS
#: Four standard deviations of the estimate below the threshold (a chance of 3e-5); a pair below it isn't verified.
SCREEN = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / COMPONENTS) ** 0.5
#: Nodes that a task holds against each other, and those of a large cluster that all its blocks hold.
BLOCK, PIVOTS = 1024, 32
U = np.uint64
WORD_CACHE = 500_000


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes | None, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their multiplicities."""
    w = words(text)
    if not w:
        return np.array([], U), np.array([], np.int64)
    h = np.array(list(map(_words.__getitem__, w)), U)
    n = min(k, len(h))
    s = np.zeros(len(h) - n + 1, U)
    for i in range(n):
        s = mix(s + h[i : i + len(s)] * U(2 * i + 3))
    return np.unique(s, return_counts=True)


def signature(d: np.ndarray, w: np.ndarray, m: int = COMPONENTS, mean: float = 10.0) -> np.ndarray:
    """m 64-bit components of the multiset of hashes d with multiplicities w."""
    levels = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 2))).astype(np.int64), 0)
    one = levels == 0
    if one.all():
        seed, low, length, weight = d, np.zeros(len(d)), np.ones(len(d)), w
    else:
        rep = np.repeat(np.arange(len(d)), levels + 1)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
        length = np.where(k == 0, 1.0, 2.0 ** np.maximum(k - 1, 0))
        low = np.where(k == 0, 0.0, length)
        seed, weight = d[rep] + k.astype(U) * U(0x9E3779B97F4A7C15), w[rep]
    total = float(w.sum())
    while True:
        limit = mean / total  # each component has so many arrivals on average
        best_t, best = np.full(m, np.inf), np.zeros(m, U)
        s, lo, ln, wt = seed, low, length, weight
        t0, j = np.zeros(len(s)), 0
        while len(s):
            lam = limit * m * float(ln.max()) if j == 0 else 1.0
            step = max(1, int(lam + 2 * lam**0.5)) if j == 0 else 4
            idx = np.arange(j, j + step, dtype=U)
            a = mix(s[:, None] + idx * U(0xD1342543DE82EF95) + U(1))
            gap = -np.log1p((a >> U(11)).astype(np.float64) * -(2.0**-53)) / (m * ln[:, None])
            gap[:, 0] += t0
            t = np.cumsum(gap, axis=1)
            r, c = np.nonzero(t <= limit)
            if len(r):
                b = mix(a[r, c] + U(0xA0761D6478BD642F))
                level = lo[r] + ((b >> U(32)).astype(np.float64) * 2.0**-32 * ln[r]).astype(np.int64)
                ok = level < wt[r]
                r, c, b = r[ok], c[ok], b[ok]
                comp = ((b & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
                times = t[r, c]
                order = np.argsort(-times, kind="stable")
                comp, times, ident = comp[order], times[order], b[order]
                first_t, first = np.full(m, np.inf), np.zeros(m, U)
                first_t[comp], first[comp] = times, ident  # the last, which is the earliest, stays
                sooner = first_t < best_t
                best_t[sooner], best[sooner] = first_t[sooner], first[sooner]
            more = t[:, -1] <= limit
            t0, j = t[more, -1], j + step
            s, lo, ln, wt = s[more], lo[more], ln[more], wt[more]
        if np.isfinite(best_t).all():
            return best
        mean *= 2


def content(d: np.ndarray, w: np.ndarray) -> tuple[int, int]:
    """The 128-bit hash of a multiset, as two longs."""
    h = np.frombuffer(xxhash.xxh3_128_digest(d.tobytes() + w.tobytes()), np.int64)
    return int(h[0]), int(h[1])


def sketches(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id and, null for texts without words: h1, h2 (content hash), sig (a byte per component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, sigs = [], [], []
            for text in binary_lists(batch, "text"):
                d, w = shingles(text)
                a, b = content(d, w) if len(d) else (None, None)
                h1.append(a), h2.append(b), sigs.append((signature(d, w) >> U(8)).astype(np.uint8).tobytes() if len(d) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], ["k1", "k2", "doc_id", "h1", "h2", "sig"])

    rows = docs.select(*row_hashes(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, h1 long, h2 long, sig binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node of its connected set) for all nodes of edges (a, b); large-star and small-star steps."""
    e = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # Done when every node points at one other that points nowhere.
    while not (e.groupBy("a").count().where("count > 1").isEmpty() and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, e = e, scratch.save(small.where("a <> b").distinct())
        scratch.drop(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted multisets."""
    (a, u), (b, v) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    p = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.minimum(u, v[p])[b[p] == a].sum())
    return both / (int(u.sum()) + int(v.sum()) - both)


def _linked(nodes: list[int], roots: list[int], sig: np.ndarray, texts: list[str] | None) -> tuple[list[int], list[int]]:
    """Links between nodes of different roots, each of which joins two classes: by signature, and by text if there are any."""
    parent = {r: r for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in bags:
            bags[i] = shingles(texts[i].encode())
        return bags[i]

    a, b, left = [], [], len(parent)
    for x in range(1, len(nodes)):
        if left == 1:
            break
        est = np.count_nonzero(sig[:x] == sig[x], axis=1) / COMPONENTS
        near = np.flatnonzero(est >= SCREEN)
        for y in near[np.argsort(-est[near], kind="stable")]:
            p, q = find(roots[x]), find(roots[y])
            if p != q and (texts is None or similarity(bag(x), bag(y)) >= THRESHOLD):
                parent[max(p, q)] = min(p, q)
                left -= 1
                a.append(nodes[x]), b.append(nodes[y])
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (task, node, sig[, root, text]) sorted by task: a, b."""
    for rows in grouped(batches, "task"):
        order = sorted(range(len(rows["node"])), key=rows["node"].__getitem__)
        order = [i for k, i in enumerate(order) if not k or rows["node"][i] != rows["node"][order[k - 1]]]
        nodes = [rows["node"][i] for i in order]
        sig = np.frombuffer(b"".join(rows["sig"][i] for i in order), np.uint8).reshape(len(order), -1)
        roots = [rows["root"][i] for i in order] if "root" in rows else nodes
        a, b = _linked(nodes, roots, sig, [rows["text"][i] for i in order] if "text" in rows else None)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _held(rows: DataFrame) -> DataFrame:
    """a, b: the links inside each task of rows."""
    return rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task").mapInArrow(_links, "a long, b long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, node) in order: members of buckets of 2 to BLOCK nodes (hub null), links to the least node of larger
    ones (hub set), and the hubs of the first and last bucket here, which other tasks may share (last set)."""

    def made(bucket: int, nodes: np.ndarray, hub: int | None, last: bool = False) -> pa.RecordBatch:
        n = len(nodes)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int64)), pa.array(nodes), pa.array([hub] * n, pa.int64()), pa.array(np.full(n, last))], ["bucket", "node", "hub", "last"])

    class Run:
        def __init__(self, bucket: int, first: bool) -> None:
            self.bucket, self.first, self.hub, self.n, self.held = bucket, first, None, 0, []

        def add(self, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
            self.hub = int(nodes[0]) if self.hub is None else self.hub
            self.n += len(nodes)
            self.held.append(nodes)
            if self.n > BLOCK:
                yield from self.flush(True)

        def flush(self, star: bool) -> Iterator[pa.RecordBatch]:
            for nodes in self.held:
                yield made(self.bucket, nodes, self.hub if star else None)
            self.held = []

        def end(self, last: bool) -> Iterator[pa.RecordBatch]:
            if self.first or last:
                yield made(self.bucket, np.array([self.hub], np.int64), None, True)
            if self.n > 1:
                yield from self.flush(self.first or last or self.n > BLOCK)

    run = None
    for batch in batches:
        bucket, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(bucket):
            continue
        cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(bucket)]))
        inner = np.ones(len(starts), bool)
        inner[[0, -1]] = False
        small = inner & (ends - starts > 1) & (ends - starts <= BLOCK)
        rows = np.repeat(small, ends - starts)
        if rows.any():
            n = int(rows.sum())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[rows]), pa.array(node[rows]), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))], ["bucket", "node", "hub", "last"])
        for i in sorted({0, len(starts) - 1, *np.flatnonzero(inner & (ends - starts > BLOCK)).tolist()}):
            if run is None or run.bucket != bucket[starts[i]]:
                if run is not None:
                    yield from run.end(False)
                run = Run(int(bucket[starts[i]]), run is None)
            yield from run.add(node[starts[i] : ends[i]])
    if run is not None:
        yield from run.end(True)


def _clusters(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: connected sets of nodes that may be near duplicates."""
    n = partitions(nodes.sparkSession)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS))))
    banded = nodes.select(F.explode(bands).alias("bucket"), "node").repartitionByRange(n, "bucket", "node").sortWithinPartitions("bucket", "node")
    found = scratch.save(banded.mapInArrow(_buckets, "bucket long, node long, hub long, last boolean"))
    stars = found.where("hub IS NOT NULL AND hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    hubs = found.where("last").groupBy("bucket").agg(F.min("node").alias("b"))  # two rows a task at most
    cut = found.where("last").join(hubs, "bucket").where("node <> b").select(F.col("node").alias("a"), "b")
    small = found.where("hub IS NULL AND NOT last").select(F.col("bucket").alias("task"), F.col("node"))
    screened = _held(small.join(nodes.select("node", "sig"), "node").select("task", "node", "sig"))
    out = components(stars.unionByName(cut).unionByName(screened), scratch)
    scratch.drop(found)
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's node, sig, cluster, blocks with text: found by row key, confirmed by content hash, once a node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for text, node, a, b in zip(binary_lists(batch, "text"), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                keep.append(node not in seen and content(*shingles(text)) == (a, b))
                if keep[-1]:
                    seen.add(node)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in (0, 1, 4, 5, 6)], ["text", "node", "sig", "cluster", "blocks"])

    rows = docs.select(*row_hashes(docs), F.col("text").cast("string").alias("text"))
    met = rows.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("text", "node", "h1", "h2", "sig", "cluster", "blocks")
    return met.mapInArrow(run, "text string, node long, sig binary, cluster long, blocks int")


def _verified(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links that make the classes of all nodes in clusters."""
    member = nodes.join(clusters.withColumnRenamed("root", "cluster"), "node")
    counts = clusters.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count("*") / (BLOCK / 2)).cast("int").alias("blocks"), F.count("*").alias("size"))
    counts = counts.withColumn("blocks", F.when(F.col("size") <= BLOCK, 1).otherwise(F.col("blocks"))).drop("size")
    wanted = member.join(counts, "cluster").select("k1", "k2", "node", "h1", "h2", "sig", "cluster", "blocks")
    fetched = scratch.save(_texts(docs, wanted))
    pivot = F.pmod(F.xxhash64("node", F.lit(13)), F.ceil(F.col("blocks") * (BLOCK / 2) / PIVOTS).cast("long")) == 0
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    block = F.explode(F.when((F.col("blocks") > 1) & pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    first = fetched.select("*", block.alias("block")).withColumn("task", F.xxhash64("cluster", "block"))
    links = scratch.save(_held(first.select("task", "node", "sig", "text")))
    large = fetched.where("blocks > 1")
    if large.isEmpty():
        return links
    # Between blocks, dealt anew: a class of some size fills blocks of its own, which never meet each other; the
    # smaller classes of a cluster share blocks. Clusters that are one class by now are done.
    roots = large.select("node", "cluster").join(components(links, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = roots.groupBy("cluster", "root").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") >= BLOCK // 4, F.col("root")))
    open_ones = sizes.groupBy("cluster").count().where("count > 1").select("cluster")
    sizes = sizes.join(open_ones, "cluster")
    pools = sizes.groupBy("cluster", "own").agg(F.ceil(F.sum("n") / (BLOCK / 2)).cast("int").alias("parts"))
    pools = pools.select(F.col("cluster").alias("c"), F.col("own").alias("o"), "parts")
    dealt = sizes.join(pools, (F.col("cluster") == F.col("c")) & F.col("own").eqNullSafe(F.col("o"))).select("cluster", "root", "own", "parts")
    placed = roots.join(dealt, ["cluster", "root"]).withColumn("block", F.xxhash64("cluster", "own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts"))))
    placed = scratch.save(placed.select("node", "cluster", "root", "own", "block"))
    blocks = placed.select("cluster", "own", "block").distinct()
    x, y = blocks.select("cluster", F.col("own").alias("own1"), F.col("block").alias("i")), blocks.select("cluster", F.col("own").alias("own2"), F.col("block").alias("j"))
    meet = x.join(y, "cluster").where("i <= j AND NOT coalesce(own1 = own2, false)").withColumn("task", F.xxhash64("i", "j"))
    sides = meet.select(F.col("i").alias("block"), "task").unionByName(meet.where("i < j").select(F.col("j").alias("block"), "task"))
    again = placed.join(sides, "block").select("task", "node", "root").join(large.select("node", "sig", "text"), "node")
    out = scratch.save(links.unionByName(_held(again.select("task", "node", "root", "sig", "text"))))
    scratch.drop(links, placed, fetched)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id and, of the row's class: class_key (null: no words), class_id, class_size, first1, first2 (keys of its first row)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(sketches(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k1", "k2", "sig")).alias("f")
    contents = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(first, F.count("*").alias("n"))
    # Ids of nodes are those of the written table, so they stay the same for all its readers.
    nodes = scratch.save(contents.select("h1", "h2", "f.doc_id", "f.k1", "f.k2", "f.sig", "n", F.monotonically_increasing_id().alias("node")))
    links = _verified(docs, nodes, scratch.save(_clusters(nodes, scratch)), scratch)
    of_node = nodes.select("h1", "h2", "node", "doc_id", "k1", "k2", "n").join(components(links, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_node = scratch.save(of_node)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k1", "k2")).alias("f")
    of_class = of_node.groupBy("root").agg(best, F.sum("n").alias("class_size"))
    of_class = of_class.select("root", F.col("f.doc_id").alias("class_id"), F.col("f.k1").alias("first1"), F.col("f.k2").alias("first2"), "class_size")
    found = of_node.select("h1", "h2", "root").join(of_class, "root").withColumnRenamed("root", "class_key")
    return rows.select("k1", "k2", "doc_id", "h1", "h2").join(found, ["h1", "h2"], "left").drop("h1", "h2")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class, null if it has none), class_size, class_key for every row of docs.

    class_key tells classes apart also where ids are null or repeat; it is null for texts without words.
    """
    lone = F.col("class_key").isNull()
    return classes(docs).select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), "class_key",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of least doc_id (null ids last, then by hashes of the row); columns stay.

    Of rows that repeat both id and text one stays. Texts without words stay.
    """
    k1, k2 = fresh(docs, "k1", "k2")
    scratch = Scratch(docs.sparkSession)
    found = classes(docs).where("class_key IS NOT NULL AND class_size > 1")
    stays = (F.col("k1") == F.col("first1")) & (F.col("k2") == F.col("first2"))
    marks = scratch.save(found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.max(stays).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"))
    keyed = docs.select("*", *row_hashes(docs, k1, k2))
    out = keyed.join(marks.select(k1, k2).hint("shuffle_hash"), [k1, k2], "left_anti")
    twice = marks.where("stays").select(k1, k2)
    if not twice.isEmpty():
        out = out.unionByName(keyed.join(twice.hint("shuffle_hash"), [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return out.select(*docs.columns)
