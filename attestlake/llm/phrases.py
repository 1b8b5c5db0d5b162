"""Phrase collocation mining: counts of frequent phrases in arrays addressed by a minimal perfect hash.

Phrases are counted level by level, Apriori-fashion. A text becomes the ids of its frequent words (-1: any other word,
or the end of a piece); two neighbouring ids of phrases of k - 1 words make the 64-bit key of a phrase of k words. Per
level:

1. mappers bincount the keys into hashed cells, whose arrays are summed as a tree; a phrase in a cell below min_count
   can't be frequent;
2. mappers give the distinct keys of the other cells: the candidates, of which both parts are frequent and the cell is
   (a phrase that no task meets min_count / tasks times can't be frequent either);
3. candidates get a minimal perfect hash, with the keys themselves stored by slot to tell members from strangers;
   mappers bincount slots, the arrays are summed as a tree;
4. what is frequent gets an id, which replaces its slot, and the texts become ids of this level.

What a task holds at once is bounded: a cell array of at most MOST_CELLS, and the hash of one part of at most PART keys;
with more candidates, jobs of their own count and look up part after part. Arrays travel in blocks, and a group of the
tree sums FAN_IN of them. Words are known by 64-bit hashes; should two words of the corpus share one, another seed is
taken. Cuts are read from the counts of a phrase's beginnings and ends, which each level hands on by id.

Words: A-Z lower-cased, pieces end at `.,;:!?`, line feed, vertical tab, form feed and carriage return, words at space
and tab. A null text is empty, a null language `und`. Rows that repeat count each time. Other columns are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.llm.common import Scratch, binary_lists

MOST_CELLS, PART, FAN_IN, BLOCK, KEY_BLOCKS = 1 << 24, 1 << 21, 32, 1 << 15, 64
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
_BREAK = b"."
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, and `.` where a piece ends."""
    return text.translate(_BYTES).replace(_BREAK, b" . ").split() if text else []


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key (the finaliser of splitmix64)."""
    z = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys, with the keys by slot.

    Keys that are alone in their cell of the first bitmap take the rank of its bit; the others go to the next bitmap.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.maps, self.n = [], len(keys)
        left, base = keys, 0
        while len(left):
            m = 64 * (2 * len(left) // 64 + 1)
            at = (mixed(left, len(self.maps)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.maps.append((m, words, base + np.cumsum(ones) - ones))
            base, left = base + int(ones.sum()), left[~alone[at]]
        self.keys = np.zeros(self.n, np.int64)
        self.keys[self._slots(keys)] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of members; any slot or -1 for other keys."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (m, words, before) in enumerate(self.maps):
            if not len(todo):
                break
            at = (mixed(keys[todo], seed) % np.uint64(m)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = before[at[hit] >> 6] + below
            todo = todo[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are no members."""
        out = self._slots(keys)
        if self.n:
            out[self.keys[out] != keys] = -1
        return out


# ---- keys of a batch -------------------------------------------------------------------------------------------------

#: keys, whether each is one, and the rows' offsets: of a batch of texts (level 1) or of ids of the level before.
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: 64 bits of a language's word under a seed.
WordHash = Callable[[str, bytes, int], int]


def word_hash(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b" " + word, seed) - (1 << 63)


def word_keys(seed: int, hashed: WordHash) -> Keys:
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, ends, known = [], [0], {}
        for lang, text in zip(batch.column("lang").to_pylist(), binary_lists(batch, "text"), strict=True):
            have, row = known.setdefault(lang, {_BREAK: None}), tokens(text)
            for w in set(row).difference(have):
                have[w] = hashed(lang, w, seed)
            out += [have[w] for w in row]
            out.append(None)
            ends.append(len(out))
        keys = pa.array(out, pa.int64())
        return keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False), np.array(ends)

    return read


def pair_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring ids of a row's list, which ends with -1."""
    ids = batch.column("ids")
    flat, ends = ids.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    after = np.append(flat[1:], -1)
    return flat << 32 | (after & 0xFFFFFFFF), (flat >= 0) & (after >= 0), ends


# ---- arrays, summed as a tree ----------------------------------------------------------------------------------------


def as_tree(arrays: DataFrame, n_tasks: int, dtype: str, join: Callable[[list[np.ndarray]], np.ndarray], bits_from: int | None = None) -> DataFrame:
    """block, part, data: what `join` makes of each block's arrays of all parts, FAN_IN at a time; of the last, bits for numbers of bits_from or more."""

    def once(as_bits: bool) -> Callable[[pa.Table], pa.Table]:
        def joined(table: pa.Table) -> pa.Table:
            whole = join([np.frombuffer(zlib.decompress(data), dtype) for data in table.column("data").to_pylist()])
            data = packed(np.packbits(whole >= bits_from, bitorder="little"), "uint8") if as_bits else packed(whole, dtype)
            return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "data": pa.array([data])})

        return joined

    while True:
        n_tasks = -(-n_tasks // FAN_IN)
        added = once(n_tasks == 1 and bits_from is not None)
        arrays = arrays.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("block", "part").applyInArrow(added, arrays.schema)
        if n_tasks == 1:
            return arrays


def tree_sum(arrays: DataFrame, n_tasks: int, dtype: str, most: int | None = None) -> DataFrame:
    """block, part, data: the sum of each block over all parts; with `most`, the bits of the sums that reach it."""

    def add(some: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(some[0]), np.int64)
        for x in some:
            total += x
        return total if most is None else np.minimum(total, most)

    return as_tree(arrays, n_tasks, dtype, add, most)


def packed(x: np.ndarray, dtype: str) -> bytes:
    return zlib.compress(x.astype(dtype).tobytes(), 1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, as a row's words take several arrays."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def blocks(counts: np.ndarray, dtype: str) -> Iterator[pa.RecordBatch]:
    """A task's array, a row a block; blocks without counts are left out."""
    part = TaskContext.get().partitionId()
    for i in range(0, len(counts), BLOCK):
        if (some := counts[i : i + BLOCK]).any():
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(some, dtype)])], ["block", "part", "data"])


ARRAYS = "block int, part int, data binary"


def gathered(arrays: DataFrame, n: int, dtype: str, block_size: int = BLOCK) -> np.ndarray:
    """The array of n numbers on the driver, by one job for all blocks: at most MOST_CELLS bits or PART counts."""
    out, got = np.zeros(n, dtype), arrays.select("block", "data").toArrow()
    for block, data in zip(got.column("block").to_pylist(), got.column("data").to_pylist(), strict=True):
        some = np.frombuffer(zlib.decompress(data), dtype)
        out[block * block_size : block * block_size + len(some)] = some
    return out


def tasks(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def full_cells(rows: DataFrame, read: Keys, cells: int, min_count: int) -> np.ndarray:
    """Of the hashed cells, those that min_count or more keys fall into, as bits. Sums stop at min_count."""
    dtype = "uint8" if min_count < 256 else "uint16" if min_count < 65536 else "int64"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, dtype)
        for batch in slices(batches):
            keys, fine, _ = read(batch)
            at, n = np.unique((mixed(keys[fine], 99) % np.uint64(cells)).astype(np.int64), return_counts=True)
            held[at] = np.minimum(held[at] + n, min_count)
        yield from blocks(held, dtype)

    return gathered(tree_sum(rows.mapInArrow(count, ARRAYS), tasks(rows), dtype, min_count), cells // 8, "uint8", BLOCK // 8)


def candidates(rows: DataFrame, read: Keys, bits: np.ndarray, min_count: int) -> DataFrame:
    """key: the distinct keys of full cells (their bits are set) that some task has met often enough.

    A key that occurs min_count times in n tasks occurs min_count / n times, rounded up, in one of them at least; tasks leave
    out what they have met less often. Keys travel as sorted arrays in blocks by hash, united as a tree.
    """
    cells, n_tasks = 8 * len(bits), tasks(rows)
    least = -(-min_count // n_tasks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches):
            keys, fine, _ = read(batch)
            keys, n = np.unique(keys[fine], return_counts=True)
            at = (mixed(keys, 99) % np.uint64(cells)).astype(np.int64)
            some = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            both, n = np.concatenate([held, keys[some]]), np.concatenate([times, n[some]])
            held, at = np.unique(both, return_inverse=True)
            times = np.bincount(at, n, len(held)).astype(np.int64)
        held = held[times >= least]
        block = (mixed(held, 7) % np.uint64(KEY_BLOCKS)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(KEY_BLOCKS + 1))
        part = TaskContext.get().partitionId()
        for b in np.flatnonzero(np.diff(cut)):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(held[order[cut[b] : cut[b + 1]]], "int64")])], ["block", "part", "data"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(zlib.decompress(data), np.int64))], ["key"])

    united = as_tree(rows.mapInArrow(find, ARRAYS), n_tasks, "int64", lambda some: np.unique(np.concatenate(some)))
    return united.mapInArrow(opened, "key long")


def slot_counts(spark: SparkSession, rows: DataFrame, read: Keys, perfect: PerfectHash) -> np.ndarray:
    """How often each member occurs, by slot."""
    shared = spark.sparkContext.broadcast(perfect)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect = shared.value
        held = np.zeros(perfect.n, np.int64)
        for batch in slices(batches):
            keys, fine, _ = read(batch)
            slots = perfect.slots(keys[fine])
            held += np.bincount(slots[slots >= 0], minlength=perfect.n)
        yield from blocks(held, "int64")

    out = gathered(tree_sum(rows.mapInArrow(count, ARRAYS), tasks(rows), "int64"), perfect.n, "int64")
    shared.destroy()
    return out


def relabelled(spark: SparkSession, rows: DataFrame, read: Keys, parts: list[tuple[np.ndarray, np.ndarray]], scratch: Scratch) -> DataFrame:
    """ids: a row's keys as ids of this level, -1 for all others, repeated -1 once; part after part where there are several."""
    for i, (keys, ids) in enumerate(parts):
        perfect = PerfectHash(keys)
        by_slot = np.zeros(perfect.n, np.int64)
        by_slot[perfect.slots(keys)] = ids
        shared = spark.sparkContext.broadcast((perfect, by_slot))
        first, last = i == 0, i == len(parts) - 1
        names = [] if last else [c for c in rows.columns if c != "found"]

        def look(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last, names=names) -> Iterator[pa.RecordBatch]:
            perfect, given = shared.value
            for batch in slices(batches):
                keys, fine, ends = read(batch)
                found = np.full(len(keys), -1, np.int64) if first else batch.column("found").flatten().to_numpy().astype(np.int64)
                slots = perfect.slots(keys[fine])
                mine = np.flatnonzero(fine)[slots >= 0]
                found[mine] = given[slots[slots >= 0]]
                if last:
                    stays = (found >= 0) | (np.append(0, found[:-1]) >= 0)
                    stays[ends[:-1][np.diff(ends) > 0]] |= True
                    ends, found = np.concatenate(([0], np.cumsum(stays)))[ends], found[stays]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))], [*names, "ids" if last else "found"])

        schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in names] + ["ids array<int>" if last else "found array<int>"])
        before, rows = rows, scratch.save(rows.mapInArrow(look, schema).where("size(ids) > 1" if last else "true"))
        if not first:
            scratch.drop(before)
        shared.destroy()
    return rows


def word_counts(docs: DataFrame, seed: int, hashed: WordHash) -> DataFrame:
    """lang, word, h, f."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(_BREAK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array([hashed(lang, w, seed) for w in c], pa.int64()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "h", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), binary_lists(batch, "text"), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from out()
        yield from out()

    return docs.mapInArrow(count, "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, part: int = PART, hashed: WordHash = word_hash) -> list[DataFrame]:
    """Frequent phrases of 1, 2, ... words: id, lang, phrase, tail (last word), a, firsts, lasts (counts of the first and of the last 1, 2, ... words), n."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for seed in range(99):
        counted = scratch.save(word_counts(docs, seed, hashed))
        if counted.groupBy("h").count().where("count > 1").isEmpty():
            break
        scratch.drop(counted)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    cells = 1 << int(np.clip(np.ceil(np.log2(max(1, counted.agg(F.sum("f")).first()[0] or 0) / 8)), 12, np.log2(MOST_CELLS)))
    frequent = counted.where(F.col("f") >= min_count)
    level = scratch.save(frequent.select("h", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.col("f").alias("a")).join(totals, "lang"))
    keys, base, rows, read = level.select(F.col("h").alias("key"), F.col("a").alias("f")), 0, docs, word_keys(seed, hashed)
    out, here = [], None
    for k in range(1, longest + 1):
        if k > 1:
            full = full_cells(rows, read, cells, min_count)
            keys = scratch.save(candidates(rows, read, full, min_count))
        n = keys.count()
        n_parts = max(1, -(-n // part))
        parts, tables, base = [], [], 0
        for p in range(n_parts):
            mine = keys if n_parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(n_parts)) == p)
            got = mine.toArrow()  # one part: at most about PART keys
            some = np.sort(got.column("key").to_numpy()) if k > 1 else got.column("key").to_numpy()
            if k > 1:
                perfect = PerfectHash(some)
                f = slot_counts(spark, rows, read, perfect)
                some, f = perfect.keys[f >= min_count], f[f >= min_count]
            else:
                f = got.column("f").to_numpy()
            ids = np.arange(base, base + len(some))
            base += len(some)
            parts.append((some, ids))
            tables.append(scratch.save(spark.createDataFrame(pa.table({"key": pa.array(some, pa.int64()), "id": pa.array(ids, pa.int64()), "a": pa.array(f, pa.int64())}))))
        found = tables[0]
        for more in tables[1:]:
            found = found.unionByName(more)
        if k == 1:
            here = level.join(found.select(F.col("key").alias("h"), "id"), "h").withColumn("firsts", F.array("a")).withColumn("lasts", F.array("a")).drop("h")
        else:
            head = here.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("begun"), "firsts", "n")
            tail = here.select(F.col("id").alias("rest"), "tail", "lasts")
            found = found.select("id", "a", F.shiftright("key", 32).alias("head"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest"))
            here = found.join(head, "head").join(tail, "rest").select(
                "id", "lang", F.concat_ws(" ", "begun", "tail").alias("phrase"), "tail", "a", "n", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts"), "head", "rest",
            )
        here = scratch.save(here)
        out.append(here)
        if k == longest or not base:
            break
        before, rows = rows, relabelled(spark, rows, read, parts, scratch)
        scratch.drop(before)
        read = pair_keys
    return out


def _score(a: Column | str, n: Column | str, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits: exact for counts below 10^16."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(16,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, share: int = 100, top: int = 2000, part: int = PART, hashed: WordHash = word_hash) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    A phrase goes if a longer one that holds it has at least share percent of its count: with any such longer phrase,
    the one with one word more that lies within it is frequent too, so those alone are asked (share 100; for a lower
    one, counts only fall with length, so they still suffice).
    """
    levels = phrases(docs, min_count, longest, part, hashed)
    kept = []
    for k in range(2, len(levels) + 1):
        rows = levels[k - 1]
        if k < len(levels):
            more = levels[k]
            within = more.select(F.col("head").alias("id"), F.col("a").alias("longer")).unionByName(more.select(F.col("rest").alias("id"), F.col("a").alias("longer"))).groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(within, "id", "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * share)
        cuts = [F.struct(_score("a", "n", F.col("firsts")[j - 1], F.col("lasts")[k - j - 1]).alias("score"), F.lit(j).alias("cut"), F.col("firsts")[j - 1].alias("l"), F.col("lasts")[k - j - 1].alias("r")) for j in range(1, k)]
        kept.append(rows.select("lang", "phrase", "a", "n", F.array_min(F.array(*cuts)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score"))
    if not kept:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    found = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
