"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Merges of one pre-token are taken from a priority queue over merge ranks: a bucket per rank holds the positions of
its pairs, a three-level bitmap of 64-bit words tells the lowest rank that has a bucket (find first set), and the
pre-token's parts form a doubly linked list. A pair is queued as soon as neither pair beside it would be merged before
it: the lowest of all always is one of these. An entry whose pair has changed meanwhile is stale and is skipped, so a
pre-token of n bytes costs O(n log n) however long it is. Ids of frequent pre-tokens are kept in a bounded table.

Null text is the empty text: no tokens. Texts are encoded whole; special tokens don't exist, their strings are text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import accumulate, chain

import pyarrow as pa
import regex
import re
from pyspark.sql import DataFrame

#: Ids of so many pre-tokens are kept, in two halves: a full half becomes the older one, what is met there moves to the new.
CACHE_ENTRIES = 700_000
#: Longer pre-tokens are not kept.
CACHE_BYTES = 64


class RankQueue:
    """The bitmap over ranks: bit r of words says that rank r has a bucket, blocks sum up words, top sums up blocks.

    It is empty between pre-tokens. Codec.merge works on its lists directly, a call per step would double its time.
    """

    def __init__(self, n_ranks: int) -> None:
        self.words = [0] * ((n_ranks >> 6) + 1)
        self.blocks = [0] * ((n_ranks >> 12) + 1)


#: More than any rank.
NONE = 1 << 40
#: 1 << i.
BIT = [1 << i for i in range(64)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pre-token pattern. Texts within Latin-1 use the same pattern with its classes written out."""
    general = regex.compile(pattern.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\s+", r"\p{White_Space}+").replace(r"\S", r"\P{White_Space}"))
    letters, digits, space = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
    narrow = re.compile(
        f" ?[{letters}]+| ?[{digits}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
    )
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if pattern != usual:
        return regex.compile(pattern).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general.findall(text)
        return narrow.findall(text)

    return split


class Codec(dict):
    """Pre-token (str) -> tuple of ids, filled as needed; encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks = ranks
        self.split = splitter(pattern)
        self.older: dict[str, tuple[int, ...]] = {}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pair_ranks = [[ranks.get(bytes((a, b)), NONE) for b in range(256)] for a in range(256)]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        known = ranks.get(piece)
        if known is not None:
            return (known,)
        n = len(piece)
        get, words, blocks, top = ranks.get, self.queue.words, self.queue.blocks, 0
        first: dict[int, int] = {}  # the leftmost position of a bucket
        more: dict[int, list[int]] = {}  # its other positions
        rows = self.pair_ranks
        pair = [rows[a][b] for a, b in zip(piece, piece[1:])]  # rank of the pair that starts here; NONE: none, or merged away
        pair += (NONE, NONE)
        end = list(range(1, n + 2))  # part i spans piece[i:end[i]]
        left = list(range(-1, n))
        # A pair waits until neither neighbour goes first; pair[-1] is NONE.
        due = [(i, r) for i, r in enumerate(pair[:-1]) if pair[i - 1] > r <= pair[i + 1]]
        while True:
            for at, r in due:
                if r in first:
                    heappush(more.setdefault(r, []), max(at, first[r]))
                    first[r] = min(at, first[r])
                else:
                    first[r] = at
                    w = r >> 6
                    words[w] |= BIT[r & 63]
                    blocks[w >> 6] |= BIT[w & 63]
                    top |= BIT[w >> 6]
            if not top:
                break
            b = (top & -top).bit_length() - 1
            x = blocks[b]
            w = (b << 6) + (x & -x).bit_length() - 1
            y = words[w]
            rank = (w << 6) + (y & -y).bit_length() - 1
            i = first.pop(rank)
            if rank in more:
                first[rank] = heappop(more[rank])
                if not more[rank]:
                    del more[rank]
            else:
                words[w] = y = y & (y - 1)
                if not y:
                    blocks[b] = x = x & (x - 1)
                    if not x:
                        top &= top - 1
            due = []
            if pair[i] != rank:
                continue  # stale
            mid = end[i]
            end[i] = stop = end[mid]
            gone, pair[mid] = pair[mid], NONE
            new = after = NONE
            if stop < n:
                left[stop] = i
                new, after = get(piece[i : end[stop]], NONE), pair[stop]
                if gone <= after < new and after <= pair[end[stop]]:
                    due.append((stop, after))
            pair[i] = new
            if (p := left[i]) >= 0:
                old, before = pair[p], pair[left[p]]
                pair[p] = r = get(piece[p:stop], NONE)
                if before > r <= new:
                    due.append((p, r))
                elif old < before <= r and before < pair[left[left[p]]]:
                    due.append((left[p], before))
                if r > new <= after:
                    due.append((i, new))
            elif NONE > new <= after:
                due.append((i, new))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.older.get(token)
        if ids is None:
            ids = self.merge(token.encode())
        if len(token) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES // 2:
                self.older = dict(self)
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def written(self, ids: list[int]) -> bytes:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits_of.__getitem__, ids)).encode()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per process."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids of every text; one pass, no shuffle.

    path: a rank file that exists on every node. decoded_sha256 is taken over the bytes that decoding the ids gives.
    Null text: no tokens. Null doc_id and repeated rows: a row each. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, enc, dec, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                got = c.encode(text)
                n.append(len(got))
                enc.append(hashlib.sha256(c.written(got)).hexdigest())
                dec.append(hashlib.sha256(c.decode(got)).hexdigest())
                if ids:
                    all_ids.append(pa.array(got, pa.int32()))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                off = pa.array([0, *accumulate(n)], pa.int32())
                cols.append(pa.ListArray.from_arrays(off, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
