"""Filling fixed-capacity containers with items: best-two-fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import vocab
from chronoweave.session import written

SHARD_ITEMS = 20_000
SHARD_CONTAINERS = 200
MOST_SHARD_ITEMS = 1_000_000
MOST_SPECS = 1_000
_WORD = 4096
PLACED = "spec_id int, container_id long, doc_id long, piece int, start_token long, n_tokens int, offset int"


def token_sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each text by a public vocabulary; 0 for null and empty texts."""
    content = docs.sparkSession.sparkContext.broadcast(vocab.vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.encoder(content.value)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(s)) if (s := x.as_py()) else 0 for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


class _Pool:
    """Unpacked items by size. Sizes that are there are bits, in words of _WORD sizes each; a bit in `some` tells which words aren't empty.

    Memory follows the number of sizes that occur, not the capacity.
    """

    def __init__(self, sizes: list[int]) -> None:
        self.by_size: dict[int, list[int]] = {}
        for k in range(len(sizes) - 1, -1, -1):
            self.by_size.setdefault(sizes[k], []).append(k)
        self.words: dict[int, int] = {}
        self.some = 0
        for s in self.by_size:
            self._mark(s)

    def _mark(self, size: int) -> None:
        w, bit = divmod(size, _WORD)
        self.words[w] = self.words.get(w, 0) | 1 << bit
        self.some |= 1 << w

    def largest(self, most: int) -> int:
        """The largest size of at most `most` that is there, else 0."""
        if most <= 0:
            return 0
        w, bit = divmod(most, _WORD)
        here = self.words.get(w, 0) & ((2 << bit) - 1)
        if here:
            return w * _WORD + here.bit_length() - 1
        w = (self.some & ((1 << w) - 1)).bit_length() - 1
        return w * _WORD + self.words[w].bit_length() - 1 if w >= 0 else 0

    def take(self, size: int) -> int:
        items = self.by_size[size]
        k = items.pop()
        if not items:
            w, bit = divmod(size, _WORD)
            self.words[w] &= ~(1 << bit)
            if not self.words[w]:
                self.some &= ~(1 << w)
        return k

    def put(self, size: int, k: int) -> None:
        self.by_size[size].append(k)
        self._mark(size)

    def best_two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The two sizes with the largest sum above more_than that fit into room."""
        best, found = more_than, None
        a = self.largest(room - 1)
        while a and 2 * a > best:
            b = self.largest(min(room - a, a))
            if b == a and len(self.by_size[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (indexes into sizes, each size from 1 to capacity) by container.

    A container takes the largest item that fits until none does. Then its smallest item makes way for the two unpacked items that
    together fill the gap so widened best, if they fill it better; that is repeated while it gains.
    """
    pool, out = _Pool(sizes), []
    while pool.some:
        held, gap = [], capacity
        while s := pool.largest(gap):
            held.append((s, pool.take(s)))
            gap -= s
        while gap:
            least = min(held)
            two = pool.best_two(gap + least[0], least[0])
            if not two:
                break
            held.remove(least)
            taken = [(s, pool.take(s)) for s in two]
            pool.put(*least)
            held += taken
            gap += least[0] - sum(two)
        out.append([k for _, k in held])
    return out


def _pack_shard(key: tuple, items: pa.Table) -> pa.Table:
    spec, shard, capacity = (k.as_py() for k in key)
    items = items.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
    docs, sizes = items["doc_id"].to_pylist(), items["n_tokens"].to_pylist()
    full = [(n - 1) // capacity if n else 0 for n in sizes]
    rest = [k for k, n in enumerate(sizes) if n]
    packed = best_two_fit([sizes[k] - full[k] * capacity for k in rest], capacity)
    rows: list[tuple] = []
    for no, held in enumerate(packed):
        at = 0
        for x in held:
            k = rest[x]
            n = sizes[k] - full[k] * capacity
            rows.append((no, docs[k], full[k], full[k] * capacity, n, at))
            at += n
    no = len(packed)
    for k, pieces in enumerate(full):
        for p in range(pieces):
            rows.append((no, docs[k], p, p * capacity, capacity, 0))
            no += 1
    rows += [(0, docs[k], 0, 0, 0, 0) for k, n in enumerate(sizes) if not n]
    cols = list(zip(*rows))
    return pa.table({
        "spec_id": pa.array(np.full(len(rows), spec, np.int32)), "container_id": pa.array(np.array(cols[0], np.int64) + (shard << 32)), "doc_id": pa.array(cols[1], pa.int64()), "piece": pa.array(cols[2], pa.int32()),
        "start_token": pa.array(cols[3], pa.int64()), "n_tokens": pa.array(cols[4], pa.int32()), "offset": pa.array(cols[5], pa.int32()),
    })


def shard_count(items: int, tokens: int, capacity: int, shard_items: int = SHARD_ITEMS) -> int:
    """Shards of a spec: each of shard_items items, or of as many more as SHARD_CONTAINERS containers hold, but MOST_SHARD_ITEMS at most."""
    wanted = max(shard_items, SHARD_CONTAINERS * capacity * items // max(tokens, 1)) if shard_items >= SHARD_ITEMS else shard_items
    return max(1, -(-items // min(wanted, MOST_SHARD_ITEMS)))


def fill_containers(sizes: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers of every spec's capacity filled with all items: spec_id, container_id, doc_id, piece, start_token, n_tokens, offset.

    sizes: doc_id, n_tokens; they are written once, as their number and sum are needed first. specs: spec_id, capacity; at most 1,000 rows,
    else an error. Only items longer than the capacity are split, into pieces of the capacity and one rest. piece counts from 0,
    start_token is where the piece begins in its text, offset where it begins in its container. Items are spread over shards by a hash
    (see shard_count), each packed by itself as a bounded group in a task of its own, so at most the last containers of a shard are worse
    than those of one large packing.

    Null n_tokens counts as 0. Items of size 0 take no space and come out in their shard's first container, so that no document
    is missing. Repeated items are items of their own. Specs with null or no positive capacity raise an error. Empty sizes or specs
    give no rows; other columns are ignored.
    """
    known = specs.select(F.col("spec_id").cast("int"), F.col("capacity").cast("int")).limit(MOST_SPECS + 1).collect()
    if len(known) > MOST_SPECS or any(not r.capacity or r.capacity < 1 for r in known):
        raise ValueError("specs: at most 1,000, each with a positive capacity")
    if not known:
        return sizes.sparkSession.createDataFrame([], PLACED)
    items = written(sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens")), "sizes")
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("s")).first()
    shards = [shard_count(total["n"], total["s"], r.capacity, shard_items) for r in known]
    each = F.array(*(F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.capacity).alias("capacity"), F.lit(n).alias("shards")) for r, n in zip(known, shards)))
    rows = items.withColumn("_s", F.explode(each)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.col("_s.shards"))).select("_s.spec_id", "shard", "_s.capacity", "doc_id", "n_tokens")
    spread = rows.repartition(min(2 * sum(shards), 100_000), "spec_id", "shard", "capacity")  # packing is work, not bytes: no coalescing by size
    return spread.groupBy("spec_id", "shard", "capacity").applyInArrow(_pack_shard, PLACED)


def fill_report(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: n_containers, n_tokens, n_docs (rows of whole or last pieces), and fill, the share of the space used."""
    per = placed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))
    joined = per.join(specs.select("spec_id", "capacity"), "spec_id")
    return joined.select("spec_id", "capacity", "n_containers", "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"))
