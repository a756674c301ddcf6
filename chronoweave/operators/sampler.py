"""Temporal neighbour sampling: as-of, recent top-k, windows, snapshots and several hops, never looking into the future.

Edges and queries are put in one order of (node, t, kind, eid) by ranges and swept once: a query needs the number of edges of its node that came
before it, and the newest k of them are the last k that were swept. Ranges are cut by rows, not by nodes, so a node with a third of all edges,
whether spread over time, in bursts or at one instant, lies in as many ranges as its rows fill; what its later ranges lack, the count and the
newest k edges of the range before, is one small row a range. Edges are shuffled and sorted once per hop, and only for draws at random
ranks are the numbered edges joined. Edges: eid, src, dst, t. Queries: any unique key columns, node, t.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from chronoweave.functions.draws import draw
from chronoweave.operators.layers import from_lists, to_lists
from chronoweave.session import written

CHUNK = 1000  # queries whose neighbourhoods are padded to one array at a time
BEFORE, EDGE, UPTO, END = 0, 1, 2, 3  # at one time: queries for edges before it, the edges, queries for edges up to it
_OWN = {"node", "t", "eid", "dt", "root", "root_t", "nbr_pos", "rk", "snap", "lo", "hi", "pos", "at"}


def _probes(queries: DataFrame, key: list[str], kind: int, t: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    if clash := _OWN & set(key):
        raise ValueError(f"key columns with names of the result's own: {sorted(clash)}")
    carried = F.struct(*key, *((c.alias(n)) for n, c in (extra or {}).items()))
    return queries.select("node", t.cast("long").alias("t"), F.lit(kind).alias("_kind"), carried.alias("_query"))


def _sweep(k: int, keep_edges: bool, names: list[str]):
    """Rows in order to rows with pos, the edges of the node so far within the partition, and the newest k of them for queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kind_of = TaskContext.get().partitionId(), None
        node_now, count = None, 0
        tail = [np.zeros(0, np.int64)] * 3  # eid, dst, t of the newest edges of node_now, oldest first

        def lists(values: list[np.ndarray], sizes: np.ndarray) -> list[pa.Array]:
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in values]

        def batch(n: int, kind, node, t, pos, query, eid, dst, found: list[pa.Array]) -> pa.RecordBatch:
            null = pa.nulls(n, pa.int64())
            columns = [pa.array(np.full(n, part, np.int32)), kind, node, null if t is None else t, pos, query, null if eid is None else eid, null if dst is None else dst, *found]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            node, t, kind = (b.column(c).to_numpy() for c in ("node", "t", "_kind"))
            kind_of = b.column("_query").type
            is_edge = kind == EDGE
            at = np.flatnonzero(is_edge)
            own = [pc.fill_null(b.column(c), 0).to_numpy() for c in ("eid", "dst")] + [t]
            if node_now != node[0]:
                count, tail = 0, [x[:0] for x in tail]
            edges = [np.concatenate([x, y[at]]) for x, y in zip(tail, own)]
            held = len(tail[0])
            swept = np.cumsum(is_edge) - is_edge
            begins = np.r_[True, node[1:] != node[:-1]]
            run_no = np.cumsum(begins) - 1
            within = swept - swept[np.flatnonzero(begins)][run_no]
            first = run_no == 0
            before = within + np.where(first, count, 0)
            asked = np.flatnonzero(~is_edge)
            if len(asked):
                got = np.minimum((within + np.where(first, held, 0))[asked], k)
                ends = np.cumsum(got)
                take = np.repeat(held + swept[asked] - 1, got) - (np.arange(ends[-1]) - np.repeat(ends - got, got))
                pick = pa.array(asked)
                yield batch(len(asked), b.column("_kind").take(pick), b.column("node").take(pick), b.column("t").take(pick), pa.array(before[asked], pa.int64()), b.column("_query").take(pick), None, None, lists([x[take] for x in edges], got))
            if keep_edges and len(at):
                pick = pa.array(at)
                none = lists([np.zeros(0, np.int64)] * 3, np.zeros(len(at), np.int64))
                yield batch(len(at), b.column("_kind").take(pick), b.column("node").take(pick), b.column("t").take(pick), pa.array(before[at] + 1, pa.int64()), b.column("_query").take(pick), b.column("eid").take(pick), b.column("dst").take(pick), none)
            alone = run_no[-1] == 0
            of_last = int(within[-1] + is_edge[-1])
            count = of_last + (count if alone else 0)
            kept = min(k, of_last + (held if alone else 0))
            node_now, tail = node[-1], [x[len(x) - kept :] for x in edges]
        if node_now is not None:
            yield batch(1, pa.array([END], pa.int32()), pa.array([node_now], pa.int64()), None, pa.array([count], pa.int64()), pa.nulls(1, kind_of), None, None, lists([x[::-1] for x in tail], np.array([len(tail[0])])))

    return run


def _swept(edges: DataFrame, probes: DataFrame | None, k: int, keep_edges: bool = False) -> DataFrame:
    """_kind, node, t, pos, _query, eid, dst, eids, dsts, ts: queries with the number of edges before them and the newest k, and the edges with
    their rank if asked for. Written once, as the ranges are drawn anew each time. One row a range comes to the driver.
    """
    if probes is None:
        probes = edges.sparkSession.createDataFrame([], "node long, t long, _kind int, _query struct<none: int>")
    rows = edges.select(F.col("src").alias("node"), "t", F.lit(EDGE).alias("_kind"), "eid", "dst").unionByName(probes, allowMissingColumns=True)
    order = ["node", "t", "_kind", "eid"]
    ranged = rows.select(*order, "dst", "_query").repartitionByRange(*order).sortWithinPartitions(*order)
    long = lambda n: StructField(n, LongType())
    lists = [StructField(n, ArrayType(LongType())) for n in ("eids", "dsts", "ts")]
    out = StructType([StructField("_part", IntegerType()), StructField("_kind", IntegerType()), long("node"), long("t"), long("pos"), rows.schema["_query"], long("eid"), long("dst"), *lists])
    found = written(ranged.mapInArrow(_sweep(k, keep_edges, out.names), out), "swept")
    prior, node, total, tail = [], None, 0, ([], [], [])
    for r in sorted(found.filter(F.col("_kind") == END).select("_part", "node", "pos", "eids", "dsts", "ts").collect()):
        if node is not None:
            prior.append((r["_part"], node, total, *tail))
        if r.node == node:
            total, tail = total + r.pos, tuple((a + b)[:k] for a, b in zip(r[3:], tail))
        else:
            node, total, tail = r.node, r.pos, tuple(r[3:])
    found = found.filter(F.col("_kind") != END)
    if not prior:
        return found.drop("_part")
    more = edges.sparkSession.createDataFrame(prior, "_part int, node long, _count long, _eids array<long>, _dsts array<long>, _ts array<long>")
    joined = found.join(F.broadcast(more), ["_part", "node"], "left")
    longer = {c: F.when(F.col("_count").isNull(), F.col(c)).otherwise(F.slice(F.concat(c, f"_{c}"), 1, max(k, 1))) for c in ("eids", "dsts", "ts")}
    return joined.withColumns({**longer, "pos": F.col("pos") + F.coalesce("_count", F.lit(0))}).drop("_part", "_count", "_eids", "_dsts", "_ts")


def _exploded(found: DataFrame) -> DataFrame:
    """A row per edge found: _query's fields, root, at, pos, nbr_pos (0 is newest), node, eid, t."""
    each = found.select("_query.*", F.col("node").alias("root"), F.col("t").alias("_asked"), "pos", F.posexplode(F.arrays_zip("dsts", "eids", "ts")).alias("nbr_pos", "_e"))
    return each.select("*", F.col("_e.dsts").alias("node"), F.col("_e.eids").alias("eid"), F.col("_e.ts").alias("t")).drop("_e")


def over_recent(edges: DataFrame, queries: DataFrame, k: int, widths: tuple[int, int], layer: Callable[..., np.ndarray]) -> DataFrame:
    """queries without own, with h: the layer over each query's own vector and its node's newest k edges strictly before t, worked out in the sweep itself, so that
    no row per neighbour is ever made.

    edges: node, t, eid, nbr and edge (vectors of `widths`, null for zeros). queries: node, t, own (as wide as nbr), any further columns. layer(own, nbr, edge, dt, mask)
    gives (n, out). A query near the start of a range, whose newest edges may lie in the range before, keeps what it has and is finished from that range's last k edges.
    """
    vec = ArrayType(DoubleType())
    carried = [c for c in queries.columns if c not in ("node", "t", "own")]
    probes = queries.select("node", "t", F.lit(BEFORE).alias("_kind"), F.struct(*carried).alias("_query"), "own")
    rows = edges.select("node", "t", F.lit(EDGE).alias("_kind"), "eid", "nbr", "edge").unionByName(probes, allowMissingColumns=True)
    order = ["node", "t", "_kind", "eid"]
    ranged = rows.select(*order, "nbr", "edge", "_query", "own").repartitionByRange(*order).sortWithinPartitions(*order)
    held = ArrayType(StructType([StructField("t", LongType()), StructField("nbr", vec), StructField("edge", vec)]))
    out = StructType([StructField("_part", IntegerType()), StructField("_kind", IntegerType()), StructField("node", LongType()), StructField("t", LongType()), rows.schema["_query"], StructField("own", vec), StructField("h", vec), StructField("_held", held)])
    found = written(ranged.mapInArrow(_layer_sweep(k, widths, layer, out.names), out), "swept")
    prior, node, tail = [], None, []
    for r in sorted(found.filter(F.col("_kind") == END).select("_part", "node", "_held").collect()):
        if node is not None:
            prior.append((r["_part"], node, tail))
        tail = (r["_held"] + tail)[:k] if r.node == node else r["_held"]
        node = r.node
    whole = found.filter((F.col("_kind") == BEFORE) & F.col("h").isNotNull()).select("_query.*", "node", "t", "h")
    more = edges.sparkSession.createDataFrame(prior, StructType([StructField("_part", IntegerType()), StructField("node", LongType()), StructField("_more", held)]))
    rest = found.filter((F.col("_kind") == BEFORE) & F.col("h").isNull()).join(F.broadcast(more), ["_part", "node"], "left")
    short = rest.select("_query", "node", "t", "own", F.slice(F.concat("_held", F.coalesce("_more", F.array().cast(held))), 1, k).alias("_held"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                b = whole.slice(a, CHUNK)
                lists = b.column("_held")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                t, nbr, edge = flat.field("t").to_numpy(zero_copy_only=False), from_lists(flat.field("nbr"), widths[0]), from_lists(flat.field("edge"), widths[1])
                h = _padded_layer(layer, from_lists(b.column("own"), widths[0]), b.column("t").to_numpy(), sizes, np.arange(len(flat)), t, nbr, edge)
                yield pa.RecordBatch.from_arrays([b.column("_query"), b.column("node"), b.column("t"), to_lists(h)], names=["_query", "node", "t", "h"])

    done = short.mapInArrow(finish, StructType([rows.schema["_query"], StructField("node", LongType()), StructField("t", LongType()), StructField("h", vec)]))
    return whole.unionByName(done.select("_query.*", "node", "t", "h"))


def _padded_layer(layer: Callable[..., np.ndarray], own: np.ndarray, at: np.ndarray, sizes: np.ndarray, take: np.ndarray, t: np.ndarray, nbr: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The layer over queries with own vectors and times, whose neighbours are, one query after the other, the rows `take` of t, nbr and edge."""
    n, most = len(sizes), max(int(sizes.max(initial=0)), 1)
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    near, by, dt, mask = np.zeros((n, most, nbr.shape[1])), np.zeros((n, most, edge.shape[1])), np.zeros((n, most)), np.zeros((n, most), bool)
    near[row, col], by[row, col], dt[row, col], mask[row, col] = nbr[take], edge[take], at[row] - t[take], True
    return layer(own, near, by, dt, mask)


def _layer_sweep(k: int, widths: tuple[int, int], layer: Callable[..., np.ndarray], names: list[str]):
    """As _sweep, but the newest k edges of a query go into the layer; those of a query that may lack some of the range before come out, newest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, node_now, query_type = TaskContext.get().partitionId(), None, None, None
        tail = [np.zeros(0, np.int64), np.zeros((0, widths[0])), np.zeros((0, widths[1]))]  # t, nbr, edge of the newest edges of node_now, oldest first

        def held(sizes: np.ndarray, take: np.ndarray, of: list[np.ndarray]) -> pa.Array:
            each = pa.StructArray.from_arrays([pa.array(of[0][take], pa.int64()), to_lists(of[1][take]), to_lists(of[2][take])], names=["t", "nbr", "edge"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each)

        def batch(n: int, kind: int, node, t, query, own, h, more) -> pa.RecordBatch:
            lists, none = pa.list_(pa.float64()), held(np.zeros(0, np.int64), np.zeros(0, np.int64), tail).type
            filled = [x if x is not None else pa.nulls(n, y) for x, y in ((t, pa.int64()), (query, query_type), (own, lists), (h, lists), (more, none))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, kind, np.int32)), node, *filled], names=names)

        for whole in batches:
            for a in range(0, whole.num_rows, 8 * CHUNK):
                b = whole.slice(a, 8 * CHUNK)
                node, t, kind = (b.column(c).to_numpy() for c in ("node", "t", "_kind"))
                query_type = b.column("_query").type
                first = node[0] if first is None else first
                is_edge = kind == EDGE
                at, asked = np.flatnonzero(is_edge), np.flatnonzero(~is_edge)
                if node_now != node[0]:
                    tail = [x[:0] for x in tail]
                edges = [np.concatenate([x, y]) for x, y in zip(tail, (t[at], from_lists(b.column("nbr").take(pa.array(at)), widths[0]), from_lists(b.column("edge").take(pa.array(at)), widths[1])))]
                kept = len(tail[0])
                swept = np.cumsum(is_edge) - is_edge
                begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                run_no = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(node)]))
                within = swept - swept[begins][run_no] + np.where(run_no == 0, kept, 0)
                got = np.minimum(within, k)
                short = asked[(node[asked] == first) & (got[asked] < k)]
                for those, finished in ((asked[(node[asked] != first) | (got[asked] == k)], True), (short, False)):
                    for c in range(0, len(those), CHUNK):
                        q = those[c : c + CHUNK]
                        n = got[q]
                        ends = np.cumsum(n)
                        take = np.repeat(kept + swept[q] - 1, n) - (np.arange(ends[-1]) - np.repeat(ends - n, n))
                        pick = pa.array(q)
                        own, query = b.column("own").take(pick), b.column("_query").take(pick)
                        h = to_lists(_padded_layer(layer, from_lists(own, widths[0]), t[q], n, take, *edges)) if finished else None
                        yield batch(len(q), BEFORE, pa.array(node[q]), pa.array(t[q]), query, None if finished else pc.cast(own, pa.list_(pa.float64())), h, None if finished else held(n, take, edges))
                of_last = int(within[-1] + is_edge[-1])
                node_now, left = node[-1], min(k, of_last)
                tail = [x[len(x) - left :] for x in edges]
        if node_now is not None:
            n = len(tail[0])
            yield batch(1, END, pa.array([node_now], pa.int64()), None, None, None, None, held(np.array([n]), np.arange(n)[::-1], tail))

    return run


def by_block(edges: DataFrame, probes: DataFrame, features: DataFrame, k: int, widths: tuple[int, int]) -> DataFrame:
    """The neighbourhoods of many probes of a block, with each edge kept once for all of them: block, own, e_t, e_nbr, e_edge, p_key, p_t, p_end.

    edges: node, t, eid, nbr and edge (vectors of `widths`, null for zeros). probes: node, t, block, key (long). features: node, own. A row holds a run of edges of a node
    in order, as long lists (e_nbr and e_edge flat), and probes of one block: each sees the last k of the first p_end edges. Blocks that follow time make rows long.
    """
    vec, longs = ArrayType(DoubleType()), ArrayType(LongType())
    rows = edges.select("node", "t", F.lit(EDGE).alias("_kind"), "eid", "nbr", "edge")
    rows = rows.unionByName(probes.select("node", "t", F.lit(BEFORE).alias("_kind"), "block", "key"), allowMissingColumns=True)
    rows = rows.unionByName(features.select("node", F.lit(_FIRST).alias("t"), F.lit(_OWN_ROW).alias("_kind"), F.col("own").alias("nbr")), allowMissingColumns=True)
    order = ["node", "t", "_kind", "eid"]
    ranged = rows.select(*order, "nbr", "edge", "block", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    long = lambda n: StructField(n, LongType())
    vectors = [StructField(n, vec) for n in ("own", "e_nbr", "e_edge")]
    out = StructType([StructField("_part", IntegerType()), StructField("_kind", IntegerType()), long("node"), long("block"), *vectors, *(StructField(n, longs) for n in ("e_t", "p_key", "p_t", "p_end"))])
    found = written(ranged.mapInArrow(_block_sweep(k, widths, out.names), out), "swept")
    lists, prior, node, tail = ("e_t", "e_nbr", "e_edge"), [], None, ()
    for r in sorted(found.filter(F.col("_kind") == END).select("_part", "node", "own", *lists).collect(), key=lambda r: r["_part"]):
        if node is not None:
            prior.append((r["_part"], node, *tail))
        before = tail if r.node == node else (None, [], [], [])
        keep = lambda x, w: x[len(x) - min(len(x), k * w) :]
        tail = (r.own or before[0], *(keep(a + r[n], w) for a, n, w in zip(before[1:], lists, (1, *widths))))
        node = r.node
    more = StructType([StructField("_part", IntegerType()), long("node"), StructField("_own", vec), StructField("_e_t", longs), StructField("_e_nbr", vec), StructField("_e_edge", vec)])
    joined = found.filter(F.col("_kind") != END).join(F.broadcast(edges.sparkSession.createDataFrame(prior, more)), ["_part", "node"], "left")
    starts = (F.col("_kind") == _START) & F.col("_e_t").isNotNull()  # its list begins where the range does, so the newest edges of the range before come before it
    longer = {n: F.when(starts, F.concat(f"_{n}", n)).otherwise(F.col(n)) for n in lists}
    ends = F.when(starts, F.transform("p_end", lambda x: x + F.size("_e_t"))).otherwise(F.col("p_end"))
    return joined.select("block", F.coalesce("own", "_own").alias("own"), *(c.alias(n) for n, c in longer.items()), "p_key", "p_t", ends.alias("p_end"))


_FIRST, _OWN_ROW, _START = -(1 << 63), -1, 4  # a node's vector comes before all its rows; rows whose edges begin where their range begins


def _block_sweep(k: int, widths: tuple[int, int], names: list[str]):
    """Rows in order to runs of edges with the probes of one block that see them; at the end the newest k edges of the last node, and its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node_now, own_now, first = TaskContext.get().partitionId(), None, None, None
        tail = [np.zeros(0, np.int64), np.zeros((0, widths[0])), np.zeros((0, widths[1]))]  # t, nbr, edge of the newest edges of node_now, oldest first

        def lists(values: np.ndarray, sizes: np.ndarray, width: int = 1) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes * width)], pa.int32()), pa.array(values.ravel()))

        def batch(n: int, columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *columns], names=names)

        for whole in batches:
            for a in range(0, whole.num_rows, 8 * CHUNK):
                b = whole.slice(a, 8 * CHUNK)
                node, t, kind = (b.column(c).to_numpy() for c in ("node", "t", "_kind"))
                first = node[0] if first is None else first
                if node_now != node[0]:
                    tail, own_now = [x[:0] for x in tail], None
                is_edge = kind == EDGE
                at, asked, owns = (np.flatnonzero(x) for x in (is_edge, kind == BEFORE, kind == _OWN_ROW))
                edges = [np.concatenate([x, y]) for x, y in zip(tail, (t[at], from_lists(b.column("nbr").take(pa.array(at)), widths[0]), from_lists(b.column("edge").take(pa.array(at)), widths[1])))]
                kept = len(tail[0])
                swept = np.cumsum(is_edge) - is_edge
                begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                run_no = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(node)]))
                within = swept - swept[begins][run_no] + np.where(run_no == 0, kept, 0)
                vectors = from_lists(b.column("nbr").take(pa.array(owns)), widths[0])
                of_run = np.full(len(begins), -1)
                of_run[run_no[owns]] = np.arange(len(owns))
                if own_now is not None and of_run[0] < 0:
                    of_run[0], vectors = len(vectors), np.concatenate([vectors, own_now[None]])
                if len(asked):
                    end, block = kept + swept[asked], b.column("block").to_numpy(zero_copy_only=False)[asked].astype(np.int64)
                    low = end - np.minimum(within[asked], k)
                    cut = np.flatnonzero(np.r_[True, (node[asked][1:] != node[asked][:-1]) | (block[1:] != block[:-1]) | (low[1:] > end[:-1])])
                    last = np.r_[cut[1:], len(asked)] - 1
                    lo, sizes, count = low[cut], end[last] - low[cut], last + 1 - cut
                    take = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    short = (node[asked[cut]] == first) & (within[asked[cut]] < k)
                    own = of_run[run_no[asked[cut]]]
                    owned = to_lists(vectors).take(pa.array(own, mask=own < 0))
                    key = b.column("key").to_numpy(zero_copy_only=False)[asked].astype(np.int64)
                    found = [lists(edges[1][take], sizes, widths[0]), lists(edges[2][take], sizes, widths[1]), lists(edges[0][take], sizes)]
                    each = [lists(x.astype(np.int64), count) for x in (key, t[asked], end - np.repeat(lo, count))]
                    yield batch(len(cut), [pa.array(np.where(short, _START, BEFORE).astype(np.int32)), pa.array(node[asked[cut]]), pa.array(block[cut]), owned, *found, *each])
                of_last = int(within[-1] + is_edge[-1])
                node_now, left, own = node[-1], min(k, of_last), of_run[-1]
                own_now, tail = vectors[own] if own >= 0 else None, [x[len(x) - left :] for x in edges]
        if node_now is not None:
            n, none = np.array([len(tail[0])]), pa.nulls(1, pa.list_(pa.int64()))
            owned = pa.array([own_now], pa.list_(pa.float64()))
            yield batch(1, [pa.array([END], pa.int32()), pa.array([node_now], pa.int64()), pa.nulls(1, pa.int64()), owned, lists(tail[1], n, widths[0]), lists(tail[2], n, widths[1]), lists(tail[0], n), none, none, none])

    return run


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Each edge with rk, its number from 1 among the edges of its src in order of (t, eid)."""
    return _swept(edges, None, 0, True).select(F.col("node").alias("src"), F.col("pos").alias("rk"), "eid", "dst", "t")


def asof_position(edges: DataFrame, queries: DataFrame, key: list[str]) -> DataFrame:
    """key, node, t, pos: the number of edges of node strictly before t (0 for an unknown node)."""
    return _swept(edges, _probes(queries, key, BEFORE, F.col("t")), 0).select("_query.*", "node", "t", "pos")


def _window_probes(queries: DataFrame, key: list[str], snapshots: int, duration: int, lower: bool) -> DataFrame:
    q = queries.withColumn("snap", F.explode(F.sequence(F.lit(0), F.lit(snapshots - 1))))
    carried = {"snap": F.col("snap"), "at": F.col("t")}
    p = _probes(q, key, BEFORE, F.col("t") - F.col("snap") * duration, carried)
    return p.unionByName(_probes(q, key, UPTO, F.col("t") - (F.col("snap") + 1) * duration, carried)) if duration and lower else p


def _positions(found: DataFrame, key: list[str], duration: int) -> DataFrame:
    ranked = found.filter(F.col("_kind") != EDGE).select("_query.*", "node", "_kind", "pos")
    if not duration:
        return ranked.select(*key, "snap", "node", F.col("at").alias("t"), F.lit(0).cast("long").alias("lo"), F.col("pos").alias("hi"))
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("pos")))
    return ranked.groupBy(*key, "snap", "node", F.col("at").alias("t")).agg(of(UPTO).alias("lo"), of(BEFORE).alias("hi"))


def window_positions(edges: DataFrame, queries: DataFrame, key: list[str], snapshots: int, duration: int) -> DataFrame:
    """key, snap, node, t, lo, hi for each query and snapshot i: edges with rank in (lo, hi] lie strictly between t-(i+1)D and t-iD.

    With duration 0 there is no lower bound and lo is 0.
    """
    return _positions(_swept(edges, _window_probes(queries, key, snapshots, duration, True), 0), key, duration)


def recent(edges: DataFrame, queries: DataFrame, key: list[str], k: int, snapshots: int = 1, duration: int = 0) -> DataFrame:
    """The newest k edges of each query's node strictly before its time, per snapshot window when there are several or a duration.

    Columns: key, [snap], root, root_t, nbr_pos (0 is newest), node, eid, t, dt. Edges at the same time are ordered by eid, later first.
    Queries with null node or t give nothing; so do nodes without edges. Repeated queries need keys of their own.
    """
    queries = queries.filter("node is not null and t is not null")
    if snapshots == 1 and not duration:
        rows, keys = _exploded(_swept(edges, _probes(queries, key, BEFORE, F.col("t")), k)).withColumnRenamed("_asked", "root_t"), key
    else:
        rows, keys = _exploded(_swept(edges, _window_probes(queries, key, snapshots, duration, False), k)).withColumnRenamed("at", "root_t"), [*key, "snap"]
        rows = rows.filter(F.col("t") > F.col("_asked") - duration) if duration else rows
    return rows.select(*keys, "root", "root_t", "nbr_pos", "node", "eid", "t", (F.col("root_t") - F.col("t")).alias("dt"))


def recent_nodes(edges: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """key and to, the nodes that recent finds as one list, newest first."""
    queries = queries.filter("node is not null and t is not null")
    return _swept(edges, _probes(queries, key, BEFORE, F.col("t")), k).select("_query.*", F.col("dsts").alias("to"))


def uniform(edges: DataFrame, queries: DataFrame, key: list[str], k: int, seed: int = 7, snapshots: int = 1, duration: int = 0) -> DataFrame:
    """k draws with replacement from the edges of each window; windows of fewer than k edges give all of theirs, newest first."""
    found = _swept(edges, _window_probes(queries.filter("node is not null and t is not null"), key, snapshots, duration, True), 0, True)
    q = _positions(found, key, duration).filter("hi > lo")
    n = F.col("hi") - F.col("lo")
    places = F.when(n < k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(k - 1)))
    each = q.withColumn("nbr_pos", F.explode(places))
    mixed = F.col("node") + F.col("t")
    rk = F.when(n < k, F.col("hi") - F.col("nbr_pos")).otherwise(F.col("lo") + 1 + draw(mixed, F.col("nbr_pos").cast("long") + F.col("snap") * 1000, seed, n))
    asked = each.select(*key, "snap", F.col("node").alias("root"), F.col("t").alias("root_t"), "nbr_pos", rk.alias("rk"))
    numbered = found.filter(F.col("_kind") == EDGE).select(F.col("node").alias("root"), F.col("pos").alias("rk"), F.col("dst").alias("node"), "eid", "t")
    return asked.join(numbered, ["root", "rk"]).select(*key, "snap", "root", "root_t", "nbr_pos", "node", "eid", "t", (F.col("root_t") - F.col("t")).alias("dt"))


def pointer_times(queries: DataFrame, batch: str, span: int = 1000) -> DataFrame:
    """node, batch and _top, the greatest t that was asked of the node in this or any earlier batch.

    Queries merge per (node, batch) first; batches are taken in stretches of `span`, with the greatest of the stretches before.
    """
    per = queries.groupBy("node", batch).agg(F.max("t").alias("_m")).withColumn("_s", F.floor(F.col(batch) / span))
    inside = F.max("_m").over(Window.partitionBy("node", "_s").orderBy(batch).rowsBetween(Window.unboundedPreceding, 0))
    ends = per.groupBy("node", "_s").agg(F.max("_m").alias("_e"))
    before = ends.select("node", "_s", F.max("_e").over(Window.partitionBy("node").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    return per.withColumn("_i", inside).join(before, ["node", "_s"]).select("node", batch, F.greatest("_i", "_b").alias("_top"))


def _stateful(edges: DataFrame, queries: DataFrame, key: list[str], batch: str, k: int) -> DataFrame:
    q = queries.filter("node is not null and t is not null")
    q = q.join(pointer_times(q, batch), ["node", batch])
    return _swept(edges, _probes(q, key, UPTO, F.col("_top"), {"at": F.col("t")}), k)


def stateful_position(edges: DataFrame, queries: DataFrame, key: list[str], batch: str) -> DataFrame:
    """key, node, t, pointer_time, pos: how many edges the forward-only pointer has passed when the batch is asked."""
    return _stateful(edges, queries, key, batch, 0).select("_query.*", "node", F.col("t").alias("pointer_time"), "pos").withColumnRenamed("at", "t")


def recent_stateful(edges: DataFrame, queries: DataFrame, key: list[str], batch: str, k: int) -> DataFrame:
    """Compatibility form with one forward-only pointer per node: positions are taken at the latest time asked so far.

    The pointer stands after the edges up to (and at) the greatest t of the node in this and all earlier batches; k places before
    it are looked at, without the node's oldest edge, and those strictly before the query's own t are returned.
    """
    rows = _exploded(_stateful(edges, queries, key, batch, k)).withColumnRenamed("at", "root_t")
    kept = rows.filter((F.col("pos") - F.col("nbr_pos") > 1) & (F.col("t") < F.col("root_t")))
    return kept.select(*key, "root", "root_t", "nbr_pos", "node", "eid", "t", (F.col("root_t") - F.col("t")).alias("dt"))


def next_roots(queries: DataFrame, block: DataFrame, key: list[str], keep_root_time: bool = False) -> DataFrame:
    """Queries of the next hop: the roots themselves (nbr -1) and their neighbours, at the neighbour edge's time or the root's."""
    own = queries.select(*key, F.lit(-1).alias("nbr"), "node", "t")
    return own.unionByName(block.select(*key, F.col("nbr_pos").alias("nbr"), "node", F.col("root_t" if keep_root_time else "t").alias("t")))


def multi_hop(edges: DataFrame, queries: DataFrame, key: list[str], fanout: list[int], keep_root_time: bool = False) -> list[DataFrame]:
    """One block per hop of recent neighbours; the key of hop l has l more columns nbr_1, nbr_2, ... that say where its root came from."""
    blocks, q, keys = [], queries, list(key)
    for hop, k in enumerate(fanout):
        block = recent(edges, q, keys, k)
        blocks.append(block)
        if hop + 1 < len(fanout):
            q = next_roots(q, block, keys, keep_root_time).withColumnRenamed("nbr", f"nbr_{hop + 1}")
            keys = [*keys, f"nbr_{hop + 1}"]
    return blocks
