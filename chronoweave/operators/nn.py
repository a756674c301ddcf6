"""Model operators over blocks, with initial weights (layers.initial_layer, functions.vectors.weight) or given ones.

Element-wise expressions stay in the JVM; everything with a matrix runs as products over Arrow batches, with a root's whole neighbourhood in one row, so
that attention needs one shuffle of vectors and no explosion by head or position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from chronoweave.functions import vectors as V
from chronoweave.operators import layers as L

MOST_BYTES = 64 << 20
CHUNK = 1000  # roots whose neighbourhoods are padded to one array at a time


def or_zeros(f: Column, width: int) -> Column:
    """The vector, or zeros where there is none."""
    return F.coalesce(F.transform(f, lambda x: x.cast("double")), V.zeros(width))


def checked(weights) -> None:
    """Weights that go to every executor: at most 64 MB, else an error."""
    if sum(w.nbytes for w in (weights.values() if isinstance(weights, dict) else weights)) > MOST_BYTES:
        raise ValueError("weights of more than 64 MB")


def _sent(rows: DataFrame, weights):
    """Weights on every executor."""
    checked(weights)
    return rows.sparkSession.sparkContext.broadcast(weights)


def _added(rows: DataFrame, drop: list[str], names: list[str], kind=None) -> tuple[list[str], StructType]:
    kept = [c for c in rows.columns if c not in drop]
    return kept, StructType([rows.schema[c] for c in kept] + [StructField(n, kind or ArrayType(DoubleType())) for n in names])


def _rescheduled(batch: pa.RecordBatch, kept: list[str], arrays: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *names])


def projections(rows: DataFrame, layer: L.Layer, weights: L.Weights | None = None, own: str = "own", nbr: str = "nbr", edge: str = "edge", dt: str = "dt") -> DataFrame:
    """Add q, k, v: q from the root's vector and the encoding of 0; k and v from the neighbour's, the edge's and the encoding of dt."""
    kept, out = _added(rows, [], ["q", "k", "v"])
    sent = _sent(rows, weights or L.initial_layer(layer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pc.cast(b.column(dt), pa.float64()).to_numpy(zero_copy_only=False)[:, None]
            p = L.project(sent.value, layer, L.from_lists(b.column(own), layer.node), L.from_lists(b.column(nbr), layer.node)[:, None], L.from_lists(b.column(edge), layer.edge)[:, None], at)
            yield _rescheduled(b, kept, [L.to_lists(p["q"]), L.to_lists(p["k"][:, 0]), L.to_lists(p["v"][:, 0])], ["q", "k", "v"])

    return rows.mapInArrow(run, out)


def split_projection(rows: DataFrame, parts: dict[str, int], out: int, seeds: list[int], name: str) -> DataFrame:
    """Add name: one projection per source (column and width), summed; a bias in the first only."""
    kept, schema = _added(rows, [], [name])
    sent = _sent(rows, [L.matrix(out, w, s) for w, s in zip(parts.values(), seeds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = sum((L.from_lists(b.column(c), w) @ m.T for (c, w), m in zip(parts.items(), sent.value)), L.bias(out, seeds[0])[None])
            yield _rescheduled(b, kept, [L.to_lists(np.broadcast_to(total, (b.num_rows, out)))], [name])

    return rows.mapInArrow(run, schema)


def _padded(lists: pa.Array, layer: L.Layer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nbr, edge, dt and mask of neighbourhoods (lists of structs), padded to the longest."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, n, k = lists.flatten(), len(sizes), max(int(sizes.max(initial=0)), 1)
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    nbr, edge, dt, mask = np.zeros((n, k, layer.node)), np.zeros((n, k, layer.edge)), np.zeros((n, k)), np.zeros((n, k), bool)
    if len(row):
        nbr[row, col], edge[row, col] = L.from_lists(flat.field("nbr"), layer.node), L.from_lists(flat.field("edge"), layer.edge)
        dt[row, col], mask[row, col] = pc.cast(flat.field("dt"), pa.float64()).to_numpy(zero_copy_only=False), True
    return nbr, edge, dt, mask


def neighbourhoods(rows: DataFrame, root: list[str]) -> DataFrame:
    """root and nbrs, its neighbours (nbr_pos, dt, nbr, edge) in order: as many as the fan-out has at most."""
    return rows.groupBy(*root).agg(F.sort_array(F.collect_list(F.struct("nbr_pos", "dt", "nbr", "edge"))).alias("nbrs"))


def _over_roots(packed: DataFrame, layer: L.Layer, weights: L.Weights | None, name: str, kind, f: Callable) -> DataFrame:
    """f(weights, own, nbr, edge, dt, mask) over chunks of packed (root, own, nbrs); its list column takes the place of own and nbrs."""
    kept, out = _added(packed, ["own", "nbrs"], [name], kind)
    sent = _sent(packed, weights or L.initial_layer(layer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                yield _rescheduled(b, kept, [f(sent.value, L.from_lists(b.column("own"), layer.node), *_padded(b.column("nbrs"), layer))], [name])

    return packed.mapInArrow(run, out)


def attention_layer(rows: DataFrame, roots: DataFrame, root: list[str], layer: L.Layer, weights: L.Weights | None = None) -> DataFrame:
    """Embedding of each root: rows (root, nbr_pos, nbr, edge, dt of a block), roots (root, own) -> root, h.

    A root without neighbours has h from zeros in place of the aggregate.
    """
    packed = roots.select(*root, "own").join(neighbourhoods(rows, root), root, "left")
    return _over_roots(packed, layer, weights, "h", None, lambda w, *x: L.to_lists(L.forward(w, layer, *x)[0]))


def attention(rows: DataFrame, root: list[str], layer: L.Layer, weights: L.Weights | None = None) -> DataFrame:
    """The aggregate of each root with neighbours before the output head: root, head, pos, value. rows also have own."""
    packed = neighbourhoods(rows, root).join(rows.groupBy(*root).agg(F.first("own").alias("own")), root)
    whole = _over_roots(packed, layer, weights, "agg", None, lambda w, own, nbr, edge, dt, mask: L.to_lists(L.attend(w, layer, L.project(w, layer, own, nbr, edge, dt), mask)))
    width = layer.out // layer.heads
    return whole.select(*root, F.posexplode("agg").alias("_p", "value")).select(*root, (F.col("_p") / width).cast("int").alias("head"), F.pmod("_p", F.lit(width)).alias("pos"), "value")


def messages(rows: DataFrame, root: list[str], layer: L.Layer, weights: L.Weights | None = None) -> DataFrame:
    """What is summed in attention, with a row of zeros for the root itself: root, nbr_pos (-1 the root), m (attention times v)."""

    def weighted(w, own, nbr, edge, dt, mask):
        p = L.project(w, layer, own, nbr, edge, dt)
        L.attend(w, layer, p, mask)
        m = (p["used"][..., None] * p["v"].reshape(*mask.shape, layer.heads, -1)).reshape(*mask.shape, layer.out)
        each = [np.concatenate([np.zeros((1, layer.out)), m[i, mask[i]]]).tolist() for i in range(len(mask))]
        return pa.array(each, pa.list_(pa.list_(pa.float64())))

    packed = neighbourhoods(rows, root).join(rows.groupBy(*root).agg(F.first("own").alias("own")), root)
    whole = _over_roots(packed, layer, weights, "ms", ArrayType(ArrayType(DoubleType())), weighted)
    return whole.select(*root, F.posexplode("ms").alias("_p", "m")).select(*root, (F.col("_p") - 1).alias("nbr_pos"), "m")


def output_head(agg: Column, own: Column, out: int, seed: int = 4) -> Column:
    """LayerNorm(ReLU(W [agg, own])) as an expression."""
    return V.layer_norm(F.transform(V.linear(F.concat(agg, own), out, seed), V.relu))


def time_decay(h: Column, t: Column, mem_t: Column, seed: int = 6) -> Column:
    """h * (1 + Linear((t - mem_t) / (t + 1))), one weight per position."""
    d = (t - mem_t) / (t + 1)
    return F.transform(h, lambda x, i: x * (1.0 + d * V.weight(i, F.lit(0), seed) + V.weight(i, F.lit(40), seed)))


def combine_snapshots(rows: DataFrame, by: list[str], snap: str, vector: str, width: int) -> DataFrame:
    """Recurrent cell over the snapshots of each key, the oldest (largest snap) first: h = tanh(W x + U h). by, h (array)."""
    seq = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col(snap)).alias("o"), F.col(vector).alias("x")))).alias("_s"))
    step = lambda h, s: F.transform(V.add(V.linear(s["x"], width, 7), V.linear(h, width, 8, bias=False)), F.tanh)
    return seq.select(*by, F.aggregate("_s", V.zeros(width), step).alias("h"))


def edge_scores(vectors: DataFrame, by: list[str], width: int, hidden: int, weights: L.Weights | None = None) -> DataFrame:
    """Scores of an edge's true and negative end: by, pos_score, neg_score, from rows with role (src, dst, neg) and h.

    out(ReLU(src_fc(h_u) + dst_fc(h_v))). An edge without one of its three ends gives null there.
    """
    per = vectors.groupBy(*by).agg(*(F.max(F.when(F.col("role") == r, F.col("h"))).alias(r) for r in ("src", "dst", "neg")))
    kept, out = _added(per, ["src", "dst", "neg"], ["pos_score", "neg_score"], DoubleType())
    sent = _sent(per, weights or L.initial_predictor(width, hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = L.from_lists(b.column("src"), width)
            scores = [pc.if_else(pc.and_(pc.is_valid(b.column("src")), pc.is_valid(b.column(end))), pa.array(L.predict(sent.value, src, L.from_lists(b.column(end), width))[0]), None) for end in ("dst", "neg")]
            yield _rescheduled(b, kept, scores, ["pos_score", "neg_score"])

    return per.mapInArrow(run, out)


def classifier(x: Column, hidden: int, classes: int) -> Column:
    """Two layers: logits of the classes."""
    return V.linear(F.transform(V.linear(x, hidden, 12), V.relu), classes, 13)


def bce_with_logits(label: Column, score: Column) -> Column:
    """-log sigmoid(x) for label 1, -log(1 - sigmoid(x)) for 0, in the form that doesn't overflow."""
    x = F.when(label == 1, -score).otherwise(score)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dense(rows: DataFrame, vector: str, weights: np.ndarray, bias: np.ndarray, out: str) -> DataFrame:
    """Wide dense layer: out = vector W^T + bias as matrix products over Arrow batches; a null vector gives null."""
    sent = _sent(rows, [weights, bias])

    @F.pandas_udf("array<double>")
    def layer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = sent.value
        for s in batches:
            got = [x for x in s if x is not None]
            rows_out = iter(np.stack(got).astype(float) @ w.T + b) if got else iter(())
            yield pd.Series([None if x is None else next(rows_out) for x in s], dtype=object)

    return rows.withColumn(out, layer(vector))


def default_zeros(roots: DataFrame, summed: DataFrame, by: list[str], vector: str, width: int) -> DataFrame:
    """roots with the vector of summed, zeros for those that have none there: they have no neighbours."""
    return roots.join(summed, by, "left").withColumn(vector, F.coalesce(F.col(vector), V.zeros(width)))
