"""Training of models without memory: gradients through predictor, attention layers and time encoding, summed over partitions, and Adam."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.config import Preset, RunSettings
from chronoweave.functions import vectors as V
from chronoweave.operators import etl, models, nn, sampler
from chronoweave.operators import layers as L
from chronoweave.operators.ordering import with_row_ids
from chronoweave.session import dropped, scratch, written

ROLES = ("src", "dst", "neg")
PIECE = 4096  # weights that are summed as one row
BLOCK = 4096  # edges that are packed together
CHUNK = 256  # edges whose neighbourhoods are padded to one array at a time


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.m, self.v, self.n = rate, np.zeros(size), np.zeros(size), 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.n += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.999**self.n)) + 1e-8)


def flat(weights: models.Models) -> np.ndarray:
    """All weights as one vector, by names in order."""
    return np.concatenate([weights[m][k].ravel() for m in sorted(weights) for k in sorted(weights[m])])


def shaped(vector: np.ndarray, like: models.Models) -> models.Models:
    out, at = {}, 0
    for m in sorted(like):
        out[m] = {}
        for k in sorted(like[m]):
            n = like[m][k].size
            out[m][k] = vector[at : at + n].reshape(like[m][k].shape)
            at += n
    return out


def samples(edges: DataFrame, part: DataFrame, drawn: DataFrame, node_features: DataFrame, edge_features: DataFrame, preset: Preset, node_width: int, edge_width: int) -> DataFrame:
    """eid and src, dst, neg of the edges of part: each the sampled neighbourhood of a root as a list of what the innermost layer embeds, the root
    first (pos -1), then its neighbours if there are two layers; each has its own vector, time since and edge to the root, and its neighbours.

    Lists are as long as the fan-out at most. Edges that lack one of the three roots are left out.
    """
    if preset.memory or preset.layer != "attention" or preset.snapshots > 1 or not 1 <= len(preset.fanout) <= 2:
        raise ValueError("training is for attention models without memory or snapshots, of one or two layers")
    key = ["key_eid", "key_role"]
    roots = etl.roots(part, drawn.filter("k = 0")).select(F.col("eid").alias("key_eid"), F.col("role").alias("key_role"), "node", "t").filter("node is not null and t is not null")
    asked, blocks, keys = models.sampled(edges, roots, key, preset)
    by = keys[-1]
    vectors = models._vectors
    rows = vectors(vectors(blocks[-1], node_features, "node", "id", node_width, "nbr"), edge_features, "eid", "eid", edge_width, "edge")
    packed = vectors(asked[-1], node_features, "node", "id", node_width, "own").select(*by, "own").join(nn.neighbourhoods(rows.select(*by, "nbr_pos", "nbr", "edge", "dt"), by), by, "left")
    if len(blocks) == 1:
        each = packed.withColumns({"pos": F.lit(-1), "dt": F.lit(0).cast("long"), "edge": V.zeros(edge_width)})
    else:
        to_root = vectors(blocks[0], edge_features, "eid", "eid", edge_width, "edge").select(*key, F.col("nbr_pos").alias("nbr_1"), "dt", "edge")
        each = packed.join(to_root, by, "left").withColumn("pos", F.col("nbr_1")).withColumns({"dt": F.coalesce("dt", F.lit(0)), "edge": nn.or_zeros(F.col("edge"), edge_width)})
    trees = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "dt", "own", "edge", "nbrs"))).alias("_t"))
    per = trees.groupBy(F.col("key_eid").alias("eid")).agg(*(F.first(F.when(F.col("key_role") == r, F.col("_t")), ignorenulls=True).alias(r) for r in ROLES))
    return per.filter(" and ".join(f"{r} is not null" for r in ROLES))


def packed(edges: DataFrame, part: DataFrame, drawn: DataFrame, node_features: DataFrame, edge_features: DataFrame, preset: Preset, node_width: int, edge_width: int, steps: int = 1) -> DataFrame:
    """What samples gives for models of one layer of recent neighbours, in blocks of edges that follow each other in time: a neighbour that many roots of a block share is kept
    once, with its vectors. part (the step that takes the block), block, and as lists the block's edges (e_t, e_nbr, e_edge), vectors of roots (own) and, for every edge, eids and,
    for src, dst and neg of each in turn, at (place of the vector), t, end and size: the neighbours are the `size` edges before `end`.
    """
    order = with_row_ids(part.filter("src is not null and dst is not null and t is not null").select("eid", "src", "dst", "t"), ["t", "eid"])
    step = F.pmod(F.xxhash64("eid"), F.lit(steps)).cast("long")
    full = order.join(drawn.filter("k = 0 and node is not null").select("eid", F.col("node").alias("neg")), "eid")
    each = F.array(*(F.struct(F.col(r).alias("node"), F.lit(i).alias("i")) for i, r in enumerate(ROLES)))
    block = F.floor(F.col("row_id") / BLOCK) * steps + step
    probes = full.select("t", block.alias("block"), "row_id", F.explode(each).alias("_p")).select("_p.node", "t", "block", ((F.col("row_id") % BLOCK) * 3 + F.col("_p.i")).alias("key"))
    near = edges.select("eid", "src", "dst", "t").join(edge_features.select("eid", F.col("f").alias("edge")), "eid", "left")
    near = near.join(node_features.select(F.col("id").alias("dst"), F.col("f").alias("nbr")), "dst", "left").select(F.col("src").alias("node"), "t", "eid", "nbr", "edge")
    found = sampler.by_block(near, probes, node_features.select(F.col("id").alias("node"), F.col("f").alias("own")), preset.fanout[0], (node_width, edge_width))
    schema = "part long, block long, e_t array<long>, e_nbr array<double>, e_edge array<double>, own array<double>, t array<long>, at array<int>, end array<int>, size array<int>"
    k = preset.fanout[0]

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        of = lambda c: rows[c].combine_chunks()
        length = lambda x: pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
        n_edges, n_probes = length(of("e_t")), length(of("p_key"))
        begin, row = np.repeat(np.cumsum(n_edges) - n_edges, n_probes), np.repeat(np.arange(len(n_edges)), n_probes)
        end = of("p_end").flatten().to_numpy()
        name, has = of("p_key").flatten().to_numpy(), pc.is_valid(of("own")).to_numpy(zero_copy_only=False)
        at = np.where(has, np.cumsum(has) - 1, -1)[row]
        sort = np.argsort(name)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        flat = lambda c: one(of(c).flatten())
        whole = lambda x, kind: one(pa.array(x[sort].astype(kind)))
        size = np.minimum(end, k)
        columns = [pa.array([key[0].as_py() % steps]), pa.array([key[0].as_py()]), flat("e_t"), flat("e_nbr"), flat("e_edge"), one(of("own").drop_null().flatten())]
        columns += [whole(of("p_t").flatten().to_numpy(), np.int64), whole(at, np.int32), whole(begin + end, np.int32), whole(size, np.int32)]
        return pa.table(columns, names=[c.split()[0] for c in schema.split(", ")])

    made = written(found.groupBy("block").applyInArrow(together, schema), "training")
    dropped(found)
    return made


def _unpacked(b: pa.RecordBatch, at: int, node_width: int, edge_width: int) -> Iterator[dict[str, tuple[np.ndarray, ...]]]:
    """The roots of CHUNK edges at a time of a block: own, nbr, edge, dt and mask of each role."""
    of = lambda c: b.column(c).slice(at, 1).flatten().to_numpy(zero_copy_only=False)
    t, place, end, size = (of(c).reshape(-1, 3) for c in ("t", "at", "end", "size"))
    e_t = of("e_t")
    nbr, edge = of("e_nbr").reshape(len(e_t), node_width), of("e_edge").reshape(len(e_t), edge_width)
    own = np.concatenate([of("own").reshape(place.max(initial=-1) + 1, node_width), np.zeros((1, node_width))])  # at -1: no vector
    for a in range(0, len(t), CHUNK):
        chunk = {}
        for i, r in enumerate(ROLES):
            n = size[a : a + CHUNK, i]
            most = max(int(n.max(initial=0)), 1)
            mask = np.arange(most) < n[:, None]
            pick = (end[a : a + CHUNK, i, None] - 1 - np.arange(most))[mask]
            near, by, dt = np.zeros((*mask.shape, node_width)), np.zeros((*mask.shape, edge_width)), np.zeros(mask.shape)
            near[mask], by[mask], dt[mask] = nbr[pick], edge[pick], np.repeat(t[a : a + CHUNK, i], n) - e_t[pick]
            chunk[r] = (own[place[a : a + CHUNK, i]], near, by, dt, mask)
        yield chunk


class Network:
    """Forward and backward of a model over a batch of samples."""

    def __init__(self, preset: Preset, node_width: int, edge_width: int, dropout: float = 0.0) -> None:
        self.layers, self.dropout = models.model_layers(preset, node_width, edge_width), dropout

    def _drops(self, rng: np.random.Generator | None, layer: L.Layer, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if rng is None or not self.dropout:
            return None
        keep = 1 - self.dropout
        return tuple((rng.random(shape) < keep) / keep for shape in ((*mask.shape, layer.heads), (len(mask), layer.out)))

    def embed(self, w: models.Models, trees: pa.Array | tuple, rng: np.random.Generator | None) -> tuple[np.ndarray, tuple]:
        first = self.layers[0]
        if isinstance(trees, tuple):  # of one layer, as packed gives them
            h, c = L.forward(w["layer_0"], first, *trees, self._drops(rng, first, trees[4]))
            return h, (c, np.arange(len(h)), None, None, len(h))
        sizes = pc.list_value_length(trees).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts = trees.flatten(), np.cumsum(sizes) - sizes
        inner = nn._padded(flat.field("nbrs"), first)
        h, c = L.forward(w["layer_0"], first, L.from_lists(flat.field("own"), first.node), *inner, self._drops(rng, first, inner[3]))
        if len(self.layers) == 1:
            return h[starts], (c, starts, None, None, len(h))
        second, k = self.layers[1], max(int(sizes.max()) - 1, 1)
        row = np.repeat(np.arange(len(sizes)), sizes - 1)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
        at = np.delete(np.arange(len(h)), starts)
        nbr, edge, dt, mask = np.zeros((len(sizes), k, second.node)), np.zeros((len(sizes), k, second.edge)), np.zeros((len(sizes), k)), np.zeros((len(sizes), k), bool)
        nbr[row, col], mask[row, col] = h[at], True
        edge[row, col] = L.from_lists(flat.field("edge"), second.edge)[at]
        dt[row, col] = pc.cast(flat.field("dt"), pa.float64()).to_numpy(zero_copy_only=False)[at]
        top, c_top = L.forward(w["layer_1"], second, h[starts], nbr, edge, dt, mask, self._drops(rng, second, mask))
        return top, (c, starts, c_top, (row, col, at), len(h))

    def embed_backward(self, w: models.Models, cache: tuple, dh: np.ndarray, g: models.Models) -> None:
        c, starts, c_top, places, n = cache
        inner = np.zeros((n, self.layers[0].out))
        if c_top is None:
            inner[starts] = dh
        else:
            got, d_own, d_nbr = L.backward(w["layer_1"], self.layers[1], c_top, dh)
            _add(g, "layer_1", got)
            row, col, at = places
            inner[starts] = d_own
            inner[at] += d_nbr[row, col]
        _add(g, "layer_0", L.backward(w["layer_0"], self.layers[0], c, inner)[0])

    def loss(self, w: models.Models, batch: dict[str, pa.Array | tuple], rng: np.random.Generator | None = None) -> tuple[float, models.Models]:
        """Summed logistic loss of the true and the negative edges, and its gradient."""
        g: models.Models = {m: {k: np.zeros_like(x) for k, x in v.items()} for m, v in w.items()}
        h, caches = zip(*(self.embed(w, batch[r], rng) for r in ROLES))
        d, total = [np.zeros_like(x) for x in h], 0.0
        for end, sign in ((1, -1.0), (2, 1.0)):
            s, c = L.predict(w["predictor"], h[0], h[end])
            total += float(np.logaddexp(0.0, sign * s).sum())
            got, d_src, d_end = L.predict_backward(w["predictor"], c, sign / (1 + np.exp(-sign * s)))
            _add(g, "predictor", got)
            d[0] += d_src
            d[end] += d_end
        for cache, x in zip(caches, d):
            self.embed_backward(w, cache, x, g)
        return total, g


def _add(g: models.Models, name: str, more: L.Weights) -> None:
    for k, x in more.items():
        g[name][k] = g[name][k] + x


def gradient(rows: DataFrame, net: Network, weights: models.Models, seed: int) -> tuple[np.ndarray, float, int]:
    """Summed gradient, loss and number of samples: one pass. Partitions send sums in pieces of PIECE weights, which are summed per piece before
    the driver sees them. Dropout is drawn from the seed and the eids of a chunk, or the number of a block (packed).
    """
    size, sent = len(flat(weights)), nn._sent(rows, [flat(weights)])
    like = {m: {k: np.empty(x.shape) for k, x in v.items()} for m, v in weights.items()}

    def pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        each = [total[i : i + PIECE].tolist() for i in range(0, len(total), PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(each)), pa.int32()), pa.array(each, pa.list_(pa.float64()))], names=["piece", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, seen = shaped(sent.value[0], like), np.zeros(size + 2), False
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b, seen = whole.slice(at, CHUNK), True
                rng = np.random.default_rng([seed, int(sum(b.column("eid").to_pylist())) % 2**32]) if net.dropout else None
                loss, g = net.loss(w, {r: b.column(r) for r in ROLES}, rng)
                total += np.concatenate([flat(g), [loss, b.num_rows]])
        if seen:
            yield from pieces(total)

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, seen = shaped(sent.value[0], like), np.zeros(size + 2), False
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                rng = np.random.default_rng([seed, block]) if net.dropout else None
                for chunk in _unpacked(b, i, net.layers[0].node, net.layers[0].edge):
                    seen = True
                    loss, g = net.loss(w, chunk, rng)
                    total += np.concatenate([flat(g), [loss, len(chunk["src"][0])]])
        if seen:
            yield from pieces(total)

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.sum([x.as_py() for x in rows["v"]], 0).tolist()], pa.list_(pa.float64()))})

    out = "piece int, v array<double>"
    got = {r.piece: r.v for r in rows.mapInArrow(run_blocks if "block" in rows.columns else run, out).groupBy("piece").applyInArrow(together, out).collect()}
    if not got:
        return np.zeros(size), 0.0, 0
    total = np.concatenate([got[i] for i in range(len(got))])
    return total[:size], float(total[size]), int(total[size + 1])


def train(edges: DataFrame, node_features: DataFrame, edge_features: DataFrame, run: RunSettings, node_width: int, edge_width: int, hidden: int = 8, steps: int = 1, first: int = 3, timers: StageTimers | None = None) -> tuple[models.Models, list[tuple[int, float, float]]]:
    """Weights of the best epoch and, per epoch, its number, mean loss and average precision on the validation split.

    Training edges (split 0) with a negative each become samples once, written to the shared folder; an epoch is `steps` passes over as many parts
    of them by a hash of eid, each one step of Adam. The best epoch is the one of the greatest precision from `first` on (numbered from 0), as long as there is
    one, else the last. With no training edges the weights stay the initial ones.
    """
    timers = timers or StageTimers()
    part = edges.filter("split = 0")
    with timers.stage("t_sample"):
        drawn = etl.negatives(part, etl.dense_ids(edges), 1, run.seed)
        preset = run.preset
        blocks = preset.layer == "attention" and preset.strategy == "recent" and len(preset.fanout) == 1 and not (preset.memory or preset.duration) and preset.snapshots == 1
        make = packed if blocks else samples
        rows = make(edges, part, drawn, node_features, edge_features, preset, node_width, edge_width, *([steps] if blocks else []))
        rows = rows if blocks else written(rows, "training")
    weights = models.initial_weights(run.preset, node_width, edge_width, hidden)
    net, w = Network(run.preset, node_width, edge_width, run.dropout), flat(weights)
    adam, told, best, best_ap = Adam(len(w), run.rate), [], None, -1.0
    for epoch in range(run.epochs):
        loss, n = 0.0, 0
        for step in range(steps):
            with timers.stage("t_backward"):
                now = rows.filter((F.col("part") if blocks else F.pmod(F.xxhash64("eid"), F.lit(steps))) == step) if steps > 1 else rows
                g, more, seen = gradient(now, net, shaped(w, weights), run.seed + epoch * steps + step)
            loss, n = loss + more, n + seen
            if seen:
                w = adam.step(w, g / seen)
        with timers.stage("t_eval"), scratch(edges.sparkSession):
            row = models.evaluate(edges, 1, node_features, edge_features, run, node_width, edge_width, hidden, shaped(w, weights)).first()
        told.append((epoch, loss / max(n, 1), row.ap))
        if epoch >= first and row.ap is not None and row.ap > best_ap:
            best, best_ap = w.copy(), row.ap
        timers.next_epoch()
    return shaped(w if best is None else best, weights), told


class StageTimers:
    """Named wall-clock timers per epoch and their means after a warm-up."""

    def __init__(self) -> None:
        self.rows: list[dict[str, float]] = [{}]

    @contextmanager
    def stage(self, name: str):
        began = time.time()
        try:
            yield
        finally:
            self.rows[-1][name] = self.rows[-1].get(name, 0.0) + time.time() - began

    def next_epoch(self) -> None:
        self.rows.append({})

    def means(self, warm_up: int = 0) -> dict[str, float]:
        kept = [r for r in self.rows[warm_up:] if r]
        return {n: sum(r.get(n, 0.0) for r in kept) / len(kept) for n in sorted({n for r in kept for n in r})}


def metrics_table(spark: SparkSession, told: list[tuple[int, float, float]], timers: StageTimers) -> DataFrame:
    """epoch, name, value: loss, ap and the seconds of every stage of every epoch."""
    rows = [(e, n, None if v is None else float(v)) for e, loss, ap in told for n, v in (("loss", loss), ("ap", ap))]
    rows += [(e, n, v) for e, r in enumerate(timers.rows) for n, v in r.items()]
    return spark.createDataFrame(rows, "epoch int, name string, value double")
