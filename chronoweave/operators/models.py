"""Whole models: sampling over several hops and snapshots, gathers, memory, layers, link scores and their metrics.

Models without memory have no dependence between batches, so all roots of a split are one job. With memory, roots are embedded from
what the batches before their own had left: in the fold itself (remembered), or from reads that it answers, or from the history of states (memory.history).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.config import Preset, RunSettings
from chronoweave.functions import vectors as V
from chronoweave.operators import etl, mailboxes, memory, metrics, nn, remembered, sampler
from chronoweave.operators import layers as L
from chronoweave.operators.ordering import with_row_ids
from chronoweave.session import dropped, written

Models = dict[str, L.Weights]
Past = DataFrame | Callable[[DataFrame], DataFrame]  # the history of states, or what answers reads (batch, node, t) of it


def model_layers(preset: Preset, node_width: int, edge_width: int) -> list[L.Layer]:
    """The attention layers from the innermost hop outwards. With memory the innermost takes vectors of the memory's width."""
    first = preset.out_width if preset.memory else node_width
    return [L.Layer(first if i == 0 else preset.out_width, edge_width, preset.time_width, preset.heads, preset.out_width, preset.combined and i == 0) for i in range(len(preset.fanout))]


def initial_weights(preset: Preset, node_width: int, edge_width: int, hidden: int) -> Models:
    """Weights by name: layer_0 (innermost), layer_1, ..., predictor. Snapshots share them."""
    named = {f"layer_{i}": L.initial_layer(x) for i, x in enumerate(model_layers(preset, node_width, edge_width))} if preset.layer == "attention" else {}
    return named | {"predictor": L.initial_predictor(output_width(preset, node_width), hidden)}


def output_width(preset: Preset, node_width: int) -> int:
    return preset.out_width if preset.layer == "attention" or preset.memory else node_width


def _vectors(rows: DataFrame, features: DataFrame, key: str, by: str, width: int, out: str) -> DataFrame:
    """rows with the features of their key, zeros where there are none."""
    f = features.select(F.col(by).alias(key), F.col("f").alias("_f"))
    return rows.join(f, key, "left").withColumn(out, nn.or_zeros(F.col("_f"), width)).drop("_f")


def memory_inputs(occurrences: DataFrame, past: Past, node_features: DataFrame, preset: Preset, node_width: int, edge_width: int) -> DataFrame:
    """batch, node, t, h, mem_t of the distinct occurrences (batch, node, t): new memory at t, with the node's features added, projected if of another width."""
    m = past(occurrences.select("batch", "node", "t")) if callable(past) else memory.inputs(occurrences, past, preset.memory, preset.out_width, edge_width, preset.time_width)
    if not (preset.memory.add_features and node_width):
        return m.withColumnRenamed("mem", "h")
    full = _vectors(m, node_features, "node", "id", node_width, "_own")
    if node_width != preset.out_width:
        full = nn.split_projection(full, {"_own": node_width}, preset.out_width, [50], "_map")
    return full.select("batch", "node", "t", "mem_t", V.add(F.col("mem"), F.col("_own" if node_width == preset.out_width else "_map")).alias("h"))


def embeddings(edges: DataFrame, queries: DataFrame, key: list[str], node_features: DataFrame, edge_features: DataFrame, preset: Preset, node_width: int, edge_width: int, past: Past | None = None, weights: Models | None = None) -> DataFrame:
    """key and h for each query (key, node, t): of preset.out_width, or of node_width for the identity layer without memory.

    Every hop of the fan-out is one attention layer: roots and sampled neighbours of a hop are embedded by the hop below, those of the
    last hop by their features, or by their memory (and features) for presets with memory, which need past (see Past) and batch among the key
    columns. Several snapshots are embedded apart, with the time since an edge counted from the query's own time, and combined, the oldest
    first. Queries with null node or t have no h and don't come out; nodes and edges without features have zeros, nodes without memory too.
    """
    if preset.memory is not None and (past is None or "batch" not in key):
        raise ValueError(f"{preset.name} has a memory: its history and a key with batch are needed")
    own = {k: f"key_{i}" for i, k in enumerate(key)}  # the caller's names may be those of a block's columns
    keys = list(own.values())
    q = queries.filter("node is not null and t is not null").select(*(F.col(k).alias(n) for k, n in own.items()), "node", "t")
    batch = own.get("batch")
    if preset.layer == "identity" or not preset.fanout:
        if preset.memory is None:
            h = _vectors(q, node_features, "node", "id", node_width, "h").withColumn("mem_t", F.lit(0).cast("long"))
        else:
            at = q.withColumnRenamed(batch, "batch")
            h = at.join(memory_inputs(at, past, node_features, preset, node_width, edge_width), ["batch", "node", "t"]).withColumnRenamed("batch", batch)
        normed = V.layer_norm(F.col("h"))
        h = h.select(*keys, (nn.time_decay(normed, F.col("t"), F.coalesce("mem_t", F.lit(0))) if preset.time_decay else normed).alias("h"))
    else:
        back = F.explode(F.sequence(F.lit(0), F.lit(preset.snapshots - 1)))
        several = preset.snapshots > 1
        asked = q.withColumn("key_snap", back) if several else q
        h = _layers(edges, asked, [*keys, "key_snap"] if several else keys, node_features, edge_features, preset, node_width, edge_width, past, batch, weights)
        h = nn.combine_snapshots(h, keys, "key_snap", "h", preset.out_width) if several else h
    return h.select(*(F.col(n).alias(k) for k, n in own.items()), "h")


def sampled(edges: DataFrame, queries: DataFrame, key: list[str], preset: Preset) -> tuple[list[DataFrame], list[DataFrame], list[list[str]]]:
    """Per hop what is asked (key, node, t), the block found, with dt from the time the query was made for, and the key: one more nbr_i a hop."""
    shift = F.col("key_snap") * preset.duration if preset.snapshots > 1 else F.lit(0)
    asked, blocks, keys = [queries], [], [list(key)]
    for hop, k in enumerate(preset.fanout):
        pick = sampler.recent if preset.strategy == "recent" else sampler.uniform
        block = pick(edges, asked[-1].withColumn("t", F.col("t") - shift), keys[-1], k, duration=preset.duration).drop("snap")
        blocks.append(block.withColumns({"root_t": F.col("root_t") + shift, "dt": F.col("dt") + shift}))
        if hop + 1 < len(preset.fanout):
            asked.append(sampler.next_roots(asked[-1], blocks[-1], keys[-1], preset.keep_root_time).withColumnRenamed("nbr", f"nbr_{hop + 1}"))
            keys.append([*keys[-1], f"nbr_{hop + 1}"])
    return asked, blocks, keys


def _by_sweeps(edges: DataFrame, queries: DataFrame, key: list[str], node_features: DataFrame, edge_features: DataFrame, preset: Preset, node_width: int, edge_width: int, weights: Models) -> DataFrame:
    """_layers for recent neighbours that are seen at their edge's own time: what a neighbour brings then depends on its edge only, so each layer is
    worked out once an edge, and once a query, in a sweep (sampler.over_recent); a layer's edges come out with the vectors that the next one needs.
    """
    named = lambda f, by: f.select(F.col(by), F.col("f").alias("_f"))
    plain = edges.select("eid", "src", "dst", "t").join(named(edge_features, "eid").withColumnRenamed("_f", "edge"), "eid", "left")
    near = plain.join(named(node_features, "id").select(F.col("id").alias("dst"), F.col("_f").alias("own")), "dst", "left")
    asked = queries.select(*key, "node", "t").join(node_features.select(F.col("id").alias("node"), F.col("f").alias("own")), "node", "left")
    last = len(preset.fanout) - 1
    stored: list[DataFrame] = []
    for at, shape in enumerate(model_layers(preset, node_width, edge_width)):
        w = weights.get(f"layer_{at}") or L.initial_layer(shape)
        nn.checked(w)
        rows = asked.select(*key, "node", "t", "own")
        if at < last:  # an edge asks for its far end at its own time
            far = near.select("eid", "src", "edge", F.col("dst").alias("node"), "t", "own")
            rows = rows.unionByName(far, allowMissingColumns=True)
        seen = near.select(F.col("src").alias("node"), "t", "eid", F.col("own").alias("nbr"), "edge")
        made = sampler.over_recent(seen, rows, preset.fanout[last - at], (shape.node, shape.edge), lambda own, *x, w=w, shape=shape: L.forward(w, shape, own, *x)[0])
        for x in stored:
            dropped(x)
        stored = [made]
        near = made.filter("eid is not null").select("eid", "src", "edge", F.col("node").alias("dst"), "t", F.col("h").alias("own")) if at < last else None
        asked = made.filter("eid is null").select(*key, "node", "t", F.col("h").alias("own")) if at < last else made
    return asked.select(*key, "h")


def _layers(edges: DataFrame, queries: DataFrame, key: list[str], node_features: DataFrame, edge_features: DataFrame, preset: Preset, node_width: int, edge_width: int, past: Past | None, batch: str | None, weights: Models | None) -> DataFrame:
    if preset.memory is None and preset.strategy == "recent" and not preset.keep_root_time and not preset.duration and preset.snapshots == 1:
        return _by_sweeps(edges, queries, key, node_features, edge_features, preset, node_width, edge_width, weights or {})
    shapes = model_layers(preset, node_width, edge_width)
    weights = weights or {}
    if isinstance(past, remembered.Answers) and past.edges is edges and past.edge_features is edge_features and remembered.fits(preset):
        each = [weights.get(f"layer_{i}") or L.initial_layer(x) for i, x in enumerate(shapes)]
        for w in each:
            nn.checked(w)
        return remembered.embeddings(past.order, queries, key, batch, node_features, edge_features, preset, shapes, each, node_width, edge_width)
    asked, blocks, keys = sampled(edges, queries, key, preset)
    seen = F.col("root_t" if preset.keep_root_time else "t")  # the time at which a neighbour is seen
    h = None
    for level in range(len(blocks) - 1, -1, -1):
        by, block = keys[level], blocks[level]
        if h is None and preset.memory is not None:
            own = asked[level].select(*by, "node", "t")
            near = block.select(*by, "nbr_pos", "node", seen.alias("t"), "eid", "dt")
            every = own.select(F.col(batch).alias("batch"), "node", "t").unionByName(near.select(F.col(batch).alias("batch"), "node", "t"))
            state = written(memory_inputs(every, past, node_features, preset, node_width, edge_width), "memory-inputs").withColumnRenamed("batch", batch)
            at = [batch, "node", "t"]
            roots = own.join(state.select(*at, F.col("h").alias("own")), at).select(*by, "own")
            rows = near.join(state.select(*at, F.col("h").alias("nbr")), at)
        elif h is None:
            roots = _vectors(asked[level], node_features, "node", "id", node_width, "own").select(*by, "own")
            rows = _vectors(block, node_features, "node", "id", node_width, "nbr")
        else:
            below = f"nbr_{level + 1}"
            roots = h.filter(F.col(below) == -1).select(*by, F.col("h").alias("own"))
            rows = block.join(h.filter(F.col(below) >= 0).select(*by, F.col(below).alias("nbr_pos"), F.col("h").alias("nbr")), [*by, "nbr_pos"])
        rows = _vectors(rows, edge_features, "eid", "eid", edge_width, "edge").select(*by, "nbr_pos", "nbr", "edge", "dt")
        layer = len(blocks) - 1 - level
        h = nn.attention_layer(rows, roots, by, shapes[layer], weights.get(f"layer_{layer}"))
        h = written(h, "layer") if level else h  # read twice by the hop above
    return h


def numbered(edges: DataFrame, rows: int) -> DataFrame:
    """Edges with batch and edge_pos, in order of time."""
    return etl.batched(with_row_ids(edges, ["t", "eid"]), rows).withColumn("edge_pos", F.pmod("row_id", F.lit(rows))).drop("row_id")


def _routes(edges: DataFrame, true: DataFrame, preset: Preset) -> DataFrame | None:
    """Who gets the mails of the true edges beside their ends: batch, pos, to."""
    if preset.memory.deliver_to != "neighbors":
        return None
    sends = memory.mail_rows(true).select("batch", "pos", "node", "t").withColumnRenamed("pos", "mail_pos")
    return sampler.recent_nodes(edges, sends, ["batch", "mail_pos"], preset.fanout[0]).withColumnRenamed("mail_pos", "pos")


def memory_history(edges: DataFrame, true: DataFrame, edge_features: DataFrame, preset: Preset, edge_width: int) -> DataFrame:
    """The history of states over true edges (batch, edge_pos, eid, src, dst, t); edges are those that neighbours to deliver to are sampled from."""
    return memory.history(true, edge_features, preset.memory, preset.out_width, edge_width, preset.time_width, _routes(edges, true, preset))


def memory_answers(edges: DataFrame, true: DataFrame, edge_features: DataFrame, preset: Preset, edge_width: int) -> Past:
    """As memory_history, for embeddings to ask: no history is stored, the fold answers what is read (memory.answers). true are the edges, numbered: where mails go
    to neighbours, the fold finds them itself (mailboxes.answers) unless their mean is kept. Layers over recent neighbours are worked out in the fold as well
    (remembered.embeddings), and no reads are made.
    """
    if preset.memory.deliver_to == "neighbors" and preset.memory.combine == "last":
        return lambda reads: mailboxes.answers(reads, true, edge_features, preset.memory, preset.fanout[0], preset.out_width, edge_width, preset.time_width)
    answered = lambda reads: memory.answers(reads, true, edge_features, preset.memory, preset.out_width, edge_width, preset.time_width, _routes(edges, true, preset))
    return remembered.Answers(answered, edges, true, edge_features)


def link_scores(edges: DataFrame, part: DataFrame, node_features: DataFrame, edge_features: DataFrame, run: RunSettings, node_width: int, edge_width: int, hidden: int = 8, weights: Models | None = None) -> DataFrame:
    """batch, edge_pos, label, score of the edges of `part` and of as many negatives each as run says; edges are those sampled from.

    Negatives come from all nodes of edges or, if run.inductive, from the nodes of the inductive test edges. Batches are counted over part or, with
    memory, over all edges in order of time, whatever their split, as all of them write to the memory; a root reads what earlier batches wrote.
    """
    pool = with_row_ids(etl.inductive_nodes(edges), ["node"], "id") if run.inductive else etl.dense_ids(edges)
    drawn = etl.negatives(part, pool, run.eval_negatives, run.seed)
    order = numbered(edges if run.preset.memory else part, run.batch_rows)
    asked, key, past = etl.roots(part, drawn), ["eid", "role", "k"], None
    if run.preset.memory:
        past = memory_answers(edges, order, edge_features, run.preset, edge_width)
        asked, key = asked.join(order.select("eid", "batch"), "eid"), [*key, "batch"]
    made = embeddings(edges, asked, key, node_features, edge_features, run.preset, node_width, edge_width, past, weights)
    stored = isinstance(past, remembered.Answers) and remembered.fits(run.preset)  # the fold has written them
    h = made if stored else written(made, "embeddings")
    if past is None:
        dropped(made)
    true = h.filter("role <> 'neg'").select("eid", "role", "h").join(h.filter("role = 'neg'").select("eid", "k").distinct(), "eid").select("eid", "k", "role", "h")
    ends = nn.edge_scores(true.unionByName(h.filter("role = 'neg'").select("eid", "k", "role", "h")), ["eid", "k"], output_width(run.preset, node_width), hidden, (weights or {}).get("predictor"))
    each = F.array(F.struct(F.lit(1).alias("label"), F.col("pos_score").alias("score")), F.struct(F.lit(0).alias("label"), F.col("neg_score").alias("score")))
    scored = ends.select("eid", "k", F.explode(each).alias("_s")).select("eid", "k", "_s.*").filter("score is not null and (label = 0 or k = 0)")
    return scored.join(order.select("eid", "batch", "edge_pos"), "eid").select("batch", "edge_pos", "label", "score")


def evaluate(edges: DataFrame, split: int, node_features: DataFrame, edge_features: DataFrame, run: RunSettings, node_width: int, edge_width: int, hidden: int = 8, weights: Models | None = None) -> DataFrame:
    """One row: ap, auc, mrr and loss of a split (1 validation, 2 test; with run.inductive only the test edges with new nodes)."""
    part = etl.inductive_links(edges) if run.inductive else edges
    scored = link_scores(edges, part.filter(F.col("split") == split), node_features, edge_features, run, node_width, edge_width, hidden, weights)
    return metrics.summary(written(scored, "scored"))
