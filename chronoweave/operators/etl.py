"""From raw interactions to a dense, time-ordered temporal graph, its splits, batches, roots and negatives.

All operators take edges as eid, src, dst, t, split (see clean_edges) and ignore further columns; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.draws import draw, uniform
from chronoweave.operators.ordering import with_prefix_sum, with_row_ids


def clean_edges(edges: DataFrame) -> DataFrame:
    """eid, src, dst, t, split of the rows with src, dst and time; split may be null. Repeated deliveries stay, under their own eid."""
    e = edges.filter("src is not null and dst is not null and time is not null")
    return e.select(F.col("eid").cast("long").alias("eid"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("time").cast("long").alias("t"), F.col("ext_roll").cast("int").alias("split"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """The distinct nodes (node) of src and dst."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").distinct()


def dense_ids(edges: DataFrame) -> DataFrame:
    """node and its dense id: its rank from 0 among all nodes."""
    return with_row_ids(nodes_of(edges), ["node"], "id")


def reindexed(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edges with src and dst replaced by dense ids. Hot nodes are left to the skew join of adaptive execution: ids has one row a node."""
    ids = dense_ids(edges) if ids is None else ids
    s, d = ids.select(F.col("node").alias("src"), F.col("id").alias("_s")), ids.select(F.col("node").alias("dst"), F.col("id").alias("_d"))
    return edges.join(s, "src").join(d, "dst").select("eid", F.col("_s").alias("src"), F.col("_d").alias("dst"), "t", "split")


def rebased(edges: DataFrame) -> DataFrame:
    """Times counted from the least of all."""
    return edges.withColumn("t", F.col("t") - edges.agg(F.min("t")).scalar())


def time_sorted(edges: DataFrame) -> DataFrame:
    """Edges with row_id, their number from 0 in order of (t, eid)."""
    return with_row_ids(edges, ["t", "eid"])


def positional_split(ordered: DataFrame, train: float = 0.7, val: float = 0.85) -> DataFrame:
    """New split by position in time: row_id below floor(train * n) is 0, below floor(val * n) 1, else 2."""
    n = ordered.agg(F.count(F.lit(1))).scalar()
    return ordered.withColumn("split", F.when(F.col("row_id") < F.floor(n * train), 0).when(F.col("row_id") < F.floor(n * val), 1).otherwise(2))


def node_count(edges: DataFrame) -> DataFrame:
    """max(max(src), max(dst)) + 1."""
    return edges.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n_nodes"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, under the same eid; a loop is its own reverse and comes twice."""
    return edges.unionByName(edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "t", "split"))


def degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Out-degree of every node of ids (node, id), 0 where it is no src."""
    d = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return ids.join(d, "node", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def indptr(degree: DataFrame) -> DataFrame:
    """Row pointers over dense ids: id and the number of edges of all smaller ids; one more row closes the last."""
    body = with_prefix_sum(degree, ["id"], "degree", "ptr").select("id", "ptr")
    return body.union(degree.agg(F.count(F.lit(1)).alias("id"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ptr")))


def flat_adjacency(edges: DataFrame) -> DataFrame:
    """Edges with pos, their place in the neighbour lists of all nodes end to end: in order of (src, t, eid). indptr tells where a node's list begins."""
    return with_row_ids(edges, ["src", "t", "eid"], "pos")


def split_slices(ordered: DataFrame) -> DataFrame:
    """ordered with slice: 0 before the first row with split > 0, 1 from there to the first with split > 1, 2 from there on."""
    bounds = split_bounds(ordered)
    at = lambda c: F.col("row_id") >= bounds.select(c).scalar()
    return ordered.withColumn("slice", F.when(at("val_end"), 2).when(at("train_end"), 1).otherwise(0))


def split_bounds(ordered: DataFrame) -> DataFrame:
    """First row_id with split > 0 and with split > 1."""
    return ordered.agg(F.min(F.when(F.col("split") > 0, F.col("row_id"))).alias("train_end"), F.min(F.when(F.col("split") > 1, F.col("row_id"))).alias("val_end"))


def new_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that occur in no training edge."""
    return nodes_of(edges).join(nodes_of(edges.filter("split = 0")), "node", "left_anti")


def inductive_links(edges: DataFrame) -> DataFrame:
    """Training and validation edges, and the test edges with at least one end among the new nodes; null split is left out."""
    new = new_nodes(edges)
    test = edges.filter("split = 2").join(new.select(F.col("node").alias("src"), F.lit(1).alias("_s")), "src", "left").join(new.select(F.col("node").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return edges.filter("split < 2").unionByName(test.filter("_s = 1 or _d = 1").select("eid", "src", "dst", "t", "split"))


def inductive_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the inductive test edges, both ends."""
    return nodes_of(inductive_links(edges).filter("split = 2"))


def batched(ordered: DataFrame, rows: int) -> DataFrame:
    """Batches of `rows` edges in order of time."""
    return ordered.withColumn("batch", F.floor(F.col("row_id") / rows))


def shifted_batches(ordered: DataFrame, rows: int, reorder: int, shift: int) -> DataFrame:
    """Batches begun `shift` chunks (of rows / reorder edges) later; the leading part is batch -1 when there is a shift."""
    chunk = rows // reorder
    return ordered.withColumn("batch", F.floor((F.col("row_id") - shift * chunk) / rows))


def negatives(edges: DataFrame, pool: DataFrame, per_edge: int = 1, seed: int = 42) -> DataFrame:
    """eid, k, node: per_edge nodes for each edge drawn with replacement from pool (id from 0 without gaps, node); true edges may be hit."""
    n = pool.agg(F.count(F.lit(1))).scalar()
    drawn = edges.select("eid", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1))).alias("k")).withColumn("id", draw(F.col("eid"), F.col("k").cast("long"), seed, n))
    return drawn.join(pool.select("id", "node"), "id").select("eid", "k", "node")


def hits(drawn: DataFrame, listed: DataFrame) -> DataFrame:
    """Drawn nodes that are in listed (node), and their number against that of the list: n_hits, n_list, rate."""
    got = drawn.join(listed.select("node").distinct(), "node", "left_semi").agg(F.count(F.lit(1)).alias("n_hits"))
    n = listed.select("node").distinct().agg(F.count(F.lit(1))).scalar()
    return got.select("n_hits", n.alias("n_list"), (F.col("n_hits") / n).alias("rate"))


def roots(edges: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """Roots of each edge: eid, role (src, dst, neg), k, node, t; the time is the edge's for every role."""
    ends = F.array(F.struct(F.lit("src").alias("role"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("role"), F.col("dst").alias("node")))
    out = edges.select("eid", "t", F.explode(ends).alias("_r")).select("eid", "_r.role", F.lit(0).alias("k"), "_r.node", "t")
    if drawn is not None:
        out = out.unionByName(drawn.join(edges.select("eid", "t"), "eid").select("eid", F.lit("neg").alias("role"), "k", "node", "t"))
    return out


def synthetic_features(ids: DataFrame, key: str, width: int, seed: int) -> DataFrame:
    """key, pos, value in [-1, 1): features made from the keys alone."""
    at = ids.select(F.col(key).alias(key), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("pos"))
    return at.withColumn("value", uniform(F.col(key), F.col("pos").cast("long"), seed))
