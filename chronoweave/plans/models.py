"""Queries of blocks, feature gathers, hot sets, kernels, model expressions, memory, metrics and topology, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.functions.vectors import weight_sql
from chronoweave.config import MemorySettings
from chronoweave.operators import blocks, etl, hotset, kernels, layers, memory, metrics, models, nn, sampler, topology
from chronoweave.plans import base
from chronoweave.plans.base import EF, NF, ORDERED, E, R, S, block_sql
from chronoweave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = ["batch", "root_pos"]
K = 5
BATCH = 600
CAPACITY = 500
SLOTS = 3
PARTS = 8
WIDTH = 4


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "with " + sql if sql[:6] != "select" else sql
        return f

    return register


def _block(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return sampler.recent(base.edges(spark, d), base.queries(spark, d), KEY, k)


def _positions(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """One row per element, rounded so that the order of floating-point sums doesn't matter."""
    return df.select(*by, F.posexplode(vector).alias("pos", "_v")).select(*by, "pos", F.round(F.col("_v"), 6).alias("value"))


_B = f"{E}, {R}, b as ({block_sql(K)})"

# ---- blocks and gathers ---------------------------------------------------------------------------------------------


@query(f"{_B} select batch, root_pos, cast(-1 as integer) as nbr_pos, node, t, cast(0 as bigint) as dt from r union all select batch, root_pos, nbr_pos, node, t, dt from b")
def blk01_message_rows(spark: SparkSession, d: str) -> DataFrame:
    return blocks.message_rows(base.queries(spark, d), _block(spark, d))


@query(f"{_B} select batch, root_pos, nbr_pos, root as node, node as root, eid, t, dt from b")
def blk02_reversed(spark: SparkSession, d: str) -> DataFrame:
    return blocks.reversed_block(_block(spark, d))


@query(f"{R} select batch, root_pos, node, t from r")
def blk03_roots_only(spark: SparkSession, d: str) -> DataFrame:
    return base.queries(spark, d).select(*KEY, "node", "t")


def _elements(width: int) -> str:
    return ", ".join(f"cast(f[{i + 1}] as double) as f{i}" for i in range(width))


_NODE_GATHER = f"{_B}, {NF} select batch, root_pos, nbr_pos, node, {_elements(8)} from b left join nf on nf.id = b.node"
_EDGE_GATHER = f"{_B}, {EF} select batch, root_pos, nbr_pos, b.eid, {_elements(4)} from b left join ef on ef.eid = b.eid"


def _whole(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.select(*KEY, "nbr_pos", key, *(F.col("f")[i].cast("double").alias(f"f{i}") for i in range(width)))


@query(_NODE_GATHER)
def blk04_node_gather(spark: SparkSession, d: str) -> DataFrame:
    return _whole(blocks.gather(_block(spark, d), base.node_features(spark, d), "node", "id"), "node", 8)


@query(_EDGE_GATHER)
def blk05_edge_gather(spark: SparkSession, d: str) -> DataFrame:
    return _whole(blocks.gather(_block(spark, d), base.edge_features(spark, d), "eid", "eid"), "eid", 4)


@query(f"{_B} select node, t, count(*) as n from b group by node, t")
def blk06_distinct_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return blocks.distinct_occurrences(_block(spark, d))


@query(f"{_B} select 'node' as kind, node as id from b union select 'edge', eid from b")
def blk09_ids(spark: SparkSession, d: str) -> DataFrame:
    b = _block(spark, d)
    return b.select(F.explode(F.array(F.struct(F.lit("node").alias("kind"), F.col("node").alias("id")), F.struct(F.lit("edge").alias("kind"), F.col("eid").alias("id")))).alias("x")).select("x.*").distinct()


# ---- hot sets -------------------------------------------------------------------------------------------------------
_HOPS = f"""{E}, {R}, g as (select eid, src, dst, t from e union all select eid, dst, src, t from e), h1 as ({block_sql(4, "g")}), r2 as (select batch, root_pos, cast(-1 as integer) as nbr_1, node, t from r union all select batch, root_pos, nbr_pos, node, t from h1),
h2 as ({block_sql(3, "g", "r2", "batch, root_pos, nbr_1")}), hot_e as (select eid, count(*) as score from (select distinct eid, batch, 1 as hop from h1 union all select distinct eid, batch, 2 from h2) group by eid), hot_n as (select node, count(*) as score from (select distinct node, batch from h2) group by node)"""


def _hot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hotness of the nodes of the outermost block and of the edges of all blocks."""
    hops = sampler.multi_hop(etl.with_reverse(base.edges(spark, d)), base.queries(spark, d), KEY, [4, 3])
    every = hops[0].select("eid", "batch", F.lit(1).alias("hop")).unionByName(hops[1].select("eid", "batch", F.lit(2).alias("hop")))
    return hotset.hotness(hops[-1], "node", ["batch"]), hotset.hotness(every, "eid", ["batch", "hop"])


@query(f"{_HOPS} select 'node' as kind, node as id, score from hot_n union all select 'edge', eid, score from hot_e")
def cac01_hotness(spark: SparkSession, d: str) -> DataFrame:
    n, e = _hot(spark, d)
    return n.select(F.lit("node").alias("kind"), F.col("node").alias("id"), "score").unionByName(e.select(F.lit("edge").alias("kind"), F.col("eid").alias("id"), "score"))


_RANKED = f"{_HOPS}, ids as (select src as node from e union select dst from e), rk as (select node, coalesce(score, 0) as score, row_number() over (order by coalesce(score, 0) desc, node) - 1 as place from ids left join hot_n using (node))"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return hotset.ranked(_hot(spark, d)[0], etl.nodes_of(base.edges(spark, d)), "node")


@query(f"{_RANKED} select * from rk")
def cac02_hot_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(f"{_HOPS}, u as (select 'node' as kind, node as id, score from hot_n union all select 'edge', eid, score from hot_e), x as (select *, row_number() over (order by score desc, kind, id) as n from u) select kind, count(*) as n from x where n <= {CAPACITY} group by kind")
def cac03_joint_split(spark: SparkSession, d: str) -> DataFrame:
    return hotset.joint_split(*_hot(spark, d), CAPACITY)


_COUNTS = f"{E}, c as (select (select count(*) from (select src from e union select dst from e)) as n, count(*) as m from e)"


def _sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    e = base.edges(spark, d)
    return etl.nodes_of(e).count(), e.count()


@query(f"{_COUNTS} select least(n, {CAPACITY * 20}) as nodes, least(m, {CAPACITY * 20} - least(n, {CAPACITY * 20})) as edges from c")
def cac04_node_first(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([hotset.node_first_split(*_sizes(spark, d), CAPACITY * 20)], "nodes long, edges long")


@query(f"{_COUNTS} select least(n, {CAPACITY} * n // (n + m)) as nodes, least(m, {CAPACITY} - {CAPACITY} * n // (n + m)) as edges from c")
def cac05_proportional(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([hotset.proportional_split(*_sizes(spark, d), CAPACITY)], "nodes long, edges long")


@query(f"{_COUNTS} select cast(floor((n * 8 / 4.0::double + m) * 0.5::double) as bigint) as capacity from c")
def cac06_capacity(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(hotset.capacity(*_sizes(spark, d), 8, 4, 0.5),)], "capacity long")


@query(f"{_RANKED} select node, place as slot from rk where place < {CAPACITY}")
def cac08_slots(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).filter(F.col("place") < CAPACITY).select("node", F.col("place").alias("slot"))


@query(f"{_RANKED}, hot as (select node from rk where place < {CAPACITY}), b as ({block_sql(K)}), {NF} select batch, root_pos, nbr_pos, b.node, {_elements(8)}, b.node in (select node from hot) as hit from b left join nf on nf.id = b.node")
def cac09_hit_or_miss(spark: SparkSession, d: str) -> DataFrame:
    hot = _ranked(spark, d).filter(F.col("place") < CAPACITY)
    features = base.node_features(spark, d).withColumnRenamed("id", "node")
    found = hotset.hit_or_miss(_block(spark, d), hot, features, "node", "node")
    return _whole(found.withColumn("node", F.struct("node", "hit")), "node", 8).select("*", "node.hit").withColumn("node", F.col("node.node"))


@query(_NODE_GATHER)
def cac07_gather_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the features is kept near, so those of the hot nodes are sent to the rows and only the others' rows move."""
    hot = _ranked(spark, d).filter(F.col("place") < CAPACITY)
    return _whole(hotset.gathered(_block(spark, d), base.node_features(spark, d).withColumnRenamed("id", "node"), "node", "node", 0.1, hot), "node", 8)


@query(_NODE_GATHER)
def cac12_full_gather(spark: SparkSession, d: str) -> DataFrame:
    """All features are sent to every executor if they are small enough, else gathered by key."""
    return _whole(hotset.gathered(_block(spark, d), base.node_features(spark, d), "node", "id", 1.0), "node", 8)


@query(_NODE_GATHER)
def cac10_gather_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _whole(blocks.gather_distinct(_block(spark, d), base.node_features(spark, d), "node", "id"), "node", 8)


# ---- kernels --------------------------------------------------------------------------------------------------------
_DENSE = f"{E}, {base.NODES}, g as (select id, count(eid) as degree from nodes left join e on dst = node group by id)"


def _dense_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = base.edges(spark, d)
    ids = etl.dense_ids(e)
    return kernels.in_degrees(etl.reindexed(e, ids), ids)


@query(f"{_DENSE} select id, degree from g")
def gop01_in_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _dense_degrees(spark, d)


_PTR = f"{_DENSE}, p as (select id, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as ptr from g)"


@query(f"{_PTR} select id, ptr from p union all select count(*), cast(sum(degree) as bigint) from g")
def gop02_exclusive_sum(spark: SparkSession, d: str) -> DataFrame:
    return etl.indptr(_dense_degrees(spark, d))


@query(f"{_PTR}, q as (select id, ptr from p union all select count(*), cast(sum(degree) as bigint) from g) select id, cast(coalesce(ptr // 1000 > lag(ptr) over (partition by id // 256 order by id) // 1000, false) as integer) as mark from q")
def gop03_balance_marks(spark: SparkSession, d: str) -> DataFrame:
    return kernels.balance_marks(etl.indptr(_dense_degrees(spark, d)), 1000)


@query(f"{_B}, c as (select batch, node as root_pos, count(*) as n from b group by all) select batch, root_pos, n, cast(sum(n) over (partition by batch order by root_pos) - n as bigint) as start, cast(sum(n) over (partition by batch order by root_pos) as bigint) as stop from c")
def gop04_pointers_by_target(spark: SparkSession, d: str) -> DataFrame:
    return blocks.row_pointers(_block(spark, d).select("batch", F.col("node").alias("root_pos")))


_NODE_SUM = f"{_B}, {NF}, x as (select batch, root_pos, f from b join nf on nf.id = b.node) select batch, root_pos, cast(p - 1 as integer) as pos, round(sum(cast(f[p] as double)), 6) + 0.0 as value from x, (select unnest(range(1, 9)) as p) group by all"


@query(_NODE_SUM)
def gop05_scatter_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.gather(_block(spark, d), base.node_features(spark, d), "node", "id")
    return kernels.scatter_sum(rows, KEY, "f", 8).withColumn("value", F.round("value", 6))


@query(f"{_B}, {NF}, x as (select node, f from b join nf on nf.id = b.node) select node, cast(p - 1 as integer) as pos, round(sum(cast(f[p] as double)), 6) + 0.0 as value from x, (select unnest(range(1, 9)) as p) group by all")
def gop06_segment_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums by neighbour instead of root: the other direction of the block."""
    rows = blocks.gather(_block(spark, d), base.node_features(spark, d), "node", "id")
    return kernels.scatter_sum(rows, ["node"], "f", 8).withColumn("value", F.round("value", 6))


_SCORES = f"{_B}, {NF}, x as (select batch, root_pos, nbr_pos, cast(f[1] as double) as x, cast(f[2] as double) as dy from b join nf on nf.id = b.node), y as (select *, exp(x - max(x) over (partition by batch, root_pos)) as e from x), z as (select *, e / sum(e) over (partition by batch, root_pos) as y from y)"


def _softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.gather(_block(spark, d), base.node_features(spark, d), "node", "id")
    return kernels.edge_softmax(rows.select(*KEY, "nbr_pos", F.col("f")[0].cast("double").alias("x"), F.col("f")[1].cast("double").alias("dy")), KEY, "x")


@query(f"{_SCORES} select batch, root_pos, nbr_pos, round(y, 6) as y from z")
def gop07_edge_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _softmax(spark, d).select(*KEY, "nbr_pos", F.round("y", 6).alias("y"))


@query(f"{_SCORES} select batch, root_pos, nbr_pos, round(y * (dy - sum(y * dy) over (partition by batch, root_pos)), 6) + 0.0 as dx from z")
def gop08_softmax_gradient(spark: SparkSession, d: str) -> DataFrame:
    return kernels.edge_softmax_gradient(_softmax(spark, d), KEY, "y", "dy").select(*KEY, "nbr_pos", (F.round("dx", 6) + F.lit(0.0)).alias("dx"))


def lin(x: str, width: int, seed: int, bias: bool = True) -> str:
    """linear() in SQL."""
    b = f" + {weight_sql('r', '40', seed)}" if bias else ""
    return f"list_transform(range(0, {width}), lambda r: list_sum(list_transform(range(0, len({x})), lambda c: {x}[c + 1] * {weight_sql('r', 'c', seed)})){b})"


def te(t: str, width: int) -> str:
    return f"list_transform(range(0, {width}), lambda j: cos({t} * pow(10.0::double, -9.0::double * j / {width - 1})))"


def zs(f: str, width: int) -> str:
    return f"coalesce(list_transform({f}, lambda x: x::double), list_transform(range(0, {width}), lambda x: 0.0::double))"


_OUT = 8
_QKV = f"""{_B}, {NF}, {EF},
x as (select b.*, {zs('a.f', 8)} as own, {zs('n.f', 8)} as nbr, {zs('ef.f', 4)} as ed from b left join nf a on a.id = b.root left join nf n on n.id = b.node left join ef on ef.eid = b.eid),
y as (select *, list_concat(own, {te('0.0::double', 4)}) as qi, list_concat(list_concat(nbr, ed), {te('dt::double', 4)}) as ki from x),
p as (select batch, root_pos, nbr_pos, own, {lin('qi', _OUT, 1)} as q, {lin('ki', _OUT, 2)} as k, {lin('ki', _OUT, 3)} as v from y)"""
_ATT = f"""{_QKV}, s as (select p.*, h, list_dot_product(q[h * 4 + 1 : h * 4 + 4], k[h * 4 + 1 : h * 4 + 4]) as raw from p, (select unnest(range(0, 2)) as h)),
l as (select *, case when raw > 0 then raw else raw * 0.2::double end as sc from s), m as (select *, exp(sc - max(sc) over (partition by batch, root_pos, h)) as ex from l), a as (select *, ex / sum(ex) over (partition by batch, root_pos, h) as att from m),
o as (select batch, root_pos, cast(h as integer) as head, cast(i as integer) as pos, sum(att * v[h * 4 + i + 1]) as value from a, (select unnest(range(0, 4)) as i) group by all)"""


_LAYER = layers.Layer(8, 4, 4, 2, _OUT)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    nf, ef = base.node_features(spark, d), base.edge_features(spark, d)
    x = blocks.gather(_block(spark, d), nf, "node", "id").withColumnRenamed("f", "_n")
    x = blocks.gather(x, nf, "root", "id").withColumnRenamed("f", "_r")
    x = blocks.gather(x, ef, "eid", "eid")
    return x.select(*KEY, "nbr_pos", "dt", nn.or_zeros(F.col("_r"), 8).alias("own"), nn.or_zeros(F.col("_n"), 8).alias("nbr"), nn.or_zeros(F.col("f"), 4).alias("edge"))


def _root_vectors(spark: SparkSession, d: str) -> DataFrame:
    r = base.queries(spark, d)
    return r.join(base.node_features(spark, d).withColumnRenamed("id", "node"), "node", "left").select(*KEY, "role", "edge_pos", "node", "t", nn.or_zeros(F.col("f"), 8).alias("own"))


@query(f"{_ATT} select batch, root_pos, head, pos, round(value, 6) + 0.0 as value from o")
def gop11_fused_attention(spark: SparkSession, d: str) -> DataFrame:
    return nn.attention(_rows(spark, d), KEY, _LAYER).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(f"""{_ATT}, msg as (select batch, root_pos, nbr_pos, cast(h * 4 + i as integer) as pos, round(att * v[h * 4 + i + 1], 6) + 0.0 as value from a, (select unnest(range(0, 4)) as i))
select * from msg union all select distinct batch, root_pos, cast(-1 as integer), cast(p as integer), 0.0::double from b, (select unnest(range(0, 8)) as p)""")
def gop12_weighted_values(spark: SparkSession, d: str) -> DataFrame:
    """What attention sums up: attention times v for each neighbour, and zeros for the root."""
    return _positions(nn.messages(_rows(spark, d), KEY, _LAYER), [*KEY, "nbr_pos"], "m").withColumn("value", F.col("value") + F.lit(0.0))


@query("select id, count(*) as n_rows from node_feat where len(list_filter(f, lambda x: isnan(x))) > 0 group by id")
def gop15_nan_rows(spark: SparkSession, d: str) -> DataFrame:
    return kernels.nan_rows(table(spark, d, "node_feat"), "f").groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- model expressions ----------------------------------------------------------------------------------------------
@query(f"{_B}, y as (select batch, root_pos, nbr_pos, {te('dt::double', 8)} as v from b) select batch, root_pos, nbr_pos, cast(p as integer) as pos, round(v[p + 1], 6) + 0.0 as value from y, (select unnest(range(0, 8)) as p)")
def nn01_time_encoding(spark: SparkSession, d: str) -> DataFrame:
    b = _block(spark, d).withColumn("v", V.time_encoding(F.col("dt").cast("double"), 8))
    return _positions(b, [*KEY, "nbr_pos"], "v").withColumn("value", F.col("value") + F.lit(0.0))


_P4 = "(select unnest(range(0, 4)) as p)"
_P8 = "(select unnest(range(0, 8)) as p)"


@query(f"{NF}, y as (select id, {lin(zs('f', 8), 4, 1)} as v from nf) select id, cast(p as integer) as pos, round(v[p + 1], 6) + 0.0 as value from y, {_P4}")
def nn02_linear(spark: SparkSession, d: str) -> DataFrame:
    x = base.node_features(spark, d).withColumn("v", V.linear(nn.or_zeros(F.col("f"), 8), 4, 1))
    return _positions(x, ["id"], "v").withColumn("value", F.col("value") + F.lit(0.0))


@query(f"{_QKV} select batch, root_pos, nbr_pos, cast(i as integer) as pos, round(q[i + 1], 6) + 0.0 as q, round(k[i + 1], 6) + 0.0 as k, round(v[i + 1], 6) + 0.0 as v from p, (select unnest(range(0, 8)) as i)")
def nn03_projections(spark: SparkSession, d: str) -> DataFrame:
    p = nn.projections(_rows(spark, d), _LAYER)
    z = p.select(*KEY, "nbr_pos", F.posexplode(F.arrays_zip("q", "k", "v")).alias("pos", "z"))
    return z.select(*KEY, "nbr_pos", "pos", *((F.round(f"z.{c}", 6) + F.lit(0.0)).alias(c) for c in "qkv"))


@query(f"{_QKV}, w as (select batch, root_pos, nbr_pos, list_transform(list_zip(list_zip({lin('nbr', 4, 14)}, {lin('ed', 4, 15, False)}), {lin(te('dt::double', 4), 4, 16, False)}), lambda z: z[1][1] + z[1][2] + z[2]) as v from y) select batch, root_pos, nbr_pos, cast(p as integer) as pos, round(v[p + 1], 6) + 0.0 as value from w, {_P4}")
def nn04_split_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("te", V.time_encoding(F.col("dt").cast("double"), 4))
    return _positions(nn.split_projection(rows, {"nbr": 8, "edge": 4, "te": 4}, 4, [14, 15, 16], "v"), [*KEY, "nbr_pos"], "v").withColumn("value", F.col("value") + F.lit(0.0))


@query(f"{_ATT} select batch, root_pos, nbr_pos, cast(h as integer) as head, round(sc, 6) + 0.0 as score from l")
def nn05_attention_score(spark: SparkSession, d: str) -> DataFrame:
    p = nn.projections(_rows(spark, d), _LAYER).withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(1))))
    part = lambda c: F.slice(c, F.col("head") * 4 + 1, F.lit(4))
    return p.select(*KEY, "nbr_pos", "head", (F.round(V.leaky_relu(V.dot(part(F.col("q")), part(F.col("k")))), 6) + F.lit(0.0)).alias("score"))


@query(f"{_ATT} select batch, root_pos, cast(head * 4 + pos as integer) as pos, round(value, 6) + 0.0 as value from o")
def nn06_attention_output(spark: SparkSession, d: str) -> DataFrame:
    agg = nn.attention(_rows(spark, d), KEY, _LAYER)
    return agg.select(*KEY, (F.col("head") * 4 + F.col("pos")).cast("int").alias("pos"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


def norm(x: str) -> str:
    """layer_norm() in SQL; x must be a column."""
    return f"list_transform({x}, lambda e: (e - list_sum({x}) / len({x})) / sqrt(list_sum(list_transform({x}, lambda g: (g - list_sum({x}) / len({x})) * (g - list_sum({x}) / len({x})))) / len({x}) + 1e-5::double))"


@query(f"""{_ATT}, agg as (select batch, root_pos, list(value order by head, pos) as agg from o group by all), rv as (select r.batch, r.root_pos, {zs('f', 8)} as own from r left join nf on nf.id = r.node),
h0 as (select batch, root_pos, list_concat(coalesce(agg, {zs('null::double[]', 8)}), own) as z from rv left join agg using (batch, root_pos)), h1 as (select batch, root_pos, list_transform({lin('z', 8, 4)}, lambda e: greatest(e, 0.0)) as x from h0), h2 as (select batch, root_pos, {norm('x')} as v from h1)
select batch, root_pos, cast(p as integer) as pos, round(v[p + 1], 5) + 0.0 as value from h2, {_P8}""")
def nn07_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """One attention layer with its output head for every root: also the model's forward pass and export of embeddings."""
    h = nn.attention_layer(_rows(spark, d), _root_vectors(spark, d).select(*KEY, "own"), KEY, _LAYER)
    return h.select(*KEY, F.posexplode("h").alias("pos", "v")).select(*KEY, "pos", (F.round("v", 5) + F.lit(0.0)).alias("value"))


@query(f"{_ATT}, g as (select batch, root_pos, list(value order by head, pos) as agg from o group by all), z as (select batch, root_pos, {zs('agg', 8)} as v from r left join g using (batch, root_pos)) select batch, root_pos, cast(p as integer) as pos, round(v[p + 1], 6) + 0.0 as value from z, {_P8}")
def nn09_no_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The aggregate of every root, by default zeros where it has no neighbours."""
    agg = nn.attention(_rows(spark, d), KEY, _LAYER).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("head", "pos", "value"))).alias("_a"))
    full = nn.default_zeros(base.queries(spark, d).select(*KEY), agg.select(*KEY, F.transform("_a", lambda x: x["value"]).alias("agg")), KEY, "agg", 8)
    return _positions(full, KEY, "agg").withColumn("value", F.col("value") + F.lit(0.0))


@query(f"{NF}, x as (select id, {zs('f', 8)} as x from nf), y as (select id, {norm('x')} as v from x) select id, cast(p as integer) as pos, round(v[p + 1], 5) + 0.0 as value from y, {_P8}")
def nn10_identity_layer(spark: SparkSession, d: str) -> DataFrame:
    x = base.node_features(spark, d).withColumn("v", V.layer_norm(nn.or_zeros(F.col("f"), 8)))
    return x.select("id", F.posexplode("v").alias("pos", "v")).select("id", "pos", (F.round("v", 5) + F.lit(0.0)).alias("value"))


@query(f"{R}, {NF}, x as (select batch, root_pos, {zs('f', 8)} as h, (t - 20000000.0::double) / (t + 1) as dd from r left join nf on nf.id = r.node) select batch, root_pos, cast(p as integer) as pos, round(h[p + 1] * (1.0 + dd * {weight_sql('p', '0', 6)} + {weight_sql('p', '40', 6)}), 6) + 0.0 as value from x, {_P8}")
def nn11_time_decay(spark: SparkSession, d: str) -> DataFrame:
    x = _root_vectors(spark, d).withColumn("v", nn.time_decay(F.col("own"), F.col("t"), F.lit(20000000.0)))
    return _positions(x, KEY, "v").withColumn("value", F.col("value") + F.lit(0.0))


_C3 = "list_transform(range(0, 4), lambda r: list_sum(list_transform(range(0, 4), lambda c: {x}[c + 1] * " + weight_sql("r", "c", 7) + ")) + " + weight_sql("r", "40", 7) + ")"
_U = "list_transform(range(0, 4), lambda r: list_sum(list_transform(range(0, 4), lambda c: {h}[c + 1] * " + weight_sql("r", "c", 8) + ")))"


def _step(x: str, h: str) -> str:
    return f"list_transform(list_zip({_C3.format(x=x)}, {_U.format(h=h)}), lambda z: tanh(z[1] + z[2]))"


@query(f"""{NF}, x as (select id, list_transform(f[1:4], lambda e: e::double) as x0, list_transform(f[5:8], lambda e: e::double) as x1 from nf), h1 as (select id, x1, {_step('x0', 'list_transform(range(0, 4), lambda e: 0.0::double)')} as h from x), h2 as (select id, {_step('x1', 'h')} as v from h1)
select id, cast(p as integer) as pos, round(v[p + 1], 6) + 0.0 as value from h2, {_P4}""")
def nn12_snapshot_combiner(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots a node, the halves of its vector, the older first."""
    f = base.node_features(spark, d)
    two = F.array(F.struct(F.lit(1).alias("snap"), F.slice("f", 1, 4).alias("x")), F.struct(F.lit(0).alias("snap"), F.slice("f", 5, 4).alias("x")))
    rows = f.select("id", F.explode(two).alias("s")).select("id", "s.snap", F.transform("s.x", lambda e: e.cast("double")).alias("x"))
    return _positions(nn.combine_snapshots(rows, ["id"], "snap", "x", 4), ["id"], "h").withColumn("value", F.col("value") + F.lit(0.0))


_ENDS = f"{R}, {NF}, x as (select batch, edge_pos, role, {zs('f', 8)} as h from r left join nf on nf.id = r.node), y as (select batch, edge_pos, max(h) filter (role = 'src') as s, max(h) filter (role = 'dst') as d, max(h) filter (role = 'neg') as n from x group by all)"


def _hidden(end: str) -> str:
    return f"list_transform(list_zip({lin('s', 4, 9)}, {lin(end, 4, 10)}), lambda z: greatest(z[1] + z[2], 0.0))"


def _edge_score(hid: str) -> str:
    return f"list_sum(list_transform(range(0, 4), lambda c: {hid}[c + 1] * {weight_sql('0', 'c', 11)})) + {weight_sql('0', '40', 11)}"


_EDGE = f"{_ENDS}, z as (select batch, edge_pos, s is not null and d is not null as has_d, s is not null and n is not null as has_n, {_hidden('d')} as hd, {_hidden('n')} as hn from y), sc as (select batch, edge_pos, case when has_d then {_edge_score('hd')} end as pos_score, case when has_n then {_edge_score('hn')} end as neg_score from z)"


def _edge_scores(spark: SparkSession, d: str) -> DataFrame:
    return nn.edge_scores(_root_vectors(spark, d).withColumn("h", F.col("own")), ["batch", "edge_pos"], 8, 4)


@query(f"{_EDGE} select batch, edge_pos, round(pos_score, 6) + 0.0 as pos_score, round(neg_score, 6) + 0.0 as neg_score from sc")
def nn13_edge_predictor(spark: SparkSession, d: str) -> DataFrame:
    return _edge_scores(spark, d).select("batch", "edge_pos", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("pos_score", "neg_score")))


@query(f"{NF}, h as (select id, list_transform({lin(zs('f', 8), 4, 12)}, lambda e: greatest(e, 0.0)) as h from nf), y as (select id, {lin('h', 2, 13)} as v from h) select id, round(v[1], 6) + 0.0 as logit_0, round(v[2], 6) + 0.0 as logit_1 from y")
def nn16_classifier(spark: SparkSession, d: str) -> DataFrame:
    x = base.node_features(spark, d).withColumn("v", nn.classifier(nn.or_zeros(F.col("f"), 8), 4, 2))
    return x.select("id", *((F.round(F.col("v")[i], 6) + F.lit(0.0)).alias(f"logit_{i}") for i in (0, 1)))


_LOSS = f"{S}, l as (select batch, label, greatest(case when label = 1 then -score else score end, 0.0) + ln(1 + exp(-abs(score))) as l from s), lb as (select batch, avg(l) filter (label = 1) + avg(l) filter (label = 0) as loss from l where label in (0, 1) group by batch)"


@query(f"{_LOSS} select batch, round(loss, 6) as loss from lb")
def nn17_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.losses(base.scored(spark, d)).withColumn("loss", F.round("loss", 6))


# ---- memory ---------------------------------------------------------------------------------------------------------
NODE_WIDTH, EDGE_WIDTH, TIME_WIDTH = 8, 4, 4
MAIL = 2 * NODE_WIDTH + EDGE_WIDTH
SINCE = 20_000_000
_MAILS = f"""{E}, {ORDERED}, {NF}, {EF}, eb as (select row_id // {BATCH} as batch, row_id % {BATCH} as edge_pos, eid, src, dst, t from o),
ml as (select batch, edge_pos, t, src, dst, {zs('a.f', 8)} as s, {zs('c.f', 8)} as d, {zs('ef.f', 4)} as w from eb left join nf a on a.id = src left join nf c on c.id = dst left join ef on ef.eid = eb.eid),
mails as (select batch, edge_pos * 2 as pos, src as node, t, list_concat(list_concat(s, d), w) as mail from ml union all select batch, edge_pos * 2 + 1, dst, t, list_concat(list_concat(d, s), w) from ml),
lasts as (select * from (select *, row_number() over (partition by batch, node order by pos desc) as n from mails) where n = 1)"""
_M = ", ".join(f"round(mail[{i + 1}], 6) + 0.0 as m{i}" for i in range(MAIL))


def _edge_batches(spark: SparkSession, d: str) -> DataFrame:
    return models.numbered(base.edges(spark, d), BATCH)


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """Mails without their vectors; those that are kept get them by _filled."""
    return memory.mail_rows(_edge_batches(spark, d))


def _node_memory(spark: SparkSession, d: str) -> DataFrame:
    return base.node_features(spark, d).select(F.col("id").alias("node"), "f")


def _filled(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return memory.with_mails(rows, _node_memory(spark, d), base.edge_features(spark, d), NODE_WIDTH, EDGE_WIDTH)


def _flat(df: DataFrame, by: list[str], width: int = MAIL) -> DataFrame:
    return df.select(*by, *((F.round(F.col("mail")[i], 6) + F.lit(0.0)).alias(f"m{i}") for i in range(width)))


@query(f"{_MAILS}, n as (select src as node from e union select dst from e union select id from nf) select n.node, coalesce(max(l.t), 0) as mem_t, coalesce(max(l.batch), -1) as batch from n left join lasts l on l.node = n.node group by n.node")
def mem01_initial_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of every node: of those that were never written to, the initial one."""
    nodes = etl.nodes_of(base.edges(spark, d)).unionByName(_node_memory(spark, d).select("node")).distinct()
    last = _mails(spark, d).groupBy("node").agg(F.max("t").alias("mem_t"), F.max("batch").alias("batch"))
    return memory.state_of(nodes, last, {"mem_t": "0L", "batch": "-1L"})


@query(f"{_MAILS}, q as (select distinct batch, node from mails) select q.batch, q.node, (select max(l.batch) from lasts l where l.node = q.node and l.batch < q.batch) as written_in from q")
def mem02_state_read(spark: SparkSession, d: str) -> DataFrame:
    """The batch whose state each (batch, node) sees."""
    m = _mails(spark, d)
    writes = memory.last_per_batch(m).withColumn("written_in", F.col("batch"))
    return memory.state_before(writes, m.select("batch", "node").distinct().withColumn("k", F.lit(1)), ["k"], ["written_in"]).select("batch", "node", "written_in")


@query(f"{_MAILS} select q.batch, q.pos, q.node, l.batch as written_in, l.pos as written_by from mails q asof left join lasts l on q.node = l.node and q.batch > l.batch")
def mem03_distinct_read(spark: SparkSession, d: str) -> DataFrame:
    """What every occurrence of a node sees, each node of a batch read once."""
    m = _mails(spark, d)
    writes = memory.last_per_batch(m).withColumns({"written_in": F.col("batch"), "written_by": F.col("pos")})
    return memory.state_before_distinct(writes, m.select("batch", "pos", "node"), ["written_in", "written_by"]).select("batch", "pos", "node", "written_in", "written_by")


@query(f"{_MAILS} select batch, node, pos, t as mem_t from lasts")
def mem04_memory_write(spark: SparkSession, d: str) -> DataFrame:
    return memory.last_per_batch(_mails(spark, d).select("batch", "node", "pos", "t")).select("batch", "node", "pos", F.col("t").alias("mem_t"))


@query(f"{_MAILS} select batch, pos, node, t, {_M} from mails")
def mem05_build_mails(spark: SparkSession, d: str) -> DataFrame:
    mails = memory.build_mails(_edge_batches(spark, d), _node_memory(spark, d), base.edge_features(spark, d), NODE_WIDTH, EDGE_WIDTH)
    return _flat(mails, ["batch", "pos", "node", "t"])


@query(f"{_MAILS} select batch, node, pos, t, {_M} from lasts")
def mem06_last_mail(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_filled(spark, d, memory.last_per_batch(_mails(spark, d))), ["batch", "node", "pos", "t"])


_RING = f"{_MAILS}, sl as (select *, cast((dense_rank() over (partition by node order by batch) - 1) % {SLOTS} as integer) as slot, row_number() over (partition by node order by batch desc) as age from lasts)"


def _ring(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d, memory.mailbox(memory.last_per_batch(_mails(spark, d)), SLOTS))


@query(f"{_RING} select node, slot, batch, t, {_M} from sl where age <= {SLOTS}")
def mem07_ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_ring(spark, d), ["node", "slot", "batch", "t"])


@query(f"{_RING} select node, count(*) % {SLOTS} as next_pos from sl group by node")
def mem10_next_slot(spark: SparkSession, d: str) -> DataFrame:
    return memory.next_slots(memory.last_per_batch(_mails(spark, d)), SLOTS)


@query(f"{_RING} select node, slot, batch as since, lead(batch) over (partition by node, slot order by batch) as until, pos from sl")
def mem11_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """For each mail its slot and the batches between which it stands there: what was staged in a batch and put in place after it."""
    _, placed = memory.two_phase(_mails(spark, d), SLOTS)
    return placed.select("node", "slot", "since", "until", "pos")


@query()
def mem11_fold_batches(spark: SparkSession, d: str) -> DataFrame:
    """Memory and mailbox after all edges, batch by batch, each reading what the one before wrote."""
    state = memory.state_at_end(_edge_batches(spark, d), base.edge_features(spark, d), MemorySettings(), NODE_WIDTH, EDGE_WIDTH, TIME_WIDTH)
    return state.select("node", "mem_t", F.col("mail_t")[0].alias("mail_t"), *(F.round(F.col("mem")[i], 6).alias(f"m{i}") for i in range(NODE_WIDTH)))


def _sent(spark: SparkSession, d: str) -> DataFrame:
    """Mails of the roots of the given batches, their node features, to their neighbours."""
    v = _root_vectors(spark, d).select("batch", F.col("root_pos").alias("pos"), "node", "t", F.col("own").alias("mail"))
    return memory.delivered(v, _block(spark, d))


_SENT = f"{_B}, {NF}, m as (select batch, root_pos as pos, r.node, t, {zs('f', 8)} as mail from r left join nf on nf.id = r.node), sent as (select batch, node, pos, t, mail, 0 as via, -1 as nbr_pos from m union all select b.batch, b.node, m.pos, m.t, m.mail, 1, b.nbr_pos from b join m on m.batch = b.batch and m.pos = b.root_pos)"
_M8 = ", ".join(f"round(mail[{i + 1}], 6) + 0.0 as m{i}" for i in range(NODE_WIDTH))


@query(f"{_SENT} select batch, node, pos, t, cast(via as integer) as via, {_M8} from (select *, row_number() over (partition by batch, node order by pos desc, via desc, nbr_pos desc) as n from sent) where n = 1")
def mem08_deliver_last(spark: SparkSession, d: str) -> DataFrame:
    return _flat(memory.last_delivered(_sent(spark, d)), ["batch", "node", "pos", "t", "via"], NODE_WIDTH)


@query(f"{_SENT} select batch, node, cast(p - 1 as integer) as pos, round(avg(mail[p]), 6) + 0.0 as value from sent, (select unnest(range(1, {NODE_WIDTH + 1})) as p) group by all")
def mem09_deliver_mean(spark: SparkSession, d: str) -> DataFrame:
    return memory.mean_delivered(_sent(spark, d), NODE_WIDTH).withColumn("value", F.round("value", 6) + F.lit(0.0))


def _updates(spark: SparkSession, d: str, settings: MemorySettings) -> DataFrame:
    """New memories from the last mail of each node and batch (one slot) or the ring of each node, with the node's features as old memory."""
    if settings.slots == 1:
        m = _filled(spark, d, memory.last_per_batch(_mails(spark, d))).select("node", "batch", "t", F.array("mail").alias("mails"), F.array("t").alias("mail_t"))
    else:
        full = _ring(spark, d).groupBy("node").agg(F.max("batch").alias("batch"), F.max("t").alias("t"), F.sort_array(F.collect_list(F.struct("slot", "mail", F.col("t").alias("mt")))).alias("_s"))
        m = full.select("node", "batch", "t", F.transform("_s", lambda x: x["mail"]).alias("mails"), F.transform("_s", lambda x: x["mt"]).alias("mail_t"))
    state = _node_memory(spark, d).select("node", F.transform("f", lambda x: x.cast("double")).alias("mem"))
    reads = m.join(state, "node", "left").withColumn("mem_t", F.lit(SINCE).cast("long"))
    return _positions(memory.updated(reads, settings, NODE_WIDTH, MAIL, TIME_WIDTH), ["node", "batch"], "mem").withColumn("value", F.col("value") + F.lit(0.0))


_CELL = f"{_MAILS}, c0 as (select l.node, l.batch, list_concat(mail, {te(f'(l.t - {SINCE})::double', TIME_WIDTH)}) as x, {zs('nf.f', 8)} as h from lasts l left join nf on nf.id = l.node)"
_CELL_OUT = "select node, batch, cast(p as integer) as pos, round(v[p + 1], 6) + 0.0 as value from {}, " + _P8


def _mat(x: str, seed: int) -> str:
    return lin(x, NODE_WIDTH, seed)


_GRU = f"""{_CELL}, c1 as (select node, batch, h, {_mat('x', 20)} as xr, {_mat('x', 21)} as xz, {_mat('x', 22)} as xn, {_mat('h', 23)} as hr, {_mat('h', 24)} as hz, {_mat('h', 25)} as hn from c0),
c2 as (select node, batch, h, xn, hn, list_transform(range(1, 9), lambda i: 1 / (1 + exp(-(xr[i] + hr[i])))) as r, list_transform(range(1, 9), lambda i: 1 / (1 + exp(-(xz[i] + hz[i])))) as z from c1),
c3 as (select node, batch, list_transform(range(1, 9), lambda i: (1 - z[i]) * tanh(xn[i] + r[i] * hn[i]) + z[i] * h[i]) as v from c2) {_CELL_OUT.format('c3')}"""
_TRANSFORMER = f"""{_RING}, last as (select node, max(batch) as batch, max(t) as t from sl where age <= {SLOTS} group by node),
u as (select last.node, last.batch, s.slot, list_concat(coalesce(mail, list_transform(range(0, {MAIL}), lambda i: 0.0::double)), {te('(last.t - coalesce(sl.t, 0))::double', TIME_WIDTH)}) as x, {zs('nf.f', 8)} as h
  from last cross join (select unnest(range(0, {SLOTS})) as slot) s left join sl on sl.node = last.node and sl.slot = s.slot and sl.age <= {SLOTS} left join nf on nf.id = last.node),
w as (select node, batch, slot, h, {_mat('h', 40)} as q, {_mat('x', 41)} as k, {_mat('x', 42)} as v from u),
s0 as (select w.*, i as head, list_dot_product(q[i * 4 + 1 : i * 4 + 4], k[i * 4 + 1 : i * 4 + 4]) as raw from w, (select unnest(range(0, 2)) as i)),
s1 as (select *, exp(case when raw > 0 then raw else 0.2::double * raw end) as ex from s0), s2 as (select *, ex / sum(ex) over (partition by node, head) as a from s1),
s3 as (select node, batch, head * 4 + i as p, sum(a * v[head * 4 + i + 1]) + any_value(h[head * 4 + i + 1]) as y from s2, (select unnest(range(0, 4)) as i) group by node, batch, head, i),
s4 as (select node, batch, list(y order by p) as x from s3 group by node, batch), s5 as (select node, batch, {norm('x')} as x from s4), s6 as (select node, batch, list_transform({_mat('x', 43)}, lambda e: greatest(e, 0.0)) as v from s5) {_CELL_OUT.format('s6')}"""


@query(_GRU)
def mem12_gru_updater(spark: SparkSession, d: str) -> DataFrame:
    return _updates(spark, d, MemorySettings())


@query(f"{_CELL}, c1 as (select node, batch, {_mat('x', 30)} as a, {_mat('h', 31)} as b from c0), c2 as (select node, batch, list_transform(range(1, 9), lambda i: tanh(a[i] + b[i])) as v from c1) {_CELL_OUT.format('c2')}")
def mem13_rnn_updater(spark: SparkSession, d: str) -> DataFrame:
    return _updates(spark, d, MemorySettings(updater="rnn"))


@query(_TRANSFORMER)
def mem14_transformer_updater(spark: SparkSession, d: str) -> DataFrame:
    return _updates(spark, d, MemorySettings("neighbors", "last", SLOTS, "transformer"))


# ---- metrics and topology -------------------------------------------------------------------------------------------
_AP = f"{S}, g as (select batch, score, count(*) filter (label = 1) as p, count(*) filter (label <> 1) as n from s group by all), c as (select *, sum(p) over (partition by batch order by score desc) as tp, sum(p + n) over (partition by batch order by score desc) as al, sum(p) over (partition by batch) as tot from g), apb as (select batch, sum(p / tot::double * (tp / al::double)) filter (tot > 0) as ap from c group by batch)"
_AUC = f"{S}, k as (select batch, label, rank() over (partition by batch order by score) + (count(*) over (partition by batch, score) - 1) / 2.0::double as rk from s), a as (select batch, count(*) filter (label = 1) as p, count(*) filter (label <> 1) as n, sum(rk) filter (label = 1) as rs from k group by batch), aucb as (select batch, case when p > 0 and n > 0 then (rs - p * (p + 1) / 2.0::double) / (p * n) end as auc from a)"
_RR = f"{S}, top as (select batch, edge_pos, max(score) as ps from s where label = 1 group by all), rr as (select top.batch, top.edge_pos, 1.0::double / (1 + count(s.score)) as rr from top left join s on s.batch = top.batch and s.edge_pos = top.edge_pos and s.label = 0 and s.score > ps group by all)"


# Without the table of scores, for those of a model in its place.
AP_SQL, AUC_SQL, RR_SQL, LOSS_SQL = (x.replace(S + ", ", "") for x in (_AP, _AUC, _RR, _LOSS))


@query(f"{_AP} select batch, round(ap, 6) as ap from apb")
def met01_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(base.scored(spark, d)).withColumn("ap", F.round("ap", 6))


@query(f"{_AUC} select batch, round(auc, 6) as auc from aucb")
def met02_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(base.scored(spark, d)).withColumn("auc", F.round("auc", 6))


@query(f"{_RR} select batch, edge_pos, round(rr, 6) as rr from rr")
def met03_reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reciprocal_ranks(base.scored(spark, d)).withColumn("rr", F.round("rr", 6))


@query(f"{_AP}, {_AUC.replace(S + ', ', '')}, {_RR.replace(S + ', ', '')}, {_LOSS.replace(S + ', ', '')} select round(avg(ap), 6) as ap, round(avg(auc), 6) as auc, round((select avg(rr) from rr), 6) as mrr from apb join aucb using (batch)")
def met04_means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(base.scored(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("ap", "auc", "mrr")))


@query(f"{_LOSS} select round(sum(loss), 5) as total_loss, count(*) as n_batches from lb")
def met05_total_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.losses(base.scored(spark, d)).agg(F.round(F.sum("loss"), 5).alias("total_loss"), F.count(F.lit(1)).alias("n_batches"))


@query(f"{_AP} select batch as epoch, round(ap, 6) as ap from apb where batch >= 3 order by apb.ap desc, batch limit 1")
def met06_best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Batches stand for epochs."""
    per = metrics.average_precision(base.scored(spark, d)).withColumnRenamed("batch", "epoch")
    return metrics.best_epoch(per).withColumn("ap", F.round("ap", 6))


@query(f"{NF}, {EF} select (select count(*) from nf) * 8 * 4 as node_bytes, (select count(*) from ef) * 4 * 4 as edge_bytes")
def met08_footprint(spark: SparkSession, d: str) -> DataFrame:
    n, e = base.node_features(spark, d).count(), base.edge_features(spark, d).count()
    return spark.createDataFrame([(metrics.footprint(n, 8), metrics.footprint(e, 4))], "node_bytes long, edge_bytes long")


_SIM = f"{R}, ra as (select batch, node, row_number() over (partition by batch order by root_pos) - 1 as idx, count(*) over (partition by batch) // {PARTS} as len from r), ck as (select batch, node, idx // len as i, idx % len as p from ra where len > 0 and idx < len * {PARTS}), sim as (select a.batch, a.i, b.i as j, count(*) as w from ck a join ck b on a.batch = b.batch and a.p = b.p and a.node = b.node group by all), total as (select i, j, cast(sum(w) as bigint) as w from sim group by i, j)"


def _similarity(spark: SparkSession, d: str) -> DataFrame:
    return topology.chunk_similarity(base.queries(spark, d), PARTS)


@query(f"{_SIM} select batch, cast(i as integer) as i, cast(j as integer) as j, w from sim")
def top01_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _similarity(spark, d)


@query(f"{_SIM} select cast(i as integer) as i, cast(j as integer) as j, w from total")
def top02_accumulated(spark: SparkSession, d: str) -> DataFrame:
    return topology.accumulated(_similarity(spark, d))


@query(f"{_SIM}, ij as (select i, j from (select unnest(range(0, {PARTS})) as i), (select unnest(range(0, {PARTS})) as j)) select cast(ij.i as integer) as i, cast(ij.j as integer) as j, coalesce(w, 0) as w from ij left join total using (i, j)")
def top03_matrix(spark: SparkSession, d: str) -> DataFrame:
    return topology.full_matrix(topology.accumulated(_similarity(spark, d)), PARTS)


_WEIGHTS = f"{_SIM}, pw as (select least(i, j) as a, greatest(i, j) as b, sum(w) as w from total where i <> j group by all), ps as (select x.i as a, y.i as b, coalesce(pw.w, 0) as w from (select unnest(range(0, {PARTS})) as i) x join (select unnest(range(0, {PARTS})) as i) y on x.i < y.i left join pw on pw.a = x.i and pw.b = y.i)"
_BEST = "select cast(max(p1.w + p2.w + p3.w + p4.w) as bigint) as weight, 8 as n_paired from ps p1, ps p2, ps p3, ps p4 where p1.a = 0 and p2.a = (case when p1.b = 1 then 2 else 1 end) and p2.b <> p1.b and p3.a < p3.b and p3.a not in (p1.a, p1.b, p2.a, p2.b) and p3.b not in (p1.a, p1.b, p2.a, p2.b) and p4.a not in (p1.a, p1.b, p2.a, p2.b, p3.a, p3.b) and p4.b not in (p1.a, p1.b, p2.a, p2.b, p3.a, p3.b)"


def _pairing(spark: SparkSession, d: str) -> tuple[dict[tuple[int, int], int], list[int]]:
    """The matrix has parts * parts entries, so it may come to the driver."""
    m = {(r.i, r.j): r.w for r in topology.full_matrix(topology.accumulated(_similarity(spark, d)), PARTS).collect()}
    return m, topology.pairing(m, PARTS)


@query()
def top04_pairing(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_pairing(spark, d)[1])), "part int, partner int")


@query(f"{_WEIGHTS} {_BEST}")
def top04_weight(spark: SparkSession, d: str) -> DataFrame:
    """The weight of the pairing, which is the greatest of all 105 matchings."""
    m, partner = _pairing(spark, d)
    weight = sum(m[i, j] + m[j, i] for i, j in enumerate(partner) if i < j)
    return spark.createDataFrame([(weight, sum(p >= 0 for p in partner))], "weight long, n_paired int")
