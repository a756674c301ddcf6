"""Queries of sources, graph construction, splits, batches, negatives and temporal sampling, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.draws import draw_sql, uniform_sql
from chronoweave.operators import blocks, etl, hotset, sampler
from chronoweave.plans import base
from chronoweave.plans.base import ORDERED, E, R, block_sql
from chronoweave.session import shared_dir, table
from chronoweave.sources import edges as sources
from chronoweave.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BATCH = 600
REORDER = 6
SHIFT = 2
K = 10
KEY = ["batch", "root_pos"]
SNAPSHOTS = 3
DURATION = 100_000
HOT = 200


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "with " + sql if sql[:6] != "select" else sql
        return f

    return register


# ---- sources --------------------------------------------------------------------------------------------------------
@query("select line_id, cast(p[1] as bigint) as src, cast(p[2] as bigint) as dst, cast(p[3] as bigint) as time from (select line_id, string_split_regex(trim(line, ' ' || chr(9) || chr(13)), '[ \\t]+') as p from raw_edges where fmt = 'ws' and line_no > 1) where len(p) = 3 and len(list_filter(p, lambda x: not (regexp_full_match(x, '[0-9]+') and coalesce(try_cast(x as hugeint) <= 2147483647, false)))) = 0")
def src01_text_edges(spark: SparkSession, d: str) -> DataFrame:
    """White-space separated dump lines without their header as edges, where all three are whole numbers up to 2147483647, with leading zeros or not."""
    lines = table(spark, d, "raw_edges").filter("fmt = 'ws' and line_no > 1")
    return sources.parted_edges(lines, "line_id").filter("ok").drop("ok")


@query("select eid, src, dst, time, ext_roll from edges")
def src02_edges_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select("eid", "src", "dst", "time", "ext_roll")


@query(f"{base.NF} select id, cast(pos - 1 as integer) as pos, cast(f[pos] as double) as value from nf, (select unnest(range(1, 9)) as pos)")
def src04_node_features(spark: SparkSession, d: str) -> DataFrame:
    return base.node_features(spark, d).select("id", F.posexplode("f").alias("pos", "v")).select("id", "pos", F.col("v").cast("double").alias("value"))


@query(f"{E}, nodes as (select src as node from e union select dst from e) select node, cast(pos as integer) as pos, {uniform_sql('node', 'pos', 5)} as value from nodes, (select unnest(range(0, 4)) as pos)")
def src05_synthetic_features(spark: SparkSession, d: str) -> DataFrame:
    return etl.synthetic_features(etl.nodes_of(base.edges(spark, d)), "node", 4, 5)


def _stored(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"{E} select row_number() over (order by src, t, eid) - 1 as pos, src, dst, t, eid from e")
def src03_csr_scan(spark: SparkSession, d: str) -> DataFrame:
    """The stored neighbour lists (SNK-02) read again."""
    path = _stored(spark, "csr")
    sinks.write_csr(base.edges(spark, d), path)
    return sources.csr_edges(spark, path)


@query(f"{E} select node, n, row_number() over (order by n desc, node) - 1 as place from (select src as node, count(*) as n from e group by src) order by n desc, node limit {HOT}")
def src07_hot_ids(spark: SparkSession, d: str) -> DataFrame:
    """The stored list of the nodes of most edges (SNK-04) read again."""
    path, e = _stored(spark, "hot"), base.edges(spark, d)
    per = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("score"))
    sinks.write_hot_ids(hotset.ranked(per, per.select("node"), "node"), path, HOT)
    return sources.hot_ids(spark, path).withColumnRenamed("score", "n")


@query("select eid, src, dst, time, ext_roll from edges")
def snk01_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _stored(spark, "csv")
    sinks.write_edges(table(spark, d, "edges").select("eid", "src", "dst", "time", "ext_roll"), path, "csv")
    return sources.csv_edges(spark, path)


# ---- construction ---------------------------------------------------------------------------------------------------
@query(f"{E} select * from e")
def pre01_cast(spark: SparkSession, d: str) -> DataFrame:
    return base.edges(spark, d)


@query(f"{E}, {base.NODES} select eid, a.id as src, b.id as dst from e join nodes a on a.node = src join nodes b on b.node = dst")
def pre02_dense_reindex(spark: SparkSession, d: str) -> DataFrame:
    return etl.reindexed(base.edges(spark, d)).select("eid", "src", "dst")


@query(f"{E} select eid, t - (select min(t) from e) as t from e")
def pre03_time_rebase(spark: SparkSession, d: str) -> DataFrame:
    return etl.rebased(base.edges(spark, d)).select("eid", "t")


@query(f"{E}, {ORDERED} select eid, row_id from o")
def pre04_time_sort(spark: SparkSession, d: str) -> DataFrame:
    return etl.time_sorted(base.edges(spark, d)).select("eid", "row_id")


@query(f"{E}, {ORDERED}, n as (select count(*) as n from o) select eid, cast(case when row_id < floor(n * 0.7::double) then 0 when row_id < floor(n * 0.85::double) then 1 else 2 end as integer) as split from o, n")
def pre05_positional_split(spark: SparkSession, d: str) -> DataFrame:
    return etl.positional_split(etl.time_sorted(base.edges(spark, d))).select("eid", "split")


@query(f"{E} select greatest(max(src), max(dst)) + 1 as n_nodes from e")
def pre06_node_count(spark: SparkSession, d: str) -> DataFrame:
    return etl.node_count(base.edges(spark, d))


@query(f"{E} select row_number() over (order by src, t, eid) - 1 as pos, src, dst, t, eid from e")
def pre07_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """All neighbour lists end to end: pos is the place in them, which the row pointers of pre09 cut by node."""
    return etl.flat_adjacency(base.edges(spark, d)).select("pos", "src", "dst", "t", "eid")


@query(f"{E} select eid, src, dst, t from e union all select eid, dst, src, t from e")
def pre08_reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return etl.with_reverse(base.edges(spark, d)).select("eid", "src", "dst", "t")


@query(f"{E}, {base.NODES}, g as (select id, count(src) as degree from nodes left join e on src = node group by id) select id, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as ptr from g union all select count(*), cast(sum(degree) as bigint) from g")
def pre09_indptr(spark: SparkSession, d: str) -> DataFrame:
    e = base.edges(spark, d)
    return etl.indptr(etl.degrees(e, etl.dense_ids(e)))


@query(f"{E} select src, row_number() over (partition by src order by t, eid) as rk, eid, dst, t from e")
def pre10_node_time_sort(spark: SparkSession, d: str) -> DataFrame:
    return sampler.ranked_edges(base.edges(spark, d))


@query(f"{E} select eid, cast(t as float) as t32 from e")
def pre12_narrow_time(spark: SparkSession, d: str) -> DataFrame:
    return base.edges(spark, d).select("eid", F.col("t").cast("float").alias("t32"))


# ---- splits, batches, roots, negatives ------------------------------------------------------------------------------
@query(f"{E}, {ORDERED} select min(row_id) filter (split > 0) as train_end, min(row_id) filter (split > 1) as val_end from o")
def spl01_split_bounds(spark: SparkSession, d: str) -> DataFrame:
    return etl.split_bounds(etl.time_sorted(base.edges(spark, d)))


@query(f"{E}, {ORDERED}, b as (select min(row_id) filter (split > 0) as te, min(row_id) filter (split > 1) as ve from o) select row_id, eid, cast(case when row_id >= coalesce(ve, row_id + 1) then 2 when row_id >= coalesce(te, row_id + 1) then 1 else 0 end as integer) as slice from o, b")
def spl02_split_slices(spark: SparkSession, d: str) -> DataFrame:
    """Edges in order of time cut at the first of the validation and the first of the test split."""
    return etl.split_slices(etl.time_sorted(base.edges(spark, d))).select("row_id", "eid", "slice")


NEW_SQL = f"{E}, tr as (select src as node from e where split = 0 union select dst from e where split = 0), nn as (select node from (select src as node from e union select dst from e) where node not in (select node from tr)), il as (select * from e where split < 2 union all select * from e where split = 2 and (src in (select node from nn) or dst in (select node from nn)))"


@query(f"{NEW_SQL} select eid, split from il")
def spl03_inductive_links(spark: SparkSession, d: str) -> DataFrame:
    return etl.inductive_links(base.edges(spark, d)).select("eid", "split")


@query(f"{NEW_SQL} select src as node from il where split = 2 union select dst from il where split = 2")
def spl04_inductive_nodes(spark: SparkSession, d: str) -> DataFrame:
    return etl.inductive_nodes(base.edges(spark, d))


@query(f"{E}, {ORDERED} select row_id // {BATCH} as batch, row_id % {BATCH} as edge_pos, eid, t from o")
def bat01_batches(spark: SparkSession, d: str) -> DataFrame:
    return etl.batched(etl.time_sorted(base.edges(spark, d)), BATCH).select("batch", F.pmod("row_id", F.lit(BATCH)).alias("edge_pos"), "eid", "t")


@query(f"{E}, {ORDERED} select cast(floor((row_id - {SHIFT * BATCH // REORDER}) / {BATCH}::double) as bigint) as batch, eid, t from o")
def bat02_shifted_batches(spark: SparkSession, d: str) -> DataFrame:
    return etl.shifted_batches(etl.time_sorted(base.edges(spark, d)), BATCH, REORDER, SHIFT).select("batch", "eid", "t")


_NEG = f"{E}, {base.NODES}, neg as (select eid, node from (select eid, {draw_sql('eid', '0', 42, '(select count(*) from nodes)')} as pick from e) join nodes on id = pick)"


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    e = base.edges(spark, d)
    return etl.negatives(e, etl.dense_ids(e))


@query(f"{_NEG} select eid, 'src' as role, src as node, t from e union all select eid, 'dst', dst, t from e union all select eid, 'neg', node, t from neg join e using (eid)")
def bat03_roots(spark: SparkSession, d: str) -> DataFrame:
    return etl.roots(base.edges(spark, d), _drawn(spark, d)).select("eid", "role", "node", "t")


@query(f"{E} select eid, 'src' as role, src as node, t from e union all select eid, 'dst', dst, t from e")
def bat05_positive_roots(spark: SparkSession, d: str) -> DataFrame:
    return etl.roots(base.edges(spark, d)).select("eid", "role", "node", "t")


@query(f"{_NEG} select eid, node from neg")
def neg01_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d).select("eid", "node")


@query(f"{NEW_SQL}, pool as (select node, row_number() over (order by node) - 1 as id from (select src as node from il where split = 2 union select dst from il where split = 2)), x as (select eid, {draw_sql('eid', '0', 43, '(select count(*) from pool)')} as pick from il where split = 2) select eid, node from x join pool on id = pick")
def neg02_inductive(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.operators.ordering import with_row_ids

    e = base.edges(spark, d)
    pool = with_row_ids(etl.inductive_nodes(e), ["node"], "id")
    return etl.negatives(etl.inductive_links(e).filter("split = 2"), pool, seed=43).select("eid", "node")


_HITS = f"{_NEG}, l as (select distinct id as node from node_feat where id is not null), h as (select count(*) as n_hits from neg where node in (select node from l))"


@query(f"{_HITS} select n_hits, (select count(*) from l) as n_list, n_hits / (select count(*) from l)::double as rate from h")
def neg04_filtered(spark: SparkSession, d: str) -> DataFrame:
    return etl.hits(_drawn(spark, d), table(spark, d, "node_feat").select(F.col("id").alias("node")).filter("node is not null"))


@query(f"{_NEG}, l as (select distinct id as node from node_feat where id is not null), b as (select eid // 1000 as batch, count(*) filter (node in (select node from l)) / count(*)::double as rate from neg group by 1) select round(avg(rate), 9) as mean_rate from b")
def neg05_mean_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "node_feat").select(F.col("id").alias("node"), F.lit(1).alias("hit")).filter("node is not null").distinct()
    per = _drawn(spark, d).join(listed, "node", "left").groupBy(F.floor(F.col("eid") / 1000).alias("batch")).agg((F.count("hit") / F.count(F.lit(1))).alias("rate"))
    return per.agg(F.round(F.avg("rate"), 9).alias("mean_rate"))


# ---- sampling -------------------------------------------------------------------------------------------------------
def _recent(spark: SparkSession, d: str) -> DataFrame:
    return sampler.recent(base.edges(spark, d), base.queries(spark, d), KEY, K)


_STATE = f"{E}, {R}, ranked as (select *, row_number() over (partition by src order by t, eid) as rk from e), q as (select *, max(t) over (partition by node order by batch range unbounded preceding) as top from r), p as (select q.batch, q.root_pos, q.node, q.t, q.top, count(n.eid) as hi from q left join e n on n.src = q.node and n.t <= q.top group by all)"


@query(f"{_STATE} select batch, root_pos, node, top as pointer_time, hi as pos from p")
def smp01_stateful_position(spark: SparkSession, d: str) -> DataFrame:
    return sampler.stateful_position(base.edges(spark, d), base.queries(spark, d), KEY, "batch").select(*KEY, "node", "pointer_time", "pos")


@query(f"{E}, {R} select batch, root_pos, node, q.t, count(n.eid) as pos from r q left join e n on n.src = q.node and n.t < q.t group by batch, root_pos, node, q.t")
def smp02_asof_position(spark: SparkSession, d: str) -> DataFrame:
    return sampler.asof_position(base.edges(spark, d), base.queries(spark, d), KEY)


_WINDOWS = f"{E}, {R}, q as (select r.*, snap from r, (select cast(unnest(range(0, {SNAPSHOTS})) as integer) as snap))"


@query(f"{_WINDOWS} select batch, root_pos, snap, node, q.t, count(n.eid) filter (n.t <= q.t - (snap + 1) * {DURATION}) as lo, count(n.eid) filter (n.t < q.t - snap * {DURATION}) as hi from q left join e n on n.src = q.node and n.t < q.t group by batch, root_pos, snap, node, q.t")
def smp03_window_bounds(spark: SparkSession, d: str) -> DataFrame:
    return sampler.window_positions(base.edges(spark, d), base.queries(spark, d), KEY, SNAPSHOTS, DURATION)


@query(f"{E}, {R} {block_sql(K)}")
def smp05_recent_k(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d)


_RK = "ranked as (select *, row_number() over (partition by src order by t, eid) as rk from e), pos as (select q.batch, q.root_pos, q.node, q.t, count(n.eid) as hi from r q join e n on n.src = q.node and n.t < q.t group by all)"


@query(f"""{E}, {R}, {_RK}, asked as (select *, cast(unnest(range(0, least(hi, 5))) as integer) as nbr_pos from pos),
a as (select *, case when hi < 5 then hi - nbr_pos else 1 + {draw_sql('node + t', 'nbr_pos', 7, 'hi')} end as want from asked)
select a.batch, a.root_pos, cast(0 as integer) as snap, a.node as root, a.t as root_t, nbr_pos, n.dst as node, n.eid, n.t, a.t - n.t as dt from a join ranked n on n.src = a.node and n.rk = want""")
def smp06_uniform_k(spark: SparkSession, d: str) -> DataFrame:
    return sampler.uniform(base.edges(spark, d), base.queries(spark, d), KEY, 5)


@query(f"{E}, {R}, b as ({block_sql(3)}), n as (select batch, root_pos from b group by all having count(*) < 3) select b.* from b join n using (batch, root_pos)")
def smp07_small_windows(spark: SparkSession, d: str) -> DataFrame:
    """Roots with fewer than k edges give all of them."""
    b = sampler.recent(base.edges(spark, d), base.queries(spark, d), KEY, 3)
    few = b.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n < 3").select(*KEY)
    return b.join(few, KEY, "left_semi")


@query(f"{_STATE} select p.batch, p.root_pos, p.node as root, p.t as root_t, cast(hi - n.rk as integer) as nbr_pos, n.dst as node, n.eid, n.t, p.t - n.t as dt from p join ranked n on n.src = p.node and n.rk > 1 and n.rk > hi - {K} and n.rk <= hi and n.t < p.t")
def smp08_stateful_recent(spark: SparkSession, d: str) -> DataFrame:
    return sampler.recent_stateful(base.edges(spark, d), base.queries(spark, d), KEY, "batch", K)


@query(f"{E}, {R}, b as ({block_sql(K)}) select batch, root_pos, nbr_pos, eid, dt from b")
def smp09_projection(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d).select(*KEY, "nbr_pos", "eid", "dt")


_BOTH = f"{E}, {R}, g as (select eid, src, dst, t from e union all select eid, dst, src, t from e)"


@query(f"""{_BOTH}, h1 as ({block_sql(4, 'g')}), r2 as (select batch, root_pos, cast(-1 as integer) as nbr_1, node, t from r union all select batch, root_pos, nbr_pos, node, t from h1)
{block_sql(3, 'g', 'r2', 'batch, root_pos, nbr_1')}""")
def smp10_two_hop(spark: SparkSession, d: str) -> DataFrame:
    g = etl.with_reverse(base.edges(spark, d))
    return sampler.multi_hop(g, base.queries(spark, d), KEY, [4, 3])[1]


@query(f"""{_WINDOWS} select * from (select q.batch, q.root_pos, q.snap, q.node as root, q.t as root_t, cast(row_number() over (partition by q.batch, q.root_pos, q.snap order by n.t desc, n.eid desc) - 1 as integer) as nbr_pos, n.dst as node, n.eid, n.t, q.t - n.t as dt
from q join e n on n.src = q.node and n.t < q.t - snap * {DURATION} and n.t > q.t - (snap + 1) * {DURATION}) where nbr_pos < 5""")
def smp11_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return sampler.recent(base.edges(spark, d), base.queries(spark, d), KEY, 5, SNAPSHOTS, DURATION)


_B = f"{E}, {R}, b as ({block_sql(K)})"


@query(f'{_B} select batch, dense_rank() over (partition by batch order by root_pos) - 1 as "row", row_number() over (partition by batch order by root_pos, nbr_pos) - 1 as col, root_pos, nbr_pos, node, eid, dt from b')
def smp12_coo(spark: SparkSession, d: str) -> DataFrame:
    return blocks.coo(_recent(spark, d)).withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")})


@query(f"{_B} select distinct batch, eid from b")
def smp13_distinct_edges(spark: SparkSession, d: str) -> DataFrame:
    return blocks.distinct_edges(_recent(spark, d))


@query(f"{_B} select batch, root_pos, nbr_pos, eid, dense_rank() over (partition by batch order by eid) - 1 as inv from b")
def smp14_inverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return blocks.inverse_edges(_recent(spark, d)).withColumn("inv", F.col("inv").cast("long"))


@query(f"{_B}, c as (select batch, root_pos, count(*) as n from b group by all) select batch, root_pos, n, cast(sum(n) over (partition by batch order by root_pos) - n as bigint) as start, cast(sum(n) over (partition by batch order by root_pos) as bigint) as stop from c")
def smp15_row_pointers(spark: SparkSession, d: str) -> DataFrame:
    return blocks.row_pointers(_recent(spark, d))


@query(f"{_B} select distinct batch, root_pos, dense_rank() over (partition by batch order by root_pos) - 1 as dense_row from b")
def smp16_dense_rows(spark: SparkSession, d: str) -> DataFrame:
    return blocks.coo(_recent(spark, d)).select("batch", "root_pos", F.col("row").cast("long").alias("dense_row")).distinct()


@query(f"{_B}, x as (select batch, count(*) as dim_out from r group by batch), y as (select batch, count(*) as n from b group by batch) select batch, dim_out, coalesce(n, 0) as n_edges, dim_out + coalesce(n, 0) as dim_in from x left join y using (batch)")
def smp17_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return blocks.dimensions(base.queries(spark, d), _recent(spark, d))
