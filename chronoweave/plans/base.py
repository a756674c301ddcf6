"""Cleaned base tables of the graph queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import blocks, etl
from chronoweave.session import table


def edges(spark: SparkSession, d: str) -> DataFrame:
    return etl.clean_edges(table(spark, d, "edges"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Roots without nulls and whole-row copies."""
    return table(spark, d, "root").filter("node is not null and t is not null").select("batch", "edge_pos", "root_pos", "role", "node", "t").distinct()


def node_features(spark: SparkSession, d: str) -> DataFrame:
    return blocks.latest_features(table(spark, d, "node_feat"), "id", 8, "loaded_at")


def edge_features(spark: SparkSession, d: str) -> DataFrame:
    return blocks.latest_features(table(spark, d, "edge_feat"), "eid", 4)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored").filter(F.expr("batch is not null and edge_pos is not null and label is not null and score is not null and not isnan(score)")).distinct()


E = "e as (select eid, src, dst, time as t, ext_roll as split from edges where src is not null and dst is not null and time is not null)"
R = "r as (select distinct batch, edge_pos, root_pos, role, node, t from root where node is not null and t is not null)"
_GOOD = "len(f) = {} and len(list_filter(f, lambda x: x is null or isnan(x))) = 0"
NF = f"nf as (select id, f from (select id, f, row_number() over (partition by id order by loaded_at desc nulls last, f) as n from node_feat where id is not null and {_GOOD.format(8)}) where n = 1)"
EF = f"ef as (select eid, f from (select eid, f, row_number() over (partition by eid order by f) as n from edge_feat where eid is not null and {_GOOD.format(4)}) where n = 1)"
S = "s as (select distinct batch, edge_pos, label, score from scored where batch is not null and edge_pos is not null and label is not null and score is not null and not isnan(score))"
NODES = "nodes as (select node, row_number() over (order by node) - 1 as id from (select src as node from e union select dst from e))"
ORDERED = "o as (select *, row_number() over (order by t, eid) - 1 as row_id from e)"


def block_sql(k: int, edges: str = "e", roots: str = "r", key: str = "batch, root_pos") -> str:
    """Recent neighbours by a plain join and row_number."""
    keys = ", ".join(f"q.{x.strip()}" for x in key.split(","))
    return f"""select * from (select {keys}, q.node as root, q.t as root_t, cast(row_number() over (partition by {keys} order by n.t desc, n.eid desc) - 1 as integer) as nbr_pos, n.dst as node, n.eid, n.t, q.t - n.t as dt
from {roots} q join {edges} n on n.src = q.node and n.t < q.t) where nbr_pos < {k}"""
