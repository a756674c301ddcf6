"""Queries of the training-data problems with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import frequent, overlap, packing, pii, tokenise
from chronoweave.session import table

WITHIN = 3
TOP = 20


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents; a table in fewer pieces than there are cores is spread by doc_id first, as work on texts is long.

    That moves rows only and never changes a result: no operator here depends on the order or place of rows.
    """
    docs, cores = table(spark, d, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores, "doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(table(spark, d, "edges"), WITHIN)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "edges"), WITHIN)


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_rows(table(spark, d, "edges"), WITHIN)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_top(spark, d).select("side", "node")


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    return frequent.top_values(table(spark, d, "edges"), ["src", "dst"], TOP)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_corpus(_documents(spark, d))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per document, whether decoding its ids gives its text again (a null text counts as empty): by SHA-256, so that no text is moved for it."""
    digest = lambda df, name: df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))
    back = tokenise.decode_corpus(tokenise.encode_corpus(_documents(spark, d)))
    return digest(_documents(spark, d), "was").join(digest(back, "now"), "doc_id").select("doc_id", (F.col("was") == F.col("now")).alias("same"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(packing.token_sizes(_documents(spark, d)), table(spark, d, "container_spec"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "container_spec"))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per spec the number of documents placed and of containers that are over their capacity or hold pieces out of place."""
    placed = p7_containers(spark, d).join(table(spark, d, "container_spec").select("spec_id", "capacity"), "spec_id")
    docs = placed.filter("piece = 0").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_docs"))
    per = placed.groupBy("spec_id", "container_id", "capacity").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"))
    bad = per.groupBy("spec_id").agg(F.sum(((F.col("n") > F.col("capacity")) | (F.col("n") != F.col("end"))).cast("long")).alias("n_bad"))
    return docs.join(bad, "spec_id").select("spec_id", "n_docs", "n_bad")


def p7_tight(spark: SparkSession, d: str) -> DataFrame:
    """Per spec, whether the containers are at most 1 % (and five) more than the tokens need at least."""
    r = p7_fill(spark, d)
    return r.select("spec_id", (F.col("n_containers") <= F.ceil(F.col("n_tokens") / F.col("capacity")) * 1.01 + 5).alias("tight"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_documents(spark, d), table(spark, d, "name_lexicon"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return pii.sanitise(_documents(spark, d), table(spark, d, "name_lexicon"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_report, p3_rows, p5_found, p5_top, p6_ids, p6_round_trip, p7_containers, p7_fill, p7_whole, p7_tight, p8_found, p8_clean)}

_PAIRS = f"""
k as (select eid, time, ext_roll, source, least(src, dst) as lo, greatest(src, dst) as hi from edges where src is not null and dst is not null and time is not null and ext_roll in (0, 1, 2)),
p as (select a.eid as a, b.eid as b, b.time - a.time as gap from k a join k b on a.lo = b.lo and a.hi = b.hi and a.ext_roll = 0 and b.ext_roll > 0 and abs(a.time - b.time) <= {WITHIN})
"""
_TOP = f"""
c as (select 'src' as side, src as node, count(*) as n_rows from edges where src is not null group by src union all select 'dst', dst, count(*) from edges where dst is not null group by dst),
r as (select *, row_number() over (partition by side order by n_rows desc, node) as rk from c)
"""
ORACLES: dict[str, str] = {
    "p3_found": f"with {_PAIRS} select least(a, b) as eid_a, greatest(a, b) as eid_b from p",
    "p3_report": f"""with {_PAIRS}, near as (select b, min(abs(gap)) as gap from p group by b)
select case when ext_roll = 1 then 'val' else 'test' end as split, source, count(*) as n_rows, count(gap) as n_overlap, cast(count(*) filter (gap = 0) as bigint) as n_exact from k left join near on b = eid where ext_roll > 0 group by ext_roll, source""",
    "p3_rows": f"with {_PAIRS}, n as (select a as eid, count(*) as n_links from p group by a union all select b, count(*) from p group by b), c as (select eid, ext_roll as split, min(eid) over (partition by lo, hi, time) as class_id from k) select eid, split, class_id, n_links from n join c using (eid)",
    "p6_round_trip": "select doc_id, true as same from documents",
    "p7_whole": "select spec_id, (select count(*) from documents) as n_docs, cast(0 as bigint) as n_bad from container_spec",
    "p7_tight": "select spec_id, true as tight from container_spec",
    "p5_found": f"with {_TOP} select side, node from r where rk <= {TOP}",
    "p5_top": f"with {_TOP} select side, node, n_rows from r where rk <= {TOP}",
}
