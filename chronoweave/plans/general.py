"""Queries of the general data problems (parse rejects, sessions, skew) with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import parse_rejects, sessions, skew
from chronoweave.session import table

GAP = 1800
SHARE = 0.02


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_rejects.parse_lines(table(spark, d, "raw_edges"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_rejects.rejects(_parsed(spark, d)).select("line_id")


def p1_edges(spark: SparkSession, d: str) -> DataFrame:
    return parse_rejects.typed_edges(_parsed(spark, d)).select("line_id", "src", "dst", "time")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return parse_rejects.rejects(_parsed(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return parse_rejects.rejects(_parsed(spark, d)).groupBy("fmt", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "edges"), "src", "time", GAP)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("src", "start_time", "end_time")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("src", "start_time", "end_time", "duration", "n_events")


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_summary(_sessions(spark, d), "src")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_nodes(table(spark, d, "edges"), SHARE).select("side", "node")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return skew.node_results(table(spark, d, "edges"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_edges, p1_rejects, p1_reasons, p2_found, p2_sessions, p2_summary, p4_found, p4_nodes)}

_TRIM = "trim(line, ' ' || chr(9) || chr(13))"
_WS = r"'[0-9]+([ \t]+[0-9]+){2}'"
_CELL = r"([ \t]*[0-9]+[ \t\r]*|\"[ \t\r]*[0-9]+[ \t\r]*\")"
_LINES = f"""
lines as (select line_id, fmt, {_TRIM} as s from raw_edges where line_no is distinct from 1),
shaped as (select line_id, fmt, s, case when fmt = 'ws' then regexp_full_match(s, {_WS}) else regexp_full_match(s, '{_CELL}(,{_CELL}){{4}}') end as shaped from lines),
cells as (select line_id, fmt, shaped, case when shaped then list_transform(string_split(regexp_replace(regexp_replace(s, '["\\r]', '', 'g'), case when fmt = 'ws' then '[ \\t]+' else '[ \\t]*,[ \\t]*' end, ',', 'g'), ','), lambda x: try_cast(trim(x, ' ' || chr(9)) as hugeint)) end as v from shaped),
judged as (select line_id, fmt, v, coalesce(shaped and len(list_filter(v, lambda x: x is null or x > 2147483647)) = 0 and (fmt = 'ws' or v[5] <= 2), false) as ok from cells)
"""
_QFIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_UNQUOTED = "trim(case when x[1] = '\"' then replace(substr(x, 2, len(x) - 2), '\"\"', '\"') else x end, ' ' || chr(9) || chr(13))"
_LABEL = "case when f[i] = '' then n[i] || ':empty' when not regexp_full_match(f[i], '[0-9]+') then n[i] || ':not_digits' when coalesce(try_cast(f[i] as hugeint), 9999999999) > case n[i] when 'ext_roll' then 2 else 2147483647 end then n[i] || ':out_of_range' end"
_REJECTS = f"""
lines as (select *, {_TRIM} as s from raw_edges where line_no is distinct from 1),
fields as (select *, case when fmt = 'ws' then string_split_regex(s, '[ \t]+') when regexp_full_match(s, '{_QFIELD}(,{_QFIELD})*', 's') then list_transform(regexp_extract_all(s || ',', '({_QFIELD}),', 1), lambda x: {_UNQUOTED}) end as f, case when fmt = 'ws' then ['src', 'dst', 'time'] else ['eid', 'src', 'dst', 'time', 'ext_roll'] end as n from lines),
told as (select line_id, file_name, line_no, fmt, line, case when f is null then 'broken_quoting' when s = '' then 'empty_line' when len(f) <> len(n) then 'column_count:' || len(f) else nullif(array_to_string(list_filter(list_transform(range(1, len(n) + 1), lambda i: {_LABEL}), lambda x: x is not null), '; '), '') end as reason from fields)
"""
_SESSIONS = f"""
rows_ as (select src, time, case when time - lag(time) over (partition by src order by time) <= {GAP} then 0 else 1 end as first from edges where src is not null and time is not null),
numbered as (select src, time, sum(first) over (partition by src order by time rows unbounded preceding) as no from rows_),
s as (select src, min(time) as start_time, max(time) as end_time, max(time) - min(time) as duration, count(*) as n_events from (select src, time, no from numbered) group by src, no)
"""
_NODES = """
nodes as (
  select 'src' as side, src as node, count(*) as n_rows, min(time) as first_time, max(time) as last_time, count(distinct dst) as n_partners, cast(count(*) filter (src = dst) as bigint) as n_loops from edges where src is not null group by src
  union all
  select 'dst', dst, count(*), min(time), max(time), count(distinct src), cast(count(*) filter (src = dst) as bigint) from edges where dst is not null group by dst)
"""
ORACLES: dict[str, str] = {
    "p1_found": f"with {_LINES} select line_id from judged where not ok",
    "p1_edges": f"with {_LINES} select line_id, cast(v[case when fmt = 'ws' then 1 else 2 end] as bigint) as src, cast(v[case when fmt = 'ws' then 2 else 3 end] as bigint) as dst, cast(v[case when fmt = 'ws' then 3 else 4 end] as bigint) as time from judged where ok",
    "p1_rejects": f"with {_REJECTS} select * from told where reason is not null",
    "p1_reasons": f"with {_REJECTS} select fmt, reason, count(*) as n_lines from told where reason is not null group by fmt, reason",
    "p2_found": f"with {_SESSIONS} select src, start_time, end_time from s",
    "p2_sessions": f"with {_SESSIONS} select src, start_time, end_time, duration, n_events from s",
    "p2_summary": f"with {_SESSIONS} select src, count(*) as n_sessions, cast(sum(n_events) as bigint) as n_events, max(duration) as longest, cast(sum(duration) as bigint) as total_duration from s group by src",
    "p4_found": f"with {_NODES} select side, node from nodes where n_rows >= {SHARE} * (select count(*) from edges)",
    "p4_nodes": f"with {_NODES} select * from nodes",
}
