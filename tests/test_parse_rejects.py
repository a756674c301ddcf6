import csv
import io
import random

from chronoweave.operators.parse_rejects import parse_lines, rejects, typed_edges
from chronoweave.plans import graph
from chronoweave.session import table

SCHEMA = "line_id long, file_name string, fmt string, line_no long, line string"


def run(spark, lines):
    rows = [(i, "f", fmt, 2, line) for i, (fmt, line) in enumerate(lines)]
    return {r.line_id: r for r in parse_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_reasons(spark):
    cases = [
        ("ws", "1 2 3", None), ("ws", " 1\t 2  3 \r", None), ("ws", "1 2", "column_count:2"), ("ws", "", "empty_line"), ("ws", " \t\r", "empty_line"), ("ws", "1 2 3 4", "column_count:4"), ("ws", '"1" 2 3', "src:not_digits"),
        ("ws", "1 2 2147483648", "time:out_of_range"), ("ws", "0001 2 02147483647", None), ("ws", "1 2 3", "column_count:2"), ("ws", "1 ٣ 3", "dst:not_digits"), ("ws", "1 +2 -3", "dst:not_digits; time:not_digits"), ("ws", "1 2\r 3", None),
        ("csv", "1,2,3,4,0", None), ("csv", '"1"," 2 ",3,4,2', None), ("csv", "1,2,3,4,3", "ext_roll:out_of_range"), ("csv", "1,2,3,4", "column_count:4"), ("csv", '1,"2,3",4,5,0', "src:not_digits"), ("csv", '1,"2,3,4,0', "broken_quoting"),
        ("csv", '1,2"",3,4,0', "broken_quoting"), ("csv", '1,"2"x,3,4,0', "broken_quoting"), ("csv", '1, "2",3,4,0', "broken_quoting"), ("csv", '1,"2""",3,4,0', "src:not_digits"), ("csv", "1,,3,4,0", "src:empty"), ("csv", '1,"\n2",3,4,0', "src:not_digits"),
        ("csv", "1,2,3,4,0,", "column_count:6"), ("csv", "", "empty_line"), ("csv", '1,"2\r",3,4,0\r', None), ("xml", "1 2 3", "unknown_format"), (None, "1 2 3", "unknown_format"), ("ws", None, "null_line"), ("csv", "1,2,3,4," + "0" * 100_000, None), ("ws", "9" * 100_000 + " 1 2", "src:out_of_range"),
        ("ws", "1 2 3\x1e", "time:not_digits"), ("ws", "1\x00 2 3", "src:not_digits"),
    ]
    got = run(spark, [c[:2] for c in cases])
    assert [(c, got[i].reason) for i, c in enumerate(cases) if got[i].reason != c[2]] == []
    assert (got[0].src, got[0].dst, got[0].time, got[0].eid) == (1, 2, 3, None)
    assert (got[14].eid, got[14].src, got[14].ext_roll) == (1, 2, 2)
    assert got[2].src is None


def test_all_rejected_empty_and_header(spark):
    assert {r.reason for r in run(spark, [("ws", "x"), ("csv", "")]).values()} == {"column_count:1", "empty_line"}
    assert parse_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, "ws", 1, "a b c"), (1, "f", "ws", None, "1 2 3"), (1, "f", "ws", 2, "1 2 3")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert typed_edges(parse_lines(df)).count() == 2
    assert rejects(parse_lines(df, drop_header=False)).count() == 1


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "f", "ws", 2, "1 2 3", "x", 5, "y")], SCHEMA + ", reason string, _at long, src string")
    assert [(r.reason, r.src) for r in parse_lines(df).collect()] == [(None, 1)]


def test_against_a_plain_parser(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice('12,," \t"') for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    got = run(spark, [("csv", x) for x in lines])

    def valid(line: str) -> bool:
        s = line.strip(" \t\r")
        fields, rest = [], s
        while True:
            if rest.startswith('"'):
                end = 1
                while end < len(rest) and (rest[end] != '"' or rest[end : end + 2] == '""'):
                    end += 2 if rest[end] == '"' else 1
                if end >= len(rest):
                    return False
                fields.append(rest[1:end].replace('""', '"'))
                rest = rest[end + 1 :]
                if rest and rest[0] != ",":
                    return False
            else:
                f, comma, _ = rest.partition(",")
                if '"' in f:
                    return False
                fields.append(f)
                rest = rest[len(f) :]
            if not rest:
                break
            rest = rest[1:]
        return len(fields) == 5 and all(f.strip(" \t\r").isascii() and f.strip(" \t\r").isdigit() for f in fields) and int(fields[4]) <= 2

    assert [(x, got[i].reason) for i, x in enumerate(lines) if valid(x) != (got[i].reason is None)] == []
    assert csv.reader(io.StringIO("")) is not None


def test_long_valid_fields_are_edges(spark, sf, tmp_path):
    lines = ["src dst time", "0012580574 997607 20002998", "7212089 2147483647 20006780", "1 2147483648 3", "1 99999999999 3", "000000000000000000000000000007 2 3", "1 2", "1 -2 3", "1 x 3"]
    spark.createDataFrame([(i, "a.txt", "ws", i + 1, x) for i, x in enumerate(lines)], "line_id long, file_name string, fmt string, line_no int, line string").write.parquet(f"{tmp_path}/raw_edges.parquet")
    got = sorted(tuple(r) for r in graph.src01_text_edges(spark, str(tmp_path)).collect())
    assert got == [(1, 12580574, 997607, 20002998), (2, 7212089, 2147483647, 20006780), (5, 7, 2, 3)]
    parsed = parse_lines(table(spark, sf, "raw_edges").filter("fmt = 'ws'")).filter("reason is null")
    want = sorted((r.line_id, r.src, r.dst, r.time) for r in parsed.collect())
    assert sorted((r.line_id, r.src, r.dst, r.time) for r in graph.src01_text_edges(spark, sf).collect()) == want
