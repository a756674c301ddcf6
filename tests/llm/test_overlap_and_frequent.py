import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import frequent, overlap

SCHEMA = "eid long, src long, dst long, time long, ext_roll int, source string"


def graph(seed, n=700):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, rng.randint(-60, 60)]), rng.choice([None, 0, 0, 1, 2, 5]), rng.choice([None, "a", "b"])) for i in range(n)]
    return rows + [(n + i, *r[1:]) for i, r in enumerate(rows[:60])]


def brute(rows, within):
    good = [r for r in rows if None not in r[1:5] and r[4] in (0, 1, 2)]
    return sorted((min(a[0], b[0]), max(a[0], b[0])) for a in good if a[4] == 0 for b in good if b[4] > 0 and {a[1], a[2]} == {b[1], b[2]} and abs(a[3] - b[3]) <= within)


@pytest.mark.parametrize("within", [0, 1, 3, 10, 40])
def test_pairs_against_brute_force(spark, within):
    rows = graph(within)
    got = sorted((r.eid_a, r.eid_b) for r in overlap.found_pairs(spark.createDataFrame(rows, SCHEMA), within).collect())
    assert got == brute(rows, within)


def test_lists_long_on_either_side_are_split_and_whole(spark):
    for n, m in ((1500, 40), (40, 1500), (120, 120)):
        rows = [(i, 1, 2, 5, 0, "a") for i in range(n)] + [(5000 + i, 2, 1, 5 + i % 2, 1 + i % 2, None) for i in range(m)]
        df = spark.createDataFrame(rows, SCHEMA)
        pairs = overlap.cross_split_pairs(df, 3, least_rows=100)
        assert pairs.count() == pairs.select("train_eid", "eval_eid").distinct().count() == n * m
    rows = [(i, 1, 2, 5, 0, "a") for i in range(1500)] + [(5000 + i, 2, 1, 5 + i % 2, 1 + i % 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    rep = sorted((r.split, r.source, r.n_rows, r.n_overlap, r.n_exact) for r in overlap.overlap_report(df).collect())
    assert rep == [("test", None, 20, 20, 0), ("val", None, 20, 20, 20)]
    links = {(r.split, r.class_id, r.n_links) for r in overlap.overlap_rows(df).collect()}
    assert links == {(0, 0, 40), (1, 0, 1500), (2, 5001, 1500)} and overlap.overlap_rows(df).count() == 1540


def test_pruning_leaves_few_candidates_and_loses_none(spark):
    """Of all pairs that share a term, nodes included, pruning leaves few; the threshold turns away most of those that aren't near."""
    rng = random.Random(9)
    rows = [(i, 1 if rng.random() < 0.5 else rng.randint(2, 60), rng.randint(61, 90), rng.randint(0, 400), rng.choice([0, 0, 1, 2]), "a") for i in range(1200)]
    width = 8
    rec = overlap._records(spark.createDataFrame(rows, SCHEMA), width)
    left = overlap.candidates(rec, rec.filter("split = 0"), rec.filter("split > 0"), 3, width, "eid")
    seen = [(r[0], r[1], r.far, r.near) for r in left.select(F.col("a.eid"), F.col("b.eid"), (F.abs(F.col("a.t") - F.col("b.t")) > 3).alias("far"), (F.col("dot") >= F.col("b.least")).alias("near")).collect()]
    sharing = sum(1 for a in rows if a[4] == 0 for b in rows if b[4] and {a[1], a[2]} & {b[1], b[2]})
    true = {(a[0], b[0]) for a in rows if a[4] == 0 for b in rows if b[4] and {a[1], a[2]} == {b[1], b[2]} and abs(a[3] - b[3]) <= 3}
    assert true and len(seen) == len({x[:2] for x in seen}) and len(seen) < sharing / 100
    assert {x[:2] for x in seen if not x[2]} == true and all(x[3] for x in seen if not x[2])
    far = [x for x in seen if x[2]]
    assert sum(x[3] for x in far) < len(far)


def test_scores_fall_with_distance(spark):
    rows = [(0, 1, 2, 100, 0, "a")] + [(1 + i, 2, 1, 100 + i, 1, "b") for i in range(6)]
    got = {r.gap: r.score for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(0.8 < s <= 1.0000001 for s in got.values())


def test_empty_and_extra_columns(spark):
    assert overlap.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert overlap.overlap_report(spark.createDataFrame([], SCHEMA)).count() == overlap.overlap_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(0, 1, 1, 5, 0, None, 1, 2), (1, 1, 1, 6, 2, None, 1, 2)], SCHEMA + ", anchor long, t long")
    assert overlap.found_pairs(df).collect() == [(0, 1)]


def test_top_values(spark):
    rows = [(x, None) for x in [5] * 3 + [4] * 3 + [9] * 2 + [1] + [None] * 50]
    df = spark.createDataFrame(rows, "src long, dst long")
    assert [tuple(r) for r in frequent.top_values(df, ["src", "dst"], 3).collect()] == [("src", 4, 3), ("src", 5, 3), ("src", 9, 2)]
    assert frequent.top_values(df, ["src"], 99).count() == 4
    assert frequent.top_values(df.limit(0), ["src", "dst"], 3).count() == 0
    assert frequent.top_values(spark.createDataFrame([(1, 2, 3, "x")], "src long, node long, n_rows long, side string"), ["src"], 1).collect() == [("src", 1, 1)]
    with pytest.raises(ValueError):
        frequent.top_values(df, ["src"], 0)
