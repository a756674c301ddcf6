import random

from chronoweave.operators import skew

SCHEMA = "eid long, src long, dst long, time long"


def brute(rows):
    out = {}
    for _, s, d, t in rows:
        for side, node, other in (("src", s, d), ("dst", d, s)):
            if node is not None:
                out.setdefault((side, node), []).append((other, t))
    return {k: (len(v), min((t for _, t in v if t is not None), default=None), max((t for _, t in v if t is not None), default=None), len({o for o, _ in v if o is not None}), sum(o == k[1] for o, _ in v)) for k, v in out.items()}


def test_against_brute_force_with_a_hot_node(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7, 7, 7, None, rng.randint(0, 50)]), rng.choice([None, 7, rng.randint(0, 400)]), rng.choice([None, rng.randint(0, 99)])) for i in range(4000)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.side, r.node): (r.n_rows, r.first_time, r.last_time, r.n_partners, r.n_loops) for r in skew.node_results(df, salts=8, share=0.05).collect()}
    assert got == brute(rows)
    heavy = {(r.side, r.node) for r in skew.heavy_keys(df, 0.05).collect()}
    assert ("src", 7) in heavy and ("dst", 7) in heavy


def test_dominant_counts_null_rows_in_the_total(spark):
    rows = [(i, 1 if i < 2 else i, None, None) for i in range(50)] + [(i, None, 5, None) for i in range(50)]
    got = {(r.side, r.node) for r in skew.dominant_nodes(spark.createDataFrame(rows, SCHEMA), 0.02).collect()}
    assert got == {("src", 1), ("dst", 5)}


def test_empty_and_extra_columns(spark):
    assert skew.node_results(spark.createDataFrame([], SCHEMA)).count() == 0
    assert skew.dominant_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 2, 3, 4, "x", 5)], SCHEMA + ", node string, _salt long")
    assert skew.node_results(df).count() == 2
