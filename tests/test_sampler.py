import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import blocks, etl, sampler

EDGES = "eid long, src long, dst long, t long, split int"
QUERIES = "batch long, root_pos long, node long, t long"
KEY = ["batch", "root_pos"]
# A small graph with ties at one time and nodes of degree 1.
SMALL = [(0, 0, 10, 5, 0), (1, 0, 11, 7, 0), (2, 1, 10, 8, 0), (3, 0, 12, 9, 0), (4, 0, 10, 9, 1), (5, 0, 13, 12, 2), (6, 2, 11, 15, 2)]
ASKED = [(0, 0, 0, 7), (0, 1, 1, 8), (0, 2, 2, 15), (1, 0, 0, 12), (1, 1, 0, 9), (1, 2, 10, 9), (2, 0, 0, 9), (2, 1, 0, 20)]
CLEAN = {(0, 0): [0], (1, 0): [4, 3, 1], (1, 1): [1, 0], (2, 0): [1, 0], (2, 1): [5, 4, 3]}
STATEFUL = {(1, 0): [4, 3], (2, 1): [5, 4, 3]}


def picks(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.nbr_pos):
        out.setdefault((r.batch, r.root_pos), []).append(r.eid)
    return out


def test_golden_clean_and_stateful(spark):
    e, q = spark.createDataFrame(SMALL, EDGES), spark.createDataFrame(ASKED, QUERIES)
    assert picks(sampler.recent(e, q, KEY, 3)) == CLEAN
    assert picks(sampler.recent_stateful(e, q, KEY, "batch", 3)) == STATEFUL


def test_pointer_times_in_stretches(spark):
    rng = random.Random(8)
    rows = [(b, p, rng.randint(0, 3), rng.randint(0, 50)) for b in range(9) for p in range(3)]
    q = spark.createDataFrame(rows, QUERIES)
    want = {(n, b): max(r[3] for r in rows if r[2] == n and r[0] <= b) for b, _, n, _ in rows}
    for span in (1, 2, 4, 1000):
        assert {(r.node, r.batch): r._top for r in sampler.pointer_times(q, "batch", span).collect()} == want


def random_graph(seed, n=600, nodes=9):
    rng = random.Random(seed)
    edges = [(i, min(rng.randint(0, nodes), rng.randint(0, nodes)), rng.randint(0, nodes), rng.randint(0, 120), rng.randint(0, 2)) for i in range(n)]
    asked = [(b, p, rng.choice([None, rng.randint(0, nodes + 2)]), rng.choice([None, rng.randint(-5, 130)])) for b in range(4) for p in range(25)]
    return edges, asked


@pytest.fixture
def many_ranges(spark):
    """Ranges that aren't put together, so that nodes lie in several."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(was, ("40", "false", "7")):
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ranges", ["few", "many"])
def test_recent_against_brute_force(spark, request, ranges):
    if ranges == "many":
        request.getfixturevalue("many_ranges")
    edges, asked = random_graph(3)
    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, QUERIES)
    want = {}
    for b, p, n, t in asked:
        if n is not None and t is not None:
            past = sorted(((x[3], x[0]) for x in edges if x[1] == n and x[3] < t), reverse=True)[:4]
            if past:
                want[(b, p)] = [eid for _, eid in past]
    assert picks(sampler.recent(e, q, KEY, 4)) == want
    ranks = {}
    for r in sampler.ranked_edges(e).collect():
        ranks.setdefault(r.src, []).append((r.rk, r.t, r.eid))
    for rows in ranks.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("shape", ["outlier", "burst", "one instant"])
def test_a_hot_node_is_spread_over_ranges(spark, many_ranges, shape):
    """Nine of ten edges are one node's; one far outlier, bursts and equal times don't bring them into one task."""
    n = 2000
    when = {"outlier": lambda i: 0 if i == 0 else 10**9 + i, "burst": lambda i: i // 1000 * 10**6 + i % 3, "one instant": lambda i: 5}[shape]
    edges = [(i, 1 if i % 10 else 2 + i % 7, i, when(i), 0) for i in range(n)]
    asked = [(0, p, 1, t) for p, t in enumerate([0, 6, 10**6 + 1, 10**9 + n // 2, 2 * 10**9])]
    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, QUERIES)
    found = sampler._swept(e, sampler._probes(q, KEY, sampler.BEFORE, F.col("t")), 4, True)
    files = found.filter("_kind = 1 and node = 1").groupBy(F.input_file_name()).count().agg(F.max("count"), F.count("*")).first()
    assert files[0] < n / 8 and files[1] > 10
    want = {}
    for b, p, _, t in asked:
        past = sorted(((x[3], x[0]) for x in edges if x[1] == 1 and x[3] < t), reverse=True)[:4]
        if past:
            want[(b, p)] = [eid for _, eid in past]
    assert picks(sampler.recent(e, q, KEY, 4)) == want


@pytest.mark.parametrize("ranges", ["few", "many"])
def test_windows_and_snapshots(spark, request, ranges):
    if ranges == "many":
        request.getfixturevalue("many_ranges")
    edges, asked = random_graph(5)
    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, QUERIES)
    got = {}
    for r in sorted(sampler.recent(e, q, KEY, 3, snapshots=3, duration=10).collect(), key=lambda r: r.nbr_pos):
        got.setdefault((r.batch, r.root_pos, r.snap), []).append(r.eid)
    want = {}
    for b, p, n, t in asked:
        for s in range(3):
            if n is not None and t is not None:
                past = sorted(((x[3], x[0]) for x in edges if x[1] == n and t - (s + 1) * 10 < x[3] < t - s * 10), reverse=True)[:3]
                if past:
                    want[(b, p, s)] = [eid for _, eid in past]
    assert got == want


def test_uniform_draws_lie_in_the_window(spark):
    edges, asked = random_graph(7)
    e, q = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, QUERIES)
    rows = sampler.uniform(e, q, KEY, 6, snapshots=2, duration=15).collect()
    at = {x[0]: x for x in edges}
    asked_at = {(b, p): (n, t) for b, p, n, t in asked}
    for r in rows:
        n, t = asked_at[(r.batch, r.root_pos)]
        assert at[r.eid][1] == n and t - (r.snap + 1) * 15 < at[r.eid][3] < t - r.snap * 15
    assert [tuple(r) for r in rows] and sorted(map(tuple, rows)) == sorted(map(tuple, sampler.uniform(e, q, KEY, 6, snapshots=2, duration=15).collect()))


def test_two_hops_never_look_ahead(spark):
    edges, asked = random_graph(9, 200)
    e = etl.with_reverse(spark.createDataFrame(edges, EDGES))
    one, two = sampler.multi_hop(e, spark.createDataFrame(asked, QUERIES), KEY, [3, 2])
    times = {(r.batch, r.root_pos, r.nbr_pos): (r.node, r.t) for r in one.collect()}
    for r in two.collect():
        node, t = times.get((r.batch, r.root_pos, r.nbr_1), (r.root, r.root_t))
        assert (r.root, r.root_t) == (node, t) and r.t < r.root_t
    assert times


def test_empty(spark):
    e, q = spark.createDataFrame([], EDGES), spark.createDataFrame(ASKED, QUERIES)
    assert sampler.recent(e, q, KEY, 3).count() == 0
    assert sampler.recent(spark.createDataFrame(SMALL, EDGES), q.limit(0), KEY, 3).count() == 0


def test_pointers_and_splits(spark):
    e = spark.createDataFrame(SMALL, EDGES)
    ordered = etl.positional_split(etl.time_sorted(e))
    assert [r.split for r in ordered.orderBy("row_id").collect()] == [0, 0, 0, 0, 1, 2, 2]
    ids = spark.range(14).select("id", "id").toDF("node", "id")
    ptr = [r.ptr for r in etl.indptr(etl.degrees(e, ids)).orderBy("id").collect()]
    assert ptr == [0, 5, 6] + [7] * 12
    assert {r.node for r in etl.new_nodes(e).collect()} == {13, 2}
    assert {r.eid for r in etl.inductive_links(e).collect()} == {0, 1, 2, 3, 4, 5, 6}
    assert etl.time_sorted(e.limit(0)).count() == 0


def test_features_with_faults(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], 5), (1, [3.0, 4.0], None), (1, [9.0, nan], 9), (2, [1.0], 1), (2, None, 1), (3, [5.0, None], 1), (4, [1.0, 1.0], None), (4, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    f = blocks.latest_features(spark.createDataFrame(rows, "id long, f array<float>, loaded_at long"), "id", 2, "loaded_at")
    assert sorted((r.id, list(r.f)) for r in f.collect()) == [(1, [1.0, 2.0]), (4, [1.0, 1.0])]
