import numpy as np
import pytest

from chronoweave.operators import sampler
from chronoweave.sources import edges as sources
from chronoweave.sources import sinks
from chronoweave.streaming.neighbours import mailbox_stream, recent_stream, settled

EVENTS = "node long, t long, eid long, dst long, query long"


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
    q.processAllAvailable()
    q.stop()


def test_stream_of_neighbours_equals_batch(spark, tmp_path):
    rows = [(n, t, 100 * n + t, 50 + t, None) for t in range(12) for n in (1, 2)]
    asked = [(n, t, None, None, 1000 * n + t) for n in (1, 2, 3) for t in (0, 4, 9, 12)]
    every = sorted(rows + asked, key=lambda r: r[1])
    for i in range(0, len(every), 8):
        spark.createDataFrame(every[i : i + 8], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(recent_stream(files, 3), "nbrs", tmp_path)
    got = sorted((r.query, r.nbr_pos, r.eid) for r in spark.table("nbrs").collect())
    e = spark.createDataFrame([(r[2], r[0], r[3], r[1]) for r in rows], "eid long, src long, dst long, t long")
    q = spark.createDataFrame([(r[4], r[0], r[1]) for r in asked], "query long, node long, t long")
    assert got == sorted((r["query"], r.nbr_pos, r.eid) for r in sampler.recent(e, q, ["query"], 3).collect())


def test_late_queries_are_marked_and_settled(spark, tmp_path):
    """A node of 100 edges, then queries within the lateness and far before it; the node's state is one or split."""
    edges = [(1, t, t, 500 + t, None) for t in range(100)] + [(2, t, 1000 + t, 9, None) for t in range(3)]
    steps = [edges, [(2, 200, 2000, 9, None)], [(1, 50, None, None, 7), (1, 99, None, None, 8), (1, 95, None, None, 9), (2, 150, None, None, 10), (3, 5, None, None, 11)], [(1, 40, 3000, 1, None)], [(1, 97, None, None, 12)]]
    e = spark.createDataFrame([(r[2], r[0], r[3], r[1]) for s in steps for r in s if r[4] is None], "eid long, src long, dst long, t long")
    q = spark.createDataFrame([(r[4], r[0], r[1]) for s in steps for r in s if r[4] is not None], "query long, node long, t long")
    want = sorted((r["query"], r.nbr_pos, r.eid) for r in sampler.recent(e, q, ["query"], 3).collect())
    for heavy in ((), (1,)):
        at = tmp_path / f"h{len(heavy)}"
        (at / "in").mkdir(parents=True)
        out = recent_stream(spark.readStream.schema(EVENTS).parquet(str(at / "in")), 3, "10 seconds", heavy, 4)
        for rows in steps:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(at / "in"))
            out.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(str(at / "out"))
        assert {r["query"] for r in found.filter("nbr_pos < 0").collect()} == {12}  # the state lets go of edges once its node has been seen after the watermark
        assert sorted((r["query"], r.nbr_pos, r.eid) for r in settled(found, 3, e, q).collect()) == want


def test_stream_of_mails(spark, tmp_path):
    schema = "batch long, pos long, node long, t long, mail array<double>"
    for b in range(5):
        spark.createDataFrame([(b, p, 1, b, [float(p)]) for p in range(2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "mails"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "mails"))
    run(mailbox_stream(files, 3), "box", tmp_path)
    assert sorted((r.batch, r.slot, list(r.mail)) for r in spark.table("box").collect()) == [(b, b % 3, [1.0]) for b in range(5)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("src dst time\n1 2  3\n4\t5 6\n")
    (tmp_path / "b.txt").write_text("7 8 9\n1 1 1\n")
    got = sources.text_edges(spark, str(tmp_path / "*.txt")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 3), (4, 5, 6)]
    assert sources.text_lines(spark, str(tmp_path / "a.txt"), header=False).count() == 3
    odd = spark.createDataFrame([(i, x) for i, x in enumerate(["0012580574 7 2147483647", " 1\t2 3\r", "2147483648 1 1", "1 2", "1 2 3 4", "a 1 2", "", None, "99999999999999999999999 1 2"])], "line_id long, line string")
    assert [tuple(r) for r in sources.parted_edges(odd, "line_id").filter("ok").drop("ok").collect()] == [(0, 12580574, 7, 2147483647), (1, 1, 2, 3)]
    (tmp_path / "bad.txt").write_text("src dst time\n1 2 3 4\n")
    with pytest.raises(Exception, match="whole numbers"):
        sources.text_edges(spark, str(tmp_path / "bad.txt")).collect()
    e = spark.createDataFrame([(0, 1, 2, 3, 0)], sources.EDGE_SCHEMA)
    sinks.write_edges(e, str(tmp_path / "csv"), "csv")
    sinks.write_edges(e, str(tmp_path / "pq"))
    assert sources.csv_edges(spark, str(tmp_path / "csv")).collect() == e.collect() == sources.parquet_edges(spark, str(tmp_path / "pq")).collect()
    spark.createDataFrame([(1, [True, False])], "id long, f array<boolean>").write.parquet(str(tmp_path / "f"))
    assert list(sources.features(spark, str(tmp_path / "f"), "id").first().f) == [1.0, 0.0]
    sinks.write_weights(spark, {"w": np.arange(6.0).reshape(2, 3)}, str(tmp_path / "w"))
    assert np.array_equal(sinks.read_weights(spark, str(tmp_path / "w"))["w"], np.arange(6.0).reshape(2, 3))


def test_nodes_share_states(spark, tmp_path):
    """Many nodes come in as few groups, one a bucket, and the answers are those of the table; one bucket holds all pieces of a heavy node as well."""
    rng = np.random.default_rng(2)
    edges = [(int(rng.integers(0, 40)) if i % 3 else 7, int(rng.integers(0, 90)), i, int(rng.integers(0, 9)), None) for i in range(300)]
    asked = [(int(rng.integers(0, 45)), int(rng.integers(0, 95)), None, None, i) for i in range(120)]
    e = spark.createDataFrame([(r[2], r[0], r[3], r[1]) for r in edges], "eid long, src long, dst long, t long")
    q = spark.createDataFrame([(r[4], r[0], r[1]) for r in asked], "query long, node long, t long")
    want = sorted((r["query"], r.root, r.nbr_pos, r.node, r.eid) for r in sampler.recent(e, q, ["query"], 3).collect())
    for buckets in (1, 5):
        at = tmp_path / f"b{buckets}"
        (at / "in").mkdir(parents=True)
        out = recent_stream(spark.readStream.schema(EVENTS).parquet(str(at / "in")), 3, "10 seconds", (7,), 4, buckets)
        for rows in (edges[:150], edges[150:], asked):
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(at / "in"))
            done = out.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start()
            done.awaitTermination()
            assert max(p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]) <= buckets
        found = spark.read.parquet(str(at / "out"))
        assert sorted((r["query"], r.root, r.nbr_pos, r.node, r.eid) for r in settled(found, 3, e, q).collect()) == want
