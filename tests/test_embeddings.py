import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.__main__ import main
from chronoweave.config import PRESETS, settings
from chronoweave.operators import layers as L
from chronoweave.operators import metrics, models, training
from chronoweave.sources import sinks
from tests.test_models import plain_fold

EDGES = "eid long, src long, dst long, t long, split int"


def te(t, width):
    return np.array([math.cos(t * 10.0 ** (-9.0 * j / max(width - 1, 1))) for j in range(width)])


def attend(own, nbrs, out, width, edge_width=2):
    """One layer by its definition: nbrs are (vector, edge vector, dt)."""
    w = L.initial_layer(L.Layer(len(own), edge_width, width, 2, out))
    agg = np.zeros(out)
    if nbrs:
        q = (w["wq"] @ np.concatenate([own, te(0.0, width)]) + w["bq"]).reshape(2, -1)
        k, v = (np.array([(w[f"w{x}"] @ np.concatenate([n, e, te(d, width)]) + w[f"b{x}"]).reshape(2, -1) for n, e, d in nbrs]) for x in "kv")
        s = np.einsum("hw,nhw->nh", q, k)
        s = np.where(s > 0, s, 0.2 * s)
        a = np.exp(s - s.max(0)) / np.exp(s - s.max(0)).sum(0)
        agg = np.einsum("nh,nhw->hw", a, v).reshape(-1)
    x = np.maximum(w["wo"] @ np.concatenate([agg, own]) + w["bo"], 0)
    return (x - x.mean()) / np.sqrt(x.var() + 1e-5)


def test_two_layers_by_definition(spark):
    rng = np.random.default_rng(3)
    edges = [(i, int(rng.integers(0, 5)), int(rng.integers(0, 5)), int(rng.integers(0, 30)), 0) for i in range(40)]
    nf = {n: rng.normal(size=3).round(3).tolist() for n in range(4)}
    ef = {i: rng.normal(size=2).round(3).tolist() for i in range(0, 40, 2)}
    asked = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 35))) for i in range(12)] + [(90, None, 3), (91, 1, None)]
    vec = lambda n: np.array(nf.get(n, [0.0] * 3))
    evec = lambda e: np.array(ef.get(e, [0.0] * 2))

    def embed(n, t, fanout):
        if not fanout:
            return vec(n)
        past = sorted(((x[3], x[0], x[2]) for x in edges if x[1] == n and x[3] < t), reverse=True)[: fanout[0]]
        return attend(embed(n, t, fanout[1:]), [(embed(d, et, fanout[1:]), evec(e), t - et) for et, e, d in past], 4, 4)

    e = spark.createDataFrame(edges, EDGES)
    q = spark.createDataFrame(asked, "eid long, node long, t long")
    f = spark.createDataFrame([(n, v) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v) for n, v in ef.items()], "eid long, f array<double>")
    for fanout in ((3,), (3, 2)):
        got = {r.eid: r.h for r in models.embeddings(e, q, ["eid"], f, g, settings("TGAT", fanout, (4, 4)).preset, 3, 2).collect()}
        assert set(got) == set(range(12))
        for i, n, t in asked[:12]:
            assert np.allclose(got[i], embed(n, t, fanout), atol=1e-9), (i, fanout)


def test_snapshots_count_time_from_the_query(spark):
    """Time width 0 is the preset; with another the time since an edge is that from the query, not from the snapshot's end."""
    from dataclasses import replace

    edges = [(i, 1, 2 + i % 3, 10 * i, 0) for i in range(9)]
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(6)], "id long, f array<double>")
    g = spark.createDataFrame([], "eid long, f array<double>")
    q = spark.createDataFrame([(0, 1, 85), (1, 9, 50)], "snap long, node long, t long")
    for width in (0, 3):
        preset = replace(settings("DySAT", (10,), (4, 4)).preset, duration=30, time_width=width, strategy="recent")
        got = {r.snap: np.array(r.h) for r in models.embeddings(e, q, ["snap"], f, g, preset, 2, 1).collect()}
        h = np.zeros(4)
        for snap in (2, 1, 0):
            near = [x for x in edges if 85 - (snap + 1) * 30 < x[3] < 85 - snap * 30]
            x = attend(np.array([1.0, 1.0]), [(np.array([float(d), 1.0]), np.zeros(1), 85 - t) for _, _, d, t, _ in near], 4, width, 1)
            h = np.tanh(L.matrix(4, 4, 7) @ x + L.bias(4, 7) + L.matrix(4, 4, 8) @ h)
        assert np.allclose(got[0], h) and set(got) == {0, 1}
    preset = settings("DySAT", (3, 2), (4, 4)).preset
    assert models.embeddings(e, q, ["snap"], f, g, preset, 2, 1).count() == 2


def random_graph(seed, n=60):
    rng = np.random.default_rng(seed)
    edges = [(i, int(rng.integers(0, 7)), int(rng.integers(0, 7)), 3 * i + int(rng.integers(0, 3)), 0 if i < 40 else 1) for i in range(n)]
    nf = {x: rng.normal(size=3).round(3) for x in range(5)}
    ef = {i: rng.normal(size=2).round(3) for i in range(0, n, 2)}
    return edges, nf, ef


@pytest.mark.parametrize("name", ["TGN", "APAN", "JODIE"])
def test_models_with_memory_by_definition(spark, name):
    edges, nf, ef = random_graph(4)
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v.tolist()) for n, v in ef.items()], "eid long, f array<double>")
    fanout = () if name == "JODIE" else (3, 2) if name == "TGN" else (3,)
    preset = settings(name, fanout, (4, 4)).preset
    kind = preset.memory
    order = models.numbered(e, 7)
    true = [(r.batch, r.edge_pos, r.eid, r.src, r.dst, r.t) for r in order.collect()]

    def recent(n, t, k):
        return sorted(((x[3], x[0], x[2]) for x in edges if x[1] == n and x[3] < t), reverse=True)[:k]

    routes = {(b, 2 * p + end): [d for _, _, d in recent(n, t, 3)] for b, p, _, s, d0, t in true for end, n in enumerate((s, d0))}
    want = plain_fold(true, ef, kind, 4, 2, 4, routes)
    past = models.memory_history(e, order, g, preset, 2)
    asked = [(b, s, t) for b, _, _, s, _, t in true] + [(3, 99, 500)]
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "k long, batch long, node long, t long")

    def state(n, t, b):
        seen = [x for x in want if x[0] == n and x[1] < b]
        mem, mem_t, box, box_t, _ = want[max(seen, key=lambda x: x[1])] if seen else (np.zeros(4), 0, np.zeros((kind.slots, 10)), np.zeros(kind.slots), 0)
        new = L.updated_memory(kind.updater, mem[None], np.array([float(mem_t)]), box[None], box_t[None], np.array([float(t)]), 4)[0]
        own = L.matrix(4, 3, 50) @ nf.get(n, np.zeros(3)) + L.bias(4, 50)
        return new + own if kind.add_features else new, mem_t

    def embed(n, t, b, k):
        if not k:
            return state(n, t, b)[0]
        return attend(embed(n, t, b, k[1:]), [(embed(d, et, b, k[1:]), ef.get(i, np.zeros(2)), t - et) for et, i, d in recent(n, t, k[0])], 4, 4)

    got = {r.k: r.h for r in models.embeddings(e, q, ["k", "batch"], f, g, preset, 3, 2, past).collect()}
    assert set(got) == set(range(len(asked)))
    for i, (b, n, t) in enumerate(asked):
        if name == "TGN":
            h = embed(n, t, b, fanout)
        else:
            h, mem_t = state(n, t, b)
            h = (h - h.mean()) / np.sqrt(h.var() + 1e-5)
            if name == "JODIE":
                d = (t - mem_t) / (t + 1)
                h = h * (1 + d * L.matrix(4, 1, 6)[:, 0] + L.bias(4, 6))
        assert np.allclose(got[i], h, atol=1e-8), (name, i)
    with pytest.raises(ValueError, match="memory"):
        models.embeddings(e, q, ["k"], f, g, preset, 3, 2)


@pytest.mark.parametrize("name", sorted(PRESETS))
def test_every_preset_is_evaluated(spark, name):
    edges, nf, ef = random_graph(6)
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v.tolist()) for n, v in ef.items()], "eid long, f array<double>")
    run = settings(name, () if name == "JODIE" else (3,), (4, 4), batch_rows=7, eval_negatives=2)
    scores = models.link_scores(e, e.filter("split = 1"), f, g, run, 3, 2, 4).persist()
    assert scores.filter("label = 0").count() == 40 and scores.filter("label = 1").count() == 20
    row = metrics.summary(scores).first()
    assert 0 <= row.ap <= 1 and 0 < row.mrr <= 1 and row.loss > 0
    scores.unpersist()


@pytest.mark.parametrize("fanout", [(3,), (3, 2)])
def test_training_gradient_and_loss(spark, fanout):
    edges, nf, ef = random_graph(8)
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v.tolist()) for n, v in ef.items()], "eid long, f array<double>")
    run = settings("TGAT", fanout, (3, 4), batch_rows=20, epochs=4, dropout=0.0, rate=0.05)
    part = e.filter("split = 0")
    drawn = training.etl.negatives(part, training.etl.dense_ids(e))
    rows = training.samples(e, part, drawn, f, g, run.preset, 3, 2).persist()
    weights = models.initial_weights(run.preset, 3, 2, 4)
    assert all((training.shaped(training.flat(weights), weights)[m][k] == weights[m][k]).all() for m in weights for k in weights[m])
    net = training.Network(run.preset, 3, 2)
    grad, loss, n = training.gradient(rows, net, weights, 1)
    assert n == 40
    scored = models.link_scores(e, part, f, g, run, 3, 2, 4)
    want = sum(np.logaddexp(0, -r.score if r.label else r.score) for r in scored.collect())
    assert np.isclose(loss, want)  # the forward pass of training is that of evaluation
    w = training.flat(weights)
    for at in range(0, len(w), len(w) // 6):
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        num = (training.gradient(rows, net, training.shaped(up, weights), 1)[1] - training.gradient(rows, net, training.shaped(down, weights), 1)[1]) / 2e-5
        assert np.isclose(grad[at], num, rtol=1e-3, atol=1e-3), at
    if len(fanout) == 1:
        timers = training.StageTimers()
        best, told = training.train(e, f, g, run, 3, 2, 4, steps=2, first=3, timers=timers)
        assert told[-1][1] < told[0][1] and len(told) == 4
        names = {r["name"] for r in training.metrics_table(spark, told, timers).collect()}
        assert {"loss", "ap", "t_backward", "t_eval"} <= names
        dropped = training.Network(run.preset, 3, 2, 0.5)
        again = [training.gradient(rows, dropped, weights, 3)[1] for _ in range(2)]
        assert np.isclose(*again) and not np.isclose(again[0], loss)
    rows.unpersist()


def test_training_refuses_what_it_has_no_gradient_for(spark):
    q = spark.createDataFrame([(0, 1, 2, 5, 0)], EDGES)
    f = spark.createDataFrame([], "id long, f array<float>")
    for name in ("TGN", "JODIE", "DySAT"):
        with pytest.raises(ValueError):
            training.samples(q, q, q, f, f, PRESETS[name], 2, 2)


def test_train_and_evaluate_from_the_command_line(spark, tmp_path, capsys):
    edges, nf, ef = random_graph(3)
    e = spark.createDataFrame([(i, s, d, t, x) for i, s, d, t, x in edges], "eid long, src long, dst long, time long, ext_roll int")
    e.write.parquet(str(tmp_path / "edges"))
    common = ["--edges", str(tmp_path / "edges"), "--neighbor_num", "3", "--batch_size", "20", "--rand_node_features", "4", "--time_width", "2", "--out_width", "4"]
    main(["train", *common, "--epochs", "1", "--rate", "0.05", "--out", str(tmp_path / "weights")], spark)
    weights = sinks.read_weights(spark, str(tmp_path / "weights"))
    assert "layer_0/wq" in weights and weights["layer_0/wq"].shape == (4, 6)
    main(["evaluate", *common, "--weights", str(tmp_path / "weights")], spark)
    main(["evaluate", *common, "--model_name", "JODIE"], spark)
    assert capsys.readouterr().out.count("mrr") == 2


def test_two_layers_make_no_row_per_neighbour(spark, monkeypatch):
    """A hot node over several ranges: what is written is one row an edge and query, and the vectors are those of the definition."""
    from chronoweave.operators import sampler

    rng = np.random.default_rng(5)
    edges = [(i, 1 if i % 4 else int(rng.integers(2, 6)), int(rng.integers(0, 6)), int(rng.integers(0, 60)), 0) for i in range(200)]
    nf = {n: rng.normal(size=3).round(3) for n in range(4)}
    asked = [(i, int(rng.integers(0, 7)), int(rng.integers(0, 70))) for i in range(90)]
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([], "eid long, f array<double>")
    q = spark.createDataFrame(asked, "k long, node long, t long")
    made = []
    for module in (sampler, models):
        keep = module.written
        monkeypatch.setattr(module, "written", lambda df, label, keep=keep: (made.append(keep(df, label)), made[-1])[1])
    drop = models.dropped
    rows = []
    monkeypatch.setattr(models, "dropped", lambda df: (rows.append(made[-2].count()), drop(df)))
    changed = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        got = {r.k: r.h for r in models.embeddings(e, q, ["k"], f, g, settings("TGAT", (10, 10), (4, 4)).preset, 3, 2).collect()}
        assert made[-1].select("_part").distinct().count() > 1
        assert max([*rows, made[-1].count()]) <= len(edges) + len(asked) + 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

    def embed(n, t, deep):
        if not deep:
            return nf.get(n, np.zeros(3))
        past = sorted(((x[3], x[0], x[2]) for x in edges if x[1] == n and x[3] < t), reverse=True)[:10]
        return attend(embed(n, t, deep - 1), [(embed(d, et, deep - 1), np.zeros(2), t - et) for et, _, d in past], 4, 4)

    for k, n, t in asked[::9]:
        assert np.allclose(got[k], embed(n, t, 2), atol=1e-9)


def test_packed_training_equals_samples(spark, monkeypatch):
    """A hot node over several ranges and blocks: the gradient is that of the neighbourhoods row by row, and shared neighbours are stored once."""
    rng = np.random.default_rng(9)
    edges = [(i, 1 if i % 4 else int(rng.integers(2, 6)), int(rng.integers(0, 6)), int(rng.integers(0, 60)), 0) for i in range(200)]
    nf = {n: rng.normal(size=3).round(3).tolist() for n in (0, 1, 3)}
    ef = {i: rng.normal(size=2).round(3).tolist() for i in range(0, 200, 3)}
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame(list(nf.items()), "id long, f array<double>")
    g = spark.createDataFrame(list(ef.items()), "eid long, f array<double>")
    preset = settings("TGAT", (10,), (3, 4)).preset
    part, drawn = e.filter("eid % 5 > 0"), training.etl.negatives(e, training.etl.dense_ids(e))
    weights, net = models.initial_weights(preset, 3, 2, 4), training.Network(preset, 3, 2)
    monkeypatch.setattr(training, "BLOCK", 70)
    monkeypatch.setattr(training, "CHUNK", 20)
    want = training.gradient(training.samples(e, part, drawn, f, g, preset, 3, 2), net, weights, 1)
    changed = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for steps in (1, 2):
            for k, v in changed.items():
                spark.conf.set(k, v)
            rows = training.packed(e, part, drawn, f, g, preset, 3, 2, steps)
            for k, v in before.items():
                spark.conf.set(k, v)
            got = [training.gradient(rows.filter(f"part = {i}"), net, weights, 1) for i in range(steps)]
            assert sum(x[2] for x in got) == want[2] == 160 and np.isclose(sum(x[1] for x in got), want[1])
            assert np.allclose(sum(x[0] for x in got), want[0], rtol=1e-9, atol=1e-9)
            assert rows.selectExpr("sum(size(e_t)) as n").first().n < rows.selectExpr("sum(aggregate(size, 0, (a, x) -> a + x)) as n").first().n / (3 - steps)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mailboxes_are_folded_in_one_pass(spark, monkeypatch):
    """Delivery to neighbours stores no lists of receivers and no state of stretches, and gives what the history gives."""
    from chronoweave.operators import mailboxes, memory, sampler

    edges, nf, ef = random_graph(6)
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v.tolist()) for n, v in ef.items()], "eid long, f array<double>")
    preset = settings("APAN", (3,), (4, 4)).preset
    order = models.numbered(e, 7)
    q = order.select(F.col("eid").alias("k"), "batch", F.col("src").alias("node"), "t")
    found = [models.embeddings(e, q, ["k", "batch"], f, g, preset, 3, 2, models.memory_history(e, order, g, preset, 2))]
    labels = []
    for module in (sampler, memory, mailboxes):
        monkeypatch.setattr(module, "written", lambda df, label, keep=module.written: (labels.append(label), keep(df, label))[1])
    found.append(models.embeddings(e, q, ["k", "batch"], f, g, preset, 3, 2, models.memory_answers(e, order, g, preset, 2)))
    want, got = ({r.k: r.h for r in x.collect()} for x in found)
    assert labels == ["memory-reads", "memory-answers"]
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_layers_over_memories_are_worked_out_in_the_fold(spark, monkeypatch):
    """Attention over memories stores neither neighbours nor reads, and gives what the history gives; times that are shared, roots asked out of order and at later times too."""
    from chronoweave.operators import mailboxes, memory, remembered, sampler

    edges, nf, ef = random_graph(8)
    edges = [(i, s, d, t - t % 4, x) for i, s, d, t, x in edges]
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v.tolist()) for n, v in ef.items()], "eid long, f array<double>")
    order = models.numbered(e, 7)
    asked = order.select(F.col("eid").alias("k"), "batch", F.col("src").alias("node"), "t")
    more = spark.createDataFrame([(900, 3, 99, 500), (901, 99, 1, 10_000), (902, 0, 2, 50), (903, -1, 3, 77), (904, 2, None, 5), (905, 2, 1, None), (906, None, 1, 50)], asked.schema)
    q = asked.unionByName(more).repartition(3, "k")
    for fanout in ((3, 2), (2,), (2, 3, 2)):
        preset = settings("TGN", fanout, (4, 4)).preset
        want = {r.k: r.h for r in models.embeddings(e, q, ["k", "batch"], f, g, preset, 3, 2, models.memory_history(e, order, g, preset, 2)).collect()}
        with monkeypatch.context() as patch:
            labels = []
            for module in (sampler, memory, mailboxes, models, remembered):
                patch.setattr(module, "written", lambda df, label, keep=module.written: (labels.append(label), keep(df, label))[1])
            rows = models.embeddings(e, q, ["k", "batch"], f, g, preset, 3, 2, models.memory_answers(e, order, g, preset, 2)).collect()
        assert labels == ["memory-layers"]
        got = {r.k: r.h for r in rows}
        assert len(rows) == len(got) and set(got) == set(want) - {906} and {900, 901, 902, 903} < set(got)
        assert all(np.allclose(got[k], want[k], atol=1e-8) for k in got)
    none = models.embeddings(e, q.limit(0), ["k", "batch"], f, g, preset, 3, 2, models.memory_answers(e, order, g, preset, 2))
    assert none.count() == 0


def test_scores_over_memories_store_embeddings_once(spark, monkeypatch):
    """Link scores with a memory are those from its history, and of what lies between only the roots' vectors are stored, once."""
    from chronoweave.operators import remembered, sampler

    edges, nf, ef = random_graph(9)
    e = spark.createDataFrame(edges, EDGES)
    f = spark.createDataFrame([(n, v.tolist()) for n, v in nf.items()], "id long, f array<double>")
    g = spark.createDataFrame([(n, v.tolist()) for n, v in ef.items()], "eid long, f array<double>")
    run = settings("TGN", (3, 2), (4, 4), batch_rows=7, eval_negatives=2)
    scores = lambda: sorted((r.batch, r.edge_pos, r.label, round(r.score, 8)) for r in models.link_scores(e, e.filter("split = 1"), f, g, run, 3, 2, 4).collect())
    with monkeypatch.context() as patch:
        patch.setattr(models, "memory_answers", models.memory_history)
        want = scores()
    labels = []
    for module in (sampler, models, remembered):
        monkeypatch.setattr(module, "written", lambda df, label, keep=module.written: (labels.append(label), keep(df, label))[1])
    assert scores() == want and len(want) == 3 * sum(x[4] == 1 for x in edges)
    assert [x for x in labels if x != "ordered"] == ["memory-layers"]
