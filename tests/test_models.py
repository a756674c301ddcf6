import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.config import MemorySettings, settings
from chronoweave.functions import vectors as V
from chronoweave.operators import layers as L
from chronoweave.operators import hotset, kernels, mailboxes, memory, metrics, nn, topology, training


def test_softmax_gradient_by_differences(spark):
    x, dy = np.array([0.3, -1.2, 2.0, 0.0]), np.array([1.0, -0.5, 0.25, 2.0])
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, dy))], "root int, i int, x double, dy double")
    got = kernels.edge_softmax_gradient(kernels.edge_softmax(rows, ["root"], "x"), ["root"], "y", "dy").orderBy("i").collect()
    assert np.allclose([r.y for r in got], soft(x))
    eps = 1e-6
    num = [((soft(x + eps * np.eye(4)[i]) - soft(x - eps * np.eye(4)[i])) @ dy) / (2 * eps) for i in range(4)]
    assert np.allclose([r.dx for r in got], num, atol=1e-6)


def test_wide_layer_equals_expressions(spark):
    w, b = L.matrix(3, 5, 4), L.bias(3, 4)
    rows = spark.createDataFrame([(0, [1.0, 2.0, -1.0, 0.5, 3.0]), (1, None)], "id int, x array<double>")
    got = nn.dense(rows, "x", w, b, "y").withColumn("z", V.linear(F.col("x"), 3, 4)).orderBy("id").collect()
    assert np.allclose(got[0].y, got[0].z) and got[1].y is None


def test_layer_norm(spark):
    x = np.array([1.0, 4.0, -2.0, 0.5])
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(V.layer_norm(F.col("x")).alias("y")).first().y
    assert np.allclose(got, (x - x.mean()) / np.sqrt(x.var() + 1e-5))


def test_mails_of_a_batch_and_ring(spark):
    edges = spark.createDataFrame([(b, p, 10 * b + p, 1, 2 + p, 10 * (p + 1)) for b in range(4) for p in range(2)], "batch long, edge_pos long, eid long, src long, dst long, t long")
    mem = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "node long, f array<float>")
    ef = spark.createDataFrame([(0, [7.0])], "eid long, f array<float>")
    mails = memory.build_mails(edges, mem, ef, 1, 1)
    first = mails.filter("batch = 0").orderBy("pos").collect()
    assert [(r.pos, r.node, r.t, list(r.mail)) for r in first] == [(0, 1, 10, [1.0, 2.0, 7.0]), (1, 2, 10, [2.0, 1.0, 7.0]), (2, 1, 20, [1.0, 0.0, 0.0]), (3, 3, 20, [0.0, 1.0, 0.0])]
    last = memory.last_per_batch(mails)
    assert {(r.batch, r.pos) for r in last.filter("node = 1").collect()} == {(b, 2) for b in range(4)}
    box = {(r.slot, r.batch) for r in memory.mailbox(last, 3).filter("node = 1").collect()}
    assert box == {(0, 3), (1, 1), (2, 2)}
    assert {r.node: r.next_pos for r in memory.next_slots(last, 3).collect()} == {1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        memory.mean_delivered(last, 3, "self")
    with pytest.raises(ValueError):
        MemorySettings(combine="mean")


def test_state_is_read_before_the_batch(spark):
    writes = spark.createDataFrame([(0, 1, "a"), (2, 1, "b")], "batch long, node long, v string")
    reads = spark.createDataFrame([(k, b, 1) for k, b in enumerate([0, 1, 2, 3])] + [(9, 5, 4)], "k long, batch long, node long")
    for span in (1, 2, 1000):
        got = {r.k: r.v for r in memory.state_before(writes, reads, ["k"], ["v"], span).collect()}
        assert got == {0: None, 1: "a", 2: "a", 3: "b", 9: None}


def plain_fold(rows, f, settings, width, edge_width, time_width, routes=None):
    """The history by its definition, one node at a time: {(node, batch): (mem, mem_t, mails, mail_t, next_pos)}."""
    deep = 2 * width + edge_width
    state, out = {}, {}
    blank = lambda: [np.zeros(width), 0, np.zeros((settings.slots, deep)), np.zeros(settings.slots), 0]
    for b in sorted({r[0] for r in rows}):
        before = {n: [x.copy() if hasattr(x, "copy") else x for x in s] for n, s in state.items()}
        wrote, sent = {}, []
        for _, p, eid, src, dst, t in sorted(r for r in rows if r[0] == b):
            new = {}
            for n in (src, dst):
                mem, mem_t, box, box_t, _ = before.get(n) or blank()
                new[n] = L.updated_memory(settings.updater, mem[None], np.array([float(mem_t)]), box[None], box_t[None], np.array([float(t)]), time_width)[0]
            for end, (n, other) in enumerate(((src, dst), (dst, src))):
                wrote[n] = (new[n], t)
                mail = np.concatenate([new[n], new[other], f.get(eid, np.zeros(edge_width))])
                sent += [(to, mail, t) for to in [n, *((routes or {}).get((b, 2 * p + end), []) if settings.deliver_to == "neighbors" else [])]]
        for n, (mem, t) in wrote.items():
            state.setdefault(n, blank())[:2] = [mem, t]
        for n in {x[0] for x in sent}:
            got = [x for x in sent if x[0] == n]
            s = state.setdefault(n, blank())
            mean = settings.combine == "mean"
            s[2][s[4]], s[3][s[4]] = (np.mean([x[1] for x in got], 0), np.mean([x[2] for x in got])) if mean else got[-1][1:]
            s[4] = (s[4] + 1) % settings.slots
        for n in {*wrote, *(x[0] for x in sent)}:
            mem, mem_t, box, box_t, at = state[n]
            out[n, b] = (mem.copy(), mem_t, box.copy(), box_t.copy(), at)
    return out


SETTINGS = [MemorySettings(), MemorySettings(updater="rnn", slots=3), MemorySettings("neighbors", "last", 3, "transformer", False), MemorySettings("neighbors", "mean", 2, "gru")]


@pytest.mark.parametrize("kind", SETTINGS, ids=lambda s: f"{s.deliver_to} {s.combine} {s.slots} {s.updater}")
@pytest.mark.parametrize("most", [1, 12])
def test_history_by_definition(spark, kind, most):
    """In stretches of one and of some batches, with the state put together every two stretches."""
    rng = np.random.default_rng(5)
    rows = [(b, p, 20 * b + p, int(rng.integers(0, 9)), int(rng.integers(0, 9)), 100 * b + p) for b in (0, 1, 2, 4, 5, 6) for p in range(5)]
    f = {i: np.array([float(i % 7), 1.0]) for i in range(0, 140, 2)}
    sends = {(b, 2 * p + e): [int(x) for x in rng.integers(0, 12, rng.integers(0, 3))] for b, p, *_ in rows for e in (0, 1)}
    routes = spark.createDataFrame([(b, pos, n, i) for (b, pos), to in sends.items() for i, n in enumerate(to)], "batch long, pos long, node long, nbr_pos int")
    edges = spark.createDataFrame(rows, "batch long, edge_pos long, eid long, src long, dst long, t long")
    ef = spark.createDataFrame([(i, x.tolist()) for i, x in f.items()], "eid long, f array<float>")
    want = plain_fold(rows, f, kind, 4, 2, 3, sends)
    got = memory.history(edges, ef, kind, 4, 2, 3, routes, most_edges=most, compact=2)
    rows_got = {(r.node, r.batch): r for r in got.collect()}
    assert set(rows_got) == set(want)
    for k, (mem, mem_t, box, box_t, at) in want.items():
        r = rows_got[k]
        assert np.allclose(r.mem, mem) and r.mem_t == mem_t and np.allclose(r.mails, box) and np.allclose(r.mail_t, np.floor(box_t)) and r.next_pos == at, k
    assert memory.history(edges.limit(0), ef, kind, 4, 2, 3, routes).count() == 0


def test_inputs_see_what_earlier_batches_left(spark):
    edges = spark.createDataFrame([(0, 0, 0, 1, 2, 5), (1, 0, 1, 1, 3, 9)], "batch long, edge_pos long, eid long, src long, dst long, t long")
    ef = spark.createDataFrame([(0, [1.0])], "eid long, f array<float>")
    past = memory.history(edges, ef, MemorySettings(), 2, 1)
    occ = spark.createDataFrame([(0, 1, 5), (1, 1, 9), (1, 1, 9), (2, 1, 20), (2, 7, 20)], "batch long, node long, t long")
    got = {(r.batch, r.node): r for r in memory.inputs(occ, past, MemorySettings(), 2, 1).collect()}
    assert len(got) == 4 and got[0, 1].mem_t is None and got[1, 1].mem_t == 5 and got[2, 1].mem_t == 9 and got[2, 7].mem_t is None
    zero = L.updated_memory("gru", np.zeros((1, 2)), np.zeros(1), np.zeros((1, 1, 5)), np.zeros((1, 1)), np.array([20.0]), 4)[0]
    assert np.allclose(got[2, 7].mem, zero)
    assert np.allclose(got[1, 1].mem, plain_fold([(0, 0, 0, 1, 2, 5), (1, 0, 1, 1, 3, 9)], {0: np.ones(1)}, MemorySettings(), 2, 1, 4)[1, 1][0])


def test_late_filled_mails_equal_built_ones(spark):
    edges = spark.createDataFrame([(0, 0, 0, 1, 2, 5), (1, 0, 1, 1, 3, 9)], "batch long, edge_pos long, eid long, src long, dst long, t long")
    mem, ef = spark.createDataFrame([(1, [1.0, 2.0])], "node long, f array<float>"), spark.createDataFrame([(1, [7.0])], "eid long, f array<float>")
    one = memory.build_mails(edges, mem, ef, 2, 1).select("batch", "pos", "node", "t", "mail").collect()
    two = memory.with_mails(memory.mail_rows(edges), mem, ef, 2, 1).select("batch", "pos", "node", "t", "mail").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 4


def test_gathers_by_ratio_are_alike(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(40)], "k int, node long")
    f = spark.createDataFrame([(n, [float(n)]) for n in range(5)], "id long, f array<float>")
    hot = spark.createDataFrame([(1,), (6,), (1,)], "id long")
    want = sorted(map(str, rows.join(f.withColumnRenamed("id", "node"), "node", "left").select("k", "node", "f").collect()))
    for ratio, h, most in ((1.0, None, 64 << 20), (1.0, None, 1), (0.5, hot, 64 << 20), (0.5, hot, 1), (0.0, None, 1)):
        assert sorted(map(str, hotset.gathered(rows, f, "node", "id", ratio, h, most).select("k", "node", "f").collect())) == want
    hit = hotset.hit_or_miss(rows, hot, f, "node", "id")
    assert sorted(map(str, hit.select("k", "node", "f").collect())) == want and {r.node for r in hit.filter("hit").collect()} == {1, 6}


def test_metrics_against_definitions(spark):
    rng = np.random.default_rng(2)
    rows = [(b, i, int(rng.random() < 0.4), float(rng.integers(0, 6)) / 5) for b in range(3) for i in range(40)] + [(7, 0, 1, 0.5), (8, 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "batch long, edge_pos long, label int, score double")
    ap = {r.batch: r.ap for r in metrics.average_precision(df).collect()}
    auc = {r.batch: r.auc for r in metrics.roc_auc(df).collect()}
    for b in range(3):
        y = np.array([r[2] for r in rows if r[0] == b])
        s = np.array([r[3] for r in rows if r[0] == b])
        pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
        assert np.isclose(auc[b], np.mean(pairs))
        want, before = 0.0, 0.0
        for th in sorted(set(s), reverse=True):
            recall = (y[s >= th] == 1).sum() / y.sum()
            want += (recall - before) * (y[s >= th] == 1).mean()
            before = recall
        assert np.isclose(ap[b], want)
    assert auc[7] is None and auc[8] is None and ap[7] == 1.0 and ap[8] is None
    mrr = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 0, 0.6), (0, 0, 0, 0.5), (0, 1, 1, 0.1)], "batch long, edge_pos long, label int, score double")
    assert sorted(r.rr for r in metrics.reciprocal_ranks(mrr).collect()) == [0.5, 1.0]
    assert metrics.average_precision(df.limit(0)).count() == 0


def test_pairing_is_best():
    import itertools
    import random

    rng = random.Random(1)
    for n in (2, 3, 4, 5, 6):
        w = {(i, j): rng.randint(0, 9) for i in range(n) for j in range(n)}
        gain = lambda p: sum(w[(i, j)] for i, j in enumerate(p) if j >= 0)
        p = topology.pairing(w, n)
        assert sum(x == -1 for x in p) == n % 2 and all(p[p[i]] == i for i in range(n) if p[i] >= 0)
        best = 0
        for perm in itertools.permutations(range(n)):
            q = [-1] * n
            for a, b in zip(perm[::2], perm[1::2]):
                q[a], q[b] = b, a
            best = max(best, gain(q))
        assert gain(p) == best
    big = topology.pairing({(i, i + 1): 5 for i in range(0, 20, 2)}, 20)
    assert all(big[i] == i + 1 for i in range(0, 20, 2))
    chain = {(i, i + 1): 10 + (i % 2) for i in range(29)}  # both ends of the chain are left to each other
    best = topology.pairing(chain, 30)
    assert sum(chain.get((i, j), 0) + chain.get((j, i), 0) for i, j in enumerate(best) if i < j) == 154  # 14 of the heavier edges


def test_capacities():
    assert hotset.capacity(10, 20, 8, 4, 0.5) == 20 and hotset.capacity(10, 20, 8, 4, 1.0, most_bytes=400) == 24
    assert hotset.node_first_split(10, 20, 15) == (10, 5) and hotset.proportional_split(10, 30, 20) == (5, 15)


def test_timers_and_adam(spark):
    adam, w = training.Adam(2, 0.1), np.array([3.0, -2.0])
    for _ in range(200):
        w = adam.step(w, 2 * w)
    assert np.abs(w).max() < 0.1
    t = training.StageTimers()
    with t.stage("sample"):
        pass
    assert set(t.means()) == {"sample"}


def test_settings():
    s = settings("DySAT", (5,), (4, 6), batch_rows=10)
    assert s.preset.fanout == (5,) and s.preset.snapshots == 3 and s.batch_rows == 10 and s.preset.time_width == 0 and s.preset.out_width == 6
    assert settings("TGAT", widths=(0, 6)).preset.time_width == 0


@pytest.mark.parametrize("kind", SETTINGS, ids=lambda s: f"{s.deliver_to} {s.combine} {s.slots} {s.updater}")
def test_fold_answers_reads_and_ends_without_history(spark, kind):
    rng = np.random.default_rng(8)
    rows = [(b, p, 20 * b + p, int(rng.integers(0, 9)), int(rng.integers(0, 9)), 100 * b + p) for b in (1, 2, 4, 5) for p in range(4)]
    routes = spark.createDataFrame([(b, 2 * p + e, int(rng.integers(0, 12)), 0) for b, p, *_ in rows for e in (0, 1)], "batch long, pos long, node long, nbr_pos int")
    edges = spark.createDataFrame(rows, "batch long, edge_pos long, eid long, src long, dst long, t long")
    ef = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(0, 140, 2)], "eid long, f array<float>")
    asked = [(b, int(n), 100 * b + 7) for b in (0, 1, 2, 3, 5, 9) for n in (*rng.integers(0, 12, 3), 50)]
    reads = spark.createDataFrame([*asked, asked[0]], "batch long, node long, t long")
    past = memory.history(edges, ef, kind, 4, 2, 3, routes)
    want = {(r.batch, r.node, r.t): (r.mem, r.mem_t or 0) for r in memory.inputs(reads, past, kind, 4, 2, 3).collect()}
    rows = memory.answers(reads, edges, ef, kind, 4, 2, 3, routes, most_edges=5, compact=1).collect()
    got = {(r.batch, r.node, r.t): (r.mem, r.mem_t) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(np.allclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)
    end = {r.node: r for r in memory.state_at_end(edges, ef, kind, 4, 2, 3, routes, most_edges=5, compact=1).collect()}
    last = {r.node: r for r in memory.state_after(past).collect()}
    assert set(end) == set(last) and all(np.allclose(end[n].mem, last[n].mem) and np.allclose(end[n].mails, last[n].mails) and end[n][5:] == last[n][5:] for n in last)
    assert memory.answers(reads, edges.limit(0), ef, kind, 4, 2, 3, routes).count() == len(want)


def test_mails_to_oneself_are_sorted_once(monkeypatch):
    """A batch of delivery to oneself looks for last writes once, and leaves what the general way leaves."""
    rng = np.random.default_rng(2)
    ends, t, f = rng.integers(0, 9, 20), rng.integers(0, 50, 20).astype(float), rng.normal(size=(20, 2))
    folds = [memory._Fold(np.arange(9), pa.table({}), MemorySettings(to, slots=2), 4, 10, 3) for to in ("self", "neighbors")]
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: (calls.append(1), unique(*a, **k))[1])
    for batch in range(3):
        changed = [x.take(batch, ends, t, f, ends, np.arange(20)) for x in folds[:1]]
    assert len(calls) == 3
    for batch in range(3):
        assert (folds[1].take(batch, ends, t, f, ends, np.arange(20)) == changed[0]).all()
    for x in ("mem", "mem_t", "box", "box_t", "next", "batch"):
        assert np.array_equal(getattr(folds[0], x), getattr(folds[1], x)), x


@pytest.mark.parametrize("kind", [MemorySettings("neighbors", "last", 3, "transformer", False), MemorySettings("neighbors", "last", 1, "gru")], ids=lambda s: s.updater)
@pytest.mark.parametrize("chunk", [1, 9, 1000])
def test_mailboxes_by_definition(monkeypatch, kind, chunk):
    """Instants over several batches and chunks, a hub, nodes let go of, and a pool that is too small at first."""
    monkeypatch.setattr(mailboxes, "CHUNK", chunk)
    monkeypatch.setattr(mailboxes, "POOL", 2)
    rng = np.random.default_rng(3)
    n, k = 90, 2
    times = np.sort(np.r_[rng.integers(0, 60, n - 25), np.full(25, 30)])
    edges = [(i // 4, i % 4, i, int(rng.integers(0, 9)) if i % 3 else 0, int(rng.integers(0, 12)), int(t)) for i, t in enumerate(times)]
    f = {i: np.array([float(i % 7), 1.0]) for i in range(0, n, 2)}
    recent = lambda node, t: [x[4] for x in sorted((x for x in edges if x[3] == node and x[5] < t), key=lambda x: (x[5], x[2]), reverse=True)[:k]]
    want = plain_fold(edges, f, kind, 4, 2, 3, {(b, 2 * p + e): recent(x[e], t) for b, p, _, *x, t in edges for e in (0, 1)})
    reads = sorted({(int(rng.integers(0, 26)), int(rng.integers(0, 14)), int(rng.integers(0, 90))) for _ in range(60)})
    last = {}
    for b, node in [(x[0], y) for x in edges for y in x[3:5]] + [x[:2] for x in reads]:
        last[node] = max(b, last.get(node, 0))
    rows = [(b, p, s, d, t, f[i].tolist() if i in f else None) for b, p, i, s, d, t in edges] + [(b, None, x, None, t, None) for b, x, t in reads] + [(b, None, x, None, None, None) for x, b in last.items()]
    rows.sort(key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    types = [pa.int64()] * 5 + [pa.list_(pa.float32())]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["batch", "edge_pos", "src", "dst", "t", "f"])
    got = {(r["batch"], r["node"], r["t"]): (r["mem"], r["mem_t"]) for b in mailboxes._folded(iter(table.to_batches(5)), kind, k, 4, 2, 3) for r in b.to_pylist()}
    assert set(got) == set(reads)
    for b, node, t in reads:
        seen = [x for x in want if x[0] == node and x[1] < b]
        mem, mem_t, box, box_t, _ = want[max(seen, key=lambda x: x[1])] if seen else (np.zeros(4), 0, np.zeros((kind.slots, 10)), np.zeros(kind.slots), 0)
        new = L.updated_memory(kind.updater, mem[None], np.array([float(mem_t)]), box[None], box_t[None], np.array([float(t)]), 3)[0]
        assert np.allclose(got[b, node, t][0], new) and got[b, node, t][1] == mem_t, (b, node, t)
