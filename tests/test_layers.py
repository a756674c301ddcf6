"""Layers by their definition, one root and neighbour at a time, and gradients against finite differences."""

import numpy as np
import pytest

from chronoweave.operators import layers as L

SHAPES = [L.Layer(3, 2, 4, 2, 6), L.Layer(3, 2, 0, 1, 4), L.Layer(0, 2, 0, 2, 4), L.Layer(3, 0, 1, 2, 4), L.Layer(0, 0, 2, 2, 4), L.Layer(0, 2, 3, 2, 4), L.Layer(3, 0, 0, 1, 4), L.Layer(3, 2, 4, 2, 6, True), L.Layer(0, 2, 4, 2, 6, True)]


def sample(layer, seed=0, n=5, k=3):
    rng = np.random.default_rng(seed)
    mask = rng.random((n, k)) < 0.7
    mask[0] = False
    return rng.normal(size=(n, layer.node)), rng.normal(size=(n, k, layer.node)), rng.normal(size=(n, k, layer.edge)), rng.integers(0, 50, (n, k)).astype(float), mask


@pytest.mark.parametrize("layer", SHAPES, ids=str)
def test_forward_by_definition(layer):
    w = L.initial_layer(layer)
    own, nbr, edge, dt, mask = sample(layer)
    got, _ = L.forward(w, layer, own, nbr, edge, dt, mask)
    for i in range(len(own)):
        q = np.concatenate([own[i], np.cos(w["phase"])]) @ w["wq"].T + w["bq"]
        sides = [np.concatenate([nbr[i, j], edge[i, j], np.cos(dt[i, j] * w["freq"] + w["phase"])]) for j in np.flatnonzero(mask[i])]
        agg = np.zeros(layer.out)
        width = layer.out // layer.heads
        for h in range(layer.heads):
            part = slice(h * width, (h + 1) * width)
            s = np.array([q[part] @ (x @ w["wk"].T + w["bk"])[part] for x in sides])
            s = np.where(s > 0, s, 0.2 * s)
            for a, x in zip(np.exp(s) / np.exp(s).sum() if len(s) else [], sides):
                agg[part] += a * (x @ w["wv"].T + w["bv"])[part]
        x = np.maximum(np.concatenate([agg, own[i]]) @ w["wo"].T + w["bo"], 0)
        assert np.allclose(got[i], (x - x.mean()) / np.sqrt(x.var() + 1e-5))


@pytest.mark.parametrize("layer", SHAPES, ids=str)
@pytest.mark.parametrize("drop", [False, True])
def test_gradients_equal_finite_differences(layer, drop):
    rng = np.random.default_rng(1)
    w = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in L.initial_layer(layer).items()}
    if layer.node + layer.time == 0:
        w["bq"] = np.ones(layer.out)
    own, nbr, edge, dt, mask = sample(layer, 2)
    drops = ((rng.random((5, 3, layer.heads)) < 0.8) / 0.8, (rng.random((5, layer.out)) < 0.8) / 0.8) if drop else None
    dh = rng.normal(size=(5, layer.out))
    loss = lambda: float((L.forward(w, layer, own, nbr, edge, dt, mask, drops)[0] * dh).sum())
    g, d_own, d_nbr = L.backward(w, layer, L.forward(w, layer, own, nbr, edge, dt, mask, drops)[1], dh)
    for name, values, grads in [*((k, w[k], g[k]) for k in w), ("own", own, d_own), ("nbr", nbr, d_nbr)]:
        if layer.node + layer.time == 0 and name == "bq":
            continue
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 7)]:
            was = values[at]
            values[at] = was + 1e-6
            up = loss()
            values[at] = was - 1e-6
            down = loss()
            values[at] = was
            assert np.isclose(grads[at], (up - down) / 2e-6, rtol=1e-3, atol=1e-4), name


def test_predictor_gradient():
    rng = np.random.default_rng(3)
    w = L.initial_predictor(4, 3)
    src, other, d = rng.normal(size=(6, 4)), rng.normal(size=(6, 4)), rng.normal(size=6)
    g, d_src, d_other = L.predict_backward(w, L.predict(w, src, other)[1], d)
    for values, grads in [*((w[k], g[k]) for k in w), (src, d_src), (other, d_other)]:
        at = (0,) * values.ndim
        was = values[at]
        values[at] = was + 1e-6
        up = L.predict(w, src, other)[0] @ d
        values[at] = was - 1e-6
        down = L.predict(w, src, other)[0] @ d
        values[at] = was
        assert np.isclose(grads[at], (up - down) / 2e-6, atol=1e-5)


def test_cells_keep_their_shapes_and_definition():
    x, h = np.random.default_rng(4).normal(size=(3, 5)), np.random.default_rng(5).normal(size=(3, 4))
    assert np.allclose(L.rnn_cell(x, h), np.tanh(x @ L.matrix(4, 5, 30).T + L.bias(4, 30) + h @ L.matrix(4, 4, 31).T + L.bias(4, 31)))
    s = lambda v: 1 / (1 + np.exp(-v))
    d = lambda v, i: v @ L.matrix(4, v.shape[1], i).T + L.bias(4, i)
    r, z = s(d(x, 20) + d(h, 23)), s(d(x, 21) + d(h, 24))
    assert np.allclose(L.gru_cell(x, h), (1 - z) * np.tanh(d(x, 22) + r * d(h, 25)) + z * h)
    one = L.transformer_cell(x[:, None, :], h)
    y = d(x, 42) + h
    assert np.allclose(one, np.maximum(d((y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5), 43), 0))
    assert L.frequencies(0).size == 0 and L.frequencies(1).tolist() == [1.0]
