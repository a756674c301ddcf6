"""Layers as matrix products over batches: attention over padded neighbourhoods, edge predictor, recurrent cells, and gradients of the first two.

Weights are dictionaries of arrays; those of initial_* are functions of their place (functions.vectors.weight), which SQL and tests can state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLOPE, EPS = 0.2, 1e-5
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Layer:
    """Widths of an attention layer; 0 leaves a source out. combined: a projection per source, summed, in place of one over all."""

    node: int
    edge: int
    time: int
    heads: int = 2
    out: int = 100
    combined: bool = False

    def __post_init__(self) -> None:
        if self.node + self.edge + self.time == 0 or self.out % self.heads:
            raise ValueError("a layer needs at least one source, and out must be a multiple of heads")


def from_lists(column: pa.Array, width: int) -> np.ndarray:
    """A list column as (n, width); null lists are zeros."""
    out = np.zeros((len(column), width))
    if width and len(column):
        there = pc.is_valid(column).to_numpy(zero_copy_only=False)
        out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def to_lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), pa.float64()))


def matrix(rows: int, cols: int, seed: int) -> np.ndarray:
    r, c = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    return ((r * 31 + c * 17 + seed * 7) % 19 - 9) / 20.0


def bias(rows: int, seed: int) -> np.ndarray:
    return ((np.arange(rows) * 31 + 40 * 17 + seed * 7) % 19 - 9) / 20.0


def frequencies(width: int) -> np.ndarray:
    """10^(-9 j / (width - 1)): none for width 0, 1 for width 1."""
    return 10.0 ** (-9.0 * np.arange(width) / max(width - 1, 1))


def initial_layer(layer: Layer) -> Weights:
    """Seeds 1 to 4 for q, k, v and the output; combined layers have seeds of their own per source (q 21, 22; k 14 to 16; v 17 to 19)."""
    o, sides = layer.out, layer.node + layer.edge + layer.time
    w = {"wo": matrix(o, o + layer.node, 4), "bo": bias(o, 4), "gamma": np.ones(o), "beta": np.zeros(o), "freq": frequencies(layer.time), "phase": np.zeros(layer.time)}
    if layer.combined:
        parts = {"q": ((layer.node, 21), (0, 0), (layer.time, 22)), "k": ((layer.node, 14), (layer.edge, 15), (layer.time, 16)), "v": ((layer.node, 17), (layer.edge, 18), (layer.time, 19))}
        for name, of in parts.items():
            w[f"w{name}"] = np.concatenate([matrix(o, n, s) for n, s in of], 1)
            w[f"b{name}"] = sum((bias(o, s) for n, s in of if n), np.zeros(o))
    else:
        w |= {"wq": matrix(o, layer.node + layer.time, 1), "bq": bias(o, 1), "wk": matrix(o, sides, 2), "bk": bias(o, 2), "wv": matrix(o, sides, 3), "bv": bias(o, 3)}
    if layer.node + layer.time == 0:
        w["bq"] = np.ones(o)  # nothing to ask with: q is 1 everywhere
    return w


def initial_predictor(width: int, hidden: int) -> Weights:
    return {"ws": matrix(hidden, width, 9), "bs": bias(hidden, 9), "wd": matrix(hidden, width, 10), "bd": bias(hidden, 10), "wp": matrix(1, hidden, 11), "bp": bias(1, 11)}


def encode(w: Weights, dt: np.ndarray) -> np.ndarray:
    return np.cos(np.asarray(dt, float)[..., None] * w["freq"] + w["phase"])


def softmax(s: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Over axis 1, of the places of mask; zeros where a row has none."""
    s = np.where(mask, s, -np.inf)
    top = s.max(1, keepdims=True, initial=-np.inf)
    e = np.where(mask, np.exp(s - np.where(np.isfinite(top), top, 0.0)), 0.0)
    total = e.sum(1, keepdims=True)
    return e / np.where(total > 0, total, 1.0)


def normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = np.sqrt(x.var(-1, keepdims=True) + EPS)
    return (x - x.mean(-1, keepdims=True)) / spread, spread


def project(w: Weights, layer: Layer, own: np.ndarray, nbr: np.ndarray, edge: np.ndarray, dt: np.ndarray) -> dict[str, np.ndarray]:
    """q (n, out), k and v (n, k, out) and what they were made of."""
    asked = np.concatenate([own, np.broadcast_to(np.cos(w["phase"]), (len(own), layer.time))], 1)
    sides = np.concatenate([nbr, edge, encode(w, dt)], 2)
    return {"asked": asked, "sides": sides, "q": asked @ w["wq"].T + w["bq"], "k": sides @ w["wk"].T + w["bk"], "v": sides @ w["wv"].T + w["bv"]}


def attend(w: Weights, layer: Layer, p: dict[str, np.ndarray], mask: np.ndarray, dropped: np.ndarray | None = None) -> np.ndarray:
    """Multi-head aggregate (n, out): LeakyReLU(sum of q * k) without a divisor, softmax over the neighbours, weighted sum of v. Adds to p."""
    n, k = mask.shape
    heads = lambda x: x.reshape(*x.shape[:-1], layer.heads, -1)
    raw = (heads(p["q"])[:, None] * heads(p["k"])).sum(-1)
    a = softmax(np.where(raw > 0, raw, SLOPE * raw), mask[..., None])
    used = a if dropped is None else a * dropped
    p |= {"raw": raw, "a": a, "used": used, "att_drop": dropped}
    return (used[..., None] * heads(p["v"])).sum(1).reshape(n, layer.out)


def forward(w: Weights, layer: Layer, own: np.ndarray, nbr: np.ndarray, edge: np.ndarray, dt: np.ndarray, mask: np.ndarray, drops: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, dict]:
    """Embeddings (n, out) of roots from their padded neighbourhoods: own (n, node), nbr (n, k, node), edge (n, k, edge), dt and mask (n, k).

    LayerNorm(ReLU(W [aggregate, own])). drops: masks of attention (n, k, heads) and of the output (n, out), scaled, in training only.
    """
    p = project(w, layer, own, nbr, edge, dt)
    agg = attend(w, layer, p, mask, drops and drops[0])
    z = np.concatenate([agg, own], 1)
    x = z @ w["wo"].T + w["bo"]
    x = x if drops is None else x * drops[1]
    y, spread = normalised(np.maximum(x, 0.0))
    return y * w["gamma"] + w["beta"], p | {"z": z, "x": x, "y": y, "spread": spread, "out_drop": drops and drops[1], "dt": dt}


def backward(w: Weights, layer: Layer, c: dict, dh: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray]:
    """Gradients of the weights, of own and of nbr from that of the embeddings."""
    n, k = c["raw"].shape[:2]
    g: Weights = {"gamma": (dh * c["y"]).sum(0), "beta": dh.sum(0)}
    dy = dh * w["gamma"]
    dr = (dy - dy.mean(1, keepdims=True) - c["y"] * (dy * c["y"]).mean(1, keepdims=True)) / c["spread"]
    dx = dr * (c["x"] > 0)
    dx = dx if c["out_drop"] is None else dx * c["out_drop"]
    g |= {"wo": dx.T @ c["z"], "bo": dx.sum(0)}
    dz = dx @ w["wo"]
    d_own = dz[:, layer.out :].copy()
    heads = lambda x: x.reshape(*x.shape[:-1], layer.heads, -1)
    dagg = heads(dz[:, : layer.out])
    da = (dagg[:, None] * heads(c["v"])).sum(-1)
    da = da if c["att_drop"] is None else da * c["att_drop"]
    dv = (c["used"][..., None] * dagg[:, None]).reshape(n, k, layer.out)
    ds = c["a"] * (da - (c["a"] * da).sum(1, keepdims=True))
    ds = ds * np.where(c["raw"] > 0, 1.0, SLOPE)
    dq = (ds[..., None] * heads(c["k"])).sum(1).reshape(n, layer.out)
    dk = (ds[..., None] * heads(c["q"])[:, None]).reshape(n, k, layer.out)
    flat = lambda x: x.reshape(n * k, -1)
    g |= {"wq": dq.T @ c["asked"], "bq": dq.sum(0), "wk": flat(dk).T @ flat(c["sides"]), "bk": flat(dk).sum(0), "wv": flat(dv).T @ flat(c["sides"]), "bv": flat(dv).sum(0)}
    if layer.node + layer.time == 0:
        g["bq"] = np.zeros(layer.out)
    d_asked, d_sides = dq @ w["wq"], dk @ w["wk"] + dv @ w["wv"]
    d_own += d_asked[:, : layer.node]
    turn = -np.sin(c["dt"][..., None] * w["freq"] + w["phase"]) * d_sides[..., layer.node + layer.edge :]
    g["freq"] = (turn * c["dt"][..., None]).sum((0, 1))
    g["phase"] = turn.sum((0, 1)) + (-np.sin(w["phase"]) * d_asked[:, layer.node :]).sum(0)
    return g, d_own, d_sides[..., : layer.node]


def predict(w: Weights, src: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, dict]:
    """Scores (n): out(ReLU(src_fc(h_u) + dst_fc(h_v)))."""
    hid = np.maximum(src @ w["ws"].T + w["bs"] + other @ w["wd"].T + w["bd"], 0.0)
    return (hid @ w["wp"].T + w["bp"])[:, 0], {"src": src, "other": other, "hid": hid}


def predict_backward(w: Weights, c: dict, d: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray]:
    dhid = (d[:, None] * w["wp"]) * (c["hid"] > 0)
    g = {"wp": (d[:, None] * c["hid"]).sum(0)[None], "bp": d.sum(keepdims=True), "ws": dhid.T @ c["src"], "bs": dhid.sum(0), "wd": dhid.T @ c["other"], "bd": dhid.sum(0)}
    return g, dhid @ w["ws"], dhid @ w["wd"]


# ---- recurrent cells ------------------------------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@cache
def _fixed(out: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(matrix(out, width, seed).T), bias(out, seed)


def _dense(x: np.ndarray, out: int, seed: int) -> np.ndarray:
    w, b = _fixed(out, x.shape[-1], seed)
    return x @ w + b


def gru_cell(x: np.ndarray, h: np.ndarray, seed: int = 20) -> np.ndarray:
    """Gated recurrent unit: rows of x and h are samples; seeds + 0 to 2 for the input's r, z, n and + 3 to 5 for the state's."""
    d = h.shape[1]
    r, z = (_sigmoid(_dense(x, d, seed + i) + _dense(h, d, seed + 3 + i)) for i in (0, 1))
    return (1 - z) * np.tanh(_dense(x, d, seed + 2) + r * _dense(h, d, seed + 5)) + z * h


def rnn_cell(x: np.ndarray, h: np.ndarray, seed: int = 30) -> np.ndarray:
    return np.tanh(_dense(x, h.shape[1], seed) + _dense(h, h.shape[1], seed + 1))


def transformer_cell(slots: np.ndarray, h: np.ndarray, heads: int = 2, seed: int = 40) -> np.ndarray:
    """Attention of one memory over its mailbox slots (n, slots, width), then residual, LayerNorm, a dense layer and ReLU."""
    n, d = h.shape
    parts = lambda x: x.reshape(*x.shape[:-1], heads, -1)
    raw = (parts(_dense(h, d, seed))[:, None] * parts(_dense(slots, d, seed + 1))).sum(-1)
    a = softmax(np.where(raw > 0, raw, SLOPE * raw), np.ones((n, slots.shape[1], 1), bool))
    x = (a[..., None] * parts(_dense(slots, d, seed + 2))).sum(1).reshape(n, d) + h
    return np.maximum(_dense(normalised(x)[0], d, seed + 3), 0.0)


def transformer_by_slot(slots: np.ndarray, dt: np.ndarray, h: np.ndarray, time_width: int, heads: int = 2, seed: int = 40) -> np.ndarray:
    """transformer_cell of mailboxes (slots, n, width) and the encoding of dt (slots, n), slots first: the same sums as fewer and longer array operations."""
    many, n, width = slots.shape
    d = h.shape[1]
    (wk, bk), (wv, bv) = (_fixed(d, width + time_width, seed + i) for i in (1, 2))
    w = np.concatenate([wk, wv], 1)
    kv = slots.reshape(-1, width) @ w[:width]
    kv += np.cos(frequencies(time_width)[:, None] * dt.reshape(1, -1)).T @ w[width:]
    kv += np.concatenate([bk, bv])
    kv = kv.reshape(many, n, 2 * d)
    of_head = np.repeat(np.eye(heads), d // heads, 1)
    raw = ((kv[..., :d] * _dense(h, d, seed)).reshape(-1, d) @ of_head.T).reshape(many, n * heads)
    e = np.maximum(raw, SLOPE * raw)
    e -= e.max(0)
    np.exp(e, out=e)
    e /= e.sum(0)
    x = ((e.reshape(-1, heads) @ of_head).reshape(many, n, d) * kv[..., d:]).sum(0) + h
    return np.maximum(_dense(normalised(x)[0], d, seed + 3), 0.0)


def updated_memory(cell: str, mem: np.ndarray, mem_t: np.ndarray, mails: np.ndarray, mail_t: np.ndarray, t: np.ndarray, time_width: int) -> np.ndarray:
    """New memory of nodes seen at t: from the mailbox (n, slots, width) and the encoding of t - mem_t, for transformer that of t - mail_t per slot."""
    freq = frequencies(time_width)
    if cell == "transformer":
        return transformer_cell(np.concatenate([mails, np.cos((t[:, None] - mail_t)[..., None] * freq)], 2), mem)
    x = np.concatenate([mails.reshape(len(mem), -1), np.cos((t - mem_t)[:, None] * freq)], 1)
    return {"gru": gru_cell, "rnn": rnn_cell}[cell](x, mem)
