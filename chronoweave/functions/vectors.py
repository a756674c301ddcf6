"""Expressions over vectors held as arrays; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def weight(row: Column, col: Column, seed: int) -> Column:
    """Fixed small weight of a matrix cell, a function of its place: the library's untrained initial weights."""
    return (F.pmod(row * 31 + col * 17 + seed * 7, F.lit(19)) - 9) / F.lit(20.0)


def weight_sql(row: str, col: str, seed: int) -> str:
    return f"((({row} * 31 + {col} * 17 + {seed * 7}) % 19 - 9) / 20.0::double)"


def linear(x: Column, width: int, seed: int, bias: bool = True) -> Column:
    """Dense layer with the weights of weight(): one output per row of the matrix; the bias is column -1."""

    def cell(y: Column, r: Column) -> Column:
        s = F.aggregate(F.transform(y, lambda v, c: v.cast("double") * weight(r, c, seed)), F.lit(0.0), lambda a, b: a + b)
        return s + weight(r, F.lit(40), seed) if bias else s

    return bind(x, lambda y: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda r: cell(y, r)))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    def spread(y: Column, mean: Column) -> Column:
        return F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(y) + eps)

    return bind(x, lambda y: bind(total(y) / F.size(y), lambda m: bind(spread(y, m), lambda d: F.transform(y, lambda v: (v - m) / d))))


def time_encoding(t: Column, width: int) -> Column:
    """cos(t * w_j) with w_j = 10^(-9 j / (width - 1)), the initial frequencies of a learned time encoding; nothing for width 0, cos(t) for 1."""
    if width == 0:
        return F.array().cast("array<double>")
    return F.array(*(F.cos(t * 10.0 ** (-9.0 * j / max(width - 1, 1))) for j in range(width)))
