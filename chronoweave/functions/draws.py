"""Pseudo-random draws from keys in integer arithmetic: a rerun task draws the same, and SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def draw(a: Column, b: Column, seed: int, below: Column) -> Column:
    """A whole number from 0 to below-1 for the keys a and b; below must be at least 1."""
    first = F.pmod(F.pmod(a, F.lit(PRIME)) * 48271 + F.pmod(b, F.lit(PRIME)) * 40692 + seed * 69621 + 12345, F.lit(PRIME))
    return F.pmod(F.pmod(first * 16807 + F.pmod(a + b, F.lit(65521)) * 30323, F.lit(PRIME)), below)


def uniform(a: Column, b: Column, seed: int) -> Column:
    """A double in [-1, 1) for the keys."""
    return draw(a, b, seed, F.lit(2000000)) / F.lit(1000000.0) - F.lit(1.0)


def draw_sql(a: str, b: str, seed: int, below: str) -> str:
    """The same in SQL."""

    def mod(x: str, m: str) -> str:
        return f"((({x})::bigint % {m} + {m}) % {m})"

    first = mod(f"{mod(a, str(PRIME))} * 48271 + {mod(b, str(PRIME))} * 40692 + {seed * 69621 + 12345}", str(PRIME))
    return mod(mod(f"{first} * 16807 + {mod(f'({a}) + ({b})', '65521')} * 30323", str(PRIME)), f"({below})")


def uniform_sql(a: str, b: str, seed: int) -> str:
    return f"({draw_sql(a, b, seed, '2000000')} / 1000000.0::double - 1.0)"
