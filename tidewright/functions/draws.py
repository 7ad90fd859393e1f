"""Random draws as pure functions of (seed, id, draw number).

The mixing is 32-bit multiply and xor-shift, so the same draw has the same value in every partitioning,
on every retry, and in plain SQL.
"""

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier of the public 32-bit integer mixing function and the word mask.
MULTIPLIER = 73244475
MASK = 4294967295


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _mix(x: Column) -> Column:
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw(seed, *parts) -> Column:
    """A whole number in [0, 2^32) that depends on the seed and every part."""
    word = lambda p: _col(p).cast("bigint").bitwiseAND(F.lit(MASK))
    return reduce(lambda h, p: _mix((h * 31 + word(p)).bitwiseAND(F.lit(MASK))), parts, word(seed))


def uniform(seed, *parts) -> Column:
    """A number in [0, 1)."""
    return draw(seed, *parts) / F.lit(4294967296.0)


def between(low, high, seed, *parts) -> Column:
    return _col(low) + (_col(high) - _col(low)) * uniform(seed, *parts)


def whole(low, high, seed, *parts) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return (_col(low) + F.floor((_col(high) - _col(low) + 1) * uniform(seed, *parts))).cast("bigint")


def weighted(weights: dict, seed, *parts) -> Column:
    """One of the keys of ``weights``, drawn by weight."""
    return _pick(weights, uniform(seed, *parts))


def normal(seed, *parts) -> Column:
    """A standard normal number from two uniform draws."""
    u = (draw(seed, *parts, 1) + 1) / F.lit(4294967297.0)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * uniform(seed, *parts, 2))




def sql_draw(seed, *parts) -> str:
    """The same draw as a SQL expression (DuckDB dialect)."""

    def mix(e):
        for _ in range(2):
            e = f"((xor({e}, ({e}) >> 16) * {MULTIPLIER}) & {MASK})"
        return f"xor({e}, ({e}) >> 16)"

    word = lambda p: f"(CAST({p} AS BIGINT) & {MASK})"
    return reduce(lambda h, p: mix(f"(({h} * 31 + {word(p)}) & {MASK})"), parts, word(seed))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Draws:
    """Numbered draws for one seed and id column, for generators that need many of them.

    Every named use has its own number; the hash is Spark's own, one cheap expression per draw.
    """

    def __init__(self, seed: int, id: str):
        self.seed, self.id, self.names = seed, F.col(id), {}

    def uniform(self, name, *parts):
        number = self.names.setdefault(name, len(self.names) + 1)
        mixed = F.xxhash64(F.lit(self.seed), self.id, F.lit(number), *[_col(p).cast("bigint") for p in parts])
        return mixed.bitwiseAND(F.lit(MASK)) / F.lit(4294967296.0)

    def between(self, low, high, name, *parts):
        return _col(low) + (_col(high) - _col(low)) * self.uniform(name, *parts)

    def whole(self, low, high, name, *parts):
        return (_col(low) + F.floor((_col(high) - _col(low) + 1) * self.uniform(name, *parts))).cast("bigint")

    def normal(self, name, *parts):
        u = 1.0 - self.uniform(name, *parts)
        return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * self.uniform(name + " turn", *parts))

    def weighted(self, weights: dict, name, *parts):
        upto = np.cumsum([w / float(sum(weights.values())) for w in list(weights.values())[:-1]]).tolist()
        literal = lambda k: f"'{k}'" if isinstance(k, str) else repr(k)
        names, borders = F.expr(f"array({', '.join(map(literal, weights))})"), F.expr(f"CAST(array({', '.join(f'{x!r}D' for x in upto)}) AS array<double>)")
        return let(self.uniform(name, *parts), lambda u: F.get(names, F.size(F.filter(borders, lambda b: b <= u))))


def _pick(weights: dict, u: Column) -> Column:
    total, upto, out = float(sum(weights.values())), 0.0, None
    for name, weight in list(weights.items())[:-1]:
        upto += weight / total
        out = F.when(u < upto, F.lit(name)) if out is None else out.when(u < upto, F.lit(name))
    last = F.lit(list(weights)[-1])
    return last if out is None else out.otherwise(last)
