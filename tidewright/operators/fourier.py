"""Fourier transforms of long series, spread over the cluster in four steps.

A transform of M = R * C points is taken as a grid: every column of R points is transformed, turned by its twiddle factors,
the grid is dealt out again by rows, and every row of C points is transformed. The way back runs over the same rows first, so
two deals of the grid give a product of transforms. No task holds more than ``block`` points or one row or column of the grid.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "_n bigint, _m int, _part bigint, _at bigint, _a binary, _b binary"


def _grid(m: int, block: int):
    """(rows, columns, columns a task takes, rows a task takes) of a grid of 2^m points."""
    columns = 1 << (m // 2)
    rows = 1 << (m - m // 2)
    return rows, columns, min(columns, max(1, block // rows)), min(rows, max(1, block // columns))


def _turn(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """exp(-2 pi i a b / 2^m) for every pair, with the product reduced exactly first."""
    return np.exp(-2j * np.pi * ((a[:, None] * b[None, :]) & ((1 << m) - 1)) / (1 << m))


def chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i t^2 / n); the square is reduced exactly, for t below 2^31.5."""
    return np.exp(-1j * np.pi * ((t * t) % (2 * n)) / n)


def _named(pdf: pd.DataFrame, keys) -> dict:
    return {k: pdf[k].iloc[0] for k in keys}


def _pieces(pdf, keys, n, m, at, grids, size, axis) -> pd.DataFrame:
    """The grids cut along ``axis`` into parts of ``size``; ``_at`` says where a piece stands inside its part."""
    cut = lambda g: [np.ascontiguousarray(p).tobytes() for p in np.split(g, g.shape[axis] // size, axis=axis)]
    parts = [cut(g) for g in grids]
    out = {**_named(pdf, keys), "_n": n, "_m": m, "_part": np.arange(len(parts[0])), "_at": at, "_a": parts[0]}
    return pd.DataFrame({**out, "_b": parts[1] if len(parts) > 1 else [None] * len(parts[0])})


def _assembled(column, shape, axis) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.complex128).reshape(shape) for b in column], axis=axis)


def convolved(points: DataFrame, keys, kind: str, block: int) -> DataFrame:
    """``(keys..., pos, re, im)`` of gap-free series ``points(keys..., _n, _room, t, x)``, t from 0 to _n - 1.

    ``correlation``: the sums of x[t] * x[t + pos] for pos below _room - _n + 1. ``spectrum``: the transform of the series
    at its own length _n, for any length, as a convolution with a chirp. Every key needs more than one point.
    """
    keys = list(keys)
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.select(*keys).schema)
    room = F.col("_room") if kind == "correlation" else F.col("_n") * 2 - 1
    m = F.greatest(F.length(F.bin(room - 1)), F.lit(2)).cast("int")  # 2^m >= room
    placed = points.withColumn("_m", m)
    columns, rows = F.expr("shiftleft(1L, cast(_m div 2 AS int))"), F.expr("shiftleft(1L, cast(_m - _m div 2 AS int))")
    wide = F.least(columns, F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(block) / rows)))
    placed = placed.withColumn("_part", F.floor(F.pmod("t", columns) / wide))

    def by_column(pdf):
        n, m, part = int(pdf["_n"].iloc[0]), int(pdf["_m"].iloc[0]), int(pdf["_part"].iloc[0])
        n_rows, n_columns, wide, high = _grid(m, block)
        own = part * wide + np.arange(wide)
        t, x = pdf["t"].to_numpy(), pdf["x"].to_numpy()
        grid = np.zeros((n_rows, wide), np.complex128)
        grid[t // n_columns, t % n_columns - part * wide] = x * chirp(t, n) if kind == "spectrum" else x
        grids = [grid]
        if kind == "spectrum":  # the other side of the convolution is known from the length alone
            far = np.arange(n_rows)[:, None] * n_columns + own[None, :]
            far = np.minimum(far, (1 << m) - far)
            grids.append(np.where(far < n, np.conj(chirp(np.minimum(far, n), n)), 0))
        turn = _turn(np.arange(n_rows), own, m)
        return _pieces(pdf, keys, n, m, part, [np.fft.fft(g, axis=0) * turn for g in grids], high, 0)

    def by_row(pdf):
        pdf = pdf.sort_values("_at")
        n, m, part = int(pdf["_n"].iloc[0]), int(pdf["_m"].iloc[0]), int(pdf["_part"].iloc[0])
        n_rows, n_columns, wide, high = _grid(m, block)
        a = np.fft.fft(_assembled(pdf["_a"], (high, wide), 1), axis=1)
        if kind == "spectrum":
            product = a * np.fft.fft(_assembled(pdf["_b"], (high, wide), 1), axis=1)
        else:
            product = (a * np.conj(a)).astype(np.complex128)
        back = np.fft.ifft(product, axis=1) * np.conj(_turn(part * high + np.arange(high), np.arange(n_columns), m))
        return _pieces(pdf, keys, n, m, part, [back], wide, 1)

    def back_by_column(pdf):
        pdf = pdf.sort_values("_at")
        n, m, part = int(pdf["_n"].iloc[0]), int(pdf["_m"].iloc[0]), int(pdf["_part"].iloc[0])
        n_rows, n_columns, wide, high = _grid(m, block)
        y = np.fft.ifft(_assembled(pdf["_a"], (high, wide), 0), axis=0)
        pos = (part * wide + np.arange(wide))[None, :] + n_columns * np.arange(n_rows)[:, None]
        some = pos < n
        pos, y = pos[some], y[some]
        if kind == "spectrum":
            y = y * chirp(pos, n)
        return pd.DataFrame({**_named(pdf, keys), "pos": pos, "re": y.real, "im": y.imag})

    first = placed.select(*keys, "_n", "_m", "_part", "t", "x").groupBy(*keys, "_part").applyInPandas(by_column, shape + PIECES)
    second = first.groupBy(*keys, "_part").applyInPandas(by_row, shape + PIECES)
    return second.groupBy(*keys, "_part").applyInPandas(back_by_column, f"{shape}pos bigint, re double, im double")
