"""Ordered per-key scans that never put a whole key in one task.

A plain window partitioned by a series id sends the series to a single task. Here each key is
cut into chunks of its order column; windows run inside (key, chunk), a summary with one row per
chunk carries what crosses chunk borders, and both meet again in an equi-join on (key, chunk).
A key that holds a third of all rows is therefore spread over as many tasks as it has chunks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def chunk_of(order, size) -> Column:
    """Chunk number of an integer-like order column."""
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def scan(df: DataFrame, keys, order, chunk: Column, lag=None, lead=None, last=None, next=None, cumsum=None) -> DataFrame:
    """Add ordered-scan columns to ``df``.

    ``keys``   columns that name a sequence; ``order`` columns that order it (unique within a key)
    ``chunk``  expression that grows with ``order`` and bounds the rows of one task
    ``lag``/``lead``  {new: column} value of the row before / after, NULL at the ends
    ``last``/``next`` {new: column} nearest non-null value at or before / at or after the row
    ``cumsum`` {new: column} running total up to and including the row
    """
    lag, lead, last, next, cumsum = (dict(m or {}) for m in (lag, lead, last, next, cumsum))
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    df = df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)  # one shuffle feeds windows and summary
    parts = Window.partitionBy(*keys, CHUNK)
    rows = parts.orderBy(*order)
    before = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    box = lambda c: F.struct(F.col(c).alias("v"))  # noqa: E731  NULL box = no neighbour row

    inner = {f"_i_{n}": F.lag(box(c)).over(rows) for n, c in lag.items()}
    inner |= {f"_i_{n}": F.lead(box(c)).over(rows) for n, c in lead.items()}
    inner |= {f"_i_{n}": F.last(c, ignorenulls=True).over(before) for n, c in last.items()}
    inner |= {f"_i_{n}": F.first(c, ignorenulls=True).over(after) for n, c in next.items()}
    inner |= {f"_i_{n}": F.sum(c).over(before) for n, c in cumsum.items()}
    body = df.withColumns(inner)

    at = F.struct(*[F.col(c) for c in order])
    seen = lambda c: F.when(F.col(c).isNotNull(), at)
    totals = [F.max_by(box(c), at).alias(f"_s_{n}") for n, c in lag.items()]
    totals += [F.min_by(box(c), at).alias(f"_s_{n}") for n, c in lead.items()]
    totals += [F.max_by(F.col(c), seen(c)).alias(f"_s_{n}") for n, c in last.items()]
    totals += [F.min_by(F.col(c), seen(c)).alias(f"_s_{n}") for n, c in next.items()]
    totals += [F.sum(c).alias(f"_s_{n}") for n, c in cumsum.items()]
    summary = df.groupBy(*keys, CHUNK).agg(*totals)

    line = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    later = line.rowsBetween(1, Window.unboundedFollowing)
    carry = [F.lag(f"_s_{n}").over(line).alias(f"_c_{n}") for n in lag]
    carry += [F.lead(f"_s_{n}").over(line).alias(f"_c_{n}") for n in lead]
    carry += [F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last]
    carry += [F.first(f"_s_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in next]
    carry += [F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in cumsum]
    carried = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"), *carry)

    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(CHUNK).eqNullSafe(F.col("_k_chunk"))]
    joined = body.join(carried, reduce(lambda a, b: a & b, same))
    out = {n: F.coalesce(f"_i_{n}", f"_c_{n}")["v"] for n in (*lag, *lead)}
    out |= {n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in (*last, *next)}
    zero = F.lit(0)
    out |= {n: F.coalesce(f"_i_{n}", zero) + F.coalesce(f"_c_{n}", zero) for n in cumsum}
    return joined.select(*[c for c in df.columns if c != CHUNK], *[e.alias(n) for n, e in out.items()])


def islands(df: DataFrame, keys, order, chunk: Column, value: str, starts, out="run_id") -> DataFrame:
    """Number the runs of a sequence from 1.

    ``starts(previous, current)`` is the condition under which a row opens a new run; the first
    row of a key always does.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    df = df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)  # one shuffle feeds windows and summary
    rows = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    at = F.struct(*[F.col(c) for c in order])
    previous = F.lag(F.struct(F.col(value).alias("v"))).over(rows)
    body = df.withColumn("_prev", previous).withColumn(
        "_open", F.when(F.col("_prev").isNull(), 0).when(starts(F.col("_prev.v"), F.col(value)), 1).otherwise(0)
    )
    body = body.withColumn("_opened", F.sum("_open").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    summary = body.groupBy(*keys, CHUNK).agg(
        F.min_by(F.struct(F.col(value).alias("v")), at).alias("_head"),
        F.max_by(F.struct(F.col(value).alias("v")), at).alias("_tail"),
        F.sum("_open").alias("_opens"),
    )
    line = Window.partitionBy(*keys).orderBy(CHUNK)
    before = F.lag("_tail").over(line)
    border = F.when(before.isNull(), 1).when(starts(before["v"], F.col("_head.v")), 1).otherwise(0)
    upto = summary.withColumn("_border", border).withColumn(
        "_base",
        F.sum(F.col("_border") + F.col("_opens")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_opens"),
    )
    carried = upto.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"), "_base")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(CHUNK).eqNullSafe(F.col("_k_chunk"))]
    joined = body.join(carried, reduce(lambda a, b: a & b, same))
    return joined.select(
        *[c for c in df.columns if c != CHUNK], (F.col("_base") + F.col("_opened")).cast("bigint").alias(out)
    )


def halo(df: DataFrame, order: str, size: int, reach: int) -> DataFrame:
    """Chunk rows by ``order`` and repeat those within ``reach`` of a border in the next chunk.

    A window over (key, ``_chunk``) with a frame no wider than ``reach`` then sees all it needs;
    keep the rows with ``_own``.
    """
    if reach > size:
        raise ValueError("reach must not exceed the chunk size")
    home = chunk_of(order, size)
    near = F.array_distinct(
        F.array(
            F.floor((F.col(order) - reach) / F.lit(size)).cast("bigint"),
            home,
            F.floor((F.col(order) + reach) / F.lit(size)).cast("bigint"),
        )
    )
    return df.withColumn(CHUNK, F.explode(near)).withColumn("_own", F.col(CHUNK) == home)
