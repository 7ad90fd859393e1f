"""Dense row numbers without putting a group, or the table, in one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BUCKETS, ROWS_PER_BUCKET = 4096, 65_536


def bucket_count(rows: int) -> int:
    """Hash buckets of a numbering: a power of two that depends on the row count alone, so reruns agree anywhere."""
    n = LEAST_BUCKETS
    while n * ROWS_PER_BUCKET < rows:
        n *= 2
    return n


def numbered(df: DataFrame, groups, order, weight: Column, buckets: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one, 0 for the first row of a group.

    Rows go by (hash bucket of ``order``, ``order``) inside ``groups``. Buckets are counted map-side, their offsets
    are a running total over one row per bucket, and only a bucket is sorted in a task. ``order`` must tell rows apart.
    """
    groups, order = list(groups), list(order)
    df = df.withColumns({"_w": weight.cast("bigint"), "_bucket": F.pmod(F.xxhash64(*order), F.lit(buckets))})
    line = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, "_bucket").agg(F.sum("_w").alias("_n"))
    starts = sums.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    body = df.withColumn("_before", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_bucket") == F.col("_b")]
    joined = body.join(starts, reduce(lambda a, b: a & b, same))
    kept = [c for c in df.columns if c not in ("_w", "_bucket")]
    return joined.select(*kept, (F.col("_start") + F.col("_before")).alias(out))
