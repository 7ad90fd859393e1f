"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored
from tidewright.llm.numbering import bucket_count, numbered

STEPS = 3  # two rounds each
RUN = 65_536  # copies of a row that one array of a first explode stands for


def _once(p: Column, a: int, b: int, seed: int) -> Column:
    """One pass of a generalised Feistel network over Z_a x Z_b, which is a permutation of 0 .. a*b-1."""

    def step(acc, i):
        left = F.pmod(acc["l"] + F.pmod(F.xxhash64(F.lit(seed), i, acc["r"]), F.lit(a)), F.lit(a))
        right = F.pmod(acc["r"] + F.pmod(F.xxhash64(F.lit(seed + 1), i, left), F.lit(b)), F.lit(b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(p / F.lit(b)).cast("bigint").alias("l"), F.pmod(p, F.lit(b)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["l"] * F.lit(b) + acc["r"])


def permuted(row: Column, n: int, spark, seed: int) -> Column:
    """Where the permutation of 0 .. n-1 sends ``row``.

    The network permutes a*b >= n numbers; fewer than sqrt(n) + 1 of them lie outside. A number that lands outside
    walks on until it is inside. The longest walk is measured by jobs over the outside numbers: were there one of k + 1
    steps, its second number would have one of k, so the first length that nobody needs ends the search.
    """
    n = max(n, 1)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def walk(p, steps):
        return F.aggregate(F.array_repeat(F.lit(1), steps), p, lambda q, _: F.when(q < n, q).otherwise(_once(q, a, b, seed)))

    steps, outside = 1, spark.range(n, a * b)
    while n < a * b:
        if not outside.where((walk(F.col("id"), steps) < n) & (walk(F.col("id"), steps - 1) >= n)).limit(1).count():
            break
        steps += 1
    return walk(_once(row, a, b, seed), steps)


def shard_rows(df: DataFrame, shards: int, keep, seed: int = 42) -> DataFrame:
    """Deal rows into ``shards`` whose counts differ by one at most; returns ``keep`` + (shard int, slot long).

    The rows of ``keep`` (columns that can be grouped) are numbered 0 .. n-1 in an order that their values alone
    decide; the permutation sends number g to p, shard = p mod shards, slot = p div shards. Slots of a shard run
    from 0 without gaps, and the same rows get the same places on any cluster. Equal rows are counted before the
    shuffle and dealt like others: each copy has a place of its own. NULLs are values; an empty table gives no rows.
    Further columns of ``df`` are left out.
    """
    spark, keep = df.sparkSession, list(keep)
    rows = stored(df.groupBy(*keep).agg(F.count(F.lit(1)).alias("_copies")))
    n = rows.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    starts = numbered(rows, [], keep, F.col("_copies"), bucket_count(n), "_first")
    runs = starts.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / F.lit(RUN)).cast("bigint"))))
    last = F.least(F.col("_copies"), (F.col("_run") + 1) * RUN) - 1
    each = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN, last)))
    place = each.withColumn("_p", permuted(F.col("_first") + F.col("_copy"), n, spark, seed))
    return place.select(*keep, F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / F.lit(shards)).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Shards of whole documents by the ``rows`` law, with the size and checksum of each text.

    size = UTF-8 bytes + 1 (null text: 1); text_crc32 is NULL for a null text. grown_shard is NULL: this law moves rows
    when the number of shards changes.
    """
    facts = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("bigint").alias("text_crc32"),
    )
    placed = shard_rows(facts, shards, ["doc_id", "size", "text_crc32"], seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
