"""Helpers of the corpus operators: stored intermediates, row identity, hash codes of words."""

import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one inside the warehouse, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs one task's rerun."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text) -> Column:
    """A-Z to a-z; every other letter stays as it is."""
    return F.translate(text, UPPER, LOWER)


def text_hash(text="text") -> Column:
    """Two independent 64-bit hashes of a text; with doc_id they stand for the row. NULL and the empty text differ."""
    return F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


def doc_crc(doc_id="doc_id") -> Column:
    """CRC-32 of the id written as text, as the folds use it."""
    return F.crc32(F.col(doc_id).cast("string"))


class Codes(dict):
    """Remembers ``make(word)`` per word; forgets everything at ``most`` words, so its memory is bounded."""

    def __init__(self, make, most=400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets
