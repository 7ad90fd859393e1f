"""Sinks: appended JSON lines, Parquet, keyed folders, and a primary target with best-effort copies."""

import logging

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, mode="append") -> None:
    df.write.mode(mode).parquet(path)


def write_keyed(df: DataFrame, path: str, keys, mode="overwrite") -> None:
    """One folder per key value, such as person and day or part and room."""
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def write_all(df: DataFrame, primary, secondaries=()) -> list:
    """Write to ``primary(df)``, then to the others; a failing secondary is logged and returned, a failing primary raises."""
    df = df.persist()
    try:
        primary(df)
        failed = []
        for number, target in enumerate(secondaries):
            try:
                target(df)
            except Exception as error:  # noqa: BLE001  secondaries are best effort by contract
                log.warning("secondary target %d failed: %s", number, error)
                failed.append((number, error))
        return failed
    finally:
        df.unpersist()
