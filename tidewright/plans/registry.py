"""Query registration: a name, a Spark plan and, where possible, the SQL that must agree."""

from pyspark.sql import SparkSession

QUERIES = {}
ORACLES = {}


class Tables:
    """Lazy access to one scale-factor folder: ``Tables(spark, path).events``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(name, sql=None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
