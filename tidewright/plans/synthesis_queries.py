"""Synthetic-series queries: one series per customer or supplier-part pair of the given tables."""

from pyspark.sql import functions as F

from tidewright.operators import synthesis as syn
from tidewright.plans.registry import query

LENGTH = "CASE c_custkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 60 WHEN 2 THEN 128 ELSE 256 END"


def ids(t):
    return t.customer.select(F.col("c_custkey").alias("series_id"), F.expr(LENGTH).alias("seq_len"), F.col("c_mktsegment").alias("metric"))


@query("random_attributes")
def random_attributes(t):
    return syn.random_attributes(ids(t)).drop("metric")


@query("synthetic_series")
def synthetic_series(t):
    out = syn.synthesise(syn.random_attributes(ids(t), seed=3), seed=3)
    return out.select("series_id", "seq_len", "season", "trend", "frequency", "noise", F.transform("y", lambda v: F.round(v, 4)).alias("y"), "statistics.*")


@query("synthetic_changes")
def synthetic_changes(t):
    out = syn.synthesise(syn.random_attributes(ids(t), seed=3), seed=3)
    c = out.select("series_id", F.explode("changes").alias("c"))
    return c.select("series_id", "c.type", "c.position_start", "c.position_end", F.round("c.amplitude", 3).alias("amplitude"))


@query("controlled_series")
def controlled_series(t):
    span = lambda a, b: (F.lit(a).cast("double"), F.lit(b).cast("double"))
    lo, hi = F.min("c_acctbal"), F.max("c_acctbal")
    metrics = t.customer.groupBy(F.col("c_mktsegment").alias("metric")).agg(
        (lo / 1000 + 2).alias("amplitude_min"), (hi / 1000 + 3).alias("amplitude_max"), lo.alias("bias_min"), hi.alias("bias_max"), span(8, 1)[0].alias("period_min"), span(20, 1)[0].alias("period_max"),
        F.array(F.lit("sin periodic fluctuation"), F.lit("square periodic fluctuation")).alias("season_types"), F.array(F.lit("increase"), F.lit("keep steady")).alias("trend_types"),
        F.array(F.lit("upward spike"), F.lit("shake")).alias("change_types_allowed"), span(1, 1)[0].alias("change_size_min"), span(4, 1)[0].alias("change_size_max"),
    )
    out = syn.synthesise(syn.controlled_attributes(ids(t), metrics, seed=5), seed=5)
    return out.select("series_id", "metric", "season", "trend", "frequency", "period", "overall_amplitude", F.transform("changes", lambda c: F.struct(c["type"].alias("type"), F.round(c["amplitude"], 2).alias("size"))).alias("changes"), F.transform("y", lambda v: F.round(v, 4)).alias("y"))


def systems(t):
    """Metric vocabularies: twenty neighbouring parts form a system, clustered by part type."""
    return t.part.select(
        F.floor(F.col("p_partkey") / 20).alias("system"), F.col("p_partkey").alias("metric_id"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("metric"), F.col("p_type").alias("cluster"),
    )


@query("metric_groups")
def metric_groups(t):
    return syn.metric_groups(systems(t), seed=2)


@query("correlated_changes")
def correlated_changes(t):
    members = syn.shared_positions(syn.metric_groups(systems(t), seed=2), 256, seed=2)
    rows = members.withColumn("seq_len", F.lit(256))
    attrs = syn.random_attributes(rows, seed=4, id="metric_id").withColumn(
        "change_types", F.when(F.size("change_positions") > 0, F.array(F.coalesce(F.get("change_types", F.lit(0)), F.lit("upward spike")))).otherwise(F.array().cast("array<string>"))
    )
    out = syn.synthesise(attrs, seed=4, id="metric_id")
    return out.select("system", "metric", "group_no", "group_position", "changes.position_start", F.transform("y", lambda v: F.round(v, 4)).alias("y"))


@query("correlated_shapes")
def correlated_shapes(t):
    members = syn.shared_shapes(syn.metric_groups(systems(t), seed=2), 256, seed=2).withColumn("seq_len", F.lit(256))
    attrs = syn.random_attributes(members.drop("trend"), seed=6, id="metric_id").withColumn("trend", F.lit("multiple"))
    out = syn.synthesise(attrs, seed=6, id="metric_id")
    return out.select("system", "metric", "group_no", F.transform("y", lambda v: F.round(v, 4)).alias("y"))
