"""Component, norm and acceptance queries over embeddings and windowed series."""

from pyspark.sql import functions as F

from tidewright.operators import matrix, series
from tidewright.plans.inputs import hourly
from tidewright.plans.registry import query


def labelled(t):
    """Embeddings as windows: the label is the channel."""
    return t.embeddings.select(
        F.col("label").alias("channel"), F.col("vec_id").alias("window"), F.transform("embedding", lambda x: x.cast("double")).alias("x")
    )


@query(
    "gram_matrix",
    """WITH v AS (SELECT label, vec_id, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT a.label AS channel, a.i, b.i AS j, round(sum(a.x * b.x), 6) AS g FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3""",
)
def gram_matrix(t):
    rows = matrix.gram(labelled(t))
    return rows.select("channel", "i", F.posexplode("row").alias("j", "g")).select("channel", "i", F.col("j").cast("bigint").alias("j"), F.round("g", 6).alias("g"))


@query(
    "explained_variance",
    """SELECT label AS channel, 64 AS n_components, round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS total, true AS ordered, 1.0::DOUBLE AS explained FROM embeddings GROUP BY 1""",
)
def explained_variance(t):
    parts = matrix.components(matrix.gram(labelled(t)))
    return parts.groupBy("channel").agg(
        F.count("*").cast("int").alias("n_components"), F.round(F.sum("eigenvalue"), 5).alias("total"),
        (F.max_by("component", F.struct("explained", "component")) == F.count("*") - 1).alias("ordered"), F.round(F.max("explained"), 6).alias("explained"),
    )


@query(
    "principal_round_trip",
    """SELECT label AS channel, vec_id AS "window", true AS same, 64 AS n FROM embeddings""",
)
def principal_round_trip(t):
    windows = matrix.durable(labelled(t))
    parts = matrix.durable(matrix.components(matrix.gram(windows)))
    lead = matrix.basis(parts, matrix.embedding_sizes(parts, dim=64))
    back = matrix.rebuild(matrix.embed(windows, lead), lead).withColumnRenamed("x", "y")
    gap = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b)))
    return windows.join(back, ["channel", "window"]).select("channel", "window", (gap < 1e-9).alias("same"), F.size("y").alias("n"))


def scaled_windows(t):
    cut = series.cut_windows(hourly(t), ["series_id"], None, 24, 200, 5, "maximize-overlap")
    fit = series.fit_scaler(cut, ["series_id"])
    scaled = series.scale(cut, fit, ["series_id"]).withColumnRenamed("series_id", "channel")
    return matrix.pack_windows(scaled), fit


@query("series_embedding")
def series_embedding(t):
    windows, _ = scaled_windows(t)
    windows = matrix.durable(windows)
    parts = matrix.durable(matrix.components(matrix.gram(windows)))
    scores = matrix.embed(windows, matrix.basis(parts, matrix.embedding_sizes(parts, 0.7)))
    return scores.select("channel", "window", F.transform("z", lambda v: F.round(v, 4)).alias("z"))


@query("filled_scores")
def filled_scores(t):
    windows, _ = scaled_windows(t)
    windows = matrix.durable(windows)
    parts = matrix.durable(matrix.components(matrix.gram(windows)))
    sizes = matrix.embedding_sizes(parts, 0.7)
    lead, full = matrix.basis(parts, sizes), matrix.basis(parts, sizes, "k_full")
    filled = matrix.fill_scores(matrix.embed(windows, lead), matrix.embed(windows, full), seed=1)
    return matrix.rebuild(filled, full, matrix.position_moments(windows)).select("channel", "window", F.transform("x", lambda v: F.round(v, 4)).alias("x"))


@query(
    "independent_round_trip",
    """SELECT label AS channel, vec_id AS "window", true AS same FROM embeddings""",
)
def independent_round_trip(t):
    windows = matrix.durable(labelled(t).withColumn("label", F.col("channel")).withColumn("channel", F.lit(0)))  # a label has fewer vectors than values
    embedded, mixing = matrix.independent_components(windows, 64, rounds=20)
    back = matrix.rebuild_independent(embedded, mixing).withColumnRenamed("x", "y")
    gap = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b)))
    return windows.join(back, ["channel", "window"]).select(F.col("label").alias("channel"), "window", (gap < 1e-8).alias("same"))


@query("independent_sizes")
def independent_sizes(t):
    return matrix.independent_size(labelled(t), 0.6)


NORMS_SQL = """norms AS (
  SELECT vec_id, 0 AS split, sqrt(list_sum(list_transform(CAST(embedding[1:24] AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings
  UNION ALL SELECT vec_id, 1, sqrt(list_sum(list_transform(CAST(embedding[25:64] AS DOUBLE[]), lambda x: x * x))) FROM embeddings),
fence AS (SELECT split, quantile_cont(norm, 0.25) - 0.5 * (quantile_cont(norm, 0.75) - quantile_cont(norm, 0.25)) AS low,
  quantile_cont(norm, 0.75) + 0.5 * (quantile_cont(norm, 0.75) - quantile_cont(norm, 0.25)) AS high FROM norms GROUP BY 1)"""


def norms(t):
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return matrix.split_norm_rows(rows, "vec_id", "v", [24, 40])


@query("norm_fence", f"WITH {NORMS_SQL} SELECT split, round(low, 6) AS low, round(high, 6) AS high FROM fence")
def norm_fence(t):
    return matrix.norm_fence(norms(t), 0.5).select("split", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("rows_in_fence", f"WITH {NORMS_SQL} SELECT vec_id FROM norms JOIN fence USING (split) GROUP BY 1 HAVING bool_and(norm >= low AND norm <= high)")
def rows_in_fence(t):
    return matrix.within_fence(norms(t), matrix.norm_fence(norms(t), 0.5), "vec_id")


@query("norm_diversity", f"WITH {NORMS_SQL} SELECT split, round(count(DISTINCT round(norm, 3)) / count(*), 6) AS diversity FROM norms GROUP BY 1")
def norm_diversity(t):
    return matrix.norm_diversity(norms(t)).withColumn("diversity", F.round("diversity", 6))


@query("accepted_rows")
def accepted_rows(t):
    columns = [f"v{i}" for i in range(64)]
    rows = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    accepted, _ = matrix.accept_batches(rows, matrix.sampled_rows(rows, "vec_id", columns, 3), "vec_id", columns, [24, 40], 0.0, 100)
    return accepted


@query("kernel_features")
def kernel_features(t):
    rows = matrix.kernel_features(labelled(t), 20)
    return rows.select("window", F.transform("features", lambda v: F.round(v, 5)).alias("features"))


@query("kernel_classes")
def kernel_classes(t):
    windows = matrix.durable(labelled(t).withColumn("label", F.col("channel").cast("double")))
    return matrix.train_kernel_classifier(windows, n_kernels=20)(windows).select("window", "label", "prediction")
