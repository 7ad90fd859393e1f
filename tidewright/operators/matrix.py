"""Component embeddings of windowed series, their inverses, acceptance of generated rows, and a kernel classifier.

Windows are rows ``(channel, window, x)`` with ``x`` an array of one window's values. The window length is a
modelling parameter of at most a few thousand, so one Gram matrix fits a task; windows themselves never
gather in one place.
"""

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.draws import draw, whole
from tidewright.functions.encoding import norm
from tidewright.operators.scan import chunk_of, scan
from tidewright.operators.series import exact_quantiles
from tidewright.session import durable


def pack_windows(rows: DataFrame, value="scaled") -> DataFrame:
    """Long window rows ``(channel, window, pos, value)`` as one array per window."""
    packed = rows.groupBy("channel", "window").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("r"))
    return packed.select("channel", "window", F.col("r.v").alias("x"))


HELD_VALUES = 16_000_000  # matrix entries a task keeps before it passes its sums on
FAN_IN = 64  # partial sums that one task adds up


def gram(windows: DataFrame) -> DataFrame:
    """Rows ``(channel, i, row)`` of the channel's XᵀX.

    A task keeps one running product per channel over all its windows and passes it on once; the products are added in two
    levels, row by row of the matrix, so neither the number of windows nor that of channels gathers anywhere.
    """
    kind = windows.schema["channel"].dataType
    shape = T.StructType([T.StructField("channel", kind), T.StructField("i", T.LongType()), T.StructField("b", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType()))])

    def products(batches):
        task = TaskContext.get().partitionId() % FAN_IN
        held, size = {}, 0

        def rows():
            for channel, g in held.items():
                yield pd.DataFrame({"channel": [channel] * len(g), "i": np.arange(len(g)), "b": task, "row": list(g)})

        for pdf in batches:
            for channel, part in pdf.groupby("channel", sort=False)["x"]:
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part])
                if channel in held:
                    held[channel] += x.T @ x
                else:
                    held[channel] = x.T @ x
                    size += held[channel].size
            if size > HELD_VALUES:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[:1].copy()
        head["row"] = [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]
        return head

    parts = windows.select("channel", "x").mapInPandas(products, shape)
    return parts.groupBy("channel", "i", "b").applyInPandas(total, shape).groupBy("channel", "i").applyInPandas(total, shape).drop("b")


def components(gram_rows: DataFrame) -> DataFrame:
    """``(channel, component, eigenvalue, explained, vector)``, component 0 first; ``explained`` is cumulative."""

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf.sort_values("i")["row"].to_numpy())
        values, vectors = np.linalg.eigh(g)
        values, vectors = values[::-1], vectors[:, ::-1]
        flip = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        return pd.DataFrame(
            {
                "channel": pdf["channel"].iloc[0], "component": np.arange(len(values)), "eigenvalue": values,
                "explained": np.cumsum(values) / values.sum(), "vector": list((vectors * np.where(flip == 0, 1, flip)).T),
            }
        )

    channel = gram_rows.schema["channel"].dataType.simpleString()
    shape = f"channel {channel}, component bigint, eigenvalue double, explained double, vector array<double>"
    return gram_rows.groupBy("channel").applyInPandas(decompose, shape)


def embedding_sizes(parts: DataFrame, variance=0.7, dim="auto", full_variance=0.99) -> DataFrame:
    """``(channel, k, k_full)``: components for the wanted variance (at least 2), and for 99 %."""
    reach = lambda v: F.min(F.when(F.col("explained") >= v, F.col("component"))) + 1
    k = F.greatest(F.lit(2).cast("bigint"), reach(variance)) if dim == "auto" else F.lit(int(dim)).cast("bigint")
    sizes = parts.groupBy("channel").agg(k.alias("k"), reach(full_variance).alias("_full"))
    return sizes.select("channel", "k", F.greatest("_full", "k").alias("k_full"))


def basis(parts: DataFrame, sizes: DataFrame, size="k") -> DataFrame:
    """``(channel, basis)``: leading vectors per channel, strongest last."""
    kept = parts.join(sizes, "channel").where(F.col("component") < F.col(size))
    order = F.array_sort(F.collect_list(F.struct((-F.col("component")).alias("o"), "vector")))
    return kept.groupBy("channel").agg(F.transform(order, lambda s: s["vector"]).alias("basis"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def embed(windows: DataFrame, basis_rows: DataFrame) -> DataFrame:
    """``(channel, window, z)``: the scores of every window on its channel's basis."""
    joined = windows.join(basis_rows, "channel")
    return joined.select("channel", "window", F.transform("basis", lambda b: dot(b, F.col("x"))).alias("z"))


def rebuild(scores: DataFrame, basis_rows: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """``(channel, window, x)`` from scores: Z·Bᵀ, times deviation plus mean per position when ``moments`` are given.

    ``moments(channel, mu, sd)`` hold one array per channel.
    """
    joined = scores.join(basis_rows, "channel")
    n = F.size(F.get("basis", F.lit(0)))
    at = lambda p: F.aggregate(F.zip_with("z", "basis", lambda z, b: z * F.get(b, p)), F.lit(0.0), lambda s, v: s + v)
    x = F.transform(F.sequence(F.lit(0), n - 1), at)
    if moments is not None:
        joined = joined.join(moments, "channel")
        scaled = F.zip_with("_x", "sd", lambda v, s: v * s)
        return joined.withColumn("_x", x).select("channel", "window", F.zip_with(scaled, "mu", lambda v, m: v + m).alias("x"))
    return joined.select("channel", "window", x.alias("x"))


def fill_scores(generated: DataFrame, full: DataFrame, seed=0) -> DataFrame:
    """Generated leading scores completed with the weaker scores of a drawn original window.

    ``generated(channel, window, z)`` hold the k leading scores, ``full(channel, window, z)`` all of them, both
    strongest last. Originals are numbered from 1 without gaps, so every generated row of a known channel finds one.
    """
    numbered = scan(full.select("channel", "window", F.col("z").alias("_full"), F.lit(1).alias("_one")), ["channel"], "window", chunk_of("window", 10_000), cumsum={"_pick": "_one"})
    numbered = durable(numbered)
    sizes = numbered.groupBy("channel").agg(F.max("_pick").alias("_top"))
    drawn = generated.join(sizes, "channel").withColumn("_pick", whole(F.lit(1), F.col("_top"), seed, F.col("window")))
    joined = drawn.join(numbered.select("channel", "_pick", "_full"), ["channel", "_pick"])
    weak = F.slice("_full", F.lit(1), F.size("_full") - F.size("z"))
    return joined.select("channel", "window", F.concat(weak, F.col("z")).alias("z"))


def position_moments(windows: DataFrame) -> DataFrame:
    """Mean and population deviation per position, as one array per channel."""
    rows = windows.select("channel", F.posexplode("x").alias("pos", "v"))
    fit = rows.groupBy("channel", "pos").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    packed = fit.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("r"))
    return packed.select("channel", F.col("r.mu").alias("mu"), F.col("r.sd").alias("sd"))


BLOCK_WINDOWS = 4096  # windows that meet the matrices of their channel in one task


def _met_by_block(rows: DataFrame, matrices: DataFrame, work, shape: str) -> DataFrame:
    """``work(rows, matrices)`` for every block of rows ``(channel, window, ...)``, with the one row that ``matrices`` hold of its channel."""
    known = F.broadcast(rows.groupBy("channel").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_WINDOWS))).cast("int").alias("_parts")))  # one row per channel
    left = rows.join(known, "channel").withColumn("_part", F.pmod(F.xxhash64("window"), F.col("_parts").cast("bigint")).cast("int"))
    # new names on one side: both sides come from the same rows
    right = matrices.join(known, "channel").select(F.col("channel").alias("_of"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_at"), *[F.col(c).alias(f"m_{c}") for c in matrices.columns if c != "channel"])
    met = lambda a, m: work(a, m) if len(a) and len(m) else pd.DataFrame(columns=[f.split()[0].strip("`") for f in shape.split(", ")])
    return left.groupBy("channel", "_part").cogroup(right.groupBy("_of", "_at")).applyInPandas(met, shape)


def _stacked(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def independent_components(windows: DataFrame, k: int, rounds=200, tolerance=1e-4, seed=0):
    """``(embedded, mixing)`` by fixed-point independent component analysis with the log-cosh contrast.

    Windows are centred and whitened by their principal components; each round sums k-by-k statistics over all
    windows in the cluster, and only those small sums reach the driver. ``embedded`` is ``(channel, window, z)``,
    ``mixing`` is ``(channel, mixing, mean, converged)`` with ``mixing`` as k arrays of window length; ``converged`` is
    false when ``rounds`` ended the search.
    """
    mean = position_moments(windows).select("channel", "mu")
    centred = durable(windows.join(mean, "channel").select("channel", "window", F.zip_with("x", "mu", lambda a, b: a - b).alias("x")))
    parts = components(gram(centred)).where(F.col("component") < k)
    counts = centred.groupBy("channel").agg(F.count("*").alias("n"))
    scaled = parts.join(counts, "channel").withColumn("_s", F.sqrt(F.col("eigenvalue") / F.col("n")))
    order = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("component", v.alias("v")))), lambda s: s["v"])
    white = scaled.groupBy("channel").agg(
        order(F.transform("vector", lambda v: v / F.col("_s"))).alias("basis"),
        order(F.transform("vector", lambda v: v * F.col("_s"))).alias("colour"),
    )
    white = durable(white)
    kind, name = (centred.schema[c].dataType.simpleString() for c in ("channel", "window"))

    def whiten(part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        scores = _stacked(part["x"]) @ _stacked(of["m_basis"].iloc[0]).T
        return pd.DataFrame({"channel": [part["channel"].iloc[0]], "windows": [part["window"].to_numpy()], "z": [scores.tobytes()]})

    # a block of windows is one row, so that a round reads numbers and no arrays of them
    z = durable(_met_by_block(centred, white.select("channel", "basis"), whiten, f"channel {kind}, windows array<{name}>, z binary"))
    channels = [r[0] for r in counts.select("channel").collect()]  # channels are named parameters, few
    rng = np.random.RandomState(seed)
    turn = {c: _orthogonal(rng.normal(size=(k, k))) for c in channels}
    stat_shape = f"channel {kind}, i bigint, n bigint, dg double, gz array<double>"
    change = float("inf")
    for _ in range(rounds):
        current = dict(turn)

        def statistics(batches, current=current):
            for pdf in batches:
                for channel, held in zip(pdf["channel"], pdf["z"]):
                    x = np.frombuffer(held).reshape(-1, k)
                    g = np.tanh(x @ current[channel].T)
                    yield pd.DataFrame(
                        {"channel": channel, "i": np.arange(k), "n": len(x), "dg": (1 - g * g).sum(0), "gz": list(g.T @ x)}
                    )

        sums = z.mapInPandas(statistics, stat_shape).groupBy("channel", "i").agg(
            F.sum("n").alias("n"), F.sum("dg").alias("dg"), *[F.sum(F.get("gz", F.lit(j))).alias(f"g{j}") for j in range(k)]
        )
        change = 0.0
        new = {c: np.zeros((k, k)) for c in channels}
        for row in sums.collect():  # k rows per channel
            w = current[row["channel"]][row["i"]]
            new[row["channel"]][row["i"]] = np.array([row[f"g{j}"] for j in range(k)]) / row["n"] - row["dg"] / row["n"] * w
        for c in channels:
            turned = _orthogonal(new[c])
            change = max(change, float(np.max(np.abs(np.abs(np.sum(turned * current[c], axis=1)) - 1.0))))
            turn[c] = turned
        if change < tolerance:
            break
    spark = windows.sparkSession
    rows = [(c, [[float(v) for v in r] for r in turn[c]]) for c in channels]
    rotation = spark.createDataFrame(rows, f"channel {kind}, turn array<array<double>>")

    def turned_blocks(batches):
        for pdf in batches:
            for channel, ids, held in zip(pdf["channel"], pdf["windows"], pdf["z"]):
                yield pd.DataFrame({"channel": channel, "window": ids, "z": list(np.frombuffer(held).reshape(-1, k) @ turn[channel].T)})

    embedded = z.mapInPandas(turned_blocks, f"channel {kind}, `window` {name}, z array<double>")
    n = F.size(F.get("colour", F.lit(0)))
    mixed = F.transform("turn", lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.aggregate(F.zip_with(w, "colour", lambda a, b: a * F.get(b, p)), F.lit(0.0), lambda s, v: s + v)))
    mixing = rotation.join(white, "channel").join(mean, "channel").select("channel", mixed.alias("mixing"), F.col("mu").alias("mean"), F.lit(change < tolerance).alias("converged"))
    return embedded, mixing


def _orthogonal(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(1.0 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T @ w


def rebuild_independent(embedded: DataFrame, mixing: DataFrame) -> DataFrame:
    """``(channel, window, x)`` from independent components."""
    kind, name = (embedded.schema[c].dataType.simpleString() for c in ("channel", "window"))

    def mixed(part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        x = _stacked(part["z"]) @ _stacked(of["m_mixing"].iloc[0]) + np.asarray(of["m_mean"].iloc[0])
        return pd.DataFrame({"channel": part["channel"], "window": part["window"], "x": list(x)})

    return _met_by_block(embedded, mixing.select("channel", "mixing", "mean"), mixed, f"channel {kind}, `window` {name}, x array<double>")


def independent_size(windows: DataFrame, variance=0.7, most=30) -> DataFrame:
    """``(channel, k)``: fewest components from 2 to ``most`` whose rebuilt windows keep the wanted variance.

    Rebuilding from k independent components equals rebuilding from k principal ones, so the principal scores
    decide without running the rotation for every k.
    """
    mean = position_moments(windows).select("channel", "mu")
    centred = durable(windows.join(mean, "channel").select("channel", "window", "mu", F.zip_with("x", "mu", lambda a, b: a - b).alias("x")))
    parts = durable(components(gram(centred.drop("mu"))))
    top = embedding_sizes(parts, dim=most)
    lead = basis(parts, top).join(mean, "channel")

    @F.pandas_udf("array<double>")
    def kept(x: pd.Series, mu: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for a, m, b in zip(x, mu, vectors):
            b = np.stack([np.asarray(v) for v in b])[::-1]
            rows = np.asarray(m)[None, :] + np.cumsum((b @ np.asarray(a))[:, None] * b, axis=0)
            out.append(np.concatenate([[np.var(np.asarray(a) + np.asarray(m))], rows.var(axis=1)]))
        return pd.Series(out)

    rows = centred.drop("mu").join(lead, "channel").select("channel", F.posexplode(kept("x", "mu", "basis")).alias("k", "v"))
    sums = rows.groupBy("channel", "k").agg(F.sum("v").alias("v"))
    whole_var = sums.where("k = 0").select("channel", F.col("v").alias("_all"))
    enough = sums.where("k >= 2").join(whole_var, "channel").withColumn("_ok", F.col("v") / F.col("_all") >= variance)
    return enough.groupBy("channel").agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("k"))), F.max("k")).alias("k"))


# Acceptance of generated rows ---------------------------------------------------------------


def split_norm_rows(rows: DataFrame, id: str, vector: str, dims) -> DataFrame:
    """``(id, split, norm)``: the length of each channel's part of an embedding row."""
    starts = [sum(dims[:i]) for i in range(len(dims))]
    parts = F.array(*[norm(vector, s, d) for s, d in zip(starts, dims)])
    return rows.select(id, F.posexplode(parts).alias("split", "norm"))


def norm_fence(norms: DataFrame, width=3.0) -> DataFrame:
    """``(split, low, high)``: quartiles widened by ``width`` times their distance."""
    q = exact_quantiles(norms, ["split"], "norm", [0.25, 0.75])
    spread = width * (F.col("q1") - F.col("q0"))
    return q.select("split", (F.col("q0") - spread).alias("low"), (F.col("q1") + spread).alias("high"))


def within_fence(norms: DataFrame, fence: DataFrame, id: str) -> DataFrame:
    """Ids whose norms all lie inside the fence."""
    bad = norms.join(fence, "split").where((F.col("norm") < F.col("low")) | (F.col("norm") > F.col("high")))
    return norms.select(id).distinct().join(bad.select(id).distinct(), id, "left_anti")


def norm_diversity(norms: DataFrame, digits=3) -> DataFrame:
    """``(split, diversity)``: distinct rounded norms over all norms."""
    counted = norms.groupBy("split", F.round("norm", digits).alias("r")).agg(F.count("*").alias("c"))
    return counted.groupBy("split").agg((F.count("*") / F.sum("c")).alias("diversity"))


def accept_batches(original: DataFrame, batches, id: str, columns, dims, threshold: float, wanted: int, stall=10):
    """Accept generated batches until enough rows exist and their norms stop being diverse.

    Each batch loses incomplete rows, rows equal to an accepted one after rounding, and rows outside the norm fence
    of everything accepted so far; accepted norms then widen that fence. Returns ``(accepted, history)`` with one
    ``(batch, n_accepted, diversity)`` tuple per batch. Every batch is written once.
    """
    packed = lambda df: df.select(F.col(id).alias("_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))  # noqa: E731  one array beats many columns in joins
    norms_of = lambda df: split_norm_rows(df, "_id", "_v", dims)
    old = durable(norms_of(packed(original)).drop("_id"))
    whole_rows = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v))
    accepted, history, quiet, total = None, [], 0, 0
    for number, batch in enumerate(batches):
        clean = durable(packed(batch)).where(whole_rows).withColumn("_v", F.transform("_v", lambda v: F.round(v, 3)))
        fresh = clean.groupBy("_v").agg(F.min("_id").alias("_id"))
        if accepted is not None:
            fresh = fresh.join(accepted.select("_v"), "_v", "left_anti")
        fresh = durable(fresh)
        norms = norms_of(fresh)
        good = fresh.join(within_fence(norms, norm_fence(old), "_id"), "_id", "left_semi").select("_id", "_v")
        accepted = durable(good if accepted is None else accepted.unionByName(good))
        old = durable(old.unionByName(norms.join(good.select("_id"), "_id", "left_semi").drop("_id")))
        count = accepted.count()
        diversity = norm_diversity(old).agg(F.max("diversity")).first()[0]
        quiet = quiet + 1 if count == total else 0
        total = count
        history.append((number, total, diversity))
        if quiet >= stall or (diversity < threshold and total > wanted):
            break
    if accepted is None:
        accepted = packed(original).limit(0)
    return accepted.select(F.col("_id").alias(id), *[F.col("_v")[i].alias(c) for i, c in enumerate(columns)]), history


# Random-kernel classifier -------------------------------------------------------------------


def kernel_features(windows: DataFrame, n_kernels=100, seed=0) -> DataFrame:
    """``(…, features)``: share of positive responses and highest response of fixed random kernels on each window."""
    rng = np.random.RandomState(seed)
    kernels = []
    for _ in range(n_kernels):
        size = int(rng.choice([7, 9, 11]))
        weights = rng.normal(size=size)
        kernels.append((weights - weights.mean(), float(rng.uniform(-1, 1)), int(2 ** rng.uniform(0, np.log2(63 / (size - 1))))))

    @F.pandas_udf("array<double>")
    def responses(column: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
        x = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-8)
        out = []
        for weights, bias, gap in kernels:
            span = (len(weights) - 1) * gap
            steps = x.shape[1] - span
            y = bias + sum(w * x[:, i * gap : i * gap + steps] for i, w in enumerate(weights))
            out += [(y > 0).mean(1), y.max(1)]
        return pd.Series(list(np.stack(out, 1)))

    return windows.withColumn("features", responses("x"))


def train_kernel_classifier(windows: DataFrame, label="label", n_kernels=100, seed=0):
    """Logistic regression on kernel features; returns a function that adds ``prediction`` to windows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ready = kernel_features(windows, n_kernels, seed).withColumn("features", array_to_vector("features"))
    model = LogisticRegression(labelCol=label, maxIter=50, regParam=0.01).fit(ready)

    def predict(rows: DataFrame) -> DataFrame:
        shaped = kernel_features(rows, n_kernels, seed).withColumn("features", array_to_vector("features"))
        return model.transform(shaped).drop("features", "rawPrediction", "probability")

    return predict


def sampled_rows(rows: DataFrame, id: str, columns, n_batches: int, seed=0):
    """Stand-in for a generator: every original with each value shifted by up to five hundredths, as ``n_batches`` frames."""
    for number in range(n_batches):
        moved = F.transform(F.array(*columns), lambda v, i: v + 0.01 * (F.pmod(F.xxhash64(F.lit(seed + number), F.col(id), i), F.lit(11)) - 5))  # noqa: B023
        shifted = rows.select((F.col(id) + F.lit(1_000_000_000 * (number + 1)).cast("bigint")).alias(id), moved.alias("_v"))
        yield shifted.select(id, *[F.col("_v")[i].alias(c) for i, c in enumerate(columns)])
