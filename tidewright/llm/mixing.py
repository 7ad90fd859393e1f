"""Mixing sources to target weights by entropy balancing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stored
from tidewright.llm.numbering import bucket_count, numbered

CAP = 3  # copies of a document, and words of a source against its own, at most
CLOSE = 1e-9  # a source is balanced when its words are this close to its target, relatively


def n_words(text="text") -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) + target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words. A target above ``cap`` times
    its source stops there and the excess goes to the others by weight, round after round, until none is above.
    One row per source is ordered by one task; sources are few against documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    now = stored(sources.select("source", "source_size", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double").alias("weight"), F.lit(False).alias("full")))
    while True:
        open_ = ~F.col("full")
        total, spent, weight = now.agg(
            F.sum("source_size"), F.sum(F.when(F.col("full"), F.col("source_size") * cap)), F.sum(F.when(open_, F.col("weight")))
        ).first()
        rate = (total - (spent or 0)) / weight if weight else 0.0
        over = open_ & (F.col("weight") * rate > F.col("source_size") * cap)
        if not now.where(over).limit(1).count():
            return now.select("source", "source_size", F.when(F.col("full"), F.col("source_size") * float(cap)).otherwise(F.col("weight") * rate).alias("target"))
        now = stored(now.withColumn("full", F.col("full") | over))


def balanced_rates(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` + tilt, scale: a document of size s has the rate min(cap, exp(tilt * s / scale)).

    These rates are the closest to 1 in relative entropy, none above ``cap``, whose words meet the target of each
    source. The dual is convex with one unknown a source; every source takes a Newton step each round, from sums over
    its (size, number of documents) cells, inside a bracket that shrinks, and halves the bracket where the step would
    leave it. Rounds go on until all sources are balanced. Sources that need every document at the cap, or have no
    words, are settled from the start.
    """
    start = sources.join(cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("scale"), F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # at -800 * scale / least every rate is nil, at ln(cap) * scale / least every rate is the cap
    high = F.log(F.lit(float(cap))) * F.col("scale") / F.col("least")
    low = F.lit(-800.0) * F.col("scale") / F.col("least")
    full = F.col("target") >= F.col("source_size") * cap
    now = stored(
        start.select(
            "source", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"),
            F.when(F.col("source_size") == 0, 0.0).when(full, high).otherwise(0.0).alias("tilt"),
            F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(0.0)).alias("high"),
            ((F.col("source_size") == 0) | full).alias("done"),
        )
    )
    while now.where(~F.col("done")).limit(1).count():
        at = now.where(~F.col("done")).select(F.col("source").alias("_s"), "tilt", "scale")
        x = F.col("size") / F.col("scale")
        free = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        words, inside = F.least(free, F.lit(float(cap))) * F.col("size") * F.col("n"), F.when(free < cap, free * F.col("size") * x * F.col("n"))
        sums = cells.join(at, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(words).alias("words"), F.coalesce(F.sum(inside), F.lit(0.0)).alias("slope"))
        after = now.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        miss = F.col("words") - F.col("target")
        new_low, new_high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.col("slope")
        middle = (F.col("_low") + F.col("_high")) / 2
        after = after.withColumns({"_low": new_low, "_high": new_high, "_newton": F.when(F.col("slope") > 0, newton)})
        narrow = (F.col("_high") - F.col("_low")) <= 1e-15 * F.greatest(F.abs("_low"), F.abs("_high"))
        ends = F.col("done") | (F.abs(miss) <= F.lit(CLOSE) * F.greatest(F.col("target"), F.lit(1.0))) | narrow
        step = F.when((F.col("_newton") > F.col("_low")) & (F.col("_newton") < F.col("_high")), F.col("_newton")).otherwise(middle)
        now = stored(
            after.select(
                "source", "source_size", "target", "scale", F.when(ends, F.col("tilt")).otherwise(step).alias("tilt"),
                F.when(ends, F.col("low")).otherwise(F.col("_low")).alias("low"), F.when(ends, F.col("high")).otherwise(F.col("_high")).alias("high"), ends.alias("done"),
            )
        )
    return now.select("source", "source_size", "target", "tilt", "scale")


def copies(docs: DataFrame, cap: int = CAP, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of (doc_id, source, text) in ``docs``.

    Rates are rounded per cell of equal source and size: every document takes the whole part, and of the rest as many
    take one more as the running sum of fractions over the source, larger sizes first, passes whole numbers. The words
    of a source miss its target by one document's size at most. Who of a cell takes more is decided by hash order of
    (doc_id, row content), so reruns agree. Rows that agree in doc_id, source and size are alike and take their
    places one after the other. A null text has size 0; a text without words is taken once and adds nothing.
    """
    sized = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("mark"))
    rows = stored(sized)
    cells = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap)
    rates = balanced_rates(cells, sources, cap)
    named = rates.withColumnRenamed("source", "_s")
    rated = cells.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))), F.lit(float(cap)))
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate)).withColumn("whole", F.floor(F.col("rate") + 1e-12))
    larger = Window.partitionBy("source").orderBy(F.col("size").desc())
    running = F.sum(F.col("n") * F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).over(larger.rowsBetween(Window.unboundedPreceding, 0))
    rated = rated.withColumn("upto", F.floor(running + 0.5)).withColumn("more", F.col("upto") - F.coalesce(F.lag("upto").over(larger), F.lit(0)))
    dealt = stored(rated.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "whole", "more"))
    n = rows.count()
    one = rows.withColumn("lot", F.xxhash64(F.lit(seed), "doc_id", "mark"))
    ranked = numbered(one, ["source", "size"], ["lot", "doc_id", "mark"], F.lit(1), bucket_count(n), "rank")
    joined = ranked.join(dealt, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    extra = F.when(F.col("rank") < F.col("more"), 1).otherwise(0)
    return joined.select("doc_id", "source", "mark", "size", "source_size", "target", (F.col("whole") + extra).cast("bigint").alias("copies"))


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs``; taken = copies * size."""
    out = copies(docs, cap)
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, which may be never.

    The copies are the hashed side of the join, so texts are neither sorted nor held. Rows that agree in doc_id, source
    and text share a list of copies; only where such rows exist are they told apart by a window over them.
    """
    found = stored(copies(docs, cap).groupBy("doc_id", "source", "mark").agg(F.collect_list("copies").alias("_each")))
    found = found.select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("mark").alias("_m"), "_each")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_mark") == F.col("_m"))
    marked = docs.withColumn("_mark", F.xxhash64("text"))

    def taken(part, n):
        rows = marked.join(part.hint("shuffle_hash"), same).withColumn("_n", n.cast("int")).where("_n > 0")
        return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_copy")

    out = taken(found.where((F.size("_each") == 1) & (F.get("_each", F.lit(0)) > 0)), F.get("_each", F.lit(0)))
    alike = found.where(F.size("_each") > 1)
    if alike.limit(1).count():
        place = Window.partitionBy("_id", "_s", "_m").orderBy(F.lit(0))
        out = out.unionByName(taken(alike, F.get("_each", F.row_number().over(place) - 1)))
    return out
