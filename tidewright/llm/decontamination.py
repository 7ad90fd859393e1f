"""Benchmark decontamination by winnowing, in DataFrame operations throughout."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, stored, text_hash

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 6  # a span of WINDOW words holds WINDOW - GRAM + 1 grams; the least of them is kept
MOST_BROADCAST = 1_000_000  # benchmark fingerprints (8 bytes each) that are sent to every task; more are joined by shuffle
SIZES = (1, 2, 4, GRAM)


def words(text="text") -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def _joined(df: DataFrame, out: str, left: str, right: str, shift: int, how) -> DataFrame:
    """``out``[i] = how(left[i], right[i + shift]), as long as both exist."""
    longest = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return df.withColumn(out, F.transform(F.slice(left, F.lit(1), longest), lambda x, i: how(x, F.get(F.col(right), i + shift))))


def grammed(df: DataFrame) -> DataFrame:
    """Add h1, h2, h4 and h6: rolling hashes of 1, 2, 4 and 6 words at each position of ``words``."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = _joined(df, "h2", "h1", "h1", 1, F.xxhash64)
    df = _joined(df, "h4", "h2", "h2", 2, F.xxhash64)
    return _joined(df, "h6", "h4", "h2", 4, F.xxhash64)


def winnowed(df: DataFrame) -> DataFrame:
    """Add ``least``: the smallest gram hash of every run of 8 grams, that is of every 13-word span."""
    df = _joined(df, "m2", "h6", "h6", 1, F.least)
    df = _joined(df, "m4", "m2", "m2", 2, F.least)
    return _joined(df, "least", "m4", "m4", 4, F.least)


def _size_for(n: Column) -> Column:
    """The gram size that stands for a short item of ``n`` words: the largest that fits."""
    size = F.lit(SIZES[0])
    for s in SIZES[1:]:
        size = F.when(n >= s, s).otherwise(size)
    return size


def _covered(spans: Column) -> Column:
    """How many positions a list of (start, end) covers."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["e"]).alias("upto")
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def _windows(items: DataFrame) -> DataFrame:
    """(item, n, key): each window of each item, written out."""
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).when(n > 0, F.array(F.lit(0)))
    width = F.least(n, F.lit(WINDOW))
    keys = F.transform(starts, lambda s: F.array_join(F.slice(F.col("words"), s + 1, width), " "))
    return items.select("item", width.alias("width"), F.explode(keys).alias("key")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id") -> DataFrame:
    """doc_id, th, n_words, n_hit and items of every row of ``docs`` (``th`` hashes the text).

    Winnowing: every span of 13 words keeps the smallest of its 6-gram hashes, so a span that a document shares with an
    item has the same fingerprint on both sides. Matches are extended to all windows around them, and a window counts
    when its words are equal. Items of fewer than 13 words are found by the gram they begin with. Null texts and texts
    without a word hit nothing and, as items, are never hit; a null item id reads as ''. Rows with equal doc_id and text
    share their result. Items with equal ids count once.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words().alias("words"))
    items = items.where(F.size("words") > 0)
    short = [r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect()]  # 12 at most
    sizes = sorted({max(s for s in SIZES if s <= n) for n in short})
    grams = winnowed(grammed(items))
    size = _size_for(F.size("words"))
    first = F.get(F.lit(None).cast("array<bigint>"), F.lit(0))
    for s in SIZES:
        first = F.when(size == s, F.get(F.col(f"h{s}"), F.lit(0))).otherwise(first)
    marks = stored(grams.select(F.explode(F.when(F.size("words") < WINDOW, F.array(first)).otherwise(F.col("least"))).alias("fp")).distinct())
    bounded = marks.count() <= MOST_BROADCAST

    seen = winnowed(grammed(docs.select("doc_id", text_hash().alias("th"), words().alias("words"))))
    listed = F.array_distinct(F.concat(F.col("least"), *[F.col(f"h{s}") for s in sizes]))
    facts = stored(seen.select("doc_id", "th", F.size("words").cast("bigint").alias("n_words"), listed.alias("fps")))
    candidates = facts.select("doc_id", "th", F.explode("fps").alias("fp")).join(F.broadcast(marks) if bounded else marks, "fp")
    matched = stored(candidates.groupBy("doc_id", "th").agg(F.collect_set("fp").alias("found")))

    named = matched.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "found")
    own = docs.select("doc_id", text_hash().alias("th"), "text")
    near = own.join(named, own["doc_id"].eqNullSafe(named["_id"]) & (own["th"] == named["_th"]))
    near = grammed(near.select("doc_id", "th", "found", words().alias("words"))).withColumn("n", F.size("words"))

    def places(column):
        at = F.transform(column, lambda h, i: F.when(F.array_contains(F.col("found"), h), i))
        return F.filter(at, lambda i: i.isNotNull())

    far = F.lit(WINDOW - GRAM)
    near = near.withColumn("p", places("h6"))
    runs = F.transform(F.filter("p", lambda p: F.greatest(p - far, F.lit(0)) <= F.least(p, F.col("n") - WINDOW)), lambda p: F.sequence(F.greatest(p - far, F.lit(0)), F.least(p, F.col("n") - WINDOW)))
    spans = [F.transform(F.array_distinct(F.flatten(runs)), lambda s: F.struct(s.alias("s"), F.lit(WINDOW).alias("width")))]

    def starts(n):
        at = F.filter(places(f"h{max(s for s in SIZES if s <= n)}"), lambda p: p <= F.col("n") - n)
        return F.transform(at, lambda s: F.struct(s.alias("s"), F.lit(n).alias("width")))

    spans += [starts(n) for n in short]
    near = near.withColumn("spans", F.concat(*spans))
    keyed = F.transform("spans", lambda s: F.struct(s["s"].alias("s"), F.array_join(F.slice(F.col("words"), s["s"] + 1, s["width"]), " ").alias("key")))
    asked = near.select("doc_id", "th", F.explode(keyed).alias("k")).select("doc_id", "th", "k.s", "k.key")
    hits = asked.join(_windows(items), "key")
    span = F.struct(F.col("s").cast("bigint").alias("s"), (F.col("s") + F.col("width")).cast("bigint").alias("e"))
    by_doc = hits.groupBy("doc_id", "th").agg(F.collect_set(span).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), _covered(F.col("spans")).alias("n_hit"), "items")
    out = facts.join(by_doc, facts["doc_id"].eqNullSafe(by_doc["_id"]) & (facts["th"] == by_doc["_th"]), "left")
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    return overlaps(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    bad = overlaps(docs, benchmark).where(is_contaminated()).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(bad["_id"]) & (text_hash() == bad["_th"]), "left_anti")
