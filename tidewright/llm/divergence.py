"""Source divergence audit: how far the words of each (language, source) group lie from other sources and from their language.

Terms of a group with the same pair of counts form a cell and share one value, so values are computed per cell. Cells are
ranked by the running total of their sizes; only the cells that reach the asked ranks are opened into terms again.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stored

UNIT = 1_000_000_000
LEAST_DOCS = 3  # documents of a language that must hold a term
HELD_TERMS = 400_000  # terms a task counts before it passes them on
SLICE = 1 << 20  # bytes of a text that are cut into words at once
BROADCAST_GROUPS = 100_000  # groups (some 100 bytes each) sent to every task; more are joined by shuffle
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # A-Z to a-z, the rest to blanks
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _words(text: str):
    """Terms of a text, slice by slice; no term is cut in two."""
    line, lo = text.encode().translate(LETTERS), 0
    while lo < len(line):
        hi = line.find(b" ", lo + SLICE)
        hi = len(line) if hi < 0 else hi
        yield from line[lo:hi].split()
        lo = hi


def _counting(batches):
    """Partial counts of a task: occurrences and documents of each term of each group."""
    held, size = {}, 0

    def rows():
        names, out = ["lang", "source", "term", "n", "docs"], ([], [], [], [], [])
        for (lang, source), terms in held.items():
            out[0].extend([lang] * len(terms))
            out[1].extend([source] * len(terms))
            out[2].extend(t.decode() for t in terms)
            out[3].extend(c[0] for c in terms.values())
            out[4].extend(c[1] for c in terms.values())
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            terms, own = held.setdefault((lang, source), {}), {}
            for w in _words(text):
                own[w] = own.get(w, 0) + 1
            before = len(terms)
            for w, n in own.items():
                count = terms.get(w)
                if count is None:
                    terms[w] = [n, 1]
                else:
                    count[0] += n
                    count[1] += 1
            size += len(terms) - before
            if size >= HELD_TERMS:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def share(count, total, terms) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exactly; null without terms."""
    whole = F.call_function("div", (F.col(count).cast("decimal(20,0)") + 1) * F.lit(UNIT).cast("decimal(10,0)"), F.nullif(F.col(total) + F.col(terms), F.lit(0)).cast("decimal(20,0)"))
    return whole + 1


def excess(p, q) -> Column:
    """floor((p - q)^2 / q), exactly."""
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(q))


def _total(value) -> Column:
    return F.coalesce(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _sized(value, size) -> Column:
    return F.col(value).cast("decimal(19,0)") * F.col(size).cast("decimal(18,0)")


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, kept): every occurring (lang, source), and (lang, source, term, n, of_lang) of the kept terms with n > 0.

    Both are stored. Groups carry total (N), terms (V of the language) and lang_total.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = clean.mapInArrow(_counting, COUNTS)
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    by_lang = counts.groupBy(F.col("lang").alias("_lang"), F.col("term").alias("_term")).agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= LEAST_DOCS)
    kept = stored(counts.join(by_lang, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))).select("lang", "source", "term", "n", "of_lang"))
    # a group of documents without terms has no row in kept
    seen = clean.select("lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    totals = kept.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    per_lang = by_lang.groupBy(F.col("_lang").alias("_l")).agg(F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("lang_total"))
    groups = seen.join(totals, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")), "left").join(per_lang, F.col("lang") == F.col("_l"), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", "own_terms", "terms", "lang_total")}
    return stored(groups.withColumns(zero).select("lang", "source", *zero)), kept


def pair_values(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): every group against each other source of its language, over all kept terms.

    Terms that one of the two lacks need no pairing: over all terms, f(a, b) is f(a, 0) + f(0, b) - f(0, 0) plus a
    correction that is zero unless both counts are positive. Only those cells come from a join by term.
    """
    n_groups = groups.count()
    ours = groups.select("lang", "source", "total", "own_terms", "terms")
    theirs = groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"), F.col("total").alias("item_total"), F.col("own_terms").alias("item_terms"))
    pairs = ours.join(_small(theirs, n_groups), (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))).drop("_l")

    def f(df, a, b, name):
        """Adds f of the counts a (ours) and b (theirs)."""
        return df.withColumn("_p", share(a, "total", "terms")).withColumn("_q", share(b, "item_total", "terms")).withColumn(name, excess("_p", "_q")).drop("_p", "_q")

    def told(df, group="source"):
        """Adds the totals of both groups to cells that name one or both."""
        both = pairs.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("item").alias("_i"), "total", "item_total", "terms")
        on = (F.col("lang") == F.col("_l")) & (F.col(group) == F.col("_s" if group == "source" else "_i"))
        if group == "source" and "item" in df.columns:
            on = on & (F.col("item") == F.col("_i"))
        return df.join(_small(both, n_groups * n_groups), on).withColumns({"source": F.col("_s"), "item": F.col("_i")}).drop("_l", "_s", "_i")

    cells = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("size"))
    zero = F.lit(0).cast("bigint")
    base = f(pairs.withColumn("z", zero), "z", "z", "f00").withColumn("value", _sized("f00", "terms") - _sized("f00", "own_terms") - _sized("f00", "item_terms"))
    left = f(told(cells.withColumn("z", zero)), "n", "z", "f").withColumn("value", _sized("f", "size"))
    right = f(told(cells.withColumnRenamed("source", "item").withColumn("z", zero), "item"), "z", "n", "f").withColumn("value", _sized("f", "size"))
    other = kept.select(F.col("lang").alias("_l"), F.col("term").alias("_t"), F.col("source").alias("item"), F.col("n").alias("m"))
    met = kept.join(other, (F.col("lang") == F.col("_l")) & (F.col("term") == F.col("_t")) & (F.col("source") < F.col("item")))
    met = stored(met.groupBy("lang", "source", "item", "n", "m").agg(F.count(F.lit(1)).alias("size")))
    met = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("m").alias("n"), F.col("n").alias("m"), "size"))
    met = told(met.withColumn("z", zero))
    for a, b, name in (("n", "m", "fab"), ("n", "z", "fa"), ("z", "m", "fb"), ("z", "z", "f0")):
        met = f(met, a, b, name)
    met = met.withColumn("value", _sized("fab", "size") - _sized("fa", "size") - _sized("fb", "size") + _sized("f0", "size"))
    names = ["lang", "source", "item", "value"]
    parts = [d.withColumn("value", F.col("value").cast("decimal(38,0)")).select(*names) for d in (base, left, right, met)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(_total("value").cast("bigint").alias("value"))


def top_terms(groups: DataFrame, kept: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms of a group that are more frequent there than in the language, to ``ranks``.

    The window over cells keeps ``ranks`` values per map task before its shuffle, and so does the one over terms of a value.
    """
    info = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "total", "terms", "lang_total")
    cells = kept.groupBy("lang", "source", "n", "of_lang").agg(F.count(F.lit(1)).alias("size"))
    cells = cells.join(_small(info, groups.count()), (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
    cells = cells.withColumn("p", share("n", "total", "terms")).withColumn("q", share("of_lang", "lang_total", "terms")).where("p > q").withColumn("value", excess("p", "q"))
    cells = stored(cells.select("lang", "source", "n", "of_lang", "value", "size"))
    group = Window.partitionBy("lang", "source")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("size").alias("size"))
    values = values.withColumn("_k", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("_k") <= ranks)
    values = values.withColumn("start", F.sum("size").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)))
    values = values.withColumn("start", F.coalesce("start", F.lit(0))).where(F.col("start") < ranks).select("lang", "source", "value", "start")
    opened = stored(cells.join(values, ["lang", "source", "value"]).select(*[F.col(c).alias(f"_{c}") for c in ("lang", "source", "n", "of_lang")], "value", "start"))
    same = [F.col(c) == F.col(f"_{c}") for c in ("lang", "source", "n", "of_lang")]
    terms = kept.join(_small(opened, opened.count()), same).select("lang", "source", F.col("term").alias("item"), "value", "start")
    inside = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("item"))
    return terms.withColumn("_k", inside).where(F.col("_k") <= ranks).withColumn("rank", (F.col("start") + F.col("_k")).cast("int")).where(F.col("rank") <= ranks).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` against other sources, part ``term`` against the language.

    Null lang, source and text count as ''; every row is a document of its own, repeated rows too. Ties go by the bytes of
    the item. A language with one source has no pairs, one without kept terms has pairs of value 0 and no terms; an
    empty table gives an empty one. Extra columns are left out.
    """
    groups, kept = counted(docs)
    line = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, kept).withColumn("rank", F.row_number().over(line).cast("int")).withColumn("part", F.lit("pair"))
    terms = top_terms(groups, kept, ranks).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
