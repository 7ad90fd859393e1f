"""Line dedup: range-partitioned line hashes, streamed in document order, into a keep bitmap per document."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import ascii_lower, stored, text_hash

BLANKS = " \t\n\x0b\x0c\r"
DROP, OPEN, TOTAL = 1, 0, 2
MARKS = "kind int, h1 bigint, h2 bigint, doc_id bigint, ta bigint, tb bigint, pos bigint"


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row per line whose key has ``least_chars`` code points or more: (h1, h2, doc_id, ta, tb, pos)."""
    lines = docs.select("doc_id", text_hash().alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", F.col("th.a").alias("ta"), F.col("th.b").alias("tb"), F.col("pos").cast("bigint").alias("pos"))


def _marks(least_docs: int):
    """Streams sorted (key, document descending, position) rows of one range partition.

    Holds the first ``least_docs`` - 1 documents of the current key at most. Inside the partition a key is decided at
    once; the first and the last key may go on in the neighbours, so what they leave undecided is sent out as OPEN
    together with a TOTAL row (largest doc_id, number of documents).
    """

    def stream(batches):
        schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "doc_id", "ta", "tb", "pos"))])
        key, doc, top, n_docs, first_key = None, (), None, 0, True
        waiting = []  # (document, part): a part is a range of rows of this batch, or rows carried over from an earlier one

        def tagged(part, kinds):
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *part.columns], schema=schema)

        def mark(part, kind, kinds, late):
            if isinstance(part, tuple):
                kinds[part[0] : part[1]] = kind
            else:
                late.append(tagged(part, np.full(part.num_rows, kind, np.int32)))

        def leave_open(kinds, late):
            for _, part in waiting:
                mark(part, OPEN, kinds, late)
            late.append(pa.RecordBatch.from_pylist([{"kind": TOTAL, "h1": key[0], "h2": key[1], "doc_id": top, "pos": n_docs}], schema=schema))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            known, plain = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            new_key = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            new_doc = np.flatnonzero((plain[1:] != plain[:-1]) | (known[1:] != known[:-1])) + 1
            edges = [0, *np.union1d(new_key, new_doc).tolist(), n]
            kinds, late = np.full(n, -1, np.int32), []
            for lo, hi in zip(edges[:-1], edges[1:]):
                at, who = (int(h1[lo]), int(h2[lo])), (int(plain[lo]) if known[lo] else None)
                if at != key:
                    if first_key and key is not None:
                        leave_open(kinds, late)
                        first_key = False
                    key, doc, top, n_docs, waiting = at, (), who, 0, []
                if who != doc:
                    doc, n_docs = who, n_docs + 1
                    if n_docs == least_docs:  # the largest waits for other partitions, the others go
                        for other, part in waiting:
                            if other != top:
                                mark(part, DROP, kinds, late)
                        waiting = [w for w in waiting if w[0] == top]
                if n_docs >= least_docs and who != top:
                    kinds[lo:hi] = DROP
                else:
                    waiting.append((who, (lo, hi)))
            sent = kinds >= 0
            if sent.any():
                yield tagged(batch.filter(pa.array(sent)), kinds[sent])
            yield from late
            waiting = [(who, batch.slice(p[0], p[1] - p[0]) if isinstance(p, tuple) else p) for who, p in waiting]
        if key is not None:
            late = []
            leave_open(None, late)
            yield from late

    return stream


def dropped_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, ta, tb, pos) of every line to drop; the text hashes with doc_id stand for the row of ``docs``.

    A key found in ``least_docs`` documents or more keeps its lines in the largest doc_id alone (NULL is the smallest).
    The range runs over (hash, doc_id), so a line that a third of all documents hold is spread over many tasks.
    """
    newest = F.col("doc_id").desc_nulls_last()
    rows = line_keys(docs, least_chars).repartitionByRange("h1", "h2", newest).sortWithinPartitions("h1", "h2", newest, "ta", "tb", "pos")
    marks = stored(rows.mapInArrow(_marks(least_docs), MARKS))
    totals = marks.where(F.col("kind") == TOTAL).groupBy("h1", "h2").agg(F.sum("pos").alias("n_docs"), F.max("doc_id").alias("top"))
    # two keys a range partition at most: a proven bound
    border = marks.where(F.col("kind") == OPEN).join(F.broadcast(totals.where(F.col("n_docs") >= least_docs)), ["h1", "h2"])
    late = border.where(~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "ta", "tb", "pos")
    return marks.where(F.col("kind") == DROP).select("doc_id", "ta", "tb", "pos").unionByName(late)


@F.pandas_udf(T.BinaryType())
def keep_bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n, gone):
        bits = np.ones(n, bool)
        bits[np.asarray(gone, np.int64)] = False
        return zlib.compress(np.packbits(bits).tobytes())

    return pd.Series([one(n, g) for n, g in zip(n_lines, dropped)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines whose bit is set, joined by newlines; a null bitmap keeps the text."""

    def one(t, k):
        if k is None or t is None:
            return t
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines))
        return "\n".join([lines[i] for i in np.flatnonzero(bits)])

    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def line_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep) of the documents that lose lines; keep is a zlib-packed bit per line."""
    gone = dropped_lines(docs, least_chars, least_docs).groupBy("doc_id", "ta", "tb").agg(F.collect_set("pos").alias("gone"))
    sizes = docs.select("doc_id", text_hash().alias("th"), n_lines().alias("n_lines")).distinct()
    same = gone["doc_id"].eqNullSafe(sizes["doc_id"]) & (F.struct(gone["ta"].alias("a"), gone["tb"].alias("b")) == sizes["th"])
    joined = gone.join(sizes, same).select(sizes["doc_id"], sizes["th"], "n_lines", "gone")
    return joined.select("doc_id", "th", "n_lines", F.size("gone").cast("bigint").alias("n_dropped"), keep_bitmap("n_lines", "gone").alias("keep"))


def n_lines(text="text"):
    return (F.coalesce(F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))), F.lit(0)) + 1).cast("bigint")


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, keep and kept (the text without its dropped lines) for every row of ``docs``.

    A null or empty text is one empty line and is kept. Rows with the same doc_id count as one document. A text that
    loses all its lines becomes empty.
    """
    maps = line_bitmaps(docs, least_chars, least_docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_dropped", "keep")
    own = docs.select("doc_id", "text", text_hash().alias("_t"), n_lines().alias("n_lines"))
    joined = own.join(maps, own["doc_id"].eqNullSafe(maps["_id"]) & (own["_t"] == maps["_th"]), "left")
    changed = kept_text(F.when(F.col("keep").isNotNull(), F.col("text")), "keep")
    return joined.select(
        "doc_id", "text", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep",
        F.when(F.col("keep").isNotNull(), changed).otherwise(F.coalesce("text", F.lit(""))).alias("kept"),
    )
