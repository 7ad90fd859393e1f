"""SimHash near-dedup through deletion-variant signatures."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored
from tidewright.llm.components import components

BLANK = "\t\n\x0b\x0c\r"
FOLD = str.maketrans({**{c: " " for c in BLANK}, **{c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
SEED, SHINGLE, BITS = 42, 4, 64


def fingerprint(text, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, as a signed 64-bit number; 0 without words."""
    words = [w for w in text.translate(FOLD).split(" ") if w] if text else []
    if not words:
        return 0
    line = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist())
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - last)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", more: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) of every row and the bigint columns ``more``; whole texts, null as empty."""
    names = ["doc_id", "fp", *(more or [])]

    def each(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=names)

    return docs.select("doc_id", text, *names[2:]).mapInArrow(each, ", ".join(f"{n} bigint" for n in names))


def _segments(links: int) -> list[tuple[int, int]]:
    """(first bit, width): the fewest segments of which one differs by at most one bit when ``links`` bits differ."""
    n = links // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:])]


def _bits(value, lo: int, width: int):
    return F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << width) - 1))


def near_pairs(fps: DataFrame, links: int = 4) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints of ``fps`` (column fp, distinct) at ``links`` or fewer bits.

    Each fingerprint is listed once per bit: the segment of that bit with the bit left out. Two fingerprints whose
    segments differ in one bit or none meet there. A pair that meets under several variants comes out under the first.
    Spark sizes the index as if each fingerprint were listed once, so the join is told to sort and never broadcasts it.
    """
    parts = _segments(links)
    at = {i: p for p in parts for i in range(p[0], p[0] + p[1])}
    variants = F.array(*[_bits(F.col("fp"), *at[i]).bitwiseAND(F.lit(~(1 << (i - at[i][0])))) * BITS + i for i in range(BITS)])
    index = fps.select("fp", F.explode(variants).alias("key"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("bigint")
    for lo, width in reversed(parts):
        own = _bits(x, lo, width)
        bit = F.when(own == 0, F.lit(lo)).otherwise(F.bit_count(own - 1) + lo)
        first = F.when(F.bit_count(own) <= 1, bit.cast("bigint")).otherwise(first)
    left, right = index.select("key", F.col("fp").alias("a")), index.select(F.col("key").alias("key2"), F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(x) <= links) & (F.pmod("key", F.lit(BITS)) == first)
    return left.join(right.hint("merge"), (F.col("key") == F.col("key2")) & close).select("a", "b")


def _rooted(rows: DataFrame, links: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``rows``; the root is the smallest fingerprint reachable."""
    distinct = stored(rows.select("fp").distinct())
    roots = components(near_pairs(distinct, links), "a", "b")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components_of(docs: DataFrame, links: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) for every row of ``docs``.

    Rows with equal fingerprints are collapsed before any pair is made. A text without words (null, empty or blank)
    has fingerprint 0 and links like any other. A null doc_id never is the smallest; a component of such rows alone has
    a null id. Repeated rows come out as often as they go in, an empty table gives an empty one. Extra columns of
    ``docs`` are left out.
    """
    rows = stored(fingerprints(docs))
    named = stored(_rooted(rows, links))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumnRenamed("fp", "_fp")
    ids = named.join(least, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(found, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex_of(fp="fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_group(docs: DataFrame, links: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: that with the least (doc_id, hash of the text); rows with a null doc_id stay.

    Rows of one doc_id with unlike texts are told apart by the hash. Of rows equal in both, one stays. Null, empty and
    blank texts are one component; an empty table gives an empty one; all columns are kept.
    """
    key = {"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), F.col("text"))}
    rows = stored(fingerprints(docs.where(F.col("doc_id").isNotNull()).withColumns(key), more=["_a", "_b"]))
    named = _rooted(rows, links).withColumnRenamed("fp", "_fp")
    copies = rows.join(named, F.col("fp") == F.col("_fp")).groupBy("root", "doc_id", "_a", "_b").agg(F.count(F.lit(1)).alias("rows"))
    keepers = copies.groupBy("root").agg(F.min(F.struct("doc_id", "_a", "_b", "rows")).alias("k")).select("k.*")
    keepers = stored(keepers.withColumnsRenamed({"doc_id": "_id", "_a": "_ka", "_b": "_kb"}))
    same = (F.col("doc_id") == F.col("_id")) & (key["_a"] == F.col("_ka")) & (key["_b"] == F.col("_kb"))
    kept = docs.join(keepers.where("rows = 1").hint("shuffle_hash"), same, "left_semi")  # texts aren't sorted
    if keepers.where("rows > 1").limit(1).count():
        repeated = docs.join(keepers.where("rows > 1"), same, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
