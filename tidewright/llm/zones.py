"""Centroid clustering over space-filling-curve zone maps: blocks of near vectors, boxes, candidate centroids, exact distances."""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored

SCALE = 256
BLOCK_ROWS = 256
LEVELS = 4  # bits a component has in the curve's key
EXACT = 1 << 52  # scaled components beyond are not kept: doubles there are no longer all integers
FAST = 1 << 22  # up to here squared distances of 64 components are exact in doubles
LONGEST = (1 << 63) - 1
BLOCKS = "n int, lo binary, hi binary, ids array<bigint>, points binary"
SUMS = "cluster int, size bigint, sums array<decimal(38,0)>"
PLACED = "vec_id bigint, cluster int, distance bigint"


def kept_vectors(vectors: DataFrame, dims: int, scale: int = SCALE, vec="embedding") -> DataFrame:
    """vec_id and v (array of bigint, floor(scale * x)) of vectors with exactly ``dims`` finite components within the exact range."""
    x = F.transform(F.col(vec), lambda c: c.cast("double") * scale)
    # abs(NaN) and infinities fail the comparison with the range as well (NaN is larger than any number)
    good = (F.size(vec) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float(EXACT)))
    return vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c).cast("bigint")).alias("v"))


def curve_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Places along a Hilbert curve, as rows of bytes that sort like the numbers; ``cells`` holds integers below 2^levels.

    Working down from the highest bit, a set bit of an axis reflects the first axis and a clear one swaps low bits with it;
    a Gray code over the axes follows, and the bits of one level stand together.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    bit = 1 << (levels - 1)
    while bit > 1:
        low = np.uint32(bit - 1)
        for i in range(dims):
            up = (x[i] & np.uint32(bit)) != 0
            swap = np.where(up, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros(x.shape[1], np.uint32), 1 << (levels - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & np.uint32(bit)) != 0, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(levels - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _keying(lo: list[int], hi: list[int], levels: int):
    low, width = np.array(lo, np.float64), np.maximum(np.array(hi, np.float64) - np.array(lo, np.float64) + 1, 1)

    def key(batches):
        for batch in batches:
            v = batch.column(1)
            points = v.values.to_numpy()[v.offsets[0].as_py() :].reshape(-1, len(low))[: batch.num_rows] if batch.num_rows else np.zeros((0, len(low)), np.int64)
            cells = np.minimum((points - low) / width * (1 << levels), (1 << levels) - 1).astype(np.uint32)
            keys = curve_keys(cells, levels)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["vec_id", "v", "key"])

    return key


def _blocking(dims: int):
    """Runs of sorted rows to blocks: the box, the ids and the points of each."""

    def row(ids, points):
        columns = [[len(ids)], [points.min(axis=0).tobytes()], [points.max(axis=0).tobytes()], [ids], [points.tobytes()]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n", "lo", "hi", "ids", "points"])

    def block(batches):
        ids, points = [], np.zeros((0, dims), np.int64)
        for batch in batches:
            v = batch.column(1)
            if not batch.num_rows:
                continue
            found = v.values.to_numpy()[v.offsets[0].as_py() :].reshape(-1, dims)[: batch.num_rows]
            ids, points = ids + batch.column(0).to_pylist(), np.concatenate([points, found])
            while len(ids) >= BLOCK_ROWS:
                yield row(ids[:BLOCK_ROWS], points[:BLOCK_ROWS])
                ids, points = ids[BLOCK_ROWS:], points[BLOCK_ROWS:]
        if ids:
            yield row(ids, points)

    return block


def zone_maps(kept: DataFrame, dims: int, levels: int = LEVELS) -> DataFrame:
    """The vectors in blocks along the curve, stored. Rows of one place are told apart by vec_id, so a hot place fills many tasks."""
    ends = kept.select(F.posexplode("v").alias("axis", "c")).groupBy("axis").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).orderBy("axis").collect()
    if not ends:
        return stored(kept.limit(0).mapInArrow(_blocking(dims), BLOCKS))
    keyed = stored(kept.mapInArrow(_keying([r.lo for r in ends], [r.hi for r in ends], levels), "vec_id bigint, v array<bigint>, key binary"))
    line = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "v")
    return stored(line.select("vec_id", "v").mapInArrow(_blocking(dims), BLOCKS))


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box, in ascending order.

    A centroid is out if its distance to the box is more than another's distance to the farthest corner. Doubles round,
    so both sides get room for their last digits.
    """
    c = centroids.astype(np.float64)
    below, above = lo.astype(np.float64) - c, c - hi.astype(np.float64)
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1).min()
    return np.flatnonzero(least <= most * (1 + 1e-9))


def nearest(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every point of a block: exact, the smaller number on ties."""
    some = candidates(lo, hi, centroids)
    chosen = centroids[some]
    if max(abs(int(x)) for x in (points.min(), points.max(), chosen.min(), chosen.max())) < FAST:
        p, c = points.astype(np.float64), chosen.astype(np.float64)
        squares = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]
    else:
        p, c = points.astype(object), chosen.astype(object)
        squares = np.stack([((p - one) ** 2).sum(axis=1) for one in c], axis=1)
    at = squares.argmin(axis=1)
    best = squares[np.arange(len(points)), at]
    distance = np.array([min(int(d), LONGEST) for d in best], np.int64) if best.dtype == object else best.astype(np.int64)
    return some[at], distance


def _blocks_of(batch, dims):
    for lo, hi, ids, points in zip(batch.column("lo"), batch.column("hi"), batch.column("ids"), batch.column("points")):
        lo, hi = np.frombuffer(lo.as_buffer(), np.int64), np.frombuffer(hi.as_buffer(), np.int64)
        yield lo, hi, ids.values, np.frombuffer(points.as_buffer(), np.int64).reshape(-1, dims)


def _summing(centroids: np.ndarray):
    """Sizes and exact sums of the clusters over the blocks of a task."""
    k, dims = centroids.shape

    def add(batches):
        size, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for lo, hi, _, points in _blocks_of(batch, dims):
                cluster, _ = nearest(points, lo, hi, centroids)
                for j in np.unique(cluster).tolist():
                    mine = points[cluster == j]  # at most BLOCK_ROWS * EXACT = 2^60, so the block's sum is exact
                    size[j] += len(mine)
                    sums[j] += mine.sum(axis=0).astype(object)
        used = np.flatnonzero(size).tolist()
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        columns = [used, size[used].tolist(), [[Decimal(int(x)) for x in sums[j]] for j in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "size", "sums"])

    return add


def _placing(centroids: np.ndarray):
    dims = centroids.shape[1]

    def place(batches):
        for batch in batches:
            for lo, hi, ids, points in _blocks_of(batch, dims):
                cluster, distance = nearest(points, lo, hi, centroids)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return place


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of salt and vec_id; equal hashes go by the vector, null ids come last."""
    named = kept.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = named.orderBy(F.asc_nulls_last("_h"), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; empty ones stay. The driver gets k rows of sums."""
    parts = blocks.select("lo", "hi", "ids", "points").mapInArrow(_summing(centroids), SUMS)
    axes = parts.select("cluster", "size", F.posexplode("sums").alias("axis", "part")).groupBy("cluster", "axis").agg(F.sum("part").alias("part"), F.sum("size").alias("size"))
    out = centroids.copy()
    for r in axes.collect():
        out[r["cluster"], r["axis"]] = int(r["part"]) // r["size"]
    return out


def cluster_vectors(vectors: DataFrame, k: int, rounds: int, dims: int, salt: str = "", vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): vec_id, cluster, distance, cluster_inertia and inertia of every kept vector after ``rounds`` rounds.

    Kept are vectors of ``dims`` components, none null or non-finite, with |256 x| below 2^52. Ties go to the smaller number;
    with fewer than k vectors there are as many centroids. Repeated rows count as often as they stand. Squared distances and
    their sums past 2^63 - 1 are given as 2^63 - 1. No kept vector gives an empty result. Extra columns are left out.
    """
    kept = kept_vectors(vectors, dims, vec=vec)
    centroids = first_centroids(kept, k, salt)
    blocks = zone_maps(kept, dims)
    if not len(centroids):
        return blocks.select(*[F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"))]), centroids
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    placed = stored(blocks.select("lo", "hi", "ids", "points").mapInArrow(_placing(centroids), PLACED))
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    capped = lambda d: min(d, LONGEST)
    per_cluster = F.array(*[F.lit(capped(sums.get(j, 0))).cast("bigint") for j in range(len(centroids))])
    whole = F.lit(capped(sum(sums.values()))).cast("bigint")
    return placed.select("vec_id", "cluster", "distance", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"), whole.alias("inertia")), centroids


def centroid_names(centroids: np.ndarray) -> list[str]:
    """Components of each centroid, as decimal integers with commas between."""
    return [",".join(map(str, c)) for c in centroids.tolist()]
