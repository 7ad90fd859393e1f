"""Cross-entropy difference of two bigram models over one vocabulary, counted word by word and pair by pair."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Codes, stored

BROADCAST_IDS = 2_000_000  # target ids (8 bytes each) sent to every task; more are joined by shuffle
TOKENS_PER_SLOT, LEAST_BITS = 16, 16  # the vocabulary that unseen words are smoothed over grows with the corpus
WORD_BITS = 2  # it is taken as 2^2 times fewer words than 2^table_bits
CHUNK_TOKENS = 700_000  # tokens whose texts travel and are judged together
CHUNK_BYTES = 32 << 20  # or so much text, where words are long or there are no blanks
BUCKET_BYTES = 16 << 20  # text whose keys are summed in one group
PRIOR = 50.0  # how many tokens the word model weighs inside the bigram model
CHUNKS = "chunk bigint, n0 bigint, n1 bigint, docs binary"
PARTS = "chunk bigint, bucket int, n int, keys binary, rest binary, target binary"
TOTALS = "chunk bigint, bucket int, n int, rest binary, target binary, docs binary"


def table_bits(text_bytes: int) -> int:
    """Log2 of the pairs to expect, from six bytes a token; both models and all documents use the same."""
    return max(LEAST_BITS, math.ceil(math.log2(max(text_bytes, 1) / 6 / TOKENS_PER_SLOT + 1)))


def word_codes() -> Codes:
    return Codes(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))


def slots(text, codes: Codes, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the words, led by that of the border of the text, and of the pairs of neighbours.

    Keys are whole hashes, so no two words or pairs share a count, whatever ``bits`` (of table_bits) says.
    """
    found = text.lower().split() if text else []
    ids = np.zeros(len(found) + 1, np.uint64)
    ids[1:] = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    before = ids[:-1]
    pairs = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[1:]
    return ids, pairs ^ (pairs >> np.uint64(32))


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    return pa.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _written(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    return sink.getvalue().to_pybytes()


def _chunking(most: int):
    """Rows (doc_id, text, is_target) to chunks of about ``most`` tokens, CHUNK_BYTES at most; n0 and n1 are the tokens of rest and target.

    A chunk ends with a document, so a longer text is a chunk of its own.
    """

    def chunk(batches):
        at, held, size, length = TaskContext.get().partitionId() << 32, [], [0, 0], 0

        def row():
            docs = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *[pa.array([n], pa.int64()) for n in size], pa.array([_written(docs)], pa.binary())], names=["chunk", "n0", "n1", "docs"])

        for batch in batches:
            start = 0
            for i, (text, target) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                size[int(target)] += len(text.split()) + 1 if text else 1
                length += len(text) if text else 0
                if sum(size) >= most or length >= CHUNK_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row()
                    at, held, size, length, start = at + 1, [], [0, 0], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield row()

    return chunk


def _keys(docs: pa.Table, codes: Codes):
    """(words, pairs) of every document, and the sorted keys of the chunk with the place of each."""
    found = [slots(text, codes) for text in docs.column(1).to_pylist()]
    keys, at = np.unique(np.concatenate([x for both in found for x in both]), return_inverse=True)
    return found, keys, at


def _read(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all()


def _asking(bucket_bits: int):
    """The distinct keys of each chunk with their counts in rest and target, cut by the first bits of the key."""

    def ask(batches):
        codes = word_codes()
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs = _read(docs.as_py())
                found, keys, at = _keys(docs, codes)
                target = np.repeat(np.array(docs.column(2).to_pylist(), bool), [len(w) + len(p) for w, p in found])
                ours = np.bincount(at[target], minlength=len(keys))
                rest = np.bincount(at, minlength=len(keys)) - ours
                ends = np.searchsorted(keys >> np.uint64(64 - bucket_bits), np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
                rows = []
                for bucket, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    if a < b:
                        rows.append((chunk, bucket, b - a, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(rest[a:b]), _pack(ours[a:b])))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chunk", "bucket", "n", "keys", "rest", "target"])

    return ask


def _summing(parts: pa.Table) -> pa.Table:
    """The parts of a bucket with the counts of their chunk replaced by those of the whole corpus, in the same order."""
    n = parts.column("n").to_pylist()
    whole = lambda name: [_unpack(b.as_py(), k) for b, k in zip(parts.column(name), n)]
    _, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in whole("keys")]), return_inverse=True)
    ends, out = np.cumsum(n)[:-1], {}
    for name in ("rest", "target"):
        sums = np.bincount(at, weights=np.concatenate(whole(name)).astype(np.float64))  # exact up to 2^53
        out[name] = pa.array([_pack(x) for x in np.split(sums.astype(np.uint64)[at], ends)], pa.binary())
    return pa.table({"chunk": parts.column("chunk"), "bucket": parts.column("bucket"), "n": parts.column("n"), **out, "docs": pa.nulls(len(n), pa.binary())})


class Models:
    """Losses of both models: pair counts smoothed by word counts, the rest scaled to as many tokens as the target."""

    def __init__(self, total: dict, bits: int):
        self.total, self.vocabulary = total, 1 << (bits - WORD_BITS)
        self.scale = total["1"] / total["0"] if total["0"] and total["1"] else 1.0

    def losses(self, found, count: dict, own: str) -> tuple[float, float]:
        """Mean loss per token under (target, rest); ``found`` are places of words and pairs in ``count``.

        The text's own counts are taken out of the model it belongs to.
        """
        out = []
        (_, where, n), (_, at, k) = (np.unique(x, return_inverse=True, return_counts=True) for x in found)
        words, own_words, pairs, own_pairs = found[0], n[where].astype(np.float64), found[1], k[at].astype(np.float64)
        for m in "10":
            weight = 1.0 if m == "1" else self.scale
            less = 1.0 if m == own else 0.0
            each = weight * np.maximum(count[m][words] - less * own_words, 0)
            w, b = each[1:], each[:-1]
            p = weight * np.maximum(count[m][pairs] - less * own_pairs, 0)
            size = weight * max(self.total[m] - less * len(words), 0.0)
            word = (w + 0.5) / (size + 0.5 * self.vocabulary)
            out.append(float(-np.log((np.minimum(p, b) + PRIOR * word) / (b + PRIOR)).mean()))
        return out[0], out[1]


def _judging(models: Models):
    def judge(rows: pa.Table) -> pa.Table:
        parts = sorted((r for r in rows.to_pylist() if r["docs"] is None), key=lambda r: r["bucket"])
        docs = _read(next(d.as_py() for d in rows.column("docs") if d.is_valid))
        count = {m: np.concatenate([_unpack(r[name], r["n"]) for r in parts]).astype(np.float64) for m, name in (("0", "rest"), ("1", "target"))}
        found, _, at = _keys(docs, word_codes())
        n, ours, theirs, start = [], [], [], 0
        for (words, pairs), target in zip(found, docs.column(2).to_pylist()):
            middle, end = start + len(words), start + len(words) + len(pairs)
            n.append(len(pairs))
            a, b = models.losses((at[start:middle], at[middle:end]), count, "1" if target else "0") if len(pairs) else (None, None)
            ours.append(a)
            theirs.append(b)
            start = end
        score = [0.0 if a is None else b - a for a, b in zip(ours, theirs)]
        return pa.table({"doc_id": docs.column(0), "is_target": docs.column(2), "n_tokens": pa.array(n, pa.int64()), "target_loss": pa.array(ours, pa.float64()), "rest_loss": pa.array(theirs, pa.float64()), "score": pa.array(score, pa.float64())})

    return judge


def score_documents(docs: DataFrame, target_ids: DataFrame, chunk_tokens=CHUNK_TOKENS) -> DataFrame:
    """doc_id, is_target, n_tokens, target_loss, rest_loss and score of every row of ``docs``.

    score = rest_loss - target_loss per token (white-space words, lower-cased): above 0, the text is more like the
    documents named by ``target_ids`` (doc_id) than like the rest. All texts are counted, each in one model; a text is
    judged without its own counts. A text without a token (null, empty, blank) has null losses and score 0. Without
    target documents, or without others, both models are flat on one side and scores only compare texts with the other
    side. Extra columns of ``docs`` are left out; a null doc_id is never a target.

    Every distinct word and pair has a count of its own. Chunks of documents send the keys they hold with their counts
    to the key's bucket and get back the sums over the corpus, so no table of the whole model is held anywhere.
    """
    ids = target_ids.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("is_target"))
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = stored(rows.mapInArrow(_chunking(chunk_tokens), CHUNKS))
    total = chunks.agg(F.sum("n0"), F.sum("n1")).first()
    models = Models({m: float(n or 0) for m, n in zip("01", total)}, table_bits(text_bytes))
    bucket_bits = max(4, math.ceil(math.log2(text_bytes / BUCKET_BYTES + 1)))
    parts = chunks.select("chunk", "docs").mapInArrow(_asking(bucket_bits), PARTS)
    totals = parts.groupBy("bucket").applyInArrow(_summing, TOTALS)
    texts = chunks.select("chunk", F.lit(-1).alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("rest"), F.lit(None).cast("binary").alias("target"), "docs")
    out = "doc_id bigint, is_target boolean, n_tokens bigint, target_loss double, rest_loss double, score double"
    return totals.unionByName(texts).groupBy("chunk").applyInArrow(_judging(models), out)
