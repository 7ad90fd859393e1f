"""Language ID by error-correcting output codes over character n-grams."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import doc_crc, stored

OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
BUCKETS = 1 << 16  # hashed n-grams: the top 16 bits of a multiplied code
TRAINING_ROWS = 20_000  # at most so many labelled rows train the classifiers
LEAST_ROWS = 100  # of every language, however many there are
MOST_LANGUAGES = 1024  # keeps the model's size bounded: those with most rows are learned, the rest can't be predicted
BLOCK = 1024  # buckets whose weights are worked out in one group
SMOOTHING, CLEAR_GRAMS = 0.5, 24


def grams(text) -> np.ndarray:
    """Hash buckets of the 1- to 3-grams of a lower-case text whose runs of other characters became one blank each.

    Empty if the text is null or holds no letter.
    """
    if not text or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64)
    letters = f" {OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass")
    one = np.frombuffer(letters, np.uint32).astype(np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:]
    three = two[:-1] * np.uint64(0x9E3779B1) + one[2:]
    hashed = [(part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48) for part in (one[1:-1], two + np.uint64(1 << 40), three + np.uint64(1 << 41))]
    return np.concatenate(hashed).astype(np.int64)


def codebook(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, a row per language: exhaustive up to five languages, else the best of random books."""
    if languages == 1:
        return np.ones((1, 1), np.int8)
    if languages <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(10 * np.log2(languages)))
    rng, best, gap = np.random.default_rng(seed), None, -1
    for _ in range(50):
        book = rng.choice(np.array([-1, 1], np.int8), size=(languages, bits))
        book = book[:, np.abs(book.sum(axis=0)) < languages]
        if not book.shape[1]:
            continue
        near = (book.shape[1] - (book.astype(np.int32) @ book.T)) // 2 + np.eye(languages, dtype=np.int32) * bits
        if near.min() > gap:
            best, gap = book, near.min()
    return best


def _counting(batches):
    """Partial n-gram counts of a task: (lang, bucket, n)."""
    totals = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = grams(text)
            if len(found):
                counts = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(found, minlength=BUCKETS)
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], names=["lang", "bucket", "n"])


class Model:
    """One weight per n-gram bucket and code bit, the codebook, and how far each bit is trusted."""

    def __init__(self, languages, book, weights, trust=None):
        self.languages, self.book, self.weights = languages, book, weights
        self.trust = np.full(book.shape, 1.0 / book.shape[1]) if trust is None else trust

    def margins(self, found: np.ndarray) -> np.ndarray:
        """Summed log-odds per bit, shrunk so that a long text counts as CLEAR_GRAMS independent n-grams."""
        if len(found) > BUCKETS:
            total = np.bincount(found, minlength=BUCKETS) @ self.weights
        else:
            total = self.weights[found].sum(axis=0, dtype=np.float64)
        return total * (min(len(found), CLEAR_GRAMS) / len(found))

    def decode(self, margins: np.ndarray) -> tuple[int, float]:
        """Nearest codeword by trust-weighted logistic loss, and its share among all codewords."""
        loss = (self.trust * np.logaddexp(0, -self.book * margins)).sum(axis=1)
        share = np.exp(-(loss - loss.min()) * self.book.shape[1])
        best = int(np.argmax(share))
        return best, float(share[best] / share.sum())


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the rows' ids, picked by a hash, whatever the partitions."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_rows(docs: DataFrame, most_rows: int) -> DataFrame:
    """(text, lang) of a sample of labelled rows outside the held-out fold, some ``most_rows`` in all.

    Languages share the rows evenly, at least LEAST_ROWS each; rows are picked by a hash of the id against the share of
    their language, so a rare language is learned beside a huge one and no language is gathered in one task.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_crc() % 3 != 1))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES).collect()
    each = max(LEAST_ROWS, most_rows // max(len(sizes), 1))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["rows"])) for r in sizes], "_lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    return usable.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(drawn).select("text", "lang")  # at most MOST_LANGUAGES shares


def _weighing(languages: list[str], totals: np.ndarray, book: np.ndarray):
    """Log-odds of every code bit for the buckets of one block; each language weighs the same."""
    place = {n: i for i, n in enumerate(languages)}

    def weights(dense: np.ndarray) -> np.ndarray:
        share = (dense + SMOOTHING) / (totals[:, None] + SMOOTHING * BUCKETS)
        zero = np.zeros(dense.shape[1])
        return np.stack([np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)) if (bit < 0).any() else zero for bit in book.T], axis=1).astype(np.float32)

    def weigh(rows: pa.Table) -> pa.Table:
        dense = np.zeros((len(languages), BLOCK))
        bucket = rows.column("bucket").to_numpy()
        dense[[place[n] for n in rows.column("lang").to_pylist()], bucket % BLOCK] = rows.column("n").to_numpy()
        return pa.table({"block": pa.array([int(bucket[0]) // BLOCK], pa.int64()), "weights": pa.array([weights(dense).tobytes()], pa.binary())})

    return weights, weigh


def train(docs: DataFrame, most_rows: int = TRAINING_ROWS) -> Model | None:
    """Fit the bit classifiers on a bounded sample of labelled rows outside the held-out fold.

    Every n-gram of the sampled texts counts. Codewords belong to the languages in code point order. Returns None
    when there is nothing to learn from. The driver gets one weight per bucket and code bit, never the counts.
    """
    spark = docs.sparkSession
    chosen = training_rows(docs, most_rows)
    counts = stored(chosen.mapInArrow(_counting, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # at most MOST_LANGUAGES rows
    languages = sorted(sums)
    if not languages:
        return None
    book = codebook(len(languages))
    plain, weigh = _weighing(languages, np.array([float(sums[n]) for n in languages]), book)
    blocks = counts.groupBy((F.col("bucket") / BLOCK).cast("bigint").alias("block")).applyInArrow(weigh, "block bigint, weights binary").collect()
    found = {r["block"]: np.frombuffer(r["weights"], np.float32).reshape(BLOCK, -1) for r in blocks}
    weights = np.concatenate([found[i] if i in found else plain(np.zeros((len(languages), BLOCK))) for i in range(BUCKETS // BLOCK)])
    model = Model(languages, book, weights)
    shared, place = spark.sparkContext.broadcast(vars(model)), {n: i for i, n in enumerate(languages)}

    def hits(batches):
        model = Model(**shared.value)
        right, seen = np.zeros(model.book.shape), np.zeros((len(model.languages), 1))
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(text)
                if len(found):
                    right[place[lang]] += model.margins(found) * model.book[place[lang]] > 0
                    seen[place[lang]] += 1
        for i, row in enumerate(right):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(row)), pa.array(np.arange(len(row))), pa.array(row), pa.array([float(seen[i, 0])] * len(row))], names=["language", "bit", "hits", "n"])

    tested = chosen.mapInArrow(hits, "language bigint, bit bigint, hits double, n double").groupBy("language", "bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas()
    trust = np.zeros(book.shape)
    trust[tested["language"], tested["bit"]] = (tested["hits"] + 1) / (tested["n"] + 2)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, most_rows: int = TRAINING_ROWS, clear: float = 0.6) -> DataFrame:
    """``docs`` + held_out, lang_pred, score and ambiguous.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when no labelled row exists.
    Otherwise the language with the nearest codeword wins, the first by code point on a tie, and ``ambiguous`` marks
    a share below ``clear``. A row with a null doc_id is neither learned from nor held out. Columns of ``docs`` that
    have one of the new names are replaced. Repeated rows come out as often as they go in, an empty table gives an empty one.
    """
    spark, model = docs.sparkSession, train(docs, most_rows)
    shared = spark.sparkContext.broadcast(vars(model) if model else None)
    new = ["held_out", "lang_pred", "score", "ambiguous"]
    docs = docs.drop(*new).withColumn("held_out", F.coalesce(doc_crc() % 3 == 1, F.lit(False)))
    at = docs.columns.index("text")

    def predict(batches):
        model = Model(**shared.value) if shared.value else None
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at).to_pylist():
                found = grams(text) if model else ()
                best, score = model.decode(model.margins(found)) if len(found) else (None, 0.0)
                langs.append(UNKNOWN if best is None else model.languages[best])
                scores.append(score)
            vague = [s < clear for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(vague, pa.bool_())], names=[*batch.schema.names, *new[1:]])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(new[1:], ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(predict, schema)


def predictions(docs: DataFrame, most_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id and what ``identify`` adds, for every row; nulls, repeats and empty tables as there."""
    return identify(docs.select("doc_id", "text", "lang"), most_rows).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
