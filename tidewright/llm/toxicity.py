"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Codes, bucket_of, doc_crc, stored
from tidewright.llm.language import sample

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 18  # hashed tokens and word beginnings: the model is 1 MB whatever the corpus
STEMS = (4, 5, 6)  # lengths of the beginnings that stand in for inflected words
TRAINING_ROWS = 20_000  # at most so many labelled rows are learned from
PRIOR = 500.0  # weight of the Dirichlet prior, in tokens
SURE = 2.5  # log-odds count as far as they are sure to this many standard deviations
DRIFT = 0.5  # cost of a neutral token inside a passage
E_VALUE = 0.01  # a passage is significant if chance gives fewer than so many in a text of that length
EULER = 0.5772156649015329
LOWEST, HIGHEST = -20.0, 60.0  # bounds of the statistic; a text without a positive token has the lowest


def features(word: str) -> tuple[int, ...]:
    """Buckets of a token: itself and its beginnings."""
    return (bucket_of(word, BUCKETS), *(bucket_of(f"{word[:n]}*", BUCKETS) if len(word) > n else bucket_of(word, BUCKETS) for n in STEMS))


def tokens(text, codes: Codes) -> list:
    """What ``codes`` has for each token of a text; null has none."""
    return [codes[w] for w in TOKEN.findall(text.lower())] if text else []


def _counting(batches):
    """Partial token counts of a task: (bucket, toxic count, other count)."""
    codes, totals = Codes(features), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = tokens(text, codes)
            if found:
                totals[1 - label] += np.bincount(np.array(found).ravel(), minlength=BUCKETS)
    used = np.flatnonzero(totals.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0, used]), pa.array(totals[1, used])], names=["bucket", "toxic", "other"])


def token_scores(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log-odds ratio with an informative Dirichlet prior, cut to what is sure, less the drift."""
    both = toxic + other
    prior = PRIOR * (both + 1e-3) / (both + 1e-3).sum()
    a, b = toxic + prior, other + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    doubt = SURE * np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0) - DRIFT


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root x of sum(share * exp(x * score)) = 1: how fast chance passages get rarer with their score."""
    if scores.max(initial=-1) <= 0 or not share[scores > 0].sum():
        return 1.0
    low, high = 0.0, 1.0
    mass = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum())
    while mass(high) < 1 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mass(mid) < 1 else (low, mid)
    return high


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in one pass and linear time.

    Runs of non-positive tokens are folded into running totals first, so the loop visits positive tokens alone. Each
    new positive run looks back for the last segment whose left total is lower; it merges with it when its own right
    total is higher, else stands alone. Every kept segment remembers the one it found, and looking back hops from one
    to the next: a segment that is hopped over is never met again.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    lefts, rights = total[positive].tolist(), total[positive + 1].tolist()
    kept: list[tuple] = []  # left total, right total, start, end, the segment found
    for i, left, right in zip(positive.tolist(), lefts, rights):
        start, j = i, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                break
            left, _, start, _, back = kept[j]
            del kept[j:]
            j = back
        kept.append((left, right, start, i + 1, j))
    return [(r - l, s, e) for l, r, s, e, _ in kept]


class Model:
    """A token scores as the surest of its features; ``rate`` and ``log_k`` turn sums into chance expectations."""

    def __init__(self, scores, rate, log_k=0.0, intercept=0.0, slope=1.0):
        self.scores, self.rate, self.log_k, self.intercept, self.slope = scores, rate, log_k, intercept, slope

    def codes(self) -> Codes:
        def best(word):
            own = self.scores[list(features(word))]
            return float(own[np.argmax(np.abs(own + DRIFT))])

        return Codes(best)

    def passages(self, scores: np.ndarray):
        """Normalised scores (rate * S - ln(K n)) of the segments, best first, with their token spans."""
        base = self.log_k + math.log(max(len(scores), 1))
        return sorted(((self.rate * s - base, lo, hi) for s, lo, hi in segments(scores)), reverse=True)

    def statistic(self, passages) -> float:
        """The best sum statistic over the r best passages."""
        best, total = LOWEST, 0.0
        for r, (x, _, _) in enumerate(passages, 1):
            if r > 1 and x <= math.log(r):
                break
            total += x - (math.log(r) if r > 1 else 0)
            best = max(best, total)
        return min(best, HIGHEST)

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * statistic))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak ridge; the slope is never negative."""
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS) -> Model | None:
    """Learn from a bounded sample of labelled rows outside the held-out fold; None when there is no such row.

    A doc_id with several labels is toxic if one says so. Scores come from one half of the sample and calibration from
    the other, so that the tokens of a text don't vouch for themselves.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (doc_crc() % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels may cover more than these documents
    chosen = sample(known, most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most most_rows rows of 12 bytes
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2))
    label = F.when(F.col("_toxic") > 0, 1).otherwise(0).cast("int").alias("label")
    first, second = rows.where(half == 0).select("text", label), rows.where(half == 1).select("text", label)
    counts = stored(first.mapInArrow(_counting, "bucket bigint, toxic bigint, other bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))).toPandas()
    if counts.empty:
        return None
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[counts["bucket"]], other[counts["bucket"]] = counts["toxic"], counts["other"]
    scores = token_scores(toxic, other)
    model = Model(scores.astype(np.float32), decay(scores, other / max(other.sum(), 1)))

    def measured():
        """(label, best segment, tokens, statistic) of the second half under the model as it is: at most most_rows rows."""
        shared = spark.sparkContext.broadcast(vars(model))

        def measure(batches):
            model = Model(**shared.value)
            codes = model.codes()
            for batch in batches:
                found = [np.array(tokens(t, codes)) for t in batch.column(0).to_pylist()]
                best = [max((s for s, _, _ in segments(at)), default=0.0) for at in found]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([float(b) for b in best]), pa.array([len(at) for at in found]), pa.array([model.statistic(model.passages(at)) for at in found], pa.float64())], names=["label", "best", "n", "t"])

        return second.mapInArrow(measure, "label int, best double, n bigint, t double").toPandas()

    seen = measured()
    clean = seen[(seen["label"] == 0) & (seen["best"] > 0)]
    if len(clean) > 20:  # a chance maximum is Gumbel distributed, with its mean at EULER
        model.log_k = float(np.median(model.rate * clean["best"] - np.log(clean["n"].clip(lower=1))) - EULER)
        seen = measured()
    if seen["label"].nunique() == 2:
        model.intercept, model.slope = _logistic(seen["t"].to_numpy(), seen["label"].to_numpy(float))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (token spans) of every row of ``docs``.

    A null or empty text has no token and gets the lowest score; without labelled rows every score is 0. Repeated rows come
    out as often as they go in, an empty table gives an empty one.
    Labels, lang, source and doc_id are no input of a score. Extra columns of ``docs`` are left out.
    """
    trained = train(docs, labels, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vars(trained) if trained else None)
    rows = docs.select("doc_id", F.coalesce(doc_crc() % 4 == 2, F.lit(False)).alias("held_out"), "text")
    limit = -math.log(E_VALUE)

    def judge(batches):
        model = Model(**shared.value) if shared.value else None
        codes = model.codes() if model else None
        for batch in batches:
            found = [np.array(tokens(t, codes)) if model else () for t in batch.column(2).to_pylist()]
            ranked = [model.passages(at) if model else [] for at in found]
            scores = [model.probability(model.statistic(x)) if model else 0.0 for x in ranked]
            spans = [[{"start": lo, "end": hi, "evidence": float(x)} for x, lo, hi in some if x >= limit] for some in ranked]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32()), pa.array(spans, kind)],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    out = "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<start:bigint,end:bigint,evidence:double>>"
    return rows.mapInArrow(judge, out)
