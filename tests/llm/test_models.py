"""Byte-level BPE, clustering over zone maps and count cells, against other ways to the same results."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.tables import documents, rows
from tidewright.llm import bpe, divergence, zones

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = " \t\n\r\x0b\x0c\x1c\x1f\x85  　'stremdlv aAbBéß中文字😀١²½Ⅷ_-.,!?0189​́‍"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_are_those_of_the_library(spark, library):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 5000, "ab" * 3000, "ACGT" * 2000 + "x", "\n" * 3000, "中" * 1000, "=" * 2000 + "a", "".join(draw.choice("qwertzuiopASDFG") for _ in range(3000))]
    texts += [t for _, t, *_ in rows()] + [None, "", "x"]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(7, texts[7], "", ""), (None, "no id", "", "")], "doc_id long, text string, ids string, chunk string")
    out = bpe.encode(docs.repartition(4), PATH, public_tokenizers.PATTERN).withColumn("back", bpe.decoded(F.col("ids"), PATH)).collect()
    assert Counter(r.doc_id for r in out) == Counter([*range(len(texts)), 7, None])
    for r in out:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert list(r.ids) == library.encode_ordinary(text) and bytes(r.back) == text.encode()
        assert bytes(r.packed) == np.array(r.ids, "<u4").tobytes()
    assert bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_fold_and_heap_agree(spark, library):
    ranks, draw = bpe.read_ranks(PATH), random.Random(2)
    words = ["".join(draw.choice("aeiounst th") for _ in range(draw.randint(1, 60))).encode() for _ in range(200)] + [bytes([i]) for i in range(256)] + [bytes(draw.randrange(256) for _ in range(20)) for _ in range(50)]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    for r in df.select("w", bpe.encoded(F.col("w"), bpe.rank_map(ranks)).alias("ids")).collect():
        assert list(r.ids) == bpe.merged(bytes(r.w), ranks) == library._encode_single_piece(bytes(r.w))


def test_long_word_takes_moderate_time():
    ranks = bpe.read_ranks(PATH)
    word = random.Random(3).choices(b"acgt", k=200_000)
    ids = bpe.merged(bytes(word), ranks)
    names = {i: t for t, i in ranks.items()}
    assert b"".join(names[i] for i in ids) == bytes(word)


def floor_mean(total, n):
    return total // n


def clusters_by_hand(vectors, k, rounds, dims, salt):
    kept = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, gaps.index(min(gaps)), min(gaps), v))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, j, _, v in assign():
            groups[j].append(v)
        for j, members in groups.items():
            centroids[j] = [floor_mean(sum(col), len(members)) for col in zip(*members)]
    return assign(), centroids


@pytest.mark.parametrize("size", [1.0, 50_000.0])
def test_clusters_equal_plain_rounds(spark, size):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(6, 8)) * size
    vectors = [(i, [float(x) for x in middles[i % 6] + draw.normal(size=8) * size * 0.05]) for i in range(700)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(400)]  # one vector many times
    vectors += [(5, vectors[5][1])] * 3  # repeated rows
    vectors += [(2000, None), (2001, []), (2002, [0.0] * 7), (2003, [0.0] * 9), (2004, [0.0] * 7 + [None]), (2005, [0.0] * 7 + [float("nan")]), (2006, [float("-inf")] + [0.0] * 7), (2007, [0.0] * 8), (2008, [-0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, key int").repartition(5)
    out, centroids = zones.cluster_vectors(df, 10, 4, 8, salt="2:")
    want, last = clusters_by_hand(vectors, 10, 4, 8, "2:")
    got = out.collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((i, j, d) for i, j, d, _ in want)
    assert centroids.tolist() == last
    inertia = Counter()
    for _, j, d, _ in want:
        inertia[j] += d
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) for r in got)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 2.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    out, centroids = zones.cluster_vectors(df, 40, 5, 2)
    assert len(centroids) == 3 and sorted((r.vec_id or 0, r.distance) for r in out.collect()) == [(0, 0), (1, 0), (2, 0)]
    out, centroids = zones.cluster_vectors(df.where("false"), 40, 5, 2)
    assert out.count() == 0 and len(centroids) == 0 and "cluster_inertia" in out.columns


def test_curve_visits_every_cell_by_single_steps():
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    keys = [k.tobytes() for k in zones.curve_keys(cells, 2)]
    line = cells[sorted(range(64), key=keys.__getitem__)]
    assert len(set(keys)) == 64 and (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_the_nearest():
    draw = np.random.default_rng(5)
    for _ in range(200):
        points, centroids = draw.integers(-300, 300, (20, 4)) // draw.integers(1, 40), draw.integers(-300, 300, (9, 4))
        some = zones.candidates(points.min(axis=0), points.max(axis=0), centroids)
        best = ((points[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert set(best.tolist()) <= set(some.tolist())


def audit_by_hand(docs, ranks):
    terms_of = lambda text: [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    counts, held, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in docs:
        found = Counter(terms_of(text))
        counts[lang or "", source or ""].update(found)
        of_lang[lang or ""].update(found)
        held[lang or ""].update(found.keys())
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, d in held[lang].items() if d >= 3]
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = share(own)
        pairs = []
        for (other_lang, other), theirs in counts.items():
            if other_lang == lang and other != source:
                q = share(theirs)
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        q = share(of_lang[lang])
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return out


@pytest.mark.parametrize("ranks", [200, 7])
def test_audit_equals_plain_counts(spark, ranks):
    extra = [(3000 + i, "Zebra ünïque zebra", "xx", f"only{i % 2}", 0, "", "", 0) for i in range(2)] + [(3100, "", "yy", "alone", 0, "", "", 0)]
    table = rows() + extra
    got = divergence.audit(documents(spark, table), ranks).collect()
    assert Counter(tuple(r) for r in got) == Counter(audit_by_hand(table, ranks))


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark).where("false")).count() == 0
