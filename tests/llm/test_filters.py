"""Mixing, decontamination, scores, personal data and language ID."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import SCHEMA, documents, prose, rows
from tidewright.llm import decontamination, language, lm, mixing, pii, toxicity

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_targets_refill_by_weight(spark):
    table = [("a", 1000), ("b", 10), ("c", 1000), ("d", 50), (None, 500), ("e", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(table, "source string, source_size long")).collect()}
    names, sizes = ["a", "b", "c", "d", "e", None], {s: float(n) for s, n in table}
    weights, full = {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while True:
        rate = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weights[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weights[s] * rate > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx({s: 3 * sizes[s] if s in full else weights[s] * rate for s in names})


def test_mix_meets_targets(spark):
    docs = documents(spark)
    out = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, t, *_ in rows())
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in out)
    by_source = {i: s for i, _, _, s, *_ in rows()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in out:
        s = by_source[r.doc_id]
        taken[s] += r.taken
        target[s], largest[s] = r.target, max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert got == +want


def test_rates_are_exponential_in_size(spark):
    """The dual's solution against a bisection by hand."""
    cells = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (10, 20), (100, 5), (900, 1))], "source string, size long, n long")
    total = 50 + 200 + 500 + 900
    for share in (0.2, 0.9, 1.7, 2.6):
        sources = spark.createDataFrame([("a", total, share * total)], "source string, source_size long, target double")
        r = mixing.balanced_rates(cells, sources).first()
        low, high = -50.0, 50.0
        words = lambda t: sum(n * s * min(3.0, np.exp(min(t * s / r.scale, 700))) for s, n in ((1, 50), (10, 20), (100, 5), (900, 1)))  # noqa: E731, B023
        assert words(r.tilt) == pytest.approx(share * total, rel=1e-6)
        assert low < r.tilt < r.scale * high


ITEMS = [(1, prose(300, 30)), (2, prose(301, 13)), (3, "Short Item here"), (4, None), (5, "..."), (6, prose(300, 30)), (7, "zebra"), (8, prose(302, 9)), (None, prose(303, 15))]


def contamination_by_hand(table, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(FOLD))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(len(w), 13)
        for s in range(len(w) - n + 1) if w else ():
            windows[tuple(w[s : s + n])].add("" if item is None else str(item))
    out = []
    for i, t, *_ in table:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return out


def test_decontamination(spark):
    table = rows()
    extra = lambda i, t: (i, t, "en", "s", 0, "e", "x", 1)
    long_item, edge = ITEMS[0][1].split(), ITEMS[1][1]
    table += [extra(500, prose(400, 50) + " " + " ".join(long_item[5:20]).upper() + "! " + prose(401, 50)), extra(501, " ".join(long_item[5:17])), extra(502, edge), extra(503, "a short, ITEM here... zebra")]
    table += [extra(504, prose(302, 9) + " " + prose(302, 9)), extra(505, " ".join([edge] * 40)), extra(506, prose(303, 15)), extra(507, "zebra " * 300)]
    docs = spark.createDataFrame(table, SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter(contamination_by_hand(table, ITEMS))
    got = decontamination.overlaps(docs, items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got) == want
    before = decontamination.MOST_BROADCAST
    decontamination.MOST_BROADCAST = 0  # the shuffled join gives the same
    try:
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontamination.overlaps(docs, items).collect()) == want
    finally:
        decontamination.MOST_BROADCAST = before
    bad = {i for i, n, hit, _ in want if hit and 20 * hit >= n}
    assert Counter(r.doc_id for r in decontamination.clean_documents(docs, items).collect()) == Counter(i for i, *_ in table if i not in bad)
    none = decontamination.overlaps(docs, items.where("false")).collect()
    assert len(none) == len(table) and all(r.n_hit == 0 and not r.items for r in none)
    assert decontamination.overlaps(docs.where("false"), items).count() == 0


def test_segments_are_the_maximal_ones():
    def by_hand(s):
        """Best segment, then both sides of it."""
        best = None
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                v = s[i:j].sum()
                if v > 1e-12 and (best is None or v > best[0] + 1e-12):
                    best = (v, i, j)
        if best is None:
            return []
        _, i, j = best
        return [(a, b) for a, b in by_hand(s[:i])] + [(i, j)] + [(a + j, b + j) for a, b in by_hand(s[j:])]

    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.normal(-0.3, 1, rng.integers(0, 30))
        assert [(a, b) for _, a, b in toxicity.segments(s)] == by_hand(s)


def test_segments_take_linear_time():
    """200,000 positives in ordinary text, which all stand alone, and one long falling and rising line of totals."""
    lone = np.tile([1.0, -3.0], 200_000)
    rising = np.concatenate([np.tile([1.0, -1.5], 100_000), np.tile([2.0, -0.5], 100_000)])
    start = time.time()
    assert len(toxicity.segments(lone)) == 200_000
    assert toxicity.segments(rising)
    assert time.time() - start < 3


def test_labels_beyond_the_documents(spark):
    """Labels of documents that aren't there take no room in the sample."""
    table = [(i, prose(i, 40) + (" scoundrel vermin" * 3 if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(table + [(table[0][0], table[0][1])], "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(i, 0) for i in range(10_000, 30_000)]
    out = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), most_rows=300).collect()
    assert Counter(r.doc_id for r in out)[0] == 2
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in out if r.held_out]) > 0.95


def test_toxicity_held_out(spark):
    bad = ["scoundrel", "villain", "vermin"]
    table, labels = [], []
    for i in range(400):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            words[20:20] = [bad[i % 3], bad[(i + 1) % 3], bad[i % 3]]
        table.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    table += [(1000, None), (1001, ""), (None, "villain"), (1002, "vermin " * 5000)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, known).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert len(out) == len(table) and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].predicted == out[1001].predicted == 0 and out[1002].predicted == 1
    assert [(p.start, p.end) for p in out[1002].passages] == [(0, 5000)]
    assert all(p.start <= 20 and p.end >= 23 for r in held for p in r.passages)
    assert {r.score for r in toxicity.score_documents(docs, known.where("false")).collect()} == {0.0}
    assert toxicity.score_documents(docs.where("false"), known).count() == 0


KIND_TESTS = ["a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +49 30 901820 +", "é ü 𝒳 mail a.b+c@d-e.co.uk 𝒳x", "a" * 30000, "1" * 30000, "1 " * 8000, "+1" + " " * 9000, "a@b@c@d.e", "1.1." * 3000]


def spans_by_hand(t):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum((lambda x: x - 9 if x > 9 else x)(int(c) * (i % 2 + 1)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in v.split("."))) or (k == 2 and 12 <= len(d) <= 19 and luhn) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    table = rows() + [(600 + i, t, "en", "s", 0, "e", "x", 1) for i, t in enumerate(KIND_TESTS)]
    got = pii.find(spark.createDataFrame(table, SCHEMA)).collect()
    want = Counter((i, tuple(spans_by_hand(t or ""))) for i, t, *_ in table)
    assert Counter((r.doc_id, tuple((p.s, p.k, p.e) for p in r.base)) for r in got) == want
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_revealing_terms(spark):
    """A nickname that stands beside one address alone is told; common words and one-off words aren't."""
    table = [(i, f"{prose(i, 30)} write to Quastel at quastel@example.org about house water {prose(i + 50, 5)}") for i in range(4)]
    table += [(10 + i, f"{prose(90 + i, 40)} house water light stone") for i in range(60)]
    table += [(200, "lonely unicorn single@example.org today"), (201, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    text = dict(table)
    told = {text[i][p.s : p.e] for i, r in out.items() if text[i] for p in r.spans if p.k == 4}
    assert "Quastel" in told and "house" not in told and not {"lonely", "unicorn"} & told
    clean = docs.join(pii.find(docs).select("doc_id", "spans"), "doc_id").select("doc_id", pii.sanitised(docs["text"], "spans").alias("t"))
    texts = {r.doc_id: r.t for r in clean.collect()}
    assert "Quastel" not in texts[0] and "[email]" in texts[0] and "quastel@" not in texts[0] and texts[10] == text[10]


def test_language_held_out(spark):
    docs = documents(spark)
    out = language.predictions(docs).collect()
    lang = {i: la for i, _, la, *_ in rows()}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(out) == len(rows()) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902, 903, 904))
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in language.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predictions(docs.where("false")).count() == 0


def test_rare_language_is_learned_beside_a_huge_one(spark):
    table = [(i, prose(i, 30, "en"), "en") for i in range(3000)] + [(5000 + i, prose(i, 30, "fr"), "fr") for i in range(12)]
    out = language.identify(spark.createDataFrame(table, "doc_id long, text string, lang string"), most_rows=400).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_languages_past_the_limit_stay_unlearned(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    table = [(i, prose(i, 30, "en"), "en") for i in range(300)] + [(500 + i, prose(i, 30, "fr"), "fr") for i in range(60)] + [(900 + i, prose(i, 30, "de"), "de") for i in range(9)]
    out = language.identify(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} <= {"en", "fr"} and all(r.lang_pred == r.lang for r in out if r.lang != "de")


def test_decoding_equals_plain_counts(spark):
    """Weights from blocks in Spark are those of dense tables of all counts."""
    table = [(i, prose(i, 25, lang), lang) for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    model = language.train(spark.createDataFrame(table, "doc_id long, text string, lang string"))
    counts = {n: np.zeros(language.BUCKETS) for n in model.languages}
    for i, text, lang in table:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            np.add.at(counts[lang], language.grams(text), 1)
    share = np.stack([(counts[n] + 0.5) / (counts[n].sum() + 0.5 * language.BUCKETS) for n in model.languages])
    for k, bit in enumerate(model.book.T):
        want = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))
        assert np.allclose(model.weights[:, k], want, atol=1e-5)


def test_codebooks_keep_codewords_apart():
    for n in (1, 2, 3, 4, 5, 8, 30):
        book = language.codebook(n)
        apart = [(book[i] != book[j]).sum() for i in range(n) for j in range(i)]
        assert book.shape[0] == n and min(apart, default=1) >= 1
        if n >= 4:
            assert min(apart) >= 3  # one wrong bit can be mended


def test_loss_difference(spark):
    good, other = [(i, prose(i, 80, "en")) for i in range(60)], [(100 + i, prose(i, 80, "de")) for i in range(60)]
    odd = [(200, prose(500, 80, "en")), (201, prose(500, 80, "de")), (202, None), (203, ""), (204, " \n"), (None, prose(1, 9))]
    docs = spark.createDataFrame(good + other + odd, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i, _ in good] + [(0,), (None,)], "doc_id long")
    out = {r.doc_id: r for r in lm.score_documents(docs, target).collect()}
    assert len(out) == len(good + other + odd) and out[200].score > 0.1 > -0.1 > out[201].score
    assert all(out[i].score == 0 and out[i].target_loss is None and out[i].n_tokens == 0 for i in (202, 203, 204))
    assert out[0].is_target and not out[100].is_target and not out[None].is_target
    bits, tables = lm.table_bits(sum(len((t or "").encode()) for _, t in good + other + odd)), {}
    ids, codes = {i for i, _ in good}, lm.word_codes()
    for i, t in good + other + odd:  # the same sums, counted by hand
        for kind, at in zip("wp", lm.slots(t, codes, bits)):
            counts = tables.setdefault(f"{kind}{int(i in ids)}", Counter())
            counts.update(at.tolist())
    total = {m: sum(tables[f"w{m}"].values()) for m in "01"}
    words, pairs = (x.tolist() for x in lm.slots(dict(good)[7], codes, bits))
    mine_w, mine_p, loss = Counter(words), Counter(pairs), {}
    for m in "01":
        scale, less = (1, 1) if m == "1" else (total["1"] / total["0"], 0)
        c = lambda x: scale * max(tables[f"w{m}"][x] - less * mine_w[x], 0)  # noqa: E731, B023
        uni = lambda x: (c(x) + 0.5) / (scale * max(total[m] - less * len(words), 0) + 0.5 * 2 ** (bits - lm.WORD_BITS))  # noqa: E731, B023
        ps = [scale * max(tables[f"p{m}"][x] - less * mine_p[x], 0) for x in pairs]
        loss[m] = -np.mean([np.log((min(p, c(h)) + lm.PRIOR * uni(w)) / (c(h) + lm.PRIOR)) for p, h, w in zip(ps, words[:-1], words[1:])])
    assert out[7].target_loss == pytest.approx(loss["1"], rel=1e-5) and out[7].rest_loss == pytest.approx(loss["0"], rel=1e-5)
    assert lm.score_documents(docs.where("false"), target).count() == 0
    assert lm.score_documents(docs, target.where("false")).count() == len(out)
