"""Operators do the whole job: every word, pair, term, row and text."""

from collections import Counter

import numpy as np
import pytest

from tests.llm.tables import prose
from tidewright.llm import lm, pii


def test_every_word_and_pair_has_its_own_count(spark):
    """Far more words than the least vocabulary: losses are those of plain dictionaries, over several chunks."""
    texts = [" ".join(f"w{i * 701 + j}" for j in range(700)) + " " + prose(i % 7, 30) + f" w{(i + 1) * 701}" for i in range(60)]
    docs, ids = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), set(range(20))
    out = {r.doc_id: r for r in lm.score_documents(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long"), 5000).collect()}
    bits, tables = lm.table_bits(sum(map(len, texts))), {m: Counter() for m in "01"}
    split = lambda t: ([""] + t.split(), list(zip([""] + t.split(), t.split())))
    for i, t in enumerate(texts):
        tables[str(int(i in ids))].update([x for both in split(t) for x in both])
    total = {m: sum(n for x, n in tables[m].items() if isinstance(x, str)) for m in "01"}
    for i in (0, 19, 20, 59):
        words, pairs = split(texts[i])
        mine = Counter(words + pairs)
        for m, got in (("1", out[i].target_loss), ("0", out[i].rest_loss)):
            scale, less = 1 if m == "1" else total["1"] / total["0"], m == str(int(i in ids))
            c = lambda x: scale * (tables[m][x] - less * mine[x])  # noqa: E731, B023
            uni = lambda w: (c(w) + 0.5) / (scale * (total[m] - less * len(words)) + 0.5 * 2 ** (bits - lm.WORD_BITS))  # noqa: E731, B023
            assert got == pytest.approx(-np.mean([np.log((min(c(p), c(p[0])) + lm.PRIOR * uni(p[1])) / (c(p[0]) + lm.PRIOR)) for p in pairs]), rel=1e-9)
    assert lm.table_bits(30 << 30) > lm.table_bits(3 << 30) > lm.table_bits(300 << 20)


def test_terms_anywhere_in_the_document(spark):
    """A short name far from its address is told and marked at every mention; common words and one-off words aren't."""
    far = " ".join(["house water"] * 40)
    table = [(i, f"Ito {prose(i, 20)} {far} mail ito.x@example.org {far} 李 {prose(i + 50, 5)} Ito") for i in range(4)]
    table += [(10 + i, f"house water {prose(90 + i, 40)}") for i in range(60)] + [(90, "lonely far@example.org"), (None, table[0][1])]
    out = pii.find(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert len(out) == len(table)
    for r in out:
        text = dict(table)[r.doc_id]
        told = [text[p.s : p.e] for p in r.spans if p.k == 4]
        assert told.count("Ito") == 2 * ("Ito" in text) and told.count("李") == ("李" in text)
        assert not {"house", "water", "lonely", "ito", "example"} & set(told)


def test_texts_without_blanks_are_cut_by_bytes(spark, monkeypatch):
    """A table of unspaced texts, one token each, comes in chunks of a bounded size; scores don't depend on the chunks."""
    docs = spark.createDataFrame([(i, f"{i % 7}" * 500) for i in range(400)], "doc_id long, text string").coalesce(1)
    target = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    whole = sorted(map(str, lm.score_documents(docs, target).collect()))
    seen = []
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    made = docs.select("doc_id", "text", (docs["doc_id"] < 50).alias("t")).mapInArrow(lm._chunking(10**9), lm.CHUNKS)
    seen = [r.n0 + r.n1 for r in made.collect()]
    assert len(seen) == 10 and sum(seen) == 800
    assert sorted(map(str, lm.score_documents(docs, target).collect())) == whole
