"""Queries do the whole job on texts with awkward marks."""

from types import SimpleNamespace

from tidewright.plans import job_queries, text_queries


def test_pairs_of_texts_with_brackets(spark):
    texts = ["[Answer] [1] c [End] e", "a\ue000b [x[ \ue000e [[ \ue000", "plain words only here now", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.pair_no): (r.question, r.answer, r.reason) for r in job_queries.knowledge_pairs(SimpleNamespace(documents=docs)).collect()}
    want = {}
    for i, t in enumerate(texts[:3]):
        w = t.split()
        for k in range(2):
            q, a = f"{('What of', 'And')[k]} {w[2 * k]}?", w[2 * k + 1]
            faithful, relevant = len(a.encode()) % 4 == 0, len(q.encode()) % 5 == 0
            want[i, k] = (q, a, "faithful" if faithful else "relevant" if relevant else None)
    assert got == want


def test_documents_with_references_of_their_own(spark):
    table = [(0, "body References [1] References [2]", "s"), (4, "References first", "s"), (1, "plain", "s"), (2, "mid References", "s"), (8, "plain", None), (3, None, "s"), (5, "", "s")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = {r.doc_id: r.cut for r in text_queries.without_references(SimpleNamespace(documents=docs)).collect()}
    assert got == {i: None if t is None else t.split("References")[0] for i, t, _ in table}
