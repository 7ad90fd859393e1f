"""The pipeline's stages, each against what its operator decides by hand on a small corpus."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.tables import documents, prose, rows
from tests.llm.test_filters import contamination_by_hand
from tests.llm.test_groups import components_by_hand, fingerprint
from tidewright.llm.stages import COLUMNS

ITEMS = [(1, prose(20, 25)), (2, prose(5, 80)), (3, None)]


def test_stages(spark, tmp_path):
    docs = documents(spark).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "sharding":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
    text = {i: t for i, t, *_ in rows()}
    no_letter = {i for i, t in text.items() if not t or not any(c.isalpha() for c in t)}
    told = {r.doc_id for r in kept["language_id"]}
    assert not told & no_letter and len(told) >= 0.9 * (len(text) - len(no_letter))

    prints = {i: fingerprint(text[i]) for i in told if i is not None}
    ids = sorted(prints)
    root = components_by_hand(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    single = Counter(r.doc_id for r in kept["near_dedup"])
    assert single == Counter([i for i in ids if root[i] == i] + [None] * (None in told))

    judged = contamination_by_hand([(r.doc_id, r.text) for r in kept["near_dedup"]], ITEMS)
    bad = {i for i, n, hit, _ in judged if hit and 20 * hit >= n}
    assert bad and Counter(r.doc_id for r in kept["decontamination"]) == Counter(i for i in single if i not in bad)

    before, after = {r.doc_id for r in kept["decontamination"]}, Counter(r.doc_id for r in kept["mixing"])
    assert set(after) <= before and max(after.values()) <= 3
    taken = defaultdict(int)
    for r in kept["mixing"]:
        taken[r.source] += len(r.text.split())
    assert len(taken) > 1

    final = kept["sharding"]
    assert Counter(r.doc_id for r in final) == after
    slots = defaultdict(list)
    for r in final:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(16)) <= 1
    assert Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter((r.doc_id, r.shard, r.slot) for r in final)


def test_empty_corpus(spark, tmp_path):
    documents(spark).select(*COLUMNS).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
