"""Sharding, near-duplicates, line dedup and embedding links against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.tables import SCHEMA, documents, prose, rows
from tidewright.llm import embeddings, lines, sharding, simhash
from tidewright.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components_by_hand(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_shards_are_level_gapless_and_reproducible(spark):
    docs = documents(spark)
    out = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, 1 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows()
    )
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shard_documents(docs.where("false")).count() == 0


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 5, 17, 100, 1009):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, spark, 7)).collect()]
        assert sorted(got) == list(range(n))


def test_repeated_rows_take_places_of_their_own(spark):
    same = spark.createDataFrame([(1, "a")] * 500 + [(2, "b")] * 3, "doc_id long, text string")
    out = sharding.shard_rows(same, 4, ["doc_id", "text"]).collect()
    assert len(out) == 503 and len({(r.shard, r.slot) for r in out}) == 503


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_components(spark):
    out = simhash.components_of(documents(spark)).select("doc_id", simhash.hex_of().alias("hex"), "component_id").collect()
    known = [(i, t) for i, t, *_ in rows() if i is not None]
    prints = {i: fingerprint(t) for i, t in known}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = components_by_hand(ids, linked)
    assert len(out) == len(rows())
    assert Counter((r.doc_id, r.hex, r.component_id) for r in out if r.doc_id is not None) == Counter((i, format(prints[i], "016x"), root[i]) for i, _ in known)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert simhash.components_of(documents(spark).where("false")).count() == 0


def test_every_pair_within_four_bits_is_found_once(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(-(2**62), 2**62, 40).tolist():
        for _ in range(12):
            flip = 0
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                flip |= 1 << b
            value = (centre ^ flip) & (2**64 - 1)
            fps.add(value - 2**64 if value >> 63 else value)
    fps = sorted(fps)
    got = [tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    want = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert sorted(got) == sorted(want)


def test_the_index_of_variants_is_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(0,), (1,), (1 << 40,)], "fp long").write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")  # a small file, far below Spark's limit; its index has 64 times the rows
    pairs = simhash.near_pairs(fps)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (0, 1 << 40), (1, 1 << 40)]


def test_one_per_group_keeps_the_smallest(spark):
    kept = [r.doc_id for r in simhash.one_per_group(documents(spark)).collect()]
    assert 200 in kept and not {201, 211} & set(kept) and None in kept and 0 in kept
    assert kept.count(907) == 1  # the row that is there twice


def test_one_row_of_every_component_where_ids_repeat(spark):
    """A document with an id of two texts stands for one component only; no component is lost or doubled."""
    a, b = prose(1, 60), prose(2, 60)
    for table, want in (
        ([(5, a), (5, b), (7, a), (8, b)], Counter({(5, a): 1, (5, b): 1})),
        ([(3, b), (5, a), (5, b), (7, a)], Counter({(3, b): 1, (5, a): 1})),
        ([(3, a), (3, a), (4, a), (4, b), (3, b), (3, b)], Counter({(3, a): 1, (3, b): 1})),
        ([(3, None), (3, ""), (None, a), (None, a), (2, a)], Counter({(None, a): 2, (2, a): 1, "empty": 1})),
    ):
        docs = spark.createDataFrame([(i, t, "x") for i, t in table], "doc_id long, text string, root string").repartition(3)
        got = Counter((r.doc_id, r.text) if r.text else "empty" for r in simhash.one_per_group(docs).collect())
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = components_by_hand({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {5}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


LICENSE = "Licensed under the Example License, Version 2.0."


def line_rows():
    out = [(i, f"{prose(i, 6)}\n{LICENSE if i % 2 else '  ' + LICENSE.upper() + chr(9)}\nshort line\n{LICENSE}", "en", "s", 0, "e", "x", 1) for i in range(40)]
    out += [(50, None, None, None, None, None, None, None), (51, "", "", "", 0, "", "", 0), (52, LICENSE, "", "", 0, "", "", 0), (60, "only two documents hold this line", "", "", 0, "", "", 0)]
    out += [(61, "only two documents hold this line", "", "", 0, "", "", 0), (None, LICENSE + "\nkeep", "", "", 0, "", "", 0), (52, LICENSE, "", "", 0, "", "", 0)]
    return out


def lines_by_hand(table, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, t, *_ in table:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least_chars:
                holders[key(s)].add(-1 if i is None else i)
    out = []
    for i, t, *_ in table:
        mine = -1 if i is None else i
        ls = (t or "").split("\n")
        kept = [s for s in ls if len(holders.get(key(s), ())) < least_docs or max(holders[key(s)]) == mine]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    for table in (line_rows(), rows()):
        for parts in ("2", "9"):  # borders of range partitions fall elsewhere
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = lines.dedup_lines(spark.createDataFrame(table, SCHEMA)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
            assert Counter(map(tuple, got)) == Counter(lines_by_hand(table))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_over_many_range_partitions(spark):
    """One line in every document: the range is split inside the key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    table = [(i, f"{LICENSE}\nunique {prose(i, 9)}\n{LICENSE}", "", "", 0, "", "", 0) for i in range(600)]
    got = lines.dedup_lines(spark.createDataFrame(table, SCHEMA)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert Counter(map(tuple, got)) == Counter(lines_by_hand(table))


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    table, k = [], 0
    for c in centres:
        for _ in range(20):
            table.append((k, (c + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])).astype(np.float32).tolist()))
            k += 1
    table += [(k + i, table[0][1]) for i in range(300)]  # one large group of copies
    table += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, (2 * np.array(table[0][1])).tolist()), (2006, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in table], "vec_id long, embedding array<float>, label int")
    before = embeddings.ROWS_PER_CELL, embeddings.BLOCK
    embeddings.ROWS_PER_CELL, embeddings.BLOCK = 40, 16  # many cells and blocks on a small table
    try:
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_vectors(df).collect()}
    finally:
        embeddings.ROWS_PER_CELL, embeddings.BLOCK = before
    units = {i: embeddings.unit(np.float32(v).astype(float).tolist() if v and None not in v else v) for i, v in table}
    good = [i for i in units if units[i] is not None]
    m = np.stack([units[i] for i in good])
    hit = m @ m.T >= 0.95
    np.fill_diagonal(hit, False)
    root = components_by_hand([i for i, _ in table], [(good[a], good[b]) for a, b in zip(*np.nonzero(np.triu(hit)))])
    links = dict.fromkeys(units, 0) | {good[a]: int(hit[a].sum()) for a in range(len(good))}
    assert got == {i: (links[i], root[i], root[i] == i) for i in units}
    assert embeddings.link_vectors(df.where("false")).count() == 0


def test_vectors_that_visit_many_cells_are_stored_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 4)).astype(np.float32)
    table = np.concatenate([base, base[:40] + np.float32(0.05) * rng.normal(size=(40, 4)).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<float>")
    written = []
    kept = embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda *a: written.append(kept(*a)) or written[-1])
    monkeypatch.setattr(embeddings, "ROWS_PER_CELL", 5)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "PIECE_BYTES", 4 * 8 * 20, raising=False)  # pieces of 20 vectors
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_vectors(df).collect()}
    m = np.stack([embeddings.unit(v.astype(float).tolist()) for v in table])
    hit = m @ m.T >= 0.95
    np.fill_diagonal(hit, False)
    root = components_by_hand(range(len(m)), list(zip(*np.nonzero(np.triu(hit)))))
    assert got == {i: (int(hit[i].sum()), root[i]) for i in range(len(m))}
    assert max(t.count() for t in written if "unit" in t.columns) == len(m)
    assert not any("cell" in t.columns and t.count() > len(m) for t in written)


def test_pieces_hold_runs_of_cells_and_parts_of_large_ones():
    assert embeddings._pieces([(0, 3), (1, 4), (4, 25), (5, 9), (7, 2)], 10) == [(0, 1, 0, 1), (4, 4, 0, 3), (4, 4, 1, 3), (4, 4, 2, 3), (5, 5, 0, 1), (7, 7, 0, 1)]
    assert embeddings._pieces([], 10) == []
