"""The dealt queries: each applies one operator, with production parameters, to its whole table."""

from pyspark.sql import functions as F

from tidewright.llm import bpe, decontamination, divergence, embeddings, language, lines, lm, mixing, pii, sharding, simhash, toxicity, zones

CLUSTERS, ROUNDS, DIMS = 40, 5, 64
QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_feistel_shards")
def op1(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


@query("op2_simhash_variants")
def op2(spark, sf_dir):
    out = simhash.components_of(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


@query("op3_entropy_balanced_mix")
def op3(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(
    "op4_winnowed_overlap",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT n FROM item_windows),
    doc_windows AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
    hits AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op4(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_toxic_segments")
def op5(spark, sf_dir):
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("bigint").alias("n_passages"))


@query("op6_revealing_terms")
def op6(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_language_codes")
def op7(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


@query(
    "op8_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    hot AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT doc_id, pos, line, keeper IS NULL OR keeper = doc_id AS stays FROM lines LEFT JOIN hot USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op8(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op9_spherical_cells",
    """
    WITH RECURSIVE units AS (
      SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM units a JOIN units b ON a.vec_id != b.vec_id
      AND list_cosine_similarity(a.v, b.v) >= 0.95),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
    SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = vec_id
    """,
)
def op9(spark, sf_dir):
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_loss_difference")
def op10(spark, sf_dir):
    """The target: documents labelled as good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.score_documents(table(spark, sf_dir, "documents"), good)


@query("op11_byte_bpe")
def op11(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def _clustering_sql() -> str:
    """The rounds written out one after another; c0 holds the first centroids."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT vec_id, any_value(v) AS v, min([d, c]) AS best FROM (SELECT vec_id, v, c, {gap}::BIGINT AS d FROM kept, c{n}) GROUP BY vec_id)")
        if n < ROUNDS:
            steps.append(
                f"m{n} AS (SELECT c, list(x ORDER BY i) AS m FROM (SELECT best[2] AS c, i, (sum(v[i]) // count(*) - CASE WHEN sum(v[i]) < 0 AND sum(v[i]) % count(*) != 0 THEN 1 ELSE 0 END)::BIGINT AS x "
                f"FROM a{n}, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY c)"
            )
            steps.append(f"c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c)")
    return f"""
    WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS})),
    {", ".join(steps)}
    SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
      sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN c{ROUNDS} ON c = best[2]
    """


@query("op12_hilbert_zones", _clustering_sql())
def op12(spark, sf_dir):
    out, centroids = zones.cluster_vectors(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, DIMS, salt="2:")
    names = F.array(*[F.lit(n) for n in zones.centroid_names(centroids)]) if len(centroids) else F.array().cast("array<string>")
    return out.withColumn("centroid_sha256", F.sha2(F.get(names, F.col("cluster")).cast("binary"), 256))


@query(
    "op13_count_cells",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    occ AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    by_lang AS (SELECT lang, term, count(*) AS of_lang FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    per_lang AS (SELECT lang, count(*) AS v, sum(of_lang)::HUGEINT AS n FROM by_lang GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN by_lang USING (lang, term) GROUP BY lang, source, term),
    totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY lang, source),
    groups AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source)),
    grid AS (SELECT g.lang, g.source, term, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + v) AS p, coalesce(c, 0) AS c, of_lang
      FROM groups g JOIN by_lang b USING (lang) JOIN per_lang USING (lang) LEFT JOIN counts USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
    pair AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM groups g JOIN groups o ON g.lang = o.lang AND g.source != o.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = o.source),
    term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
      FROM (SELECT g.*, 1 + (1000000000::HUGEINT * (of_lang + 1)) // (n + v) AS q FROM grid g JOIN per_lang USING (lang)) WHERE c > 0 AND p > q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 200
    """,
)
def op13(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
