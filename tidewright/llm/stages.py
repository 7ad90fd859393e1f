"""Stages of the corpus pipeline: each takes the documents its predecessor kept and its decisions take effect."""

from tidewright.llm import decontamination, language, mixing, sharding, simhash
from tidewright.llm.common import stored
from tidewright.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def known_language(spark, docs, sf_dir):
    """Drops documents whose language can't be told: no letter at all, or no clear codeword."""
    judged = language.identify(docs)
    return judged.where((judged["lang_pred"] != language.UNKNOWN) & ~judged["ambiguous"]).select(*COLUMNS)


def one_of_near_copies(spark, docs, sf_dir):
    """Keeps the smallest doc_id of each group of near copies."""
    return simhash.one_per_group(docs).select(*COLUMNS)


def without_benchmark(spark, docs, sf_dir):
    """Drops documents that the benchmark contaminates."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed_sources(spark, docs, sf_dir):
    """Repeats or drops documents so that sources meet their target weights."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def shards(spark, docs, sf_dir):
    """The documents with their shard and slot."""
    return sharding.shard_rows(docs, SHARDS, COLUMNS)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", shards),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
