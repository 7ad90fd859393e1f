"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding."""

from tidewright.llm.stages import STAGES, run

ORACLE_SQL = None  # the stages' models and fingerprints cannot be said in SQL; tests hold each stage against brute force

__all__ = ["ORACLE_SQL", "STAGES", "run"]
