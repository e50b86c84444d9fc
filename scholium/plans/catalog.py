"""All queries for the reference's own operators."""

from scholium.plans import corpus, drafts, extraction, measures, references, retrieval, rounds, searches, sequences, texts
from scholium.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "drafts", "extraction", "measures", "references", "retrieval", "rounds", "searches", "sequences", "texts"]
