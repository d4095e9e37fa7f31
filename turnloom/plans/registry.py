"""All queries of the core, with their SQL."""

from __future__ import annotations

from turnloom.plans import (  # noqa: F401
    audit,
    corpus,
    dialogue,
    evaluation,
    labelling,
    tables,
)

# audit, evaluation and labelling register theirs with dialogue
QUERIES = dialogue.QUERIES | tables.QUERIES | corpus.QUERIES
ORACLE = dialogue.ORACLE | tables.ORACLE | corpus.ORACLE
