"""What a query is after, and how much each field of a document counts for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellar.functions.text import strip, tokens

# Intents, vocabularies, and field weights by intent (fields in the order in which they are summed).
SYMBOL, IMPLEMENTATION, CONCEPT, WORKFLOW = "symbol_lookup", "implementation_lookup", "concept_lookup", "workflow_lookup"
WORKFLOW_WORDS = ("flow", "how", "lifecycle", "pipeline", "process", "steps", "trace", "works", "workflow")
LEADING_VERBS = ("build", "classify", "compute", "find", "get", "infer", "load", "open", "parse", "render", "resolve", "tokenize")
IMPLEMENTATION_WORDS = ("embedding", "implementation", "impl", "index", "ollama", "provider", "refresh", "sqlite")
CODE_WEIGHTS = {
    SYMBOL: {"local_symbol": 0.35, "file_symbol": 0.25, "path": 0.15, "header": 0.15, "body": 0.10},
    IMPLEMENTATION: {"header": 0.25, "path": 0.25, "file_symbol": 0.20, "local_symbol": 0.15, "body": 0.15},
    CONCEPT: {"header": 0.30, "body": 0.30, "file_symbol": 0.20, "path": 0.20},
    WORKFLOW: {"header": 0.30, "file_symbol": 0.25, "path": 0.25, "body": 0.20},
}
IDENTIFIER_WEIGHTS = {
    SYMBOL: {"symbol_name": 0.40, "signature": 0.25, "path": 0.15, "header": 0.15, "context": 0.05},
    IMPLEMENTATION: {"header": 0.30, "signature": 0.25, "path": 0.20, "symbol_name": 0.15, "context": 0.10},
    CONCEPT: {"header": 0.30, "context": 0.30, "signature": 0.20, "path": 0.20},
    WORKFLOW: {"header": 0.30, "signature": 0.30, "path": 0.20, "context": 0.20},
}
MIXED_CASE = "[a-z][A-Z]|[A-Z]{2,}[a-z]"


def intent(query: Column) -> Column:
    """The intent of each query of a column."""
    q, t = strip(query), tokens(query)
    any_of = lambda words: F.arrays_overlap(t, F.array(*map(F.lit, words)))
    named = q.contains("_") | q.rlike(MIXED_CASE)
    led = (F.size(t) <= 4) & F.coalesce(F.get(t, F.lit(0)).isin(*LEADING_VERBS), F.lit(False))
    return (
        F.when(any_of(WORKFLOW_WORDS), WORKFLOW)
        .when((F.size(t) > 0) & (named | led), SYMBOL)
        .when(any_of(IMPLEMENTATION_WORDS), IMPLEMENTATION)
        .otherwise(CONCEPT)
    )
