"""Scores: vectors, lexical fields, their combination, thresholds and boosts. Built-in column functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellar.functions.text import squeezed, strip, terms

# Defaults of a search and additions for names that match.
TOP_K, SEMANTIC_WEIGHT, KEYWORD_WEIGHT, MIN_COMBINED = 5, 0.72, 0.28, 0.1
COVERAGE_SHARE, PHRASE_SHARE = 0.85, 0.15
SAME_NAME, SAME_TERMS, WIDER_NAME, IN_SIGNATURE, IN_HEADER = 0.12, 0.08, 0.04, 0.03, 0.02
DIGITS = 4


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; 0 if either is zero; an error if their lengths differ."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    wrong = F.raise_error(F.lit("vectors of different lengths")).cast("double")
    return F.when(F.size(a) != F.size(b), wrong).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def coverage(query_terms: Column, document_terms: Column) -> Column:
    """Share of the query's different terms that the document has; 0 without terms."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, document_terms)) / F.size(q))


def phrase(query: Column, text: Column) -> Column:
    q = F.lower(strip(query))
    return F.when((q != "") & F.lower(text).contains(q), F.lit(PHRASE_SHARE)).otherwise(F.lit(0.0))


def field_score(query: Column, query_terms: Column, text: Column, text_terms: Column | None = None) -> Column:
    known = terms(text) if text_terms is None else text_terms
    return F.when(text == "", F.lit(0.0)).otherwise(clamp(COVERAGE_SHARE * coverage(query_terms, known) + phrase(query, text)))


def weighted_mean(scores: dict[str, Column], fields: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the field scores by weight, over the fields that have text; 0 where none has."""
    total, over = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        if w > 0:
            has = fields[name] != ""
            total = total + F.when(has, w * scores[name]).otherwise(F.lit(0.0))
            over = over + F.when(has, F.lit(w)).otherwise(F.lit(0.0))
    return F.when(over <= 0, F.lit(0.0)).otherwise(total / over)


def fielded_score(query: Column, query_terms: Column, fields: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores of the fields that have text; 0 without terms or without such fields."""
    scores = {name: field_score(query, query_terms, text) for name, text in fields.items()}
    return F.when(F.size(query_terms) == 0, F.lit(0.0)).otherwise(weighted_mean(scores, fields, weights))


def profiled_mean(intent: Column, scores: dict[str, Column], fields: dict[str, Column], profiles: dict[str, dict[str, float]]) -> Column:
    """weighted_mean with the weights of each row's intent."""
    out = F.lit(0.0)
    for name, weights in profiles.items():
        out = F.when(intent == name, weighted_mean(scores, fields, weights)).otherwise(out)
    return out


def whole_document_score(query: Column, query_terms: Column, document: Column, symbols: Column, document_terms: Column | None = None) -> Column:
    """An older score of a document as one text and its symbols as another."""
    known = terms(document) if document_terms is None else document_terms
    got = 0.65 * coverage(query_terms, known) + 0.20 * coverage(query_terms, terms(symbols)) + phrase(query, document)
    return F.when(F.size(query_terms) == 0, F.lit(0.0)).otherwise(clamp(got))


def combined(semantic: Column, keyword: Column, options: SearchOptions | None = None) -> Column:
    o = options or SearchOptions()
    total = o.semantic_weight + o.keyword_weight
    if total <= 0:
        return clamp(semantic)
    return clamp((o.semantic_weight * F.greatest(semantic, F.lit(0.0)) + o.keyword_weight * keyword) / total)


def passes(semantic: Column, keyword: Column, score: Column, options: SearchOptions | None = None) -> Column:
    o = options or SearchOptions()
    ok = (F.greatest(semantic, F.lit(0.0)) >= o.min_semantic) & (keyword >= o.min_keyword) & (score >= o.min_combined)
    if o.require_semantic:
        ok = ok & (semantic > 0)
    if o.require_keyword:
        ok = ok & (keyword > 0)
    return ok


def name_gain(query: Column, name: Column) -> Column:
    """What a symbol's score gains for its name."""
    q, n = terms(query), terms(name)
    wider = (F.size(q) >= 2) & (F.size(n) > F.size(q)) & (F.size(F.array_except(q, n)) == 0)
    return F.when((F.size(q) > 0) & (squeezed(query) == squeezed(name)), SAME_NAME).when((F.size(q) > 0) & (q == n), SAME_TERMS).when(wider, WIDER_NAME).otherwise(0.0)


def phrase_gain(query: Column, text: Column, gain: float) -> Column:
    """gain if the query stands in the text, as it is but for case and white space at its ends."""
    p = F.lower(strip(query))
    return F.when((p != "") & F.lower(text).contains(p), gain).otherwise(0.0)


def name_boost(query: Column, name: Column, signature: Column, header: Column) -> Column:
    """What a symbol's score gains for its name, and for the query standing in its signature or header."""
    return name_gain(query, name) + phrase_gain(query, signature, IN_SIGNATURE) + phrase_gain(query, header, IN_HEADER)


def inferred_kind(signature: Column) -> Column:
    """The kind of symbol that a signature's words suggest, by the first rule that holds."""
    s = F.lower(signature)
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    return (
        F.when(s.startswith("class ") | s.contains(" class "), "class")
        .when(padded.contains(" interface "), "interface")
        .when(padded.contains(" enum "), "enum")
        .when(s.startswith("type ") | padded.contains(" type "), "type")
        .when(s.startswith("async def ") | s.startswith("def "), "function")
        .when(padded.contains(" function "), "function")
        .when(s.contains("const ") | s.contains("let ") | s.contains("var "), "variable")
        .otherwise("identifier")
    )


def _threshold(x: float | None, fallback: float) -> float:
    """A share of one; values above one are percentages; none and NaN fall back."""
    if x is None or math.isnan(x):
        return fallback
    return min(1.0, max(0.0, x / 100 if x > 1 else x))


def _weight(x: float | None, fallback: float) -> float:
    return fallback if x is None or math.isnan(x) or x < 0 else x


@dataclass(frozen=True)
class SearchOptions:
    top_k: int | None = TOP_K
    semantic_weight: float | None = SEMANTIC_WEIGHT
    keyword_weight: float | None = KEYWORD_WEIGHT
    min_semantic: float | None = 0.0
    min_keyword: float | None = 0.0
    min_combined: float | None = MIN_COMBINED
    require_semantic: bool = False
    require_keyword: bool = False

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("top_k", TOP_K if self.top_k is None else max(1, int(self.top_k)))
        put("semantic_weight", _weight(self.semantic_weight, SEMANTIC_WEIGHT))
        put("keyword_weight", _weight(self.keyword_weight, KEYWORD_WEIGHT))
        put("min_semantic", _threshold(self.min_semantic, 0.0))
        put("min_keyword", _threshold(self.min_keyword, 0.0))
        put("min_combined", _threshold(self.min_combined, MIN_COMBINED))
