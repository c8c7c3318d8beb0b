"""Relevance scores.  A question's features are few and known when a plan is
made, so each score is one product of literals and columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import occurrences


@dataclass(frozen=True)
class Features:
    tokens: list[str] = field(default_factory=list)
    technical_tokens: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    quoted: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, question: str) -> Features:
        tokens = [t for t in re.findall(r"\b\w+\b", question.lower()) if t not in fixed.FEATURE_STOPS]
        return cls(
            tokens,
            [t for t in tokens if t in fixed.TECHNICAL_TERMS],
            re.findall(rf"\b{fixed.IDENTIFIER}\b", question),
            re.findall(fixed.QUOTED, question),
        )


def path_score(path: Column) -> Column:
    """How likely a match at a path (with a leading slash) matters."""
    ends = lambda xs: F.coalesce(path.rlike("(" + "|".join(map(re.escape, xs)) + ")$"), F.lit(False))
    return (
        F.when(ends(fixed.BOOSTED_ENDINGS), 1.2).otherwise(1.0)
        * F.when(path.contains("/src/") | path.contains("/lib/"), 1.1).otherwise(1.0)
        * F.when(path.contains("/test/") | ends(fixed.TEST_ENDINGS), 0.8).otherwise(1.0)
    )


def times(factors: list[Column]) -> Column:
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return out


def file_relevance(path: Column, features: Features, n_matches: Column | None = None, n_lines: Column | None = None) -> Column:
    """Weights of every path part, ending and question token, and of the matches."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    weights = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in fixed.PATH_WEIGHTS.items()))
    by_part = F.aggregate(
        parts, F.lit(1.0), lambda score, part: F.aggregate(weights, score, lambda s, x: s * F.when(F.contains(part, x["k"]), x["w"]).otherwise(1.0))
    )
    name = F.element_at(parts, -1)
    ending = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    by_ending = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.EXTENSION_WEIGHTS.items() for x in kv]), ending), F.lit(1.0))
    stem = F.regexp_replace(name, r"(.)\.[^.]+$", "$1")
    score = by_part * by_ending * times([F.when(stem.contains(t), 1.5).otherwise(1.0) for t in features.tokens])
    if n_matches is None:
        return score
    density = n_matches / (n_lines if n_lines is not None else n_matches)
    return score * F.when(n_matches > 0, (1 + F.log(n_matches + 1.0) * 0.3) * (1 + density * 0.2)).otherwise(1.0)


def snippet_relevance(code: Column, features: Features, kind: Column | None = None, mean_distance: Column | None = None) -> Column:
    low = F.lower(code)
    factors = [F.when(low.contains(t), 1 + F.log(occurrences(low, t) + 1.0) * 0.2).otherwise(1.0) for t in features.tokens]
    factors += [F.when(low.contains(t), 1.3).otherwise(1.0) for t in features.technical_tokens]
    factors += [F.when(code.contains(i), 2.0).otherwise(1.0) for i in features.identifiers]
    factors += [F.when(code.contains(q), 2.5).otherwise(1.0) for q in features.quoted]
    if kind is not None:
        factors.append(F.when(F.lower(kind).isin("function", "method", "class"), 1.2).otherwise(1.0))
    if mean_distance is not None:
        factors.append(F.when(mean_distance.isNotNull(), 1 + 0.3 / (1 + mean_distance * 0.1)).otherwise(1.0))
    return times(factors)


def name_relevance(name: Column, query: str) -> Column:
    from .text import character_jaccard

    low, q = F.lower(name), query.lower()
    return (
        F.when(low == q, 1.0).when(low.startswith(q), 0.9).when(low.contains(q), 0.7).otherwise(character_jaccard(name, F.lit(query)))
    )


def code_relevance(code: Column, query: str) -> Column:
    low, q = F.lower(code), query.lower()
    hits = occurrences(low, q)
    base = F.least(hits * 0.1, F.lit(0.6)) + F.when(low.contains(f"def {q}") | low.contains(f"class {q}"), 0.3).otherwise(0.0)
    return F.when(hits > 0, F.least(base, F.lit(1.0))).otherwise(0.0)
