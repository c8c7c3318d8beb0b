"""Text functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def occurrences(text: Column, part: Column | str) -> Column:
    """How often part occurs in text, without overlaps."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def _words(question: Column, stops: list[str]) -> Column:
    return F.filter(found(question, fixed.IDENTIFIER), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stops))


def keywords(question: Column) -> Column:
    """Identifiers that are no stop words, by first appearance, then quoted phrases."""
    return F.array_distinct(F.concat(_words(question, fixed.KEYWORD_STOPS), found(question, fixed.QUOTED, 1)))


def key_terms(question: Column) -> Column:
    return F.array_distinct(F.concat(_words(question, fixed.TERM_STOPS), found(question, fixed.QUOTED, 1)))


WORD = r"[\p{L}\p{N}_]+"


def query_features(question: Column) -> Column:
    """struct(tokens, technical_tokens, identifiers, quoted, token_count)."""
    tokens = F.filter(found(F.lower(question), WORD), lambda t: ~t.isin(fixed.FEATURE_STOPS))
    # An identifier is bounded by word boundaries.
    identifiers = found(question, rf"(?<![\p{{L}}\p{{N}}_]){fixed.IDENTIFIER}(?![\p{{L}}\p{{N}}_])")
    return F.struct(
        tokens.alias("tokens"),
        F.filter(tokens, lambda t: t.isin(fixed.TECHNICAL_TERMS)).alias("technical_tokens"),
        identifiers.alias("identifiers"),
        found(question, fixed.QUOTED, 1).alias("quoted"),
        F.size(tokens).alias("token_count"),
    )


def estimated_tokens(text: Column, chars_per_token: int = 4) -> Column:
    """Characters after runs of white space became one space, over four; one at least; none for no text."""
    size = F.length(F.regexp_replace(stripped(text), r"\s+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), (size / chars_per_token).cast("long"))).cast("long")


def max_tokens(chars: Column, chars_per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), (chars / chars_per_token).cast("long")).cast("long")


def numbered(number: Column) -> Column:
    """The number in four places or more."""
    return F.when(number < 10000, F.lpad(number.cast("string"), 4, " ")).otherwise(number.cast("string"))


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def bar(percent: Column, width: int = 20) -> Column:
    """A bar of full and empty cells."""
    full = F.least(F.lit(width), F.greatest(F.lit(0), (percent * width / 100).cast("int")))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def level(percent: Column) -> Column:
    return F.when(percent < 50, "green").when(percent < 80, "yellow").otherwise("red")


def language_of(ext: Column, languages: dict[str, str] = fixed.LANGUAGES, default: str | None = "text") -> Column:
    table = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    out = F.element_at(table, F.lower(ext))
    return F.coalesce(out, F.lit(default)) if default else out


def is_project_module(name: Column) -> Column:
    return ~F.split(name, r"\.")[0].isin(fixed.STANDARD_MODULES + fixed.COMMON_PACKAGES)


def is_java_library(name: Column) -> Column:
    return reduce(lambda a, b: a | b, (name.startswith(p) for p in fixed.JAVA_PLATFORM + fixed.JAVA_COMMON))


def is_change_question(question: Column) -> Column:
    return F.lower(question).rlike("|".join(fixed.CHANGE_WORDS))


def character_jaccard(a: Column, b: Column) -> Column:
    """Shared characters over all characters of two texts, ignoring case."""
    of = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), ""), lambda c: c != ""))
    union = F.size(F.array_union(of(a), of(b)))
    return F.when(union > 0, F.size(F.array_intersect(of(a), of(b))) / union).otherwise(F.lit(0.0))


def docstring_text(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def symbol_patterns(name: str, kind: str | None = None) -> list[str]:
    """Search patterns for the definition of a name."""
    function = [rf"def\s+{name}\s*\(", rf"function\s+{name}\s*\(", rf"{name}\s*=\s*function"]
    classes = [rf"class\s+{name}\b", rf"interface\s+{name}\b", rf"struct\s+{name}\b"]
    return {"function": function, "class": classes}.get(kind or "", function + classes)
