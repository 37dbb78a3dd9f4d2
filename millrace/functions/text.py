"""Text expressions: matching, slugs, joins of parts, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(s: Column) -> Column:
    t = F.trim(s)
    return F.when(t != "", t)


def word_match(term: Column, text: Column) -> Column:
    """Case-insensitive match of a literal term between word boundaries, Unicode-aware."""
    quoted = F.concat(F.lit("(?iU)\\b\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
    return F.rlike(text, quoted)


def join_parts(*parts: Column) -> Column:
    """Non-empty parts joined by a blank."""
    return F.concat_ws(" ", *map(blank_to_null, parts))


def slug(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]", "_"), F.lit("_"))


def snippet(s: Column, n: int = 220) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def words(s: Column) -> Column:
    return F.filter(F.split(s, "\\s+"), lambda w: w != "")


def first_words(s: Column, n: int) -> Column:
    return F.array_join(F.slice(words(s), 1, n), " ")


def percent(p: Column) -> Column:
    return F.when(p.isNotNull(), F.format_string("%.1f%%", p * 100)).otherwise("Not available")


def pretty(feature: Column, names: dict[str, str]) -> Column:
    """Known display name, else the identifier in title case."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    plain = F.initcap(F.replace(feature, F.lit("_"), F.lit(" ")))
    return plain if pairs is None else F.coalesce(F.try_element_at(pairs, feature), plain)


def query_terms(name: Column, aliases: Column, n: int = 3) -> Column:
    """Name and aliases, first spelling of each term kept whatever its case, at most n."""
    all_terms = F.filter(F.concat(F.array(name), aliases), lambda t: t.isNotNull() & (F.trim(t) != ""))
    lowered = F.transform(all_terms, lambda t: F.lower(t))
    first = F.filter(all_terms, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
    return F.slice(first, 1, n)


def or_query(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def extract_json_object(s: Column) -> Column:
    """The outermost {...} of a model's answer, code fences or prose around it ignored; NULL without one."""
    return blank_to_null(F.regexp_extract(s, r"(?s)(\{.*\})", 1))


def to_json(**fields: Column) -> Column:
    """A JSON object for persistence, keys in the order given; unknown values are kept as null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})
