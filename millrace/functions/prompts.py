"""Prompts as column expressions: one string a row, built where the evidence is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import EVENT_TYPES

NARRATIVE_WORDS, EXCERPT_WORDS = 120, 25


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


_EXTRACTION = "\n".join([
    "Answer with one JSON object and nothing else. Its keys:",
    f'  "event_type": one of {", ".join(EVENT_TYPES)}',
    '  "severity": a whole number from 1 to 10',
    '  "confidence": a number from 0 to 1',
    '  "entities": a list of the names that matter',
    '  "reasoning": one sentence',
])


def news(text: Column, resource: Column) -> Column:
    """Extraction from a news text about a resource."""
    return _lines(F.concat(F.lit("Below is a news text that may bear on the supply of or demand for "), resource, F.lit(".")), "Say what kind of event it reports and how severe that is for this resource.", "", "Text:", F.coalesce(text, F.lit("")), "", _EXTRACTION)


def demand(text: Column, resource: Column) -> Column:
    """Extraction from the few words of a filing's metadata: sparse input asks for low confidence."""
    return _lines(F.concat(F.lit("Below is no document but the metadata of a company's filing, which may bear on the demand for "), resource, F.lit(".")), "Where so little says nothing about the resource, answer with low confidence and low severity; don't fill in what isn't there.", "", "Metadata:", F.coalesce(text, F.lit("")), "", _EXTRACTION)


def evidence_lines(evidence: Column) -> Column:
    """evidence: array of struct(signal_id, source_url, raw_text), a line each."""
    return F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- signal "), e.signal_id.cast("string"), F.lit(" ("), F.coalesce(e.source_url, F.lit("no address")), F.lit("): "), F.coalesce(e.raw_text, F.lit("")))), "\n")


def feature_list(features: Column) -> Column:
    """features: array of struct(feature, contribution) -> 'a (+0.250), b (-0.100)'."""
    return F.array_join(F.transform(features, lambda f: F.concat(f.feature, F.lit(" ("), F.format_string("%+.3f", f.contribution), F.lit(")"))), ", ")


def narration(resource: Column, evidence: Column, probability: Column, features: Column) -> Column:
    """A short note on a resource from the evidence alone; the model's lines are left out where it has none."""
    model = F.when(probability.isNotNull(), F.concat(F.lit("Model, for orientation: probability "), F.format_string("%.4f", probability), F.coalesce(F.concat(F.lit("; drivers "), F.when(F.size(features) > 0, feature_list(features))), F.lit(""))))
    return _lines(F.concat(F.lit("Write a note on the supply of "), resource, F.lit(".")), "Use the evidence below and nothing else.", "", "Evidence:", evidence_lines(evidence), model, "", f'Answer with one JSON object: "narrative" of at most {NARRATIVE_WORDS} words, and "citations", a list of objects with "signal_id" (one of those above) and "excerpt" (at most {EXCERPT_WORDS} words of its text).')


def judgment(resource: Column, horizon: Column, features: Column, evidence: Column) -> Column:
    """A probability without labels. features: map of name to value, unknown ones shown as such."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_keys(features)), lambda k: F.concat(k, F.lit(" = "), F.when(F.element_at(features, k).isNull(), "unknown").otherwise(F.format_string("%.4f", F.element_at(features, k))))), "\n")
    return _lines(F.concat(F.lit("How likely is it that the supply of "), resource, F.lit(" gets tighter within "), horizon, F.lit("?")), "", "Features:", pairs, "", "Evidence:", evidence_lines(evidence), "", 'Answer with one JSON object: "tightening_probability" from 0 to 1, and "rationale".')
