"""Terms of a catalogue found in texts by one automaton: every text is read once, whatever the number of terms.

A term matches where it stands literally, whatever the case of its letters, between word boundaries: exactly one of the two characters
around either end is a letter, digit or underscore. Catalogues hold at most MAX_TERMS terms and MAX_CHARS characters and travel to every
task; the automaton is built once a Python worker. Null and empty terms match nothing, null texts hold nothing.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TERMS, MAX_CHARS = 100_000, 16_000_000


def _one(c: str) -> str:
    """Case folding of one character to one character."""
    if c == "İ":
        return "i"
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


@functools.cache
def _odd() -> re.Pattern:
    """Characters that lower() alone would not fold so, or not by themselves."""
    return re.compile("[Σ" + re.escape("".join(c for c in map(chr, range(128, 0x1F000)) if c.lower() != _one(c))) + "]")


def folded(s: str) -> str:
    """s in one case, as long as it was."""
    return s.lower() if s.isascii() else _odd().sub(lambda m: _one(m[0]), s).lower()


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(s: str, at: int) -> bool:
    return (at > 0 and _word(s[at - 1])) != (at < len(s) and _word(s[at]))


class Terms:
    """The automaton over folded terms; built at first use and kept by the worker that holds it."""

    def __init__(self, terms: list[str | None]):
        self.terms, self._automaton = terms, None

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self._automaton = terms, None

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            numbers: dict[str, list[int]] = {}
            for i, t in enumerate(self.terms):
                if t:
                    numbers.setdefault(folded(t), []).append(i)
            self._automaton = ahocorasick.Automaton()
            for t, n in numbers.items():
                self._automaton.add_word(t, (len(t), n))
            self._automaton.make_automaton()
        return self._automaton

    def find(self, text: str | None) -> list[int]:
        """Numbers of the terms that the text holds, each once, in rising order."""
        if not text or not len(self.automaton):
            return []
        s, out = folded(text), set()
        for last, (size, numbers) in self.automaton.iter(s):
            if numbers[0] not in out and _edge(s, last + 1) and _edge(s, last + 1 - size):
                out.update(numbers)
        return sorted(out)


def catalogue(terms: DataFrame) -> list:
    """The rows of a catalogue that is small enough to travel to every task."""
    rows = terms.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS or sum(len(r.term or "") for r in rows) > MAX_CHARS:
        raise ValueError(f"catalogues hold at most {MAX_TERMS} terms and {MAX_CHARS} characters")
    return rows


def match_terms(docs: DataFrame, text: str, terms: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row for each document and row of terms(term, ...) that it holds: the columns `keep` of docs (all) and those of the catalogue.

    Documents pass through in Arrow batches, without a shuffle; catalogue columns come back by a hash join on the row's number.
    """
    spark = docs.sparkSession
    rows = catalogue(terms)
    shared = spark.sparkContext.broadcast(Terms([r.term for r in rows]))
    keep = docs.columns if keep is None else keep

    def run(batches):
        for b in batches:
            found = [shared.value.find(t) for t in b.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = pa.array([i for f in found for i in f], pa.int32())
            yield pa.record_batch([*(c.take(at) for c in b.columns[1:]), flat], [*b.schema.names[1:], "_term_no"])

    kinds = dict(docs.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_term_no int"])
    hits = docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, ddl)
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_term_no int, {', '.join(f'`{c}` {t}' for c, t in terms.dtypes)}")
    return hits.join(F.broadcast(numbered), "_term_no").drop("_term_no")  # at most MAX_TERMS rows


def exploded(catalog: DataFrame, key: str, name: str, aliases: str, position: str | None = None) -> DataFrame:
    """(key, term, position) of a catalogue with one row an entity: its name, then its aliases, each spelling once, blanks left out."""
    every = F.array_distinct(F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda t: t.isNotNull() & (F.trim(t) != "")))
    place = F.col(position) if position else F.lit(None).cast("long")
    return catalog.select(key, F.explode(every).alias("term"), place.alias("position"))
