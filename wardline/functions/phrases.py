"""Phrases counted as whole words, all of all banks in one pass over a text.

One Aho-Corasick automaton over every phrase is built once in each Python worker and run over Arrow
batches, so the cost of a text doesn't depend on how many phrases there are.
"""

from __future__ import annotations

import functools
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


TEXTS = 256  # texts that are Python strings at a time


@functools.lru_cache(4096)
def word_sign(c: str) -> bool:
    """Whether a sign belongs to words: a letter, a number of any kind, or _."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


class Counter:
    """Occurrences per bank: each phrase by itself, whole words only, not overlapping itself; one inside another counts for both."""

    def __init__(self, banks: tuple[tuple[str, tuple[str, ...]], ...]):
        places: dict[str, list[int]] = {}
        for bank, (_, phrases) in enumerate(banks):
            for phrase in phrases:
                if phrase:
                    places.setdefault(phrase.lower(), []).append(bank)
        self.banks, self.automaton = len(banks), ahocorasick.Automaton()
        for i, (phrase, owners) in enumerate(places.items()):
            self.automaton.add_word(phrase, (i, len(phrase), owners))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def counts(self, text: str) -> list[int]:
        found = [0] * self.banks
        if self.empty:
            return found
        behind: dict[int, int] = {}  # where each phrase's last occurrence ended
        n = len(text)
        for last, (phrase, size, owners) in self.automaton.iter(text):
            end = last + 1
            start = end - size
            if (end < n and word_sign(text[end])) or (start and word_sign(text[start - 1])) or start < behind.get(phrase, 0):
                continue
            behind[phrase] = end
            for bank in owners:
                found[bank] += 1
        return found


@functools.lru_cache(8)
def counter(banks) -> Counter:
    return Counter(banks)


def phrase_counts(text: Column, banks: dict[str, tuple[str, ...]]) -> Column:
    """A struct of the occurrences of each bank's phrases in lower-case text; null for null.

    Phrases are matched in lower case; a phrase listed twice counts twice; empty phrases never occur.
    """
    fixed = tuple((name, tuple(phrases)) for name, phrases in banks.items())
    if not fixed:
        return F.struct(F.lit(0).alias("_none"))
    names = [name for name, _ in fixed]

    def count(texts: pa.Array) -> pa.Array:
        own = counter(fixed)
        rows = [None if t is None else own.counts(t) for at in range(0, len(texts), TEXTS) for t in texts.slice(at, TEXTS).to_pylist()]
        columns = [pa.array([None if r is None else r[k] for r in rows], pa.int32()) for k in range(len(names))]
        return pa.StructArray.from_arrays(columns, names=names, mask=pa.array([r is None for r in rows]))

    return F.arrow_udf(count, StructType([StructField(n, IntegerType()) for n in names]))(text)


def phrase_count(text: Column, phrases) -> Column:
    """Occurrences of all phrases in lower-case text."""
    return F.coalesce(phrase_counts(text, {"all": tuple(phrases)})["all"], F.lit(0))
