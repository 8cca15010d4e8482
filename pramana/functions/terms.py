"""Many terms in a text, found in one pass of an automaton instead of one search for each term.

The terms of a row are an array beside its text. Each different array is turned
into an automaton once in a batch of rows, so the work of a row grows with its text
and its hits. Where terms overlap in a text, the longest goes first, then the one
that stands first.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

PIECES = ArrayType(StructType([StructField("before", StringType()), StructField("term", StringType()), StructField("which", IntegerType())]))


@lru_cache(maxsize=64)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds every term that is not empty; its output is (number of the term, length)."""
    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        if term and term not in made:
            made.add_word(term, (i, len(term)))
    if len(made):
        made.make_automaton()
    return made


def hits(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Every place of a term: (start, length, number of the term)."""
    return [(end - n + 1, n, i) for end, (i, n) in machine.iter(text)] if len(machine) else []


def chosen(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Places that do not overlap: the longest first, then the one that stands first; in order of start."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for place in sorted(found, key=lambda p: (-p[1], p[0])):
        at = bisect_left(starts, place[0])
        if (at and kept[at - 1][0] + kept[at - 1][1] > place[0]) or (at < len(kept) and kept[at][0] < place[0] + place[1]):
            continue
        starts.insert(at, place[0])
        kept.insert(at, place)
    return kept


def _given(terms) -> tuple[str, ...]:
    return tuple(t or "" for t in terms) if terms is not None else ()


@F.pandas_udf(ArrayType(StringType()))
def _within(texts: pd.Series, terms: pd.Series) -> pd.Series:
    def one(text: str | None, of) -> list[str]:
        given = _given(of)
        return [given[i] for i in sorted({i for _, _, i in hits(text or "", automaton(given))})]

    return pd.Series([one(t, of) for t, of in zip(texts, terms, strict=True)])


def _pieces(text: str | None, terms) -> list[dict] | None:
    if text is None:
        return None
    out, at, given = [], 0, _given(terms)
    for start, n, i in chosen(hits(text, automaton(given))):
        out.append({"before": text[at:start], "term": given[i], "which": i})
        at = start + n
    return [*out, {"before": text[at:], "term": None, "which": None}]


@F.pandas_udf(PIECES)
def _cut(texts: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([_pieces(t, of) for t, of in zip(texts, terms, strict=True)])


@F.pandas_udf(ArrayType(PIECES))
def _cut_each(texts: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([None if all_ is None else [_pieces(t, of) for t in all_] for all_, of in zip(texts, terms, strict=True)])


def within(text: Column, terms: Column) -> Column:
    """The different terms of an array that stand in the text, in the order of the array; empty ones do not count."""
    return _within(text, terms)


def cut(text: Column, terms: Column) -> Column:
    """The text in pieces: what stands before each term, the term, and its place in the array (of the first of equal ones); the last piece has no term."""
    return _cut(text, terms)


def _joined(pieces: Column, make) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], F.when(p["term"].isNull(), "").otherwise(make(p)))), "")


def replaced(text: Column, terms: Column, make) -> Column:
    """The text with every term replaced by make(piece)."""
    return _joined(cut(text, terms), make)


def replaced_each(texts: Column, terms: Column, make) -> Column:
    """The same for every text of an array."""
    return F.transform(_cut_each(texts, terms), lambda pieces: _joined(pieces, make))
