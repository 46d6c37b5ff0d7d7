"""Lexical likeness of two texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import fold_span

# fixed values
STOPWORDS = ("o", "a", "os", "as", "um", "uma", "uns", "umas", "the", "an", "of", "de", "do", "da", "dos", "das")
ABBREVIATIONS = {"fc": ("futebol", "clube"), "cr": ("clube", "regatas"), "ec": ("esporte", "clube")}


def norm(c: Column) -> Column:
    """Folded, without articles and prepositions wherever they stand."""
    return F.array_join(F.filter(F.split(fold_span(c), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS)), " ")


def tokens(normed: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normed, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio, of which Spark has no builtin; in Arrow batches."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def likeness_from(least: float):
    """The larger of Jaccard and sequence ratio of two normed texts where it may be `least` or more, else 0 or more: lengths and characters in common bound the
    ratio from above at little cost. It is declared to be non-deterministic, which it is not, so that a filter on it stays above the distinct below it
    and each pair is worked out once."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, low = [], least - 1e-4
        for x, y in zip(a, b, strict=True):
            s, t = set(x.split(" ")), set(y.split(" "))
            words = len(s & t) / len(s | t)
            m = SequenceMatcher(None, x, y)
            out.append(max(words, m.ratio()) if m.real_quick_ratio() >= low and m.quick_ratio() >= low else words)
        return pd.Series(out, dtype="float64")

    return run.asNondeterministic()


def similarity(a: Column, b: Column) -> Column:
    """Of normed texts: 1 if equal, 0 if one is empty, else the larger of Jaccard and sequence ratio, to 4 digits."""
    value = F.round(F.greatest(jaccard(tokens(a), tokens(b)), sequence_ratio(a, b)), 4)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(value)


def abbreviated(a: Column, b: Column) -> Column:
    """Whether one normed text has an abbreviation, the other its words, and they share another token."""
    found = F.lit(False)
    for x, y in ((tokens(a), tokens(b)), (tokens(b), tokens(a))):
        for short, long in ABBREVIATIONS.items():
            words = F.array(*[F.lit(w) for w in long])
            found |= F.array_contains(x, short) & (F.size(F.array_except(words, y)) == 0) & F.arrays_overlap(F.array_remove(x, short), y)
    return found
