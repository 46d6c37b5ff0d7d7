"""Texts joined with the phrases they contain, however many phrases there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many phrases are sent to every task and looked for one by one; more are met at their rarest piece.
SMALL = 10_000
#: Characters of a piece.
PIECE = 4
#: Characters, at most, by which the neighbours of a whole word are matched in the join, and anchors that are sent to every task.
SIDE, BROADCAST = 2, 100_000


def _pieces(text: Column, n: int) -> Column:
    """All different stretches of n characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _by_words(texts: DataFrame, keyed: list[Column], text: str, whole: DataFrame) -> DataFrame:
    """Pairs of texts and phrases of two spaces or more that may meet. Between its first and its last space a phrase has whole words of the text, so it is
    met at the longest of these three in a row: the middle one as it is, the one before by its end, the one after by its start. For a phrase of two spaces this is exact."""
    w = F.split("__p", " ")
    # by get, as the optimiser may work this out for other phrases too before they are filtered
    a, b, c = (lambda i, d=d: F.get(w, i + d) for d in (-1, 0, 1))
    three = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.length(F.concat(a(i), b(i), c(i))).alias("n"), a(i).alias("a"), b(i).alias("b"), c(i).alias("c")))
    anchor = whole.select("__p", F.array_max(three).alias("t")).select("__p", F.col("t.b").alias("__b"), F.col("t.a").alias("__e"), F.col("t.c").alias("__s"))
    sides = [F.least(F.length(c), F.lit(SIDE)) for c in ("__e", "__s")]
    anchor = anchor.select("*", sides[0].alias("__m"), sides[1].alias("__n")).withColumns({"__x": F.right("__e", F.col("__m")), "__y": F.left("__s", F.col("__n"))})
    kinds = anchor.groupBy("__m", "__n").count().collect()  # (SIDE + 1) ** 2 at most
    # a null text has no words; to filter it first would work out a derived text twice
    words, n = texts.select(*keyed, F.split(text, " ").alias("__t")), F.greatest(F.size("__t") - 2, F.lit(0))
    rows = words.select(*[k for k in words.columns if k != "__t"], F.inline(F.arrays_zip(*[F.slice("__t", F.lit(i), n) for i in (1, 2, 3)])).alias("__a", "__b", "__c"))
    middle = anchor.select("__b").distinct()
    if sum(r[2] for r in kinds) <= BROADCAST:
        anchor, middle = F.broadcast(anchor), F.broadcast(middle)
    ends = [F.struct(F.lit(m).alias("__m"), F.lit(n).alias("__n"), F.right("__a", F.lit(m)).alias("__x"), F.left("__c", F.lit(n)).alias("__y")) for m, n, _ in kinds]
    near = rows.join(middle, "__b", "left_semi").select("*", F.inline(F.array(*ends)))
    met = near.join(anchor, ["__b", "__m", "__n", "__x", "__y"]).filter(F.endswith("__a", "__e") & F.startswith("__c", "__s"))
    return met.select(*[k for k in words.columns if k != "__t"], "__p")


def _by_pieces(texts: DataFrame, keyed: list[Column], text: str, whole: DataFrame) -> DataFrame:
    """Pairs of texts and phrases that may meet: those with the piece of a phrase that fewest texts hold."""
    short = F.length("__p") < PIECE
    held = whole.select("__p", F.explode(F.when(short, F.array("__p")).otherwise(_pieces(F.col("__p"), PIECE))).alias("__g"))
    lengths = sorted(r[0] for r in held.select(F.length("__g")).distinct().collect())  # PIECE + 1 of them at most
    own = F.flatten(F.array(*[_pieces(F.col(text), n) if n else F.array(F.lit("")) for n in lengths]))
    met = texts.filter(F.col(text).isNotNull()).select(*keyed, F.explode(own).alias("__g")).join(held.select("__g").distinct(), "__g", "left_semi")
    often = met.groupBy("__g").agg(F.count("*").alias("__n"))
    # a piece that no text holds is an anchor that nothing meets
    anchor = held.join(often, "__g", "left").groupBy("__p").agg(F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g"))
    return met.join(anchor, "__g").drop("__g")


def contained(texts: DataFrame, key: list[str], text: str, phrases: DataFrame, phrase: str, small: int | None = None) -> DataFrame:
    """Rows of texts with each row of phrases whose phrase its text contains, as characters; key tells different texts apart.

    More than `small` phrases are anchored: those of two spaces or more at a whole word between these and its neighbours, others at the piece of them
    (PIECE characters, or the whole phrase if it has fewer) that fewest texts hold. Texts are joined to anchors by their words or pieces and the pairs
    that meet are verified, so a phrase costs what its words or its rarest piece bring in. An empty phrase is in every text; null texts and phrases meet nothing; repeated rows come back repeated.
    """
    phrases = phrases.filter(F.col(phrase).isNotNull())
    if phrases.limit((SMALL if small is None else small) + 1).count() <= (SMALL if small is None else small):
        return texts.join(F.broadcast(phrases), F.contains(text, phrase))
    whole = phrases.select(F.col(phrase).alias("__p")).distinct()
    keyed, named = [F.col(k).alias(f"__{k}") for k in key], [f"__{k}" for k in key]
    spaced = F.size(F.split("__p", " ")) > 2
    parts = [way(texts, keyed, text, some) for way, some in ((_by_words, whole.filter(spaced)), (_by_pieces, whole.filter(~spaced))) if not some.isEmpty()]
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    found = texts.join(pairs, same).filter(F.contains(text, "__p")).drop(*named)
    return found.join(phrases, F.col("__p") == F.col(phrase)).drop("__p")
