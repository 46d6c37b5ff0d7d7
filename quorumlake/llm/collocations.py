"""Phrase collocations by top-order marginalisation: only the longest windows are counted, shorter phrases are sums of them.

Each word and its lead columns (the next words of its piece, null past the end) make one padded window of the longest order. Tasks sum the
windows of many documents before these are shuffled, once, by all words but the last; sums of windows and of these prefixes then need
no other shuffle, and ROLLUP sums the counts of successively shorter prefixes. No phrase of a lower order is ever exploded. Of
the summed tables only counts of `least` or more go on: parts of a candidate are at least as frequent as it is.

Prefixes that are frequent in a sample of documents are dealt over several tasks by the last word, and summed up from these. This only decides
where rows go: whatever the sample holds, counts are of all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Bytes of text cut into words at a time; windows that a task sums before it passes them on.
TEXT, HELD = 2 << 20, 1 << 19
#: Documents of the sample, about; a prefix that makes up one in HOT of its windows (so HOT prefixes at most) is dealt over SALTS tasks.
SAMPLE, HOT, SALTS = 2_000, 1_000, 64


def _windows(langs: pa.Array, texts: pa.Array, order: int):
    """Tables (prefix, last) of whole pieces, some TEXT bytes of them at a time (more if a piece is longer): prefix is the words of a padded window but the
    one in last place, two line feeds, and the language."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), r"[.,;:!?\x0A-\x0D]")
    pieces, owner = pc.replace_substring(pc.list_flatten(lists), "\t", " "), pc.list_parent_indices(lists)
    ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT)))
        lists = pc.split_pattern(pieces[at:to], " ")
        words, piece = pc.list_flatten(lists), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(words), 0)
        words, piece = words.filter(full), piece.filter(full).to_numpy()
        lead = [words]
        for k in range(1, order):
            same = np.zeros(len(piece), bool)
            same[: max(len(piece) - k, 0)] = piece[k:] == piece[: max(len(piece) - k, 0)]
            later = pa.concat_arrays([words[k:], pa.nulls(min(k, len(words)), pa.string())])
            lead.append(pc.if_else(pa.array(same), later, pa.scalar(None, pa.string())))
        prefix = pc.binary_join_element_wise(*lead[:-1], " ", null_handling="skip")
        yield pa.table({"prefix": pc.binary_join_element_wise(prefix, langs.take(owner[at:to].take(pa.array(piece))), "\n\n"), "last": lead[-1]})
        at = to


def _read(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")


def _summed_windows(docs: DataFrame, order: int, hot: list[str]) -> DataFrame:
    """(prefix, last, n): windows as summed by task; of the hot prefixes the place between the line feeds holds one of SALTS numbers, by the last word."""
    hot_set = pa.array(hot, pa.string())

    def salted(prefix: pa.Array, last: pa.Array) -> pa.Array:
        at = np.flatnonzero(pc.is_in(prefix, hot_set).to_numpy(zero_copy_only=False))
        if not len(at):
            return prefix
        new = [p.replace("\n\n", f"\n{zlib.crc32((w or '').encode()) % SALTS}\n", 1) for p, w in zip(prefix.take(pa.array(at)).to_pylist(), last.take(pa.array(at)).to_pylist(), strict=True)]
        mask = np.zeros(len(prefix), bool)
        mask[at] = True
        return pc.replace_with_mask(prefix, pa.array(mask), pa.array(new, pa.string()))

    def run(batches):
        held: list[pa.Table] = []

        def summed():
            g = pa.concat_tables(held).combine_chunks().group_by(["prefix", "last"]).aggregate([([], "count_all")])
            held.clear()
            for b in g.sort_by("prefix").combine_chunks().to_batches(max_chunksize=1 << 16):  # neighbours alike shuffle smaller
                yield pa.RecordBatch.from_arrays([salted(b.column(0), b.column(1)), b.column(1), b.column(2)], ["prefix", "last", "n"])

        for b in batches:
            texts = b.column("text")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT)))
                for t in _windows(b.column("lang")[at:to], texts[at:to], order):
                    held.append(t)
                    if sum(map(len, held)) >= HELD:
                        yield from summed()
                at = to
        if held:
            yield from summed()

    return docs.mapInArrow(run, "prefix string, last string, n bigint")


def _hot(docs: DataFrame, order: int) -> list[str]:
    """Prefixes to be dealt over several tasks: those that make up one in HOT of the windows of a sample."""
    some = _summed_windows(docs.sample(min(1.0, SAMPLE / max(docs.count(), 1)), seed=1), order, [])
    some = cut(some.groupBy("prefix").agg(F.sum("n").alias("n")))
    total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r.prefix for r in some.filter(F.col("n") * HOT >= total).orderBy(F.desc("n"), "prefix").limit(HOT).collect()]


def _first(text: Column, words: int) -> Column:
    """The first words of a phrase."""
    return F.substring_index(text, " ", words)


def counts(docs: DataFrame, order: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n): frequency of each phrase of 1 to `order` words that has `least` or more, and under words 0 of all words of a language."""
    read = _read(docs, text_col, lang_col)
    # dealt by prefix once: the sums of windows and of prefixes need no other shuffle
    dealt = _summed_windows(read, order, _hot(read, order)).repartition("prefix")
    windows = dealt.groupBy("prefix", "last").agg(F.sum("n").alias("n"))
    # counts `last` so that it isn't pruned, which would take a shuffle of its own
    prefixes = dealt.groupBy("prefix").agg(F.sum("n").alias("n"), F.count("last").alias("full")).filter("full >= 0")
    phrase, salt, lang = (F.split("prefix", "\n", 3)[k] for k in range(3))
    told = prefixes.select(lang.alias("lang"), phrase.alias("phrase"), salt.alias("salt"), "n").withColumn("words", F.regexp_count("phrase", F.lit(" ")) + 1)
    names = [f"p{k}" for k in range(1, order - 1)]
    shorter = [F.when(F.col("words") >= k, _first(F.col("phrase"), k)).alias(f"p{k}") for k in range(1, order - 1)]
    # grouping_id has a bit for each column summed over: none for the longest prefix, all but that of lang for the language
    rolled = told.select("lang", *shorter, "n").rollup("lang", *names).agg(F.sum("n").alias("n"), (order - 2 - F.bit_count(F.grouping_id())).alias("words"))
    rolled = rolled.withColumn("phrase", F.element_at(F.array(*[F.col(c) for c in names]), F.greatest("words", F.lit(1))) if names else F.lit(None).cast("string"))
    # conditions on words come after the cut: pushed down, they would keep the three from sharing one shuffle
    top = windows.filter(F.col("n") >= least).select(F.lit("window").alias("kind"), lang.alias("lang"), F.lit(order).alias("words"), F.concat_ws(" ", phrase, F.coalesce("last", F.lit(""))).alias("phrase"), F.lit("").alias("salt"), "n")
    mid = told.filter((F.col("n") >= least) | (F.col("salt") != "")).select(F.lit("prefix").alias("kind"), "lang", "words", "phrase", "salt", "n")
    low = rolled.filter((F.col("n") >= least) | (F.col("words") < 1)).select(F.lit("rolled").alias("kind"), "lang", "words", "phrase", F.lit("").alias("salt"), "n")
    all_ = cut(top.unionByName(mid).unionByName(low))
    # no more than windows that are full, prefixes of full length, and languages: what is padded has sums of its own further down
    full = all_.filter(f"kind = 'window' and not endswith(phrase, ' ') or kind = 'prefix' and words = {order - 1} or kind = 'rolled' and lang is not null and (words = 0 or phrase is not null)")
    salted = F.col("salt") != ""
    summed = full.filter(salted).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return full.filter(~salted).select("lang", "words", "phrase", "n").unionByName(summed)


def scored(found: DataFrame, order: int = 3, cover: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of counts(): candidates of two or more words at their lowest-scoring cut.

    Left out are those whose words lie inside a longer candidate with at least `cover` percent of their frequency. Arithmetic is
    in decimals of 38 digits: exact for counts up to 10**16.
    """
    many = found.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    inner = []
    for long in range(3, order + 1):
        for short in range(2, long):
            inner += [F.when(F.col("words") == long, F.substring_index(_first(F.col("phrase"), i + short), " ", -short)) for i in range(long - short + 1)]
    if inner:
        inside = many.filter("words > 2").select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "a")
        inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept = many.join(inside, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {cover} * a").drop("longer")
    else:
        kept = many
    cuts = F.array(*[F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), _first(F.col("phrase"), k).alias("head"), F.substr("phrase", F.length(_first(F.col("phrase"), k)) + 2).alias("tail"))) for k in range(1, order)])
    cuts = kept.select("lang", "phrase", "a", F.inline(F.array_compact(cuts)))
    part = found.filter("words >= 1").select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    wide = "cast({0} as decimal(19, 0))"
    score = F.expr(f"cast({wide.format('a')} * {wide.format('a')} * 1000000 div ({wide.format('l')} * {wide.format('r')}) as bigint)")
    cuts = cuts.withColumn("score", score)
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("c")).select("lang", "phrase", "a", "c.*")


def collocations(docs: DataFrame, order: int = 3, least: int = 10, cover: int = 50, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of 2 to `order` words that hold together most.

    Words are what lies between spaces and tabs in pieces of text that end at punctuation or a line's end; only A-Z are lower-cased. score is
    a*a / (l*r), in millionths. Ties go by a, then by the phrase in byte order, so ranks are total. A null lang counts as und; null and
    empty texts have no words; repeated rows count as often as they come; an empty table gives no rows. Other columns aren't read. A text is cut
    into pieces whole, its words some TEXT bytes at a time.
    """
    found = cut(counts(docs, order, least, text_col, lang_col))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = cut(scored(found, order, cover))
    # ranked in parts first, so that no task holds all candidates of a language
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best))
    rows = rows.withColumn("rank", part).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    total = found.filter("words = 0").select("lang", "n")
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
