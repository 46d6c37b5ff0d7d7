"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A seed reads some of the words of a short window and ignores the others, so it still matches where an ignored word was
changed. All windows of the documents are hashed under each mask and joined to the hashes of the benchmark. A hit fixes how document
and item lie against each other; there the words of the whole item are compared, and the pair counts where a stretch of it
agrees but for a fifth of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Words that are read (1) and ignored (0).
MASKS = ("1111011", "11101011", "110110011")
SPAN = max(map(len, MASKS))
#: Items of fewer words than the longest mask, down to SHORT, count only where they stand whole and unchanged.
SHORT = 5
#: Words of a stretch that are compared (or the whole item, if shorter), and the share of them that agrees at least.
STRETCH, SHARE = 16, 0.8
#: Seeds that are broadcast at most, 32 bytes each. Beyond, documents and seeds are shuffled.
BROADCAST = 2_000_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for null."""
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, *keep: str, lengths: tuple[int, ...] = ()) -> DataFrame:
    """(seed, pos, *keep) for each mask, and each of `lengths` as a mask without gaps, at each word of `h`, the array of word hashes."""
    ahead = [F.col("h")] + [F.slice("h", i + 1, F.greatest(F.size("h") - i, F.lit(0))).alias(f"h{i}") for i in range(1, SPAN)]
    at = rows.select(*keep, "h", F.posexplode(F.arrays_zip(*ahead)).alias("pos", "at"))

    def word(i: int) -> Column:
        return F.col("at")["h" if i == 0 else f"h{i}"]

    def seed(k: int, mask: str) -> Column:
        read = [word(i) for i, x in enumerate(mask) if x == "1"]
        return F.when(read[-1].isNotNull(), F.xxhash64(F.lit(k), *read))

    every = [seed(k, m) for k, m in enumerate(MASKS)] + [seed(100 + n, "1" * n) for n in lengths]
    return at.select("pos", *keep, F.explode(F.array(*every)).alias("seed")).filter("seed is not null")


def sown(kinds: DataFrame, short: list[int]) -> DataFrame:
    """(seed, rep, n, item_pos): by the masks for items of SPAN or more words, by the whole item for shorter ones."""
    rows = kinds.select("rep", "n", F.col("item").alias("h"))
    out = seeds(rows.filter(F.col("n") >= SPAN), "rep", "n").select("seed", "rep", "n", F.col("pos").alias("item_pos"))
    for k in short:
        whole = F.xxhash64(F.lit(100 + k), *[F.get("h", F.lit(i)) for i in range(k)])
        out = out.union(rows.filter(F.col("n") == k).select(whole, "rep", "n", F.lit(0)))
    return out.distinct()


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tid, rep, item ids, matched, compared, doc_word, item_word): of each row of docs (doc_id, text), told by its id and
    the hash of its text, and each distinct item the first of the longest agreeing stretches."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tid"), words(F.col("text")).alias("h"))
    items = items.withColumn("rep", F.xxhash64("h"))
    kinds = cut(items.groupBy("rep").agg(F.min("h").alias("item"), F.collect_set(F.struct("item_id")).alias("items")).withColumn("n", F.size("item")))
    short = sorted(r.n for r in kinds.filter(F.col("n") < SPAN).select("n").distinct().collect())
    planted = cut(sown(kinds, short))
    small = planted.count() <= BROADCAST
    key = ["doc_id", "tid", "rep", "lead"]
    own = ("doc_id", "tid", "h") if small else ("doc_id", "tid")
    hits = seeds(docs, *own, lengths=tuple(short)).join(F.broadcast(planted) if small else planted, "seed")
    hits = hits.withColumn("lead", F.col("pos") - F.col("item_pos"))
    begin = F.greatest(F.col("lead"), F.lit(0))
    facing = F.slice("h", begin + 1, F.greatest(F.col("lead") + F.col("n") - begin, F.lit(0)))
    if small:
        found = hits.select(*key, facing.alias("facing")).groupBy(*key).agg(F.first("facing").alias("facing"))
    else:
        found = hits.select(*key, "n").distinct().withColumnsRenamed({"doc_id": "d", "tid": "t"})
        found = found.join(docs.dropDuplicates(["doc_id", "tid"]), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid"))).select(*key, facing.alias("facing"))
    found = cut(found).join(kinds, "rep")
    skipped = F.greatest(-F.col("lead"), F.lit(0))
    same = F.zip_with("facing", F.slice("item", skipped + 1, F.size("facing")), lambda a, b: (a == b).cast("int"))
    width = F.least("n", F.lit(STRETCH))
    found = found.withColumn("same", same).withColumn("width", width).withColumn("skipped", skipped).filter("size(same) > 0")
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("width") + 1, F.lit(1))), lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda a, x: a + x))
    least = F.when(F.col("n") < SPAN, F.col("n")).otherwise(F.ceil(F.col("width") * SHARE))
    found = found.withColumn("sums", sums).withColumn("matched", F.array_max("sums")).filter(F.col("matched") >= least)
    first = (F.array_position("sums", F.col("matched")) - 1).cast("int")
    return found.select("doc_id", "tid", "rep", "items", "matched", F.col("width").alias("compared"), (F.greatest("lead", F.lit(0)) + first).alias("doc_word"), (F.col("skipped") + first).alias("item_word"))


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("bigint").alias("item_id"), words(F.col(text_col)).alias("h")).filter(F.size("h") >= SHORT)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, compared, doc_word, item_word), one row a pair: the first of the longest agreeing stretches.

    Of `compared` words, from doc_word and item_word on, `matched` agree. Items of SHORT to SPAN - 1 words count only whole and
    unchanged; items of fewer words stand in any prose by chance and are not looked for. Equal items are searched once and come back
    each. Null and blank texts have no words. Rows repeated under one id, of equal or of other texts, give one row, that
    of the longest stretch (ties: the first words); null ids are kept as they are; empty tables give no rows.
    """
    found = _found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), _items(items, item_col, item_text_col))
    best = Window.partitionBy("doc_id", "rep").orderBy(F.desc("matched"), "doc_word", "item_word")
    found = found.withColumn("r", F.row_number().over(best)).filter("r = 1")
    return found.select("doc_id", F.explode("items").alias("i"), "matched", "compared", "doc_word", "item_word").select("doc_id", F.col("i.item_id").alias("item_id"), "matched", "compared", "doc_word", "item_word")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap with no item. Columns stay as they are. Rows are told by id and text: of several under one id, or
    under null, only those that overlap go."""
    text = F.col(text_col).cast("string")
    leaked = _found(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), _items(items, "item_id", "text"))
    leaked = cut(leaked.select(F.col("doc_id").alias("__leaked"), F.col("tid").alias("__tid")).distinct())
    if leaked.count() <= BROADCAST:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, F.col(id_col).cast("bigint").eqNullSafe(F.col("__leaked")) & (F.xxhash64(text) == F.col("__tid")), "left_anti")
