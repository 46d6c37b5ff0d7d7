"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form one long run of words that is cut into blocks of equal length. Slot i
of the mix belongs to the source under the point frac(i / golden ratio) of the cumulative weights; the k-th slot of a source takes
the k-th block of its run, which starts again from its front when it ends. So every stretch of the mix holds the sources in
near their weights, no sampling is involved, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
REPEATS = 3
#: Slots that the whole mix has at least (as far as blocks of one word allow), and words in a block at most.
SLOTS, BLOCK = 1 << 16, 4096
#: Cells of [0, 1) for the lookup of a point among the cumulative weights, and documents a bucket of a source's run has, about.
CELLS, BUCKET = 4096, 2_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words between ASCII white space, 0 for null and blank texts."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("bigint").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): one row for each source, so the windows here hold sources only.

    Sources by code point, nulls last, weigh `weights` in turn and share the total of all sizes; none gets more than
    `repeats` times its own size, and what it can't take is shared anew among the rest by weight, until none is above.
    The sources that stop are those of least size for their weight: with these in order, the level that the others reach
    is (total - what the stopped ones take) / weight of the others, and the first source that it does not fill ends the list.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    top = (F.col("source_size") * float(repeats)).alias("top")
    per = per.select("*", top).withColumn("ratio", F.col("top") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    share = F.coalesce(F.least("top", F.col("level") * F.col("weight")), F.col("top"))
    return per.select("source", "source_size", "docs", share.alias("target"))


def runs(sized: DataFrame, per: DataFrame) -> DataFrame:
    """sized with `start`, the words before the document in its source's shuffled run.

    A running sum in two levels: each source is dealt by hash into buckets of about BUCKET documents, whose totals are
    summed up first, so that no source, however large, is summed in one task.
    """
    order = F.xxhash64(F.lit("mix"), F.col("doc_id"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET))
    keyed = sized.join(per.select(F.col("source").alias("s"), parts.alias("parts")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("order", order).withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id"), "parts")).drop("parts")
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = keyed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start"))


def schedule(per: DataFrame, block: int) -> DataFrame:
    """(slot, source, k): slot takes the k-th block, from 0, of the source's run. Each source has ceil(target / block) slots.

    The points may give a source a few slots more or less than that: those beyond are left out, and what lacks comes last.
    """
    spark = per.sparkSession
    quota = per.select("source", F.ceil(F.round("target") / block).cast("bigint").alias("quota")).filter("quota > 0")
    n = quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    upto = F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last()))
    spans = quota.withColumn("hi", upto / F.lit(float(max(n, 1)))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("hi")), F.lit(0.0)))
    cells = F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))))
    spans = spans.withColumn("cell", cells)
    point = F.pmod(F.col("id") * GOLDEN, F.lit(1.0))
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    given = points.join(spans, "cell").filter("point >= lo and point < hi").select("slot", "source", "quota")
    # the rank of a slot in its source: by stretches of slots, so that a large source is not ranked in one task
    given = given.withColumn("stretch", F.floor(F.col("slot") / BUCKET))
    counts = given.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "stretch").orderBy("slot")
    given = given.withColumn("inner", F.row_number().over(own) - 1).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t")))
    given = given.withColumn("k", F.col("base") + F.col("inner")).filter("k < quota").select("slot", "source", "k")
    had = given.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("had"))
    lacking = quota.join(had, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < quota")
    lacking = lacking.select("source", "quota", F.explode(F.sequence(F.col("had"), F.col("quota") - 1)).alias("k"))
    last = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("source"), F.lit(CELLS))).orderBy(F.col("source").asc_nulls_last(), "k")) - 1
    rest = lacking.select((F.lit(n) + last * CELLS + F.pmod(F.xxhash64("source"), F.lit(CELLS))).alias("slot"), "source", "k")
    return given.unionByName(rest)


def block_words(per: DataFrame, slots: int = SLOTS, most: int = BLOCK) -> int:
    """Words in a block: as many as give the mix `slots` slots, from 1 to `most`."""
    total = per.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    return int(min(max(total // slots, 1), most))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(pieces, sized): pieces has (slot, source, doc_id, first, words), the words of a document that a slot takes, and sized
    has (doc_id, source, size, source_size, target) of every row of docs.

    Repeated rows are taken as so many documents, a null doc_id as one like any other, a null source as a source of its own.
    Blank texts have size 0 and no pieces; sources of blank texts have target 0; an empty table gives no rows.
    """
    sized = cut(sizes(docs))
    per = cut(targets(sized, weights, repeats))
    block = block_words(per)
    placed = runs(sized, per).filter("size > 0")
    goal = per.select(F.col("source").alias("s"), "source_size", F.round("target").cast("bigint").alias("words"))
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rounds = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rounds = rounds.withColumn("lo", F.col("round") * F.col("source_size") + F.col("start")).filter("lo < words")
    rounds = rounds.withColumn("hi", F.least(F.col("lo") + F.col("size"), "words"))
    parts = rounds.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    parts = parts.withColumn("from", F.greatest("lo", F.col("k") * block)).withColumn("to", F.least("hi", (F.col("k") + 1) * block))
    slots = schedule(per, block).select("slot", F.col("source").alias("s"), F.col("k").alias("kk"))
    pieces = parts.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("kk")))
    pieces = pieces.select("slot", "source", "doc_id", "size", (F.col("from") - F.col("lo")).alias("first"), (F.col("to") - F.col("from")).alias("words"))
    whole = sized.join(per.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return pieces, whole


def taken(pieces: DataFrame, sized: DataFrame) -> DataFrame:
    """sized with `taken`: the words that the mix takes of the row, repeats counted.

    Rows that agree in doc_id, source and size share what was taken of them evenly, the odd words going to the first of them.
    """
    key = ["doc_id", "source", "size"]
    got = pieces.groupBy(*[F.col(c).alias(f"g_{c}") for c in key]).agg(F.sum("words").alias("all"))
    copies = sized.groupBy(*key, "source_size", "target").agg(F.count("*").alias("copies"))
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"g_{c}"))
    rows = copies.join(got, same, "left").withColumn("all", F.coalesce("all", F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    each = F.expr("all div copies") + F.when(F.col("copy") < F.col("all") % F.col("copies"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", each.cast("bigint").alias("taken"))
