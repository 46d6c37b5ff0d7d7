"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: by their number of tokens, then by their first tokens, in which every token with a digit counts as a
variable field. Lines that meet at a leaf are generalised there, frequent and rare ones alike: a token stays if enough documents have
it at its place, the others become variable. A template also holds the lines of every template that it generalises, so values that are
frequent on their own count with the rare ones. Lines of templates that recur in enough documents are dropped, but for those of
each template's first document.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Documents in which a template recurs, at least; first tokens that the tree is parsed by; share of a template's tokens that stay.
DOCUMENTS, DEPTH, CONSTANT = 10, 3, 0.7
#: Parts that the documents of one line are dealt over where lines meet their templates.
SALTS = 16
#: Texts of a batch that are Python objects at once.
SLICE = 500
FIELD = "<*>"
_DIGIT = re.compile(r"\d", re.A)


def _key(tokens: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest("\x1f".join(tokens).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _keys(line: str) -> tuple[int, int] | None:
    """(leaf, line) of a line, none for a blank one."""
    tokens = line.split()
    if not tokens:
        return None
    lead = [FIELD if _DIGIT.search(t) else t for t in tokens[:DEPTH]]
    return _key([str(len(tokens)), *lead]), _key(tokens)


def _parsed(batches):
    for b in batches:
        docs, leaves, lines = [], [], []
        for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
            found = {_keys(x) for x in text.as_py().split("\n")} - {None}
            docs += [doc] * len(found)
            leaves += [k for k, _ in found]
            lines += [k for _, k in found]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(leaves, pa.int64()), pa.array(lines, pa.int64())], ["doc", "leaf", "line"])


def _spelled(batches):
    """(leaf, line, tokens) of the lines asked for, once each."""
    for b in batches:
        leaves, lines, tokens = [], [], []
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            wanted = set(wanted)
            for x in text.split("\n"):
                if (k := _keys(x)) and k[1] in wanted:
                    wanted.discard(k[1])
                    leaves.append(k[0])
                    lines.append(k[1])
                    tokens.append(x.split())
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(lines, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["leaf", "line", "tokens"])


def _met(shapes: DataFrame) -> DataFrame:
    """(leaf, template, general): templates and those that generalise them, from (leaf, template, tokens, anchor) with null fields.

    A template that generalises another agrees with it in all tokens that it has, so also in its rarest one (its anchor):
    they are joined on that and then compared. A template without tokens of its own beyond the leaf has the leaf as anchor.
    """
    some = shapes.select("leaf", F.col("template").alias("general"), F.col("tokens").alias("g_tokens"), "anchor").filter(F.exists("g_tokens", lambda x: x.isNull()))
    places = F.filter(F.transform("tokens", lambda x, i: F.when(x.isNotNull(), F.struct(i.cast("int").alias("pos"), x.alias("token")))), lambda x: x.isNotNull() & (x["pos"] >= DEPTH))
    own = shapes.select("leaf", "template", "tokens", F.explode(F.concat(places, F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("token"))))).alias("anchor"))
    both = own.join(some, ["leaf", "anchor"]).filter(F.col("template") != F.col("general"))
    fits = F.forall(F.zip_with("tokens", "g_tokens", lambda x, g: g.isNull() | g.eqNullSafe(x)), lambda x: x)
    return both.filter(fits).select("leaf", "template", "general").distinct()


def recurring(docs: DataFrame, least: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, templates): the distinct (doc, leaf, line) of all rows with an id and a text, and (leaf, line, firsts) of each line
    of which a template recurs in `least` or more documents; firsts: the documents that keep it, those of least id of its templates."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")
    lines = cut(texts.mapInArrow(_parsed, "doc bigint, leaf bigint, line bigint"))
    alike = cut(lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("doc").alias("first")))
    crowded = alike.groupBy("leaf").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).filter(F.col("all") >= least)
    single = alike.join(crowded.filter("kinds = 1").select("leaf"), "leaf", "left_semi").select("leaf", "line", F.array("first").alias("firsts"))
    several = alike.join(crowded.filter("kinds > 1").select("leaf"), "leaf", "left_semi")
    asked = several.groupBy(F.col("first").alias("doc")).agg(F.collect_set("line").alias("wanted"))
    spelled = texts.join(asked, "doc").mapInArrow(_spelled, "leaf bigint, line bigint, tokens array<string>").dropDuplicates(["leaf", "line"])
    each = cut(spelled.join(several, ["leaf", "line"]).select("leaf", "line", "n", "first", F.posexplode("tokens").alias("pos", "token")))
    common = each.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("all")).filter(F.col("all") >= least)
    placed = each.join(common, ["leaf", "pos", "token"], "left").withColumn("token", F.when(F.col("all").isNotNull(), F.col("token")))
    rarest = F.min(F.when(F.col("token").isNotNull() & (F.col("pos") >= DEPTH), F.struct("all", "pos", "token")))
    shaped = placed.groupBy("leaf", "line", "n", "first").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("parts"), rarest.alias("rarest"))
    shaped = shaped.withColumn("tokens", F.transform("parts", lambda x: x["token"]))
    shaped = shaped.filter(F.size(F.array_compact("tokens")) >= CONSTANT * F.size("tokens")).withColumn("template", F.xxhash64(F.transform("tokens", lambda x: F.struct(x))))
    leaf = F.struct(F.lit(-1).alias("pos"), F.lit("").alias("token"))
    anchor = F.when(F.col("rarest").isNotNull(), F.struct("rarest.pos", "rarest.token")).otherwise(leaf)
    shaped = cut(shaped.select("leaf", "line", "n", "first", "template", "tokens", anchor.alias("anchor")))
    kinds = shaped.groupBy("leaf", "template").agg(F.first("tokens").alias("tokens"), F.first("anchor").alias("anchor"))
    met = cut(_met(kinds).unionByName(kinds.select("leaf", "template", F.col("template").alias("general"))))
    # lines are summed by their template before they meet those that generalise it
    by_kind = cut(shaped.groupBy("leaf", "template").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.sum("n").alias("all"), F.min("first").alias("first")))
    summed = met.join(by_kind, ["leaf", "template"])
    per = cut(summed.groupBy("leaf", "general").agg(F.sum("kinds").alias("kinds"), F.max("most").alias("most"), F.sum("all").alias("all"), F.min("first").alias("first")))
    # documents are counted only where the counts of the lines don't settle it: those of each template first. One with enough of them settles
    # all that generalise it; of the others each has fewer, so what is left to put together is as many rows at most for each pair
    unsettled = per.filter((F.col("kinds") > 1) & (F.col("most") < least) & (F.col("all") >= least)).select("leaf", "general")
    open_ = cut(met.join(unsettled, ["leaf", "general"]))
    asked = shaped.select("leaf", "line", "template").join(open_.select("leaf", "template").distinct(), ["leaf", "template"], "left_semi")
    holding = cut(_salted(asked, lines).select("leaf", "template", "doc").distinct())
    sizes = open_.join(holding.groupBy("leaf", "template").agg(F.count("*").alias("documents")), ["leaf", "template"])
    sizes = cut(sizes.groupBy("leaf", "general").agg(F.max("documents").alias("documents")))
    left = open_.join(sizes.filter(F.col("documents") < least).select("leaf", "general"), ["leaf", "general"])
    held = left.join(holding, ["leaf", "template"]).select("leaf", "general", "doc").distinct()
    counted = held.groupBy("leaf", "general").agg(F.count("*").alias("documents")).unionByName(sizes.filter(F.col("documents") >= least))
    again = cut(per.join(counted, ["leaf", "general"], "left").filter(F.coalesce("documents", "most") >= least).select("leaf", "general", F.col("first").alias("keeper")))
    below = met.filter("template <> general").join(again, ["leaf", "general"]).select("leaf", F.col("template").alias("general"))
    tops = again.join(below, ["leaf", "general"], "left_anti")
    kept = met.join(tops, ["leaf", "general"]).groupBy("leaf", "template").agg(F.collect_set("keeper").alias("firsts"))
    general = shaped.select("leaf", "line", "template").join(kept, ["leaf", "template"]).select("leaf", "line", "firsts")
    return lines, cut(single.unionByName(general))


def _salted(few: DataFrame, lines: DataFrame) -> DataFrame:
    """few, keyed by (leaf, line), joined to lines; the documents of one line are dealt over SALTS parts."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(few, ["leaf", "line", "salt"]).drop("salt")


def drop_recurring(docs: DataFrame, least: int = DOCUMENTS, counts: bool = True) -> DataFrame:
    """docs with `text` without the lines whose template recurs across documents. With counts, `lines` and `dropped`, the numbers of
    lines that hold tokens, are added and replace columns of the same name; without, all other columns stay as they are.

    Of a template that no other recurring one generalises, the document of least doc_id keeps its lines, all others lose theirs; a text may
    become empty. Of several such templates of one line each has its keeper (ties don't arise: ids are compared). Lines left stay
    as they are, in order; so do blank ones. Repeats within one document alone don't count. A null text stays null with 0 lines; rows
    with a null doc_id are neither counted nor changed; rows repeated under a doc_id are changed alike, and count as so many
    documents of a line but as one where the documents of several lines are put together. An empty table gives no rows.
    """
    lines, templates = recurring(docs, least)
    gone = _salted(templates, lines).filter(~F.array_contains("firsts", F.col("doc")))
    gone = gone.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__gone"))

    kind = pa.struct([("text", pa.string()), ("lines", pa.int64()), ("dropped", pa.int64())])

    @F.arrow_udf("struct<text:string,lines:bigint,dropped:bigint>")
    def cleaned(texts: pa.Array, drops: pa.Array) -> pa.Array:
        done = [pa.array([], kind)]
        for i in range(0, len(texts), SLICE):
            out = []
            for text, drop in zip(texts.slice(i, SLICE).to_pylist(), drops.slice(i, SLICE).to_pylist(), strict=True):
                kept, n, dropped, drop = [], 0, 0, set(drop or ())
                for x in (text or "").split("\n"):
                    k = _keys(x) if drop else None
                    n += bool(x.split())
                    if k and k[1] in drop:
                        dropped += 1
                    else:
                        kept.append(x)
                out.append({"text": None if text is None else "\n".join(kept), "lines": n, "dropped": dropped})
            done.append(pa.array(out, kind))
        return pa.concat_arrays(done)

    joined = docs.join(gone, F.col("doc_id").cast("bigint") == F.col("__doc"), "left")
    joined = joined.withColumn("__new", cleaned(F.col("text").cast("string"), F.col("__gone")))

    def column(name: str) -> Column:
        return F.col(f"__new.{name}").alias(name)

    new = ("text", "lines", "dropped") if counts else ("text",)
    return joined.select(*[column(c) if c in new else docs[c] for c in docs.columns], *[column(c) for c in new if c not in docs.columns])
