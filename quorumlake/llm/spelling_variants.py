"""Spelling variants by blocked Gram matrices: words one edit apart, and the frequent form that each rare one leads to.

A word is the vector of its letter counts. One edit changes two counts by one (a replacement: squared distance 2) or one count (an insertion
or deletion: 1). Words are dealt into blocks by length and by their counts in CLASSES classes of letters; an edit moves a word to the same
block, to one where a letter went from one class to another, or to one of the next length with one more letter of a class. Only such
pairs of blocks are compared: a product of their count matrices gives all squared distances, pairs at most two apart are kept, and
each is verified letter by letter. Blocks are cut into packs of bounded size, so any number of words of one block is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All letters that a word may hold once A-Z are lower-cased.
LETTERS = UPPER.lower() + "".join(map(chr, range(0xC0, 0x100)))
CLASSES = 6
#: Letters of a pack, about.
PACK = 12_288


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, that come `least` times or more and have `shortest` code points or more.

    Of a run whose crc32 with its document's id is divisible by `every`, one code point is left out, which plants misspellings to be found.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run")).filter(F.length("run") >= shortest)
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _classes(word: Column) -> Column:
    """How many letters of each class the word has; they add up to its length."""
    of = [LETTERS[k::CLASSES] for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, x, "")) for x in of])


def _moves() -> Column:
    """What one edit changes in the counts of classes, each unordered pair of blocks once: nothing, a letter from one class to a later one's place, one more letter."""
    unit = np.eye(CLASSES, dtype=int)
    deltas = [np.zeros(CLASSES, int), *[unit[i] - unit[j] for i in range(CLASSES) for j in range(i + 1, CLASSES)], *unit]
    return F.array(*[F.array(*[F.lit(int(x)) for x in d]) for d in deltas])


def _points(words: list[str]) -> np.ndarray:
    """Code points, a row for a word; all are of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _counts(points: np.ndarray) -> np.ndarray:
    order = np.full(0x100, len(LETTERS), np.int64)
    order[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    flat = order[points] + np.arange(len(points))[:, None] * (len(LETTERS) + 1)
    return np.bincount(flat.ravel(), minlength=len(points) * (len(LETTERS) + 1)).reshape(len(points), -1).astype(np.float32)


def one_edit(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs one edit apart: words of a of one length, those of b of the same or of one more."""
    x, y = _points(a), _points(b)
    cx, cy = _counts(x), _counts(y)
    squared = (cx * cx).sum(1)[:, None] + (cy * cy).sum(1)[None, :] - 2 * (cx @ cy.T)
    i, j = np.nonzero(squared < 2.5)
    n = x.shape[1]
    keep = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // n)
    for s in range(0, len(i), step):
        u, v = x[i[s : s + step]], y[j[s : s + step]]
        if y.shape[1] == n:
            keep[s : s + step] = (u != v).sum(1) == 1
        else:
            head = np.logical_and.accumulate(u == v[:, :n], axis=1).sum(1)
            tail = np.logical_and.accumulate((u == v[:, 1:])[:, ::-1], axis=1).sum(1)
            keep[s : s + step] = head + tail >= n
    return i[keep], j[keep]


def _best(own: np.ndarray, other: np.ndarray, words: list[str], n: np.ndarray, names: list[str], freq: np.ndarray) -> tuple[list, list, list, list]:
    """Of each word with near ones: the word, how many, and the near one of largest frequency (ties: least), from pairs of places."""
    if not len(own):
        return [], [], [], []
    by_name = np.argsort(np.argsort(np.array(names, dtype=object)))
    order = np.lexsort((by_name[other], -freq[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    count = np.diff(np.r_[first, len(own)])
    return [words[k] for k in own[first]], count.tolist(), [names[k] for k in other[first]], freq[other[first]].tolist()


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of (word, n): of each word that has any, how many words are one edit away, and the most frequent of them."""
    keyed = words.select("word", "n", _classes(F.col("word")).alias("block"))
    size = keyed.groupBy("block").agg(F.ceil(F.count("*") * F.greatest(F.max(F.length("word")), F.lit(1)) / PACK).alias("packs"))
    dealt = keyed.join(size, "block").withColumn("pack", F.pmod(F.xxhash64("word"), F.col("packs")))
    packs = cut(dealt.groupBy("block", "pack").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")))
    keys = packs.select("block", "pack")
    moved = keys.select(F.col("block").alias("a"), F.col("pack").alias("a_pack"), F.explode(F.transform(_moves(), lambda d: F.zip_with("block", d, lambda x, y: x + y))).alias("b"))
    pairs = moved.join(keys.select(F.col("block").alias("b"), F.col("pack").alias("b_pack")), "b").filter("a <> b or a_pack <= b_pack")
    left = packs.select(F.col("block").alias("a"), F.col("pack").alias("a_pack"), F.col("words").alias("a_words"), F.col("ns").alias("a_ns"))
    right = packs.select(F.col("block").alias("b"), F.col("pack").alias("b_pack"), F.col("words").alias("b_words"), F.col("ns").alias("b_ns"))
    pairs = pairs.join(left, ["a", "a_pack"]).join(right, ["b", "b_pack"])
    pairs = pairs.select("a_words", "a_ns", "b_words", "b_ns", ((F.col("a") == F.col("b")) & (F.col("a_pack") == F.col("b_pack"))).alias("self"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, an, b, bn = (batch.column(k)[row].values for k in range(4))
                a, b = a.to_pylist(), b.to_pylist()
                an, bn = an.to_numpy(zero_copy_only=False), bn.to_numpy(zero_copy_only=False)
                i, j = one_edit(a, b)
                out = _best(i, j, a, an, b, bn)
                if not batch.column(4)[row].as_py():
                    out = tuple(x + y for x, y in zip(out, _best(j, i, b, bn, a, an), strict=True))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["word", "n_near", "best", "best_n"])

    found = pairs.mapInArrow(run, "word string, n_near bigint, best string, best_n bigint")
    top = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t")).select("word", "n_near", "t.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Each round halves the way that is left; forms never lead back."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(at.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(at)
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        at = now.select("word", "root")
        at._cut = now._cut


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 2, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of vocabulary(), its form (the most frequent word one edit away, if `factor` times as frequent;
    ties: the least in code-point order), and the root that forms lead to from it (itself without a form).

    Null and empty texts have no words; a null id counts as empty; repeated rows count as often as they come; an empty table gives no rows.
    Runs of any length are words. Other columns aren't read.
    """
    words = cut(vocabulary(docs, id_col, text_col, every, shortest, least))
    joined = words.join(near(words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    all_ = cut(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(all_.filter("form is not null"))
    return all_.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
