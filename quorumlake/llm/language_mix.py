"""Language identification as inference of a multilingual mixture.

Each language is a distribution of character trigrams, counted over all labelled documents. A document's trigrams are taken as
drawn from a mixture of languages, whose proportions expectation-maximisation estimates. Its set of languages grows by the one
of next largest proportion for as long as the likelihood gains more than a penalty for one more language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Trigrams are hashed to so many values. The model holds so many numbers at most (67 MB of doubles, as many counts come to the driver for it),
#: enough for 256 languages; for more, neighbouring values are put together until it does, so it stays as large for any number of languages.
VALUES, NUMBERS = 1 << 15, 1 << 23
#: Log-likelihood that one more language must gain, times the logarithm of the number of trigrams.
PENALTY = 4.0
UNKNOWN = "und"
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams of a whole text; case is folded, runs of other characters than letters are one boundary."""
    counts = np.zeros(VALUES, np.int64)
    if not text:
        return counts
    tail = np.zeros(2, np.uint32)
    for i in range(0, len(text) + 1, _CHUNK):
        codes = np.frombuffer(text[i : i + _CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.concatenate([tail, np.where(_letters()[codes], codes, 0), np.zeros(1 if i + _CHUNK > len(text) else 0, np.uint32)]).astype(np.uint32)
        tail = codes[-2:]
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        whole = ((a != 0) | (b != 0)) & ((b != 0) | (c != 0))
        h = a[whole] * np.uint32(0x9E3779B1) + b[whole] * np.uint32(0x85EBCA77) + c[whole] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(17), minlength=VALUES)
    return counts


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # of each value in each language
    shift: int = 0  # values are put together by leaving out so many of their last bits


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the trigrams of every row whose text and language aren't null. The counts of a task are summed up before they leave it."""

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found[lang] = found.get(lang, 0) + trigrams(text.as_py())
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "value", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, value int, n bigint").groupBy("lang", "value").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    languages = counts.agg(F.count_distinct("lang")).first()[0]
    shift = min(15, max(0, int(np.ceil(np.log2(max(languages, 1) * VALUES / NUMBERS)))))
    table = counts.groupBy("lang", F.shiftright("value", shift).alias("value")).agg(F.sum("n").alias("n")).toArrow()
    names, row = np.unique(np.array(table.column("lang").to_pylist(), object), return_inverse=True)
    p = np.full((len(names), VALUES >> shift), 0.05 * 2**shift)
    p[row, table.column("value").to_numpy()] += table.column("n").to_numpy()
    return Model(names.tolist(), p / p.sum(axis=1, keepdims=True), shift)


def _mixture(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the languages (rows of p) under the trigram counts n, and the log-likelihood there."""
    share = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(rounds):
        mixed = share @ p
        new = share * (p @ (n / mixed)) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ np.log(share @ p))


def infer(model: Model, text: str | None) -> list[tuple[str, float]]:
    """The languages of a text with their proportions, largest first; none for a text without letters."""
    counts = trigrams(text).reshape(-1, 1 << model.shift).sum(axis=1)
    at = np.flatnonzero(counts)
    if not len(at) or not model.languages:
        return []
    p, n = model.p[:, at], counts[at].astype(np.float64)
    order = np.argsort(-_mixture(p, n, 8)[0], kind="stable")
    alone = np.log(p) @ n
    best = int(np.argmax(alone))
    order = np.r_[best, order[order != best]]
    share, like = np.ones(1), float(alone[best])
    penalty = PENALTY * np.log(n.sum() + 1)
    for k in range(2, len(order) + 1):
        more, gained = _mixture(p[order[:k]], n, 20)
        if gained - like <= penalty:
            break
        share, like = more, gained
    ranked = sorted(zip(order.tolist(), share.tolist(), strict=False), key=lambda x: (-x[1], x[0]))
    return [(model.languages[i], min(1.0, s)) for i, s in ranked]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `lang_pred` (und without letters), `score`, the proportion of that language (0 for und), and `languages`, all of
    the mixture as an array of (lang, share). Only the text is read; those three names replace columns of the same name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<lang:string,share:double>>")
    def languages(texts: pa.Array) -> pa.Array:
        found = [[{"lang": lang, "share": s} for lang, s in infer(shared.value, t.as_py())] for t in texts]
        return pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))

    out = docs.withColumn("languages", languages(F.col(text_col).cast("string")))
    first = F.get("languages", F.lit(0))
    return out.withColumn("lang_pred", F.coalesce(first["lang"], F.lit(UNKNOWN))).withColumn("score", F.coalesce(first["share"], F.lit(0.0)))


def held_out(doc_id) -> object:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row, learned from the rows not held out.

    Null, empty and letterless texts are `und` with score 0, as is every text where nothing could be learned. Repeated rows come
    back repeated; an empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(rows.filter(~held_out(F.col("doc_id"))))
    return identify(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs with a language that makes up `least` of their mixture. Texts without letters go. Columns stay as they are."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    tagged = identify(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), model)
    return tagged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
