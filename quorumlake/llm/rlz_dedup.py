"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id. It is indexed in blocks, each named by an anchor: of the
GRAM-word grams inside a window of WINDOW words the one of least hash (a minimizer), so equal windows have equal anchors
wherever they stand and one gram in five is kept. Documents that meet an earlier one at an anchor are parsed there: each
window is looked up by a 96-bit hash of its words and gets its first occurrence, and greedily, runs of windows that go on in step with
their occurrence become factors. A window is looked up at every word, so also across the boundaries of factors.

Copies of a whole document are one factor and aren't parsed. Of the others two tables are shuffled: anchors, and windows
of documents that share some. What a task sees more than once it answers itself, in runs, so a passage that a third of all
documents hold is sent once a batch, not once a document.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

WINDOW, GRAM = 13, 5
#: Words that are hashed at once, and words whose hash a worker remembers. They bound memory, not results.
BATCH, REMEMBERED = 1 << 18, 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(words: np.ndarray, n: int, odd: np.uint64, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of n consecutive words, from every word or from those at `at`."""
    last = len(words) - n + 1
    h = np.zeros(max(last, 0) if at is None else len(at), np.uint64)
    if len(h):
        for j in range(n):
            h *= odd
            h += words[j : last + j] if at is None else words[at + j]
    return _mixed(h)


def _parts(batch: pa.RecordBatch, hashes: _Hashes):
    """Rows of the batch, some at a time: (first row, words of each row as bytes, all hashes, first word of each row)."""
    first, part, n = 0, [], 0
    texts = batch.column("text")
    for i in range(batch.num_rows):
        part.append((texts[i].as_py() or b"").split())
        n += len(part[-1])
        if n >= BATCH or i == batch.num_rows - 1:
            h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(part)), np.uint64, n)
            yield first, part, h, np.cumsum([0, *map(len, part)])
            first, part, n = i + 1, [], 0


def _anchors(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, is an anchor, least gram of each window, is a window of one document), by the word they start at."""
    g = _grams(h, GRAM, _ODD[0])
    wide = WINDOW - GRAM + 1
    n = max(len(g) - wide + 1, 0)
    inside = np.repeat(starts[1:], np.diff(starts))[:n] - np.arange(n) >= WINDOW
    least = g[:n].copy()
    for s in range(1, wide):
        np.minimum(least, g[s : s + n], out=least)
    chosen = np.zeros(len(g), bool)
    for s in range(wide):
        chosen[s : s + n] |= (g[s : s + n] == least) & inside
    return g, chosen, least, inside


def _index(batches):
    """(anchor, doc_id, others): a row for each anchor of some documents, with the least of them and the others."""
    hashes = _Hashes()
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for first, part, h, starts in _parts(b, hashes):
            g, chosen, _, _ = _anchors(h, starts)
            at = np.flatnonzero(chosen)
            row = np.repeat(np.arange(len(part)), np.diff(starts))[at]
            doc, key = ids[first + row], g[at]
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            doc, key = doc[fresh], key[fresh]
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(lead)
            offsets = np.append(heads - np.arange(len(heads)), len(key) - len(heads)).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc[~lead], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key[heads].view(np.int64)), pa.array(doc[heads], pa.int64()), others], ["anchor", "doc_id", "others"])


def _digests(batches):
    """(doc_id, hi, lo, words): a 128-bit hash of the words."""
    for b in batches:
        found, n = [], []
        for x in b.column("text"):
            words = (x.as_py() or b"").split()
            found.append(xxhash.xxh3_128_digest(b" ".join(words)))
            n.append(len(words))
        h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64())], ["doc_id", "hi", "lo", "words"])


def _lookups(batches):
    """(w, v, doc_id, pos, run, ref_doc, ref_pos): the windows at shared anchors. Those whose first occurrence in the batch is in a
    smaller doc_id come with it, in runs, under a hash of their own; the others ask one by one under the hash (w, v) of their words."""
    hashes = _Hashes()
    wide = WINDOW - GRAM + 1
    names = ["w", "v", "doc_id", "pos", "run", "ref_doc", "ref_pos"]
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        shared = b.column("anchors")
        for first, part, h, starts in _parts(b, hashes):
            g, chosen, least, inside = _anchors(h, starts)
            n, rows = len(least), np.repeat(np.arange(len(part)), np.diff(starts))
            lists = shared.slice(first, len(part))
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists])
            salt = np.arange(len(part), dtype=np.uint64) * _ODD[1]
            known = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.repeat(salt, sizes)
            at = np.flatnonzero(chosen)
            hit = np.zeros(len(g), bool)
            hit[at] = np.isin(g[at] ^ salt[rows[at]], known)
            ask = np.zeros(n, bool)
            for s in range(wide):
                ask |= hit[s : s + n] & (g[s : s + n] == least)
            at = np.flatnonzero(ask & inside)
            w, v = _grams(h, WINDOW, _ODD[0], at), (_grams(h, WINDOW, _ODD[1], at) >> np.uint64(33)).astype(np.int64)
            row = rows[at]
            doc, pos = ids[first + row], at - starts[row]
            order = np.lexsort((pos, doc, v, w))
            w_, v_ = w[order], v[order]
            lead = np.ones(len(w), bool)
            lead[1:] = (w_[1:] != w_[:-1]) | (v_[1:] != v_[:-1])
            head = np.empty(len(w), np.int64)
            head[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))]
            found = np.flatnonzero(doc[head] < doc)  # in order of row and position
            asks = np.setdiff1d(np.arange(len(w)), found, assume_unique=True)
            ref_doc, ref_pos = doc[head[found]], pos[head[found]]
            new = np.ones(len(found), bool)
            new[1:] = (np.diff(row[found]) != 0) | (np.diff(pos[found]) != 1) | (np.diff(ref_doc) != 0) | (np.diff(ref_pos) != 1)
            begin = np.flatnonzero(new)
            run = np.diff(np.append(begin, len(found)))
            runs = found[begin]
            own = _mixed(w[runs] ^ (doc[runs].astype(np.uint64) * _ODD[1] + pos[runs].astype(np.uint64)))
            none = np.zeros(len(asks), np.int64)
            mask = np.append(np.ones(len(asks), bool), np.zeros(len(runs), bool))
            columns = [
                pa.array(np.append(w[asks], own).view(np.int64)),
                pa.array(np.append(v[asks], np.full(len(runs), -1)), pa.int32()),
                pa.array(doc[np.append(asks, runs)], pa.int64()),
                pa.array(pos[np.append(asks, runs)], pa.int32()),
                pa.array(np.append(none + 1, run), pa.int32()),
                pa.array(np.append(none, ref_doc[begin]), pa.int64(), mask=mask),
                pa.array(np.append(none, ref_pos[begin]), pa.int32(), mask=mask),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


FACTORS = "array<struct<start:int,words:int,ref_doc:bigint,ref_start:int>>"


def _parse(batches):
    """(doc_id, words, removed, kept, factors) from the windows found."""
    factor = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
    for b in batches:
        out = [[], [], [], []]
        for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
            words, factors, removed = (text.as_py() or b"").split(), [], 0
            if spans.is_valid and len(spans):
                x = spans.values
                pos, run, doc, ref = (x.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "run", "ref_doc", "ref_pos"))
                order = np.lexsort((-run, pos))
                pos, run, doc, ref = pos[order], run[order], doc[order], ref[order]
                cuts = np.flatnonzero((np.diff(pos) != run[:-1]) | (np.diff(doc) != 0) | (np.diff(ref) != run[:-1])) + 1
                first = np.append(0, cuts)
                size = np.maximum.reduceat(pos + run, first) - pos[first] + WINDOW - 1
                factors = [{"start": int(a), "words": int(n), "ref_doc": int(d), "ref_start": int(r)} for a, n, d, r in zip(pos[first], size, doc[first], ref[first], strict=True)]
                # what the factors cover goes; each holds a window, and those at their boundaries were looked up like all others
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, np.minimum(pos[first], len(words)), 1)
                np.add.at(cover, np.minimum(pos[first] + size, len(words)), -1)
                gone = np.cumsum(cover)[: len(words)] > 0
                removed = int(gone.sum())
                words_kept = [w for w, g in zip(words, gone, strict=True) if not g]
            else:
                words_kept = words
            for column, value in zip(out, (len(words), removed, b" ".join(words_kept), factors), strict=True):
                column.append(value)
        kept = pa.array(out[2], pa.binary()).cast(pa.string()) if b.num_rows else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), kept, pa.array(out[3], factor)], ["doc_id", "words", "removed", "kept", "factors"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, removed, kept, factors) of each row: a word goes if one of its windows of 13 words starts in a smaller doc_id too.

    Words lie between ASCII white space and are compared as they are; kept words are joined by one space; factors are the
    copied stretches (first word, words, and where in ref_doc they start). Windows are judged on the input alone. Null and blank
    texts have no words. A null doc_id is compared with nothing and loses nothing. doc_id is a key: rows repeated under it are
    no copies of each other and come back repeated. An empty table gives no rows; other columns aren't read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    known = texts.filter("doc_id is not null")
    digests = cut(known.mapInArrow(_digests, "doc_id bigint, hi bigint, lo bigint, words bigint").filter(F.col("words") >= WINDOW))
    least = digests.groupBy("hi", "lo").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("last")).filter("ref_doc < last").drop("last")
    copies = cut(digests.join(least, ["hi", "lo"]).filter("ref_doc < doc_id").select(F.col("doc_id").alias("doc"), "ref_doc", (F.col("words") - WINDOW + 1).cast("int").alias("run")).distinct())
    index = known.mapInArrow(_index, "anchor bigint, doc_id bigint, others array<bigint>")
    index = index.withColumn("n", F.sum(1 + F.size("others")).over(Window.partitionBy("anchor"))).filter("n > 1")
    shared = index.select("anchor", F.explode(F.concat(F.array("doc_id"), F.col("others"))).alias("doc"))
    shared = shared.groupBy("doc").agg(F.collect_list("anchor").alias("anchors"))
    shared = cut(shared.join(copies.select("doc"), "doc", "left_anti"))
    # both joins are left joins of the same rows, so that the texts are shuffled once
    asked = texts.join(shared, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "anchors")
    windows = asked.mapInArrow(_only_shared, "w bigint, v int, doc_id bigint, pos int, run int, ref_doc bigint, ref_pos int")
    first = Window.partitionBy("w", "v").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    windows = windows.withColumn("first_doc", F.first("doc_id").over(first)).withColumn("first_pos", F.first("pos").over(first))
    windows = windows.filter("ref_doc is not null or first_doc < doc_id")
    windows = windows.select(F.col("doc_id").alias("doc"), "pos", "run", F.coalesce("ref_doc", "first_doc").alias("ref_doc"), F.coalesce("ref_pos", "first_pos").alias("ref_pos"))
    whole = copies.select("doc", F.lit(0).alias("pos"), "run", "ref_doc", F.lit(0).alias("ref_pos"))
    spans = windows.unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("pos", "run", "ref_doc", "ref_pos")).alias("spans"))
    found = texts.join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return found.mapInArrow(_parse, f"doc_id bigint, words bigint, removed bigint, kept string, factors {FACTORS}")


def _only_shared(batches):
    yield from _lookups(x for b in batches if (x := b.filter(b.column("anchors").is_valid())).num_rows)
