import random
from collections import defaultdict

from quorumlake.llm import rlz_dedup

SCHEMA = "doc_id bigint, text string, words int, anchors string, doc string"


def brute(rows, n=13):
    first = defaultdict(list)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for p in range(len(w) - n + 1):
                first[tuple(w[p : p + n])].append(i)
    first = {k: min(v) for k, v in first.items()}
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p : p + n])] < i:
                gone |= set(range(p, p + n))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"é{i}" if i % 7 == 0 else f"w{i}" for i in range(90)]
    rows = []
    passages = [" ".join(r.choices(vocab, k=r.choice((12, 13, 14, 60)))) for _ in range(8)]
    for i in range(160):
        parts = [" ".join(r.choices(vocab, k=r.randrange(0, 50))) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        rows.append((i * 3 % 160, r.choice((" ", "\n", " \t ")).join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a " * 40_000), (304, "a " * 30), (None, rows[0][1]), rows[5], rows[5]]
    return rows


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(parts)
    return rlz_dedup.dedup(docs).collect()


def test_as_brute_force(spark):
    rows = corpus(1)
    out = run(spark, rows)
    assert sorted(((r.doc_id, r.words, r.removed, r.kept) for r in out), key=str) == brute(rows)
    words = {i: (t or "").split() for i, t in rows if i is not None}
    for r in out:
        for f in r.factors:
            assert f.ref_doc < r.doc_id and f.words >= 13
            assert words[r.doc_id][f.start : f.start + f.words] == words[f.ref_doc][f.ref_start : f.ref_start + f.words]


def test_small_batches_change_nothing(spark, monkeypatch):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = rlz_dedup.dedup(docs.repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.doc_id, r.words, r.removed, r.kept) for r in out), key=str) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
