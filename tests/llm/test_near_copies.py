import random
from itertools import combinations

import corpus_pipeline as cp
from quorumlake.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(texts):
    """doc_id: least doc_id of its group, over all pairs."""
    root, sets = {k: k for k in texts}, {k: shingles(v) for k, v in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def corpus(seed):
    """Texts of 4 to 3,000 words; copies with 0 to 10 % of their words edited in one run or in several places; a crowd of copies of one text."""
    r = random.Random(seed)
    vocab, line = [f"w{i}" for i in range(500)], " ".join(f"common{i}" for i in range(12))
    texts = {0: None, 1: "", 2: " \t\n", 3: "One two", 4: "one two", 5: "É é"}
    for i in range(10, 40):
        texts[i] = " ".join(r.choices(vocab, k=(4, 8, 30, 50, 100, 200, 300, 1000, 3000)[i % 9]))
        if i % 2:
            texts[i] += " " + line
    for i in range(40, 220):
        w = texts[10 if i > 190 else r.randrange(10, 40)].split()
        n = len(w) * r.choice((0, 1, 2, 3, 5, 10)) // 100 or 1
        runs = r.choice((1, n))
        for _ in range(runs):
            a = r.randrange(len(w))
            w[a : a + n // runs] = r.choices(vocab, k=len(w[a : a + n // runs]))
        texts[i] = "  ".join(w)
    texts |= {i: " ".join(f"m{j}" for j in range(60)) + f" {line} end{i}" for i in range(300, 330)}
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, v, "x", "y", 1) for k, v in texts.items()], SCHEMA)


def test_as_all_pairs(spark):
    texts = corpus(1)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_stage_as_all_pairs_without_broadcasts_or_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST", 0)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    texts = corpus(2)
    kept = cp.drop_near_duplicates(spark, frame(spark, texts), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts).values()))


def test_one_changed_word_of_fifty_is_a_near_copy(spark):
    w = [f"w{i}" for i in range(50)]
    rows = {1: " ".join(w), 2: " ".join([*w[:20], "changed", *w[21:]]), 3: " ".join([*w[:20], "x", *w[21:40], "y", "z", *w[42:]])}
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, frame(spark, rows), "").collect()) == sorted(set(brute(rows).values()))
    assert len(set(brute(rows).values())) == 2


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d", "p", None, 1), (2, "a b c d", "q", None, 2), (2, "a b c d", "q", None, 2), (None, "z z z", "r", None, 3), (None, "z z z", "r", None, 3), (5, None, "s", None, None), (6, "", "t", None, 4)]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or -1, r.lang) for r in kept.collect()) == [(-1, "r"), (1, "p"), (5, "s")]
    assert near_copies.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
