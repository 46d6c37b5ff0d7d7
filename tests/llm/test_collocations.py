import random
import re
from collections import Counter

import pytest

from quorumlake.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, n string, window int, words string, phrase string, rank int"


def brute(rows, order=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in found.items():
        if any(q[0] == lang and len(q) > len(w) + 1 and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) and 100 * b >= cover * a for q, b in found.items()):
            continue
        s, _, l, r = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, best in out.items() for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", "z", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


def corpus(seed, docs=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Übe", "the", "of", "the", "A\x0bb", "x y"]
    fixed = ["New York City", "once upon a time", "top of the pops", "a a a a", "per se"]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(r.randrange(60)):
            text += (r.choice(fixed) if r.random() < 0.3 else r.choice(vocab)) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ";x "])
        rows.append((text, r.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t.. ,", "de"), ("long words " * 30_000, "en")] + [rows[0]] * 5


@pytest.mark.parametrize(("order", "least", "cover", "top"), [(3, 10, 50, 2000), (4, 5, 80, 7), (2, 3, 50, 2000)])
def test_as_brute_force(spark, order, least, cover, top):
    rows = corpus(order)
    got = collocations.collocations(table(spark, rows), order, least, cover, top).collect()
    assert sorted(map(tuple, got)) == brute(rows, order, least, cover, top)
    assert len(got) > 10


def test_small_pieces_of_work_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TEXT", 50)
    monkeypatch.setattr(collocations, "HELD", 40)
    monkeypatch.setattr(collocations, "HOT", 10)
    monkeypatch.setattr(collocations, "SALTS", 3)
    rows = corpus(9)[:60]
    assert sorted(map(tuple, collocations.collocations(table(spark, rows)).collect())) == brute(rows)


def test_arithmetic_passes_64_bits(spark):
    n = 4_000_000_000
    found = spark.createDataFrame([("en", 1, "a", 3 * n), ("en", 1, "b", 2 * n), ("en", 2, "a b", n + 1), ("en", 0, None, 9 * n)], "lang string, words int, phrase string, n bigint")
    (row,) = collocations.scored(found).collect()
    assert (row.l, row.r, row.score) == (3 * n, 2 * n, 10**6 * (n + 1) ** 2 // (6 * n * n))


def test_empty_table(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
