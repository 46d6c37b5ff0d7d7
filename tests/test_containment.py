"""Containment at any number of phrases gives the rows of the plain comparison."""

import random

from quorumlake.operators import containment as C
from quorumlake.operators import graph as G

TEXTS = "id int, text string, n string"


def pairs(df):
    return sorted(((r.id, r.text, r.phrase, r.tag) for r in df.collect()), key=str)


def test_as_plain_comparison(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcé𝒜", k=r.randrange(1, 6))) for _ in range(40)]
    texts = [(i, " ".join(r.choices(words, k=r.randrange(1, 12))), "x") for i in range(60)]
    texts += [(100, None, "x"), (101, "", "x"), (102, "aa" * 3000, "x"), texts[0], (103, "line\nfeed abc", "y"), (None, "abc abc", "z")]
    phrases = [(" ".join(r.choices(words, k=r.randrange(1, 4))), i) for i in range(80)]
    phrases += [("", -1), (None, -2), ("a", -3), ("abc", -4), ("e\nf", -5), ("nowhere at all", -6), phrases[0], (phrases[0][0], -7)]
    want = sorted(((i, t, p, k) for i, t, _ in texts for p, k in phrases if t is not None and p is not None and p in t), key=str)
    t, p = spark.createDataFrame(texts, TEXTS), spark.createDataFrame(phrases, "phrase string, tag int")
    assert len(want) > 300
    assert pairs(C.contained(t, ["id"], "text", p, "phrase", small=0)) == want
    assert pairs(C.contained(t, ["id"], "text", p, "phrase")) == want
    assert C.contained(t.limit(0), ["id"], "text", p, "phrase", small=0).collect() == []
    assert C.contained(t, ["id"], "text", p.limit(0), "phrase", small=0).collect() == []


def test_search_of_many_keywords(spark, monkeypatch):
    edges = spark.createDataFrame([("New York", "IN", "USA"), ("Paris", "IN", "France"), ("a", "b", "York")], "subject string, predicate string, object string")
    keys = spark.createDataFrame([("york",), ("FRA",), ("york",)], "keyword string")
    want = [("New York", "IN", "USA"), ("Paris", "IN", "France"), ("a", "b", "York")]
    assert list(map(tuple, G.search_context(edges, keys).collect())) == want
    monkeypatch.setattr(C, "SMALL", 0)
    assert list(map(tuple, G.search_context(edges, keys).collect())) == want


def test_phrases_of_whole_words_are_met_at_these(spark):
    r = random.Random(7)
    words = ["a", "b", "ab", "ba", "aab", "", "é", "abé𝒜", "bb"]
    texts = [(i, " ".join(r.choices(words, k=r.randrange(1, 14))), "x") for i in range(120)] + [(200, None, "x"), (201, "  ", "x"), (202, "xa b  bab a", "y"), (None, "a b ab", "z"), (203, "a\nb c a b", "z")]
    phrases = [(" ".join(r.choices(words, k=r.randrange(3, 7))), i) for i in range(150)] + [("  ", -1), (" b ", -2), ("a b ", -3), (None, -4), ("a b ab", -5), ("a b ab", -6), ("a b", -7), ("é", -8), ("\nb c a", -9)]
    want = sorted(((i, t, p, k) for i, t, _ in texts for p, k in phrases if t is not None and p is not None and p in t), key=str)
    t = spark.createDataFrame(texts, TEXTS)
    got = C.contained(t, ["id"], "text", spark.createDataFrame(phrases, "phrase string, tag int"), "phrase", small=0)
    assert pairs(got) == want and len({k for _, _, _, k in want if k >= 0}) > 30
    spaced = [x for x in phrases if x[0] is not None and x[0].count(" ") > 1]
    only = C.contained(t, ["id"], "text", spark.createDataFrame(spaced, "phrase string, tag int"), "phrase", small=0)
    assert pairs(only) == [x for x in want if x[2].count(" ") > 1]
    assert "regexp_extract_all" not in only._jdf.queryExecution().optimizedPlan().toString()
    nulls = spark.createDataFrame([(None, 1)], "phrase string, tag int")
    assert C.contained(t, ["id"], "text", nulls, "phrase", small=0).collect() == []
