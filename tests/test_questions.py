"""Context for many questions is that of each question on its own."""

import random

import pytest

from quorumlake.operators import containment as C
from quorumlake.operators import questions as Q

EDGE = "id int, subject string, predicate string, object string, extra string"


def plain(questions, edges, vectors, top_facts, top_paths):
    both = [(i, s, p, o) for i, s, p, o, _ in edges] + [(i, o, p, s) for i, s, p, o, _ in edges]
    out = set()
    for q, words in questions:
        lines = sorted({(s, p, o) for _, s, p, o, _ in edges if any(w in x.lower() for w in words for x in (s, o))})[:top_facts]
        main = max(words, key=len) if words else None
        paths = {(1, a, (p,), b) for _, a, p, b in both if main and main in a.lower()}
        paths |= {(2, a, (p, p2), c) for i, a, p, b in both if main and main in a.lower() for j, b2, p2, c in both if b2 == b and i != j}
        kinds = {}
        for text in [" ".join(x) for x in lines]:
            kinds.setdefault(text, "fact")
        for k, text in vectors:
            if k == q and text:
                kinds.setdefault(text[:400], "vector")
        for _, a, p, b in sorted(paths)[:top_paths]:
            kinds.setdefault(f"{a} via [{' -> '.join(p)}] {b}", "path")
        out |= {(q, text, kind) for text, kind in kinds.items()}
    return sorted(out)


@pytest.mark.parametrize("small", [10_000, 0])
def test_as_each_question_alone(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    r = random.Random(small)
    names = ["Alpha", "Beta", "Alpha Beta", "gamma", "Gamma Ray", "delta", "hub", "Élan", "rayon", "solo"]
    edges = [(i, r.choice(["hub", r.choice(names)]), r.choice("pq"), r.choice(names), "x") for i in range(60)] + [(100, "solo", "p", "far"), (101, "far", "p", "solo"), (102, "lone", "q", "lone two")]
    edges = [(*e, "x")[:5] for e in edges]
    questions = [(1, ["alpha"]), (2, ["hub", "alpha"]), (3, ["solo"]), (4, ["lone"]), (5, ["nothing"]), (6, ["ray", "beta", "élan"]), (7, [])]
    vectors = [(1, "Alpha p gamma"), (2, "v" * 500), (2, ""), (3, None), (7, "seen")]
    asked = [(q, " de ".join(w) + "?") for q, w in questions] + [(8, None), (9, "de a")]
    got = Q.context(spark.createDataFrame(asked, "question_id int, text string"), spark.createDataFrame(edges, EDGE), spark.createDataFrame(vectors, "question_id int, text string"), 5, 9)
    assert sorted((x.question_id, x.text, x.kind) for x in got.collect()) == plain(questions, edges, vectors, 5, 9)


def test_nothing_asked_or_known(spark):
    asked, none = spark.createDataFrame([(1, "alpha")], "question_id int, text string"), spark.createDataFrame([], EDGE)
    assert Q.context(asked, none, asked.limit(0)).collect() == []
    assert Q.context(asked.limit(0), none, asked.limit(0)).collect() == []
