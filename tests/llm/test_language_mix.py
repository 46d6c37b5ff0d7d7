import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from quorumlake.llm import language_mix as lm

SCHEMA = "doc_id bigint, text string, lang string, source string, languages int, score string"
SYLLABLES = {"aa": ["ka", "to", "ri", "mu"], "bb": ["éch", "lle", "que", "ou"], "cc": ["schä", "ung", "ich", "zu"]}


def write(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(n))


def corpus(n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, write(r, lang, r.choice((3, 40, 200))).upper() if i % 9 == 0 else write(r, lang, 40), lang, "s", 1, "x"))
    mixed = write(r, "aa", 300) + "\n" + write(r, "bb", 200)
    return rows + [(1000, mixed, "aa", "s", 1, "x"), (1001, None, "aa", "s", 1, "x"), (1002, "", None, "s", 1, "x"), (1003, "123 --- !", "bb", "s", 1, "x"), (1004, write(r, "cc", 60_000), None, None, None, None), (None, write(r, "aa", 9), "aa", "s", 1, "x"), rows[0], rows[0]]


def test_held_out_accuracy_and_mixtures(spark):
    rows = corpus()
    out = lm.predict(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    tested = [r for r in out if r.held_out and r.doc_id < 1000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.98 * len(tested) > 30
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and by[1003].score == 0
    assert by[1004].lang_pred == "cc" and by[1004].score == 1
    shares = {x.lang: x.share for x in by[1000].languages}
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 0.53) < 0.12


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = corpus(120)
    spoiled = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else x, *rest) for i, t, x, *rest in rows]
    one, two = (sorted(map(str, lm.predict(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, spoiled))
    assert one == two


def test_more_languages_than_the_model_has_room_for(spark, monkeypatch):
    rows = corpus(120)
    monkeypatch.setattr(lm, "NUMBERS", lm.VALUES)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lm.learn(docs)
    assert model.shift == 2 and model.p.shape == (3, lm.VALUES // 4) and np.allclose(model.p.sum(axis=1), 1)
    lang = {r[0]: r[2] for r in rows[:120]}
    assert all(r.lang_pred == lang[r.doc_id] for r in lm.predict(docs).collect() if r.doc_id in lang)


def test_chunks_change_no_counts(monkeypatch):
    text = "Éab cd, " * 300
    whole = lm.trigrams(text)
    monkeypatch.setattr(lm, "_CHUNK", 7)
    assert (lm.trigrams(text) == whole).all()


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    kept = lm.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {1001, 1002, 1003}
    assert lm.predict(docs.limit(0)).count() == 0
    assert lm.keep_identified(docs.limit(0)).count() == 0


def test_mixture_and_set_as_brute_force():
    """Proportions against plain expectation-maximisation run to its end, and the set against all sets of languages by penalised likelihood."""
    r = np.random.default_rng(3)
    p = r.dirichlet(np.full(60, 0.3), 4)
    for true in ([1.0, 0, 0, 0], [0.6, 0.4, 0, 0], [0, 0.5, 0.2, 0.3], [0, 0, 0, 1.0]):
        n = r.multinomial(3000, np.array(true) @ p).astype(float)
        at = n > 0

        def fitted(some, n=n[at], q=p[:, at]):
            share = np.full(len(some), 1 / len(some))
            for _ in range(3000):
                share = share * (q[some] @ (n / (share @ q[some]))) / n.sum()
            return share, float(n @ np.log(share @ q[some]))

        share, like = lm._mixture(p[:, at], n[at], 3000)
        want, best = fitted(list(range(4)))
        assert np.abs(share - want).max() < 0.02 and abs(like - best) < 5.0
        sets = [list(c) for k in range(1, 5) for c in combinations(range(4), k)]
        chosen = max(sets, key=lambda c, n=n: fitted(c)[1] - lm.PENALTY * np.log(n.sum() + 1) * (len(c) - 1))
        assert chosen == [i for i, x in enumerate(true) if x]
        model = lm.Model(list("abcd"), np.pad(p, ((0, 0), (0, lm.VALUES - 60)), constant_values=1e-12))
        counts = np.pad(n.astype(np.int64), (0, lm.VALUES - 60))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm, "trigrams", lambda text, counts=counts: counts)
            assert sorted(lang for lang, _ in lm.infer(model, "x")) == sorted("abcd"[i] for i in chosen)
