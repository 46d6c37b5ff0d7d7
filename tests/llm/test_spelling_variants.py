import random
import re
import zlib
from collections import Counter

from quorumlake.llm import spelling_variants as sv

SCHEMA = "doc_id bigint, text string, word string, n int, block string, form string"


def brute_words(rows, every=97, shortest=5, least=3):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, **how):
    words = brute_words(rows, **how)
    near = {w: [x for x in words if x != w and apart(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def shown(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdeé×ÿ"
    base = ["".join(r.choices(letters, k=r.choice([5, 5, 6, 6, 7, 9]))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * r.choice([3, 6, 12, 40])
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w))
            words += [r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])] * r.choice([3, 4, 7])
    r.shuffle(words)
    texts = [" ".join(w.upper() if r.random() < 0.1 else w for w in words[i : i + 20]) for i in range(0, len(words), 20)]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, "1 2 3 ---"), (None, "chain chains chains"), (504, "aaaab " * 5000), (505, "q" * 30_000 + "é"), (506, ("q" * 30_000 + " ") * 3)]
    return rows + [rows[0]] * 4


def test_as_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        assert sum(1 for w in want if w[4]) > 50
        assert shown(sv.variants(table(spark, rows))) == want


def test_many_packs_and_planted_edits(spark, monkeypatch):
    monkeypatch.setattr(sv, "PACK", 20)
    rows = corpus(3)[:-7]
    got = shown(sv.variants(table(spark, rows), every=3))
    assert got == brute(rows, every=3)


def test_one_edit(spark):
    assert [x.tolist() for x in sv.one_edit(["abcde", "bacde"], ["abcde", "abcdf", "abxde", "ébcde"])] == [[0, 0, 0], [1, 2, 3]]
    assert [x.tolist() for x in sv.one_edit(["abcde"], ["abcdee", "aabcde", "abcdxe", "bcdexa"])] == [[0, 0, 0], [0, 1, 2]]


def test_chain_of_forms(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("x", "w070")]
    got = {r.word: r.root for r in sv.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w070" for w, _ in forms}


def test_forms_tie_to_the_least_and_empty(spark):
    rows = [(1, " ".join(["haust"] * 3 + ["hausta"] * 8 + ["haast"] * 8))]
    words = {r.word: r for r in sv.variants(table(spark, rows), every=10**12).collect()}
    assert words["haust"].form == "haast" and words["haust"].n_near == 2
    assert sv.variants(table(spark, [])).collect() == []
