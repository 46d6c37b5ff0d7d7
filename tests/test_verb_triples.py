"""Triples by verb forms: longest form, whole words, spans up to the next verb."""

import random
import re

from quorumlake.functions.vocabulary import predicate_forms
from quorumlake.operators import extract as X

FORMS = {"usa": "USE", "usa se": "USED", "localiza se em": "AT", "is": "BE", "played for": "FOR", "played": "PLAY", "e": "BE"}


def got(spark, texts, **how):
    rows = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id int, text string, subject string")
    return sorted(map(tuple, X.verb_triples(rows, **how).collect()))


def plain(texts, forms, reach):
    out, longest = [], max(f.count(" ") for f in forms) + 1
    for i, text in enumerate(texts):
        for c, clause in enumerate(re.split(r"[.;,:!?()\[\]\n\r]+", text or "")):
            w = re.findall(r"[^\W_]+", clause)
            low = [x.lower().translate(str.maketrans("éãç", "eac")) for x in w]
            verbs, k = [], 0
            while k < len(w):
                n = next((n for n in range(longest, 0, -1) if k + n <= len(w) and " ".join(low[k : k + n]) in forms), 0)
                if n:
                    verbs.append((k, n))
                k += n or 1
            for j, (k, n) in enumerate(verbs):
                since = sum(verbs[j - 1]) if j else 0
                until = verbs[j + 1][0] if j + 1 < len(verbs) else len(w)
                s, o = w[max(since, k - reach) : k], w[k + n : min(until, k + n + reach)]
                if s and o:
                    out.append((i, c, j, " ".join(s), forms[" ".join(low[k : k + n])], " ".join(o)))
    return sorted(out)


def test_examples(spark):
    texts = ["A Rede usa dados; o clube localiza-se em São Paulo", "Pelé played for Santos, and played well", "This is. usa x", "Ele usa-se aqui é bom", None, ""]
    want = [(0, 0, 0, "A Rede", "USE", "dados"), (0, 1, 0, "o clube", "AT", "São Paulo"), (1, 0, 0, "Pelé", "FOR", "Santos"), (1, 1, 0, "and", "PLAY", "well"), (3, 0, 0, "Ele", "USED", "aqui"), (3, 0, 1, "aqui", "BE", "bom")]
    assert got(spark, texts, forms=FORMS) == want == plain(texts, FORMS, 6)


def test_as_a_plain_scan(spark):
    r = random.Random(3)
    forms = predicate_forms()
    words = [w for f in forms for w in f.split()] + ["Ação", "é", "x1", "foo_bar", "O"] * 30
    texts = ["".join(r.choice(words) + r.choice([" "] * 8 + ["-", ", ", ".\n", " (", "  "]) for _ in range(60)) for _ in range(60)] + ["long word " * 3000]
    assert got(spark, texts, reach=3) == plain(texts, forms, 3)
    assert len(plain(texts, forms, 3)) > 200


def test_the_pattern_takes_the_longest(spark):
    pattern = X.trie_pattern(list(predicate_forms()))
    assert all(re.fullmatch(pattern, f.replace(" ", "  ")) for f in predicate_forms())
    assert not re.fullmatch(pattern, "us") and not re.fullmatch(pattern, "usaram")
