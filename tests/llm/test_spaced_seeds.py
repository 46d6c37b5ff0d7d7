import random
import re

from quorumlake.llm import spaced_seeds as ss

DOCS, ITEMS = "doc_id bigint, text string, h string, seed int, rep int, item_id bigint", "item_id bigint, text string, doc_id bigint, n int"


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    """Every pair and every way to lay it, at places where a mask matches."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, t in items:
            x = words(t)
            if len(x) < ss.SPAN:
                at = next((a for a in range(len(w) - len(x) + 1) if w[a : a + len(x)] == x), None)
                if len(x) >= ss.SHORT and at is not None and ((d, i) not in out or at < out[d, i][2]):
                    out[d, i] = (len(x), len(x), at, 0)
                continue
            width, best = min(len(x), ss.STRETCH), None
            for lead in range(-len(x) + 1, len(w)):
                same = [j + lead < len(w) and j + lead >= 0 and w[j + lead] == x[j] for j in range(len(x))]
                inside = [j for j in range(len(x)) if 0 <= j + lead < len(w)]
                if not any(all(same[j + k] for k, b in enumerate(m) if b == "1") for m in ss.MASKS for j in range(len(x) - len(m) + 1)):
                    continue
                for a in range(inside[0], max(inside[-1] + 1 - width, inside[0]) + 1):
                    n = sum(same[a : a + width])
                    if n >= -(-width * 4 // 5) and (best is None or (-n, a + lead, a) < best):
                        best = (-n, a + lead, a)
            if best and ((d, i) not in out or best < (-out[d, i][0], *out[d, i][2:])):
                out[d, i] = (-best[0], width, best[1], best[2])
    return out


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "and"] * 5 + [f"wé{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice((3, 5, 7, 9, 15, 40))))) for i in range(25)]
    items += [(90, items[3][1].upper() + "."), (91, None), (92, ""), (None, items[3][1])]
    docs = []
    for d in range(120):
        parts = r.choices(vocab, k=r.randrange(60))
        if d % 2:
            t = words(r.choice(items[:25])[1])
            for _ in range(r.choice((0, 0, 1, 3, 8))):
                t[r.randrange(len(t))] = "changed"
            a = r.choice((0, 0, 5))
            parts[r.randrange(len(parts) + 1) : 0] = t[a:]
        docs.append((d, r.choice((" ", ", ", "\n")).join(parts)))
    return [*docs, (200, None), (201, ""), (202, "long " * 30_000 + items[4][1]), (None, items[3][1]), (None, 'of no item at all'), docs[1], docs[1], (1, 'the clean twin of an id'), (1, 'then ' + items[6][1])], items


def run(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    found = ss.overlaps(docs, items)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    return found.collect(), ss.decontaminate(docs, items)


def test_as_brute_force(spark):
    docs, items = corpus()
    got, clean = run(spark, docs, items)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.matched, r.compared, r.doc_word, r.item_word) for r in got} == want
    assert len(got) == len(want)
    rows = [(d, t) for d, t in docs if not brute([(d, t)], items)]
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(map(str, rows))
    assert (None, "of no item at all") in rows and (1, "the clean twin of an id") in rows


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs, items = corpus(2)
    monkeypatch.setattr(ss, "BROADCAST", 0)
    got, clean = run(spark, docs, items)
    assert {(r.doc_id, r.item_id): (r.matched, r.compared, r.doc_word, r.item_word) for r in got} == brute(docs, items)
    assert clean.count() == sum(not brute([x], items) for x in docs)


def test_empty_tables(spark):
    docs, items = corpus()
    assert run(spark, [], items)[0] == []
    assert run(spark, docs[:5], [])[0] == []
