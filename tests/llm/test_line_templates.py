import random
from collections import defaultdict

from quorumlake.llm import line_templates as lt

SCHEMA = "doc_id bigint, text string, line string, leaf int, dropped string, doc int"


def brute(rows, least):
    """(text, dropped) of each row, by comparing all templates of a leaf."""
    split = lambda x: tuple(x.split())
    docs_of, weight = defaultdict(set), defaultdict(int)
    for i, t in rows:
        if i is not None:
            for m in {split(x) for x in (t or "").split("\n")} - {()}:
                docs_of[m].add(i)
                weight[m] += 1
    leaves = defaultdict(list)
    for m in weight:
        leaves[len(m), tuple("<*>" if any(c in "0123456789" for c in t) else t for t in m[:3])].append(m)
    keepers = defaultdict(set)
    for members in leaves.values():
        places = defaultdict(int)
        for m in members:
            for p, t in enumerate(m):
                places[p, t] += weight[m]
        shapes = defaultdict(list)
        for m in members:
            shape = tuple(t if places[p, t] >= least else None for p, t in enumerate(m))
            if sum(t is not None for t in shape) >= 0.7 * len(shape):
                shapes[shape].append(m)
        above = {s: [g for g in shapes if all(y is None or x == y for x, y in zip(s, g, strict=True))] for s in shapes}
        held = {g: [m for s, ms in shapes.items() if g in above[s] for m in ms] for g in shapes}
        again = {g for g, ms in held.items() if max(len(set().union(*[docs_of[m] for m in ms])), *[weight[m] for m in ms]) >= least}
        tops = {g for g in again if not any(h != g and h in again for h in above[g])}
        for g in tops:
            for m in held[g]:
                keepers[m].add(min(min(docs_of[x]) for x in held[g]))
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if i is None or split(x) not in keepers or i in keepers[split(x)]]
        out.append((str(i), t if t is None else "\n".join(kept), len((t or "").split("\n")) - len(kept)))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    names = [f"name{'abcdefghij'[i]}" for i in range(10)]
    rows = []
    for i in range(n):
        lines = [" ".join(r.choices(["ka", "to", "ri", "é", "mu", "so"], k=r.randrange(4, 12))) for _ in range(4)]
        if r.random() < 0.4:
            lines.insert(r.randrange(5), f"Seen {r.randrange(99)} times on  2024-01-0{r.randrange(1, 9)}")
        if r.random() < 0.5:
            lines.insert(r.randrange(5), f"Posted in the forum by {r.choice(names + ['alice'] * 25)} last week, all rights {r.choice(('reserved', 'reserved', 'kept', 'waived'))}")
        if r.random() < 0.05:
            lines.insert(0, "A rare line stays")
        rows.append((n - i, "\n".join(lines)))
    return rows + [(900, None), (901, ""), (902, "\n \n"), (903, "w " * 60_000 + "\nSeen 1 times on 2"), (904, "own\n" * 500), (None, rows[0][1]), rows[3], rows[3]]


def run(spark, rows, least=lt.DOCUMENTS):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)
    return docs, lt.drop_recurring(docs, least)


def test_as_brute_force(spark):
    for seed, least in ((1, 10), (2, 4)):
        rows = corpus(seed)
        docs, out = run(spark, rows, least)
        assert out.columns == [*docs.columns, "lines"]
        got = sorted(((str(r.doc_id), r.text, r.dropped) for r in out.collect()), key=str)
        assert got == brute(rows, least)
        assert sum(r[2] for r in got) > 60


def test_variable_words_make_one_template(spark):
    rows = [(i, f"Posted in the forum by {'abcdefghijklmnop'[i] * 3} last week") for i in range(12)] + [(50, "Posted in the forum of another kind, this one")]
    _, out = run(spark, rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == rows[0][1] and got[50] == rows[-1][1] and all(got[i] == "" for i in range(1, 12))


def test_rare_values_recur_with_a_frequent_one(spark):
    rows = [(i, f"Posted in the forum by {'alice' if i < 50 else 'abcdefghi'[i - 50] * 4} last week") for i in range(59)]
    got = {r.doc_id: r.text for r in run(spark, rows)[1].collect()}
    assert got[0] == rows[0][1] and not any(got[i] for i in range(1, 59))


def test_a_line_of_numbers_alone_stays_but_an_equal_one_goes(spark):
    rows = [(i, f"{i} {i * 7}\n1 2 3") for i in range(30)]
    got = {r.doc_id: r.text for r in run(spark, rows)[1].collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"{i} {i * 7}" for i in range(1, 30))


def test_other_columns_stay_without_counts(spark):
    docs = spark.createDataFrame([(i, "Shared line here", "own", 1, "y", 2) for i in range(12)], SCHEMA)
    out = lt.drop_recurring(docs, counts=False)
    assert out.columns == docs.columns and {(r.line, r.dropped) for r in out.collect()} == {("own", "y")}


def test_empty_table(spark):
    assert run(spark, [])[1].count() == 0
