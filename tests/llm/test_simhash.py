import random
from itertools import combinations

import xxhash

from quorumlake.llm import simhash
from quorumlake.llm.shared import components

SCHEMA = "doc_id bigint, text string, fp string, component_id string, mask int"


def brute(texts: dict[int, str | None], words: int = 3) -> dict[int, tuple[int, int]]:
    def fp(text):
        w = (text or "").encode().lower().split()
        grams = [] if not w else [b" ".join(w)] if len(w) < words else [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {k: fp(v) for k, v in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (fps[k], find(k)) for k in texts}


def corpus(seed: int = 1) -> dict[int, str | None]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one", 5: "One two", 6: "one\x0btwo", 7: "É é", 8: "long " * 70_000}
    for i in range(10, 60):
        texts[i] = " ".join(r.choices(vocab, k=r.choice((40, 300))))
    for i in range(60, 220):
        w = str(texts[r.randrange(10, 16)]).split()
        w[r.randrange(len(w))] = r.choice(vocab)
        texts[i] = "  ".join(w)
    return texts


def check(spark, texts):
    docs = spark.createDataFrame([(k, v, "x", "y", 1) for k, v in texts.items()], SCHEMA)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_as_brute_force(spark):
    check(spark, corpus())


def test_crowded_blocks_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 2)
    check(spark, corpus(2))


def test_one_of_each_keeps_columns_repeats_and_nulls(spark):
    rows = [(1, "a b c d", "p", None, 1), (2, "a b c d", "q", None, 2), (2, "a b c d", "q", None, 2), (None, "z z z", "r", None, 3), (None, "z z z", "r", None, 3), (5, None, None, None, None), (6, "", "s", None, 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, "r"), (1, "p"), (5, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 700)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(chain + hub, "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 700)}
