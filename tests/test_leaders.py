"""Leaders in rounds are those of one pass over the names in order."""

import random

import numpy as np

from quorumlake.operators import vectors as V


def one_pass(rows, threshold):
    first, leaders, out = {}, {}, {}
    for block, seq, name, v in sorted(rows, key=lambda x: x[1]):
        first.setdefault((block, name), (seq, v))
    for (block, name), (_, v) in sorted(first.items(), key=lambda x: x[1][0]):
        x = np.array(v, float)
        x = x / max(np.linalg.norm(x), 1e-12)
        best, score = None, -1.0
        for other, y in leaders.get(block, []):
            s = round(float(x @ y), 9)
            if s > score:
                best, score = other, s
        if best is not None and score >= threshold - 1e-9:
            out[block, name] = best
        else:
            out[block, name] = name
            leaders.setdefault(block, []).append((name, x))
    return sorted((b, s, n, out[b, n]) for b, s, n, _ in rows)


def names(seed, n):
    r = random.Random(seed)
    g = np.random.default_rng(seed)
    centres = g.normal(size=(8, 6))
    vectors = {f"n{i}": (centres[r.randrange(8)] + 0.45 * g.normal(size=6)).round(3).tolist() for i in range(n)}
    vectors |= {"zero": [0.0] * 6, "zero2": [0.0] * 6, "axis": [1.0, *[0.0] * 5], "four": [4.0, 3.0, *[0.0] * 4]}
    seqs = r.sample(range(10_000), 2 * n)
    return [(r.choice(["a", "b"]) if i % 3 else "big", s, (k := r.choice(list(vectors))), vectors[k]) for i, s in enumerate(seqs)]


def test_as_one_pass(spark):
    rows = names(1, 120)
    df = spark.createDataFrame(rows, "block string, seq bigint, name string, v array<double>")
    want = one_pass(rows, 0.8)
    assert sum(1 for _, _, n, leader in want if n != leader) > 60
    assert sorted(map(tuple, V.resolve_entities(df).collect())) == want


def test_tiles_of_a_block(spark, monkeypatch):
    rows = [("x", *r[1:]) for r in names(2, 80)]
    df = spark.createDataFrame(rows, "block string, seq bigint, name string, v array<double>")
    small = V.similar_names
    monkeypatch.setattr(V, "similar_names", lambda names, threshold: small(names, threshold, 9))
    assert sorted(map(tuple, V.resolve_entities(df, 0.7).collect())) == one_pass(rows, 0.7)


def test_a_chain_and_odd_rows(spark):
    chain = [("c", i, f"w{i:02}", [float(np.cos(i * 0.5)), float(np.sin(i * 0.5))]) for i in range(12)]
    df = spark.createDataFrame([*chain, (None, 50, "q", [1.0, 0.0]), ("c", 51, None, [1.0, 0.0])], "block string, seq bigint, name string, v array<double>")
    got = V.resolve_entities(df, 0.8).collect()
    assert sorted((r.block, r.seq, r.name, r.leader) for r in got if r.block and r.name) == one_pass(chain, 0.8)
    assert {(r.seq, r.leader) for r in got if not r.block or not r.name} == {(50, "q"), (51, None)}
    assert V.resolve_entities(df.limit(0)).collect() == []
