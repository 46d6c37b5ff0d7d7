import math

import numpy as np
import pytest

from quorumlake.llm import posting_ann as pa

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, gid int, list int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    ok = sorted((i, np.float32(v).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v))
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted((-float(np.dot(x, y)), i) for i, y in ok if i != q)[:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert len(mine) == len(best)
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        total += len(best)
        hits += len({i for i, _ in mine} & {i for _, i in best})
    return hits / total


@pytest.mark.parametrize("shape", ["random", "clusters", "norms"])
def test_recall(spark, shape):
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 32))
    if shape == "clusters":
        x = 0.3 * x + 3 * r.normal(size=(40, 32))[r.integers(0, 40, 6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if shape == "norms":
        x *= r.uniform(0.5, 2, size=(6000, 1))
    rows = list(enumerate(x.astype(np.float32)))
    assert recall(pa.neighbours(table(spark, rows)).collect(), brute(rows)) >= 0.9


def test_small_table_is_exact_with_ties_copies_and_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-2, 3, 4).astype(float) + 0.1) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5, 0.25, 0.0]) for i in range(90)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 4), (2060, [1.0, None, 0, 0]), (2080, [float("nan"), 1, 1, 1]), (2100, [float("inf"), 1, 1, 1]), (2120, [1.0, 2.0]), (None, [1.0] * 4)]
    rows.append(rows[3])
    got = pa.neighbours(table(spark, rows)).collect()
    want = brute([x for x in dict(rows).items() if x[0] != 2120])
    assert {r.query_id for r in got} == set(want)
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for i, _, _ in mine] == list(range(1, len(best) + 1))
        assert np.allclose([s for _, _, s in mine], [-s for s, _ in best], atol=1e-12)
        groups = {}
        for s, i in best:
            groups.setdefault(round(-s, 9), []).append(i)
        for s, ids in list(groups.items())[:-1]:
            assert sorted(ids) == sorted(i for _, i, t in mine if round(t, 9) == s)


def test_fewer_than_k_and_empty(spark):
    got = pa.neighbours(table(spark, [(0, [1, 0]), (1, [0, 1]), (20, [1, 1])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert pa.neighbours(table(spark, [])).count() == 0


def test_double_vectors_keep_their_precision(spark):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 8)) * 10.0 ** r.integers(-3, 4, (300, 1)))] + [(400, [1e39, *[0.0] * 6, 1.0])]
    docs = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<double>")
    x = dict(rows)
    got = pa.neighbours(docs, k=5).collect()
    want = {q: sorted((-math.fsum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x if i != q)[:5] for q in x if q % 20 == 0}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == {(q, k + 1): (i, -s) for q, best in want.items() for k, (s, i) in enumerate(best)}
