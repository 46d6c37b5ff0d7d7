import numpy as np
import pytest

from quorumlake.llm import vector_dedup as vd
from quorumlake.llm.shared import cut

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, gid int, n int, leader string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, 3, "y") for i, v in rows], SCHEMA)


def brute(rows, least=0.9):
    rows = list({(i, None if v is None else tuple(v)): (i, v) for i, v in rows}.values())
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and bool(np.any(v)) for _, v in rows]
    u = [np.float32(v).astype(float) if good else None for good, (_, v) in zip(ok, rows, strict=True)]
    u = [None if x is None else x / np.linalg.norm(x) for x in u]
    links = {a: {b for b in range(len(rows)) if b != a and u[a] is not None and u[b] is not None and u[a] @ u[b] >= least} for a in range(len(rows))}
    out, done = [], {}
    for a in range(len(rows)):
        if a not in done:
            group, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()] - group:
                    group.add(b)
                    todo.append(b)
            done |= dict.fromkeys(group, min((rows[b][0] for b in group if rows[b][0] is not None), default=None))
        out.append((rows[a][0], len(links[a]), done[a], rows[a][0] == done[a]))
    return sorted(out, key=str)


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def groups(seed, n=1500, d=24):
    """Lone vectors, tight and loose groups, and a chain of vectors."""
    r = np.random.default_rng(seed)
    x = [r.normal(size=d) for _ in range(n)]
    for size, noise in ((150, 0.05), (60, 0.2), (80, 0.35), (30, 0.45)):
        centre = r.normal(size=d)
        x += [(centre / np.linalg.norm(centre) + noise * r.normal(size=d) / np.sqrt(d)) * r.uniform(0.5, 3) for _ in range(size)]
    a, b = np.linalg.qr(r.normal(size=(d, 2)))[0].T
    x += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.3)]
    x = np.float32(x)
    return [(int(i), x[k].tolist()) for k, i in enumerate(r.permutation(len(x)))]


def clear(rows, least=0.9):
    """rows without those that have a cosine as near to the threshold as rounding matters."""
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return [x for x, c in zip(rows, u @ u.T, strict=True) if np.abs(c - least).min() > 1e-9]


def test_as_brute_force(spark):
    rows = clear(groups(1))
    want = brute(rows)
    assert sum(r[1] for r in want) > 20_000
    assert shown(vd.near_duplicates(table(spark, rows))) == want


@pytest.mark.parametrize("copies", [1, 2])
def test_many_shards_blocks_and_packs(spark, monkeypatch, copies):
    monkeypatch.setattr(vd, "SHARD", 60)
    monkeypatch.setattr(vd, "BLOCK", 40)
    monkeypatch.setattr(vd, "PACK", 7)
    monkeypatch.setattr(vd, "COPIES", copies)
    monkeypatch.setattr(vd, "RECALL", 0.999)
    rows = clear(groups(2, 700))
    want, got = brute(rows), shown(vd.near_duplicates(table(spark, rows)))
    assert [r[0] for r in got] == [r[0] for r in want]
    there = sum(r[1] for r in want)
    assert there >= sum(r[1] for r in got) >= 0.99 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_odd_rows(spark):
    rows = [(1, [1, 0, 0]), (2, [2, 0.1, 0]), (2, [2, 0.1, 0]), (3, [1, 0, 0]), (3, [0, 1, 0]), (4, [0, 3, 0]), (5, None), (6, []), (7, [0, 0, 0]), (8, [1, None, 0]), (9, [float("nan"), 1, 0])]
    rows += [(10, [float("inf"), 1, 0]), (None, [0, 0, 1]), (None, [5, 0, 0]), (None, None), (12, [-1, 0, 0])]
    assert shown(vd.near_duplicates(table(spark, rows))) == brute(rows)
    assert shown(vd.near_duplicates(table(spark, [(5, None), (7, [0, 0])]))) == brute([(5, None), (7, [0, 0])])
    (row,) = [r for r in vd.near_duplicates(table(spark, [*rows, (13, [1, 0])])).collect() if r.vec_id == 13]
    assert (row.n_links, row.component_id, row.kept) == (0, 13, True)


def test_equal_vectors_and_empty(spark):
    rows = [(i, [1, 2, 3]) for i in range(50, 90)] + [(7, [2, 4, 6])]
    assert shown(vd.near_duplicates(table(spark, rows))) == brute(rows)
    assert vd.near_duplicates(table(spark, [])).count() == 0


def test_double_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.1e-200]), (3, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert shown(vd.near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_audit_counts_links(spark):
    rows = groups(3, 300)
    u = vd._unit(np.array([v for _, v in rows]))
    nodes = cut(spark.createDataFrame([(i, np.float32(v).tobytes(), 1) for i, v in rows], "gid bigint, v binary, n bigint"))
    true = (u @ u.T >= 0.9).sum(1) - 1
    linked = spark.createDataFrame([(i, int(n)) for (i, _), n in zip(rows, true, strict=True)], "gid bigint, links bigint")
    assert vd.audited(nodes, linked, "f4", 0.9) == 1.0
    half = spark.createDataFrame([(i, int(n // 2)) for (i, _), n in zip(rows, true, strict=True)], "gid bigint, links bigint")
    assert 0.4 < vd.audited(nodes, half, "f4", 0.9) < 0.51


def test_graph_leads_everywhere(spark):
    r = np.random.default_rng(4)
    u = vd._unit(r.normal(size=(800, 16)))
    lists = vd.pruned_graph(u)
    assert max(map(len, lists)) <= 2 * vd.DEGREE + 1
    medoid = np.full((len(u), 1), int(np.argmax(u @ u.sum(axis=0))))
    row, to = vd.range_search(u, lists, u, medoid, np.full(len(u), 0.7))
    found, there = set(zip(row.tolist(), to.tolist(), strict=True)), set(map(tuple, np.argwhere(u @ u.T >= 0.7).tolist()))
    assert found <= there and len(found) >= 0.98 * len(there)
