import random
import re
from collections import defaultdict

from quorumlake.llm import source_mix as sm

SCHEMA = "doc_id bigint, text string, source string, size bigint, k string, slot int"


def water(sizes: dict, weights=(5, 2, 1), repeats=3):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > repeats * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
        free -= full
    return target


def corpus(seed=3, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "b", "Z", "é", "\U0001f600", "￮", None, "tiny"] if i > 5 else ["tiny"])
        rows.append((i, r.choice(["", " ", None]) if r.random() < 0.1 else " \n".join(["w"] * r.randrange(1, 400 if source != "tiny" else 3)), source, 7, None, 1))
    rows += [rows[0], rows[7], rows[7], (None, "x y", "a", 0, "", 0), (None, "x y", None, 0, "", 0), (9000, "long " * 60_000, "b", 0, "", 0), (9001, "", "blank", 0, "", 0)]
    return rows


def test_targets_words_and_reruns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sm.taken(*sm.mix(docs)).collect()
    again = sm.taken(*sm.mix(docs.repartition(3))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == len(rows)
    sizes, took = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = water(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - goal[s]) <= 1, (s, took[s], goal[s])


def test_schedule_follows_the_weights_everywhere(spark):
    per = spark.createDataFrame([("a", 500_000, 9, 500_000.0), ("b", 200_000, 9, 250_000.0), (None, 100, 9, 300.0)], "source string, source_size bigint, docs bigint, target double")
    rows = sorted(sm.schedule(per, 100).collect(), key=lambda r: r.slot)
    assert len({r.slot for r in rows}) == len(rows) == 5000 + 2500 + 3
    for s in ("a", "b", None):
        assert [r.k for r in rows if r.source == s] == list(range(sum(r.source == s for r in rows)))
    for i in range(0, 7000, 500):
        assert abs(sum(r.source == "a" for r in rows[i : i + 500]) - 500 * 5000 / 7503) < 6


def test_pieces_cover_each_words_run_in_order(spark):
    docs = spark.createDataFrame(corpus(5, 60), SCHEMA)
    pieces, sized = sm.mix(docs)
    per_slot = defaultdict(int)
    for p in pieces.collect():
        assert 0 <= p.first < p.first + p.words <= p.size
        per_slot[p.slot] += p.words
    block = sm.block_words(sm.targets(sm.sizes(docs)))
    assert max(per_slot.values()) <= block


def test_empty_table_and_blank_texts(spark):
    assert sm.taken(*sm.mix(spark.createDataFrame([], SCHEMA))).count() == 0
    out = sm.taken(*sm.mix(spark.createDataFrame([(1, None, None, 0, "", 0), (2, "", "a", 0, "", 0)], SCHEMA))).collect()
    assert [(r.taken, r.target, r.size) for r in out] == [(0, 0.0, 0)] * 2
