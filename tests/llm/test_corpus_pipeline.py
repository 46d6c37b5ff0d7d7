import random

import corpus_pipeline as cp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"aa": ["kato", "rimu", "toka", "muri", "kari"], "bb": ["échou", "quelle", "ouque", "lléch"]}


def corpus():
    r = random.Random(7)

    def write(lang, n):
        return " ".join("".join(r.choices(WORDS[lang], k=r.randrange(1, 3))) + r.choice("aeiouxyz") for _ in range(n))

    rows = [[i, "\n".join(write(lang, 40) for _ in range(3)), lang, r.choice(["s0", "s0", "s1", None])] for i, lang in enumerate(r.choices(["aa", "bb"], k=90))]
    items = [(0, write("aa", 40)), (1, write("bb", 20))]
    for i in range(12):
        rows[i][1] += "\nShared line of many documents"
    rows.append([200, rows[20][1], "aa", "s1"])
    rows.append([201, rows[20][1].replace("\n", "\n\n"), "aa", "s1"])
    rows.append([202, write("aa", 30) + "\n" + items[0][1] + "\n" + write("aa", 9), "aa", "s1"])
    rows += [[203, None, "aa", "s0"], [204, "12 34 !!", "aa", "s0"], [205, "", None, None]]
    return [(*x, len(x[1]) if x[1] is not None else None) for x in rows], items


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != "source_mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    everyone = {r[0] for r in rows}
    assert ids["language_id"] == everyone - {203, 204, 205} == ids["line_dedup"]
    texts = {r.doc_id: r for r in seen["line_dedup"]}
    assert "Shared line" in texts[0].text and not any("Shared line" in texts[i].text for i in range(1, 12))
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert ids["near_dedup"] == ids["line_dedup"] - {200, 201}
    assert ids["decontamination"] == ids["near_dedup"] - {202}
    assert ids["source_mix"] <= ids["decontamination"] and all(0 < r.taken <= 3 * r.size for r in seen["source_mix"])
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen["source_mix"]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    rows, items = corpus()
    rows = [(*x, "own lines", "own dropped", "own size", "own taken", "own row") for x in rows]
    rows += [(None, *rows[30][1:]), (None, *rows[31][1:]), rows[32], (33, *rows[34][1:])]
    names = f"{SCHEMA}, lines string, dropped string, size string, taken string, row string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in names.split(", ")], name
        assert {(r.lines, r.dropped, r.row) for r in docs.select("lines", "dropped", "row").distinct().collect()} == {("own lines", "own dropped", "own row")}
    out = cp.run(spark, str(tmp_path))
    assert sorted(out.columns) == sorted({*docs.columns, "size", "source_size", "target", "taken"})
    out.write.parquet(str(tmp_path / "out"))
    assert {r.row for r in out.select("row").distinct().collect()} == {"own row"}


def test_near_duplicates_go_by_fingerprint_first(spark, monkeypatch):
    monkeypatch.setattr(cp.simhash, "one_of_each", lambda docs: docs.filter("doc_id <> 1"))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id bigint, text string")
    assert [r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()] == [2]
