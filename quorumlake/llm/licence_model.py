"""Licence scans by a trained paragraph classifier, in DataFrame and Spark ML functions alone.

Multinomial logistic regression over sparse word 1- and 2-grams tells licence families from prose, from licences of no known
family and from one another. It is trained on notices of each family, whole and clipped, on notices of other licences
(the unknown class) and on prose, some of which uses the words of licences. Two levels are calibrated on rows held out from training: what
probability makes a paragraph a licence, and what share of it a family. A family stands only if one of its templates, with the
words that tell it from other families, is found in the paragraph; any other licence is `unknown`.

Lines are scored first. Those that look at all like a licence and confirm no template are put together with their neighbours, as
notices are often wrapped, and judged again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Sentences of public licence notices, by family.
TEMPLATES = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "all-rights-reserved": ["All rights reserved.", "Copyright the authors. All rights reserved. No part of this work may be reproduced without permission."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the authors have dedicated all copyright and related rights to the public domain under CC0 1.0 Universal."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Sentences of licences that have no family here, for the unknown class.
OTHERS = [
    "Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Artistic License 2.0.", "Licensed under the European Union Public Licence, version 1.2.",
    "This font software is licensed under the SIL Open Font License, version 1.1.", "Licensed under the Common Development and Distribution License, version 1.0.", "Released under the Do What The Fuck You Want To Public License, version 2.",
    "This software is provided as-is, without any express or implied warranty, under the zlib license", "Licensed under the Microsoft Public License.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.",
    "Licensed under the Business Source License, version 1.1.", "Licensed under the Server Side Public License, version 1.", "Use of this software is subject to the end user license agreement.", "Licensed under the terms of our own license, see our site.",
    "Released under the Python Software Foundation License.", "This data is made available under the Open Database License.", "Licensed under the Educational Community License, version 2.0.", "Released under the Foo License.",
]
#: Prose that uses the words of licences and is none.
PROSE_LIKE = [
    "The senator said all rights reserved for women were hard won by the public", "She had to renew her driving license before the end of the year", "The restaurant lost its license to sell beer and wine",
    "He asked the owner for permission to cross the field", "The public library was free of charge to any person of the town", "The source of the river is in the hills, and the use of its water is permitted to all",
    "Copyright law was the subject of the course that she taught", "They released the second version of the film under another name", "The terms of the peace were published by the foundation of the old king",
    "The table was reserved for the guests of the general", "All seats are reserved for members and their guests", "The software was distributed to all schools of the country without warranty", "The work of the authors was granted a prize by the public",
    "A license to fish is required by anyone who is above sixteen", "The domain of the duke was open to the public", "The minister reserved the right to use all means", "The library is free software's best known home, said the speaker", "We permit the use of any source if it is attributed",
    "Permission was granted to build a house with or without a garden", "The academic license of the teacher was granted by the state in that year",
]
#: Paragraphs of documents that the classifier is trained on, at most, from so many documents of least hash; hashed n-grams.
PROSE, PROSE_DOCS, VALUES = 4_000, 400, 1 << 13
#: Of a template's words, and of its neighbouring pairs, those that a paragraph has at least; of the words that few families use.
CONFIRM, NAMED = 0.7, 0.8
#: Probability of a licence from which a line is judged again with its neighbours, and how many lines these reach.
SUSPECT, REACH = 0.2, 4
#: Precision that the calibrated levels reach on rows held out, and where they lie.
PRECISION, LEVELS = 0.99, tuple(round(0.3 + 0.05 * i, 2) for i in range(13))
#: Rows that are broadcast at most. Beyond, documents are shuffled.
BROADCAST = 500_000
NONE, UNKNOWN = "none", "unknown"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda w: w != "")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, text, words): the lines that hold words, numbered from 0 among all lines."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "text"))
    return rows.withColumn("words", words(F.col("text"))).filter(F.size("words") > 0)


def _featured(rows: DataFrame) -> DataFrame:
    rows = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    rows = rows.withColumn("grams", F.concat("words", "pairs"))
    return HashingTF(numFeatures=VALUES, binary=True, inputCol="grams", outputCol="features").transform(rows).drop("grams")


def _pairs(x: Column) -> Column:
    """Neighbouring words; without the last word, which has none after it."""
    return F.slice(F.zip_with(x, F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)), 1, F.greatest(F.size(x) - 1, F.lit(0)))


def templates(spark: SparkSession) -> DataFrame:
    """(family, template, t_words, t_pairs, names, own): names are the words that at most four families use, own the pairs of this family alone."""
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string").withColumn("t_words", words(F.col("template"))).withColumn("t_pairs", _pairs(F.col("t_words")))

    def used(column: str, most: int) -> DataFrame:
        each = rows.select("family", F.explode(column).alias("x")).distinct().groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
        return each.agg(F.collect_set("x").alias(f"few_{column}"))

    rows = rows.crossJoin(F.broadcast(used("t_words", 4))).crossJoin(F.broadcast(used("t_pairs", 1)))  # one row each
    return rows.select("family", "template", "t_words", "t_pairs", F.array_intersect("t_words", "few_t_words").alias("names"), F.array_intersect("t_pairs", "few_t_pairs").alias("own"))


def _confirmed(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """rows (text, words, predicted: families) with best: (found, family, template) of the template of a predicted family that fits best, null if none does.

    It needs CONFIRM of its words and pairs, NAMED of the words that few families use, half of the pairs that only its family has, and no
    less than any template of another family. Templates of four or fewer words, which prose may hold by chance, must make up half of
    their sentence or stand by a copyright sign. Ties go to the first family, then template.
    """
    told = notices.agg(F.collect_list(F.struct("family", "template", "t_words", "t_pairs", "names", "own")).alias("notices"))
    rows = rows.crossJoin(F.broadcast(told)).withColumn("pairs", _pairs(F.col("words")))  # one row of fixed size

    def have(x: Column, column: str) -> Column:
        return F.size(F.array_intersect(x, F.col(column)))

    def alone(t: Column) -> Column:
        parts = F.split(F.col("text"), r"[.!?;\n]+(?=\s|$)")
        return F.exists(parts, lambda s: (F.size(F.array_except(t["t_words"], words(s))) == 0) & ((F.size(words(s)) <= 2 * F.size(t["t_words"])) | s.rlike(r"(?i)copyright|\(c\)|\x{a9}")))

    def share(t: Column) -> Column:
        found = (have(t["t_words"], "words") / F.size(F.array_distinct(t["t_words"])) + have(t["t_pairs"], "pairs") / F.greatest(F.size(F.array_distinct(t["t_pairs"])), F.lit(1))) / 2
        named = (have(t["names"], "words") >= NAMED * F.size(t["names"])) & (2 * have(t["own"], "pairs") >= F.size(t["own"]))
        return F.struct((-found).alias("less"), t["family"].alias("family"), t["template"].alias("template"), (named & (found >= CONFIRM)).alias("fits"), t["t_words"].alias("t_words"))

    top = F.array_min(F.transform("notices", share))
    rows = rows.withColumn("best", top).drop("notices", "pairs")
    fits = F.col("best.fits") & F.array_contains("predicted", F.col("best.family")) & ((F.size("best.t_words") > 4) | alone(F.col("best")))
    return rows.withColumn("best", F.when(fits, F.struct((-F.col("best.less")).alias("found"), "best.family", "best.template")))


@dataclass
class Model:
    """families: none, unknown, then the known ones; level: probability of a licence; known: share of that of one family."""

    families: list[str]
    regression: LogisticRegressionModel
    level: float
    known: float


def calibrated(held: list[tuple[float, bool]]) -> float:
    """The least level of LEVELS at and above which PRECISION of (score, right) is right; the last if none is."""
    for level in LEVELS:
        over = [right for score, right in held if score >= level]
        if over and sum(over) >= PRECISION * len(over):
            return level
    return LEVELS[-1]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Notices whole, without their first or last words, and between words of prose, of each family and of OTHERS, against PROSE_LIKE and at most
    PROSE sampled paragraphs of docs that confirm no template. A fourth of all rows is held out and calibrates the levels."""
    spark = docs.sparkSession
    families = [NONE, UNKNOWN, *sorted(TEMPLATES)]
    key = F.xxhash64(F.col(id_col).cast("string"))
    last = docs.select(key.alias("h")).orderBy("h").limit(PROSE_DOCS).agg(F.max("h")).first()[0]
    prose = paragraphs(docs.filter(key <= F.lit(last)), id_col, text_col).withColumn("h", F.xxhash64("text"))
    prose = prose.select("text", "words", "h").orderBy("h").limit(PROSE).withColumn("predicted", F.array(*[F.lit(f) for f in families]))
    prose = cut(_confirmed(prose, templates(spark)).filter("best is null").select(F.lit(0.0).alias("label"), F.slice("words", 1, 200).alias("words")))
    others = spark.createDataFrame([(1.0, t) for t in OTHERS] + [(0.0, t) for t in PROSE_LIKE], "label double, template string").select("label", words(F.col("template")).alias("t_words"))
    notices = templates(spark).select((F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1).cast("double").alias("label"), "t_words").union(others)
    n = F.size("t_words")
    some = [F.array(*[F.lit(w) for w in r.some]) for r in prose.select(F.slice("words", 1, 12).alias("some")).orderBy(F.xxhash64("some"), "some").limit(8).collect()]
    cuts = [F.col("t_words"), F.slice("t_words", 1, F.greatest(n - 2, F.lit(3))), F.slice("t_words", F.when(n > 5, 3).otherwise(1), n)]
    head = F.array(F.lit("copyright"), F.lit("2020"))
    around = [x for w in some for x in (F.concat(w, F.col("t_words")), F.concat(F.col("t_words"), w))]
    # a copyright line before prose is still no licence, so it goes before notices and before PROSE_LIKE alike
    rows = notices.select("label", F.explode(F.array(*cuts, F.concat(head, F.col("t_words")), *around)).alias("words")).union(prose)
    rows = cut(_featured(rows).select("label", "features", F.xxhash64("words").alias("h")).repartition(2, "h"))
    held_out = F.pmod(F.col("h"), F.lit(4)) == 0
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, standardization=False).fit(rows.filter(~held_out))
    held = [(r.label, r.p) for r in fitted.transform(rows.filter(held_out)).select("label", vector_to_array("probability").alias("p")).collect()]
    level = calibrated([(1 - p[0], label > 0) for label, p in held])
    known = calibrated([(max(p[2:]) / (1 - p[0]), p.index(max(p[2:])) == label) for label, p in held if 1 - p[0] >= level])
    return Model(families, fitted, level, known)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    return model.regression.transform(_featured(rows).drop("pairs")).withColumn("p", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction", "features")


def _predicted(model: Model) -> Column:
    """The families that hold their share of the probability of a licence, or come next to it by a tenth."""
    names = F.array(*[F.lit(f) for f in model.families])
    least = F.least(F.lit(model.known), F.lit(0.1)) * (1 - F.col("p")[0])
    return F.transform(F.filter(F.arrays_zip(names.alias("f"), F.col("p").alias("q")), lambda x: x["q"] >= least), lambda x: x["f"])


def _islands(seeds: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, paragraph, times, wide, narrow): neighbouring seeds (doc_id, tid, paragraph, times) put together with the lines between
    them (narrow), and also with up to REACH lines before and after that no blank line parts from them (wide)."""
    by_doc = Window.partitionBy("doc_id", "tid").orderBy("paragraph")
    fresh = F.coalesce(F.col("paragraph") - F.lag("paragraph").over(by_doc) > 2, F.lit(True)).cast("int")
    seeds = seeds.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by_doc))
    spans = seeds.groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t"), "island").agg(F.min("paragraph").alias("lo"), F.max("paragraph").alias("hi"), F.max("times").alias("times"))
    spans = cut(spans)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    found = texts.join(F.broadcast(spans) if spans.count() <= BROADCAST else spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")))
    found = found.dropDuplicates(["doc_id", "tid", "island"]).withColumn("lines", F.split("text", "\n"))
    before = F.slice("lines", F.greatest(F.col("lo") - REACH, F.lit(0)) + 1, F.least(F.col("lo"), F.lit(REACH)))
    after = F.slice("lines", F.col("hi") + 2, F.lit(REACH))
    blanks = F.filter(F.transform(before, lambda x, i: F.when(F.trim(x) == "", i + 1)), lambda x: x.isNotNull())
    skipped = F.coalesce(F.array_max(blanks), F.lit(0))
    stop = F.array_position(F.transform(after, lambda x: F.trim(x) == ""), True).cast("int")
    inner = F.slice("lines", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)
    wide = F.concat(F.slice(before, skipped + 1, F.greatest(F.size(before) - skipped, F.lit(0))), inner, F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after))
    return found.select("doc_id", F.col("lo").alias("paragraph"), "times", F.array_join(wide, "\n").alias("wide"), F.array_join(inner, "\n").alias("narrow"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, template, found, text): the paragraphs that hold a licence, every one of every text.

    A paragraph is a line, or neighbouring lines where a notice is wrapped, and named by its first line. `family` is the one confirmed, or
    unknown; `template` the notice that confirms it (null for unknown), `found` the share of it that the paragraph has. Null and blank texts have
    no paragraphs; repeated rows give repeated findings; an empty table gives no rows. Ties between families: the first by name.
    Other columns aren't read.
    """
    schema = "doc_id bigint, paragraph int, family string, probability double, template string, found double, text string"
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], schema)
    model = train(docs, id_col, text_col)
    notices = templates(spark)
    lines = docs.withColumn("__tid", F.xxhash64(F.col(text_col).cast("string"))).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("__tid").alias("tid"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "text"))
    lines = lines.withColumn("words", words(F.col("text"))).filter(F.size("words") > 0)
    near = cut(_scored(lines, model).filter(1 - F.col("p")[0] >= SUSPECT).withColumn("predicted", _predicted(model)))
    judged = cut(_confirmed(near, notices).withColumn("probability", 1 - F.col("p")[0]))
    sure = judged.filter(F.col("best").isNotNull() & (F.col("probability") >= model.level))
    seeds = judged.filter(F.col("best").isNull() | (F.col("probability") < model.level))
    single = seeds.groupBy("doc_id", "tid", "paragraph").agg(F.count("*").alias("times"), F.max("probability").alias("own"))
    islands = _islands(single, docs, id_col, text_col)
    both = islands.select("doc_id", "paragraph", "times", "wide", F.explode(F.array_distinct(F.array("wide", "narrow"))).alias("piece")).withColumn("words", words(F.col("piece")))
    both = _scored(both, model)
    each = [F.max(F.col("p")[i]).alias(f"p{i}") for i in range(1, len(model.families))]
    whole = both.groupBy("doc_id", "paragraph", "times", F.col("wide").alias("text")).agg(F.min(F.col("p")[0]).alias("p0"), *each)
    whole = whole.select("doc_id", "paragraph", "times", "text", words(F.col("text")).alias("words"), F.array(*[F.col(f"p{i}") for i in range(len(model.families))]).alias("p"))
    likely = single.groupBy(F.col("doc_id").alias("d"), F.col("paragraph").alias("q")).agg(F.max("own").alias("own"))
    whole = whole.join(likely, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("paragraph") == F.col("q")), "left").withColumn("probability", F.greatest(1 - F.col("p")[0], F.coalesce("own", F.lit(0.0))))
    whole = _confirmed(whole.filter(F.col("probability") >= model.level).withColumn("predicted", _predicted(model)), notices)
    columns = ["doc_id", F.col("paragraph").cast("int").alias("paragraph"), F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), "probability", F.col("best.template").alias("template"), F.col("best.found").alias("found"), "text"]
    wrapped = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*columns)
    return sure.select(*columns).unionByName(wrapped)
