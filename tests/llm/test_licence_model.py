import random
import re
from itertools import pairwise

import numpy as np

from quorumlake.llm import licence_model as lm

SCHEMA = "doc_id bigint, text string, words int, family string, label string, features string"


def corpus():
    r = random.Random(1)
    vocab = ["the", "of", "and", "under", "to", "work", "is", "a", "terms", "free", "software", "version"] + [f"w{i}" for i in range(300)]
    rows = [(i, "\n".join(" ".join(r.choices(vocab, k=r.randrange(1, 60))) + "." for _ in range(4)), 1, "x", "y", "z") for i in range(200)]
    planted = {
        300: ("mit", "Released under the MIT License."),
        301: ("apache-2.0", "licensed under the APACHE License, version 2.0"),
        302: ("gpl-3.0", "Copyright 2024 Some One. This work is licensed under the GNU General Public License, version 3."),
        303: ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
        304: ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
        305: ("all-rights-reserved", "All rights reserved."),
        306: ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        307: ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    }
    rows += [(i, rows[i - 300][1] + "\n\n" + t + "\n" + rows[i - 200][1], 1, "x", "y", "z") for i, (_, t) in planted.items()]
    rows += [(400, None, 1, None, "", ""), (401, "", 1, "", "", ""), (402, "long " * 50_000 + "\n" + planted[300][1], 1, "", "", ""), (None, planted[304][1], 1, "", "", "")]
    rows += [(500, "Licensed under the Foo Bar Weird License, see our site.", 1, "", "", ""), rows[200], rows[200]]
    return rows, planted


def test_families_and_unknown(spark):
    rows, planted = corpus()
    found = lm.scan(spark.createDataFrame(rows, SCHEMA))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = sorted((str(r.doc_id), r.family) for r in found.collect())
    want = [(str(i), f) for i, (f, _) in planted.items()] + [("402", "mit"), ("None", "cc-by-nc"), ("300", "mit"), ("300", "mit")]
    assert [x for x in got if x[0] != "500"] == sorted(want)
    assert [f for i, f in got if i == "500"] == ["unknown"]


def test_empty_table(spark):
    assert lm.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lm.scan(spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA)).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software), to deal in the Software\nwithout restriction."


def test_wrapped_notices_other_licences_and_prose(spark):
    rows, _ = corpus()
    hard = {
        600: (MIT, ["mit"]),
        601: ("A title\n\nThis work is licensed under the GNU General\nPublic License, version 3.\n\nThe end of it.", ["gpl-3.0"]),
        602: ("Licensed under the Eclipse Public License, version 2.0.", ["unknown"]),
        603: ("The senator said all rights reserved for women were hard won by the public", []),
        604: ("Licensed under CC BY-ND 4.0.", ["unknown"]),
        605: ("Copyright 2021 The Authors, all rights reserved", ["all-rights-reserved"]),
        606: ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["agpl-3.0"]),
        607: ("He got a license to drive, and the public gave its permission to use the old road free of charge.", []),
    }
    rows += [(i, t, 1, "", "", "") for i, (t, _) in hard.items()]
    got = {}
    for r in lm.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r.family)
    assert {i: got.get(i, []) for i in hard} == {i: f for i, (_, f) in hard.items()}


def brute_words(text):
    return [w for w in re.split(r"[^\w.]+|_+|\.(?!\w)", text.lower()) if w]


def test_decision_as_brute_force(spark):
    """Probabilities from the regression's own numbers, templates by sets of words and pairs, over every line and template."""
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lm.train(docs)
    lines = lm._scored(lm.paragraphs(docs.filter("doc_id >= 290")).filter("size(words) < 1000"), model).collect()
    featured = {(str(r.doc_id), r.paragraph): r.features for r in lm._featured(lm.paragraphs(docs.filter("doc_id >= 290"))).collect()}
    weight, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    for r in lines:
        assert r.words == brute_words(r.text)
        grams = set(r.words) | {" ".join(x) for x in pairwise(r.words)}
        v = featured[str(r.doc_id), r.paragraph]
        assert 0 < len(v.indices) <= len(grams)
        z = weight[:, v.indices].sum(1) + bias
        q = np.exp(z - z.max())
        assert np.allclose(q / q.sum(), r.p, atol=1e-9)
    rows = spark.createDataFrame([(r.text, r.words, model.families) for r in lines], "text string, words array<string>, predicted array<string>")
    notices = lm.templates(spark).collect()
    for r in lm._confirmed(rows, lm.templates(spark)).collect():
        have, pairs = set(r.words), {" ".join(x) for x in pairwise(r.words)}
        best = min((-(len(have & set(t.t_words)) / len(set(t.t_words)) + len(pairs & set(t.t_pairs)) / max(len(set(t.t_pairs)), 1)) / 2, t.family, t.template, t) for t in notices)
        t = best[3]
        fits = -best[0] >= lm.CONFIRM and len(have & set(t.names)) >= lm.NAMED * len(t.names) and 2 * len(pairs & set(t.own)) >= len(t.own)
        if len(t.t_words) > 4:
            assert (r.best is not None) == fits
        assert r.best is None or (r.best.family, r.best.template) == best[1:3]


def test_calibrated_level():
    assert lm.calibrated([(0.9, True), (0.4, False), (0.5, True)]) == 0.45
    assert lm.calibrated([]) == lm.calibrated([(0.95, False)]) == lm.LEVELS[-1]
