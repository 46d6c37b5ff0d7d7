"""Literal cases: what goes in and what must come out."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import similarity as S
from quorumlake.functions import text as T
from quorumlake.functions import vocabulary as V
from quorumlake.operators import accounting as A
from quorumlake.operators import audits as U
from quorumlake.operators import extract as X
from quorumlake.operators import graph as G
from quorumlake.operators import memory as M
from quorumlake.operators import refine as R


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_folds_and_domains(spark):
    assert column(spark, ["A IA", "Rede_Neural", "conecta-se a", "O a", None, "São  Paulo!"], T.fold_key) == ["ia", "rede neural", "conecta se a", "a", "", "sao paulo"]
    assert column(spark, ["https://user@www.Example.com:8/x", "a.org/p?q", "", None], T.domain_of) == ["example.com", "a.org", "", ""]
    assert column(spark, ["One. Two?  Three", "", None], T.sentences) == [["One.", "Two?", "Three"], [], []]
    assert column(spark, ["bolt://u:secret@h", "api_key=abcdefgh12", "Bearer abc.def"], T.mask_secrets) == ["bolt://u:***@h", "api_key=***", "Bearer ***"]


def test_similarity(spark):
    pairs = [("Santos FC", "santos fc"), ("", "x"), ("Vasco da Gama", "Vasco Gama"), ("Santos FC", "Santos Futebol Clube")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", S.norm(F.col("a")).alias("a"), S.norm(F.col("b")).alias("b"))
    rows = df.select("i", S.similarity(F.col("a"), F.col("b")).alias("s"), S.abbreviated(F.col("a"), F.col("b")).alias("al")).orderBy("i").collect()
    assert [r.s for r in rows][:3] == [1.0, 0.0, 1.0] and 0.4 < rows[3].s < 0.85
    assert [r.al for r in rows] == [False, False, False, True]


def test_predicates_and_spans(spark):
    assert column(spark, ["usa", "É", "publicou", "poder", "aumentou", "2020", "the", "story", "sign", "xyzzy", "a=b", None], R.predicate_reason) == [
        "ok", "ok", "ok", "modal_predicate", "ambiguous_predicate", "numeric_predicate", "stopword_predicate", "nonverbal_predicate", "unmapped_predicate", "invalid_predicate", "url_or_code_predicate", "invalid_predicate",
    ]
    forms = V.predicate_forms()
    assert column(spark, list(forms), R.map_predicate) == list(forms.values())
    assert column(spark, ["eram", "jogou pelo", "connected", "user friendly", "preserva", "coaches", "xyz"], R.map_predicate) == ["SER", "DEFENDEU", "CONECTA_A", "É_AMIGÁVEL", "PRESERVA", "TREINOU", None]
    spans = {"Rio Branco": None, "em Santos": "object_prepositional_phrase", "Although big": "object_prepositional_phrase", "o que vier": "object_clause_fragment", "regra geral que mapeia": "object_clause_fragment", "enfim": "object_generic_phrase", "E O": "object_predicate_complement"}
    spans |= {"primeira divisão": None, "século XX": "object_date_like", "na década de 1990": "object_date_like", "anos 90": "object_date_like", "my house": "object_pronoun", "since 1990 he": "object_adverbial_phrase", "known for his dribbling": "object_predicate_complement", "seven years older than Pelé": "object_predicate_complement"}
    assert column(spark, list(spans), lambda c: R.span_reason(c, "object", None, F.lit("SER"))) == list(spans.values())
    assert column(spark, ["ação nova", "a\u0327c\u0303a\u0303o nova".replace("a\u0327", "a"), "ｆｕｌｌ ² ﬁm"], T.fold_span) == ["acao nova", "acao nova", "full 2 fim"]
    got = column(spark, ["Pelé", "de Santos", "cada um", "ele", "x" * 70, ""], lambda c: R.span_reason(c, "subject"))
    assert got == [None, "subject_starts_with_stopword", "subject_quantifier_phrase", "subject_generic_phrase", "subject_too_long", "subject_generic_phrase"]
    assert column(spark, ["ok", "Click here", "Esta frase utiliza um predicado bem conhecido de todos."], R.noisy_sentence) == [None, None, "Esta frase utiliza um predicado bem conhecido de todos."]


def test_refine_order_and_aliases(spark):
    aliases = R.alias_table(spark.createDataFrame([("INTELIGÊNCIA ARTIFICIAL", "ia"), ("INTELIGÊNCIA ARTIFICIAL", "Artificial Intelligence"), ("REDES NEURAIS", "rede neural")], "canonical string, variant string"))
    rows = [("A IA", "usa", "rede_neural", 2.0), ("ia", "usa", "Artificial Intelligence", 0.5), ("ia", "poder", "x", 0.5), ("ia", "usa", "em 1990", None), ("x", "usa", "ia", 0.1)]
    out = R.refine(spark.createDataFrame(rows, "subject string, predicate string, object string, confidence double"), aliases)
    got = {(r.subject, r.object): (r.c_subject, r.c_predicate, r.c_object, r.confidence, r.reason) for r in out.collect()}
    assert got["A IA", "rede_neural"] == ("INTELIGÊNCIA ARTIFICIAL", "UTILIZA", "REDES NEURAIS", 1.0, "ok")
    assert [got[k][4] for k in (("ia", "Artificial Intelligence"), ("ia", "x"), ("x", "ia"))] == ["self_loop", "modal_predicate", "missing_entity"]
    assert got["ia", "em 1990"][4].startswith("object_")


def test_alias_clash_fails(spark):
    with pytest.raises(Exception, match="share the key"):
        R.alias_table(spark.createDataFrame([("A", "x"), ("B", "The X")], "canonical string, variant string")).collect()


def occurrences(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "subject string, predicate string, object string, url string, domain string, confidence double, seq int")


def test_quorum_and_accounting(spark):
    t = ("IA", "UTILIZA", "Dados")
    rows = [(*t, "u1", "a.com", 0.9), ("ia", "utiliza", "dados", "u2", "b.com", 0.8), (*t, "u2", "b.com", 0.7), (*t, "u3", "b.com", 0.7), (*t, "u4", "c.com", 0.7), ("X", "SER", "Y", "u1", None, 0.1)]
    occ = occurrences(spark, rows)
    facts = {r.fact_key: r for r in G.facts(occ).collect()}
    one = facts["ia|UTILIZA|dados"]
    assert (one.subject, one.occurrences, one.domains, one.urls, one.verified) == ("IA", 5, 3, 4, True)
    assert facts["x|SER|y"].domains == 0
    row = A.snapshot(A.arrivals(G.with_keys(occ))).first()
    assert (row.occurrences, row["new"], row.same_url, row.same_domain, row.cross_domain, row.unaccounted) == (6, 2, 1, 1, 2, 0)


def test_fact_accounting_precedence(spark):
    def status(hashes):
        return G.accounting(spark.createDataFrame([(h,) for h in hashes], "fact_hash string")).first()

    assert status([]).status == "zero_facts"
    assert (status(["a", "a", None]).status, status(["a", "a"]).gap) == ("duplicate_fact_hashes", -1)
    assert status(["a", ""]).status == "missing_fact_hashes" and status(["a", "b"]).status == "ok"


def test_paths_components_and_contradictions(spark):
    edges = spark.createDataFrame([(1, "A", "p", "B"), (2, "B", "q", "C"), (3, "B", "r", "B2")], "id int, subject string, predicate string, object string")
    got = {(tuple(r.relations), r.target) for r in G.paths(edges, "A").collect()}
    assert got == {(("p",), "B"), (("p", "q"), "C"), (("p", "r"), "B2")}
    roots = {r.node: r.root for r in G.components(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a int, b int")).collect()}
    assert roots == {i: 0 for i in range(10)} | {20: 20, 21: 20}


def test_near_matches(spark):
    facts = spark.createDataFrame(
        [(1, "Santos FC", "VENCEU", "Copa do Brasil", ["a.com"]), (2, "Santos F C", "VENCEU", "Copa do Brasil", ["b.com"]), (3, "Santos FC", "VENCEU", "Copa Brasil", ["c.com"]), (4, "Outro", "SER", "Nada", ["d.com"])],
        "id int, subject string, predicate string, object string, domains array<string>",
    )
    found = U.near_matches(U.near_groups(U.groups(facts)))
    assert {(r.l_first, r.r_first, r.tier) for r in found.collect()} == {(1, 2, "high"), (2, 1, "high"), (2, 3, "high"), (3, 2, "high")}
    assert [(r.members, r.domains) for r in U.verified_clusters(found, facts, 2).collect()] == [(3, 3)]


def _norm(x):
    return " ".join(w for w in x.split() if w not in S.STOPWORDS)


def _sim(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    value = 1.0 if a == b else round(max(len(x & y) / len(x | y), SequenceMatcher(None, min(a, b), max(a, b)).ratio()), 4)
    return value if value >= 0.6 else 0.0


def _alias(a, b):
    return any(short in x and set(long) <= y and (x - {short}) & y for x, y in ((set(a.split()), set(b.split())), (set(b.split()), set(a.split()))) for short, long in S.ABBREVIATIONS.items())


def _near_kind(s, o, same, s_eq, o_eq):
    if not same:
        return ("medium", "predicate_variant") if s >= 0.85 and o >= 0.85 else None
    if s_eq and o_eq:
        return None
    if s_eq and o >= 0.85:
        return "high", "object_variant"
    if o_eq and s >= 0.85:
        return "high", "subject_variant"
    if s >= 0.85 and o >= 0.85:
        return "high", "object_variant" if o <= s else "subject_variant"
    return ("medium", "subject_variant" if s <= o else "object_variant") if s >= 0.6 and o >= 0.6 else None


def _link_kind(s, o, same, s_eq, o_eq, s_al, o_al):
    weaker = "subject_variant" if s <= o else "object_variant"
    if not same:
        return ("medium", "predicate_variant") if s >= 0.85 and o >= 0.85 else ("low", "predicate_variant") if s_eq or o_eq or s >= 0.6 and o >= 0.6 else None
    if s_eq and o_eq:
        return None
    if s_eq and (o_al or o >= 0.85):
        return "high", "object_variant"
    if o_eq and (s_al or s >= 0.85):
        return "high", "subject_variant"
    if s >= 0.85 and o >= 0.85:
        return "high", weaker
    if s_eq:
        return "medium", "object_variant"
    if o_eq:
        return "medium", "subject_variant"
    return ("medium", weaker) if s >= 0.6 and o >= 0.6 else None


def _facts(r, n):
    names = ["botafogo", "bota fogo sa", "santos", "sant0s", "abcabcabc", "axbxcxaxb", "copa do brasil", "copa brasil 1", "a b c", "a b d", "x", "xy", "vasco gama", "gama vasco", "flamengo", "framengo", ""]
    names += ["santos fc", "santos futebol clube", "fc vila", "vila nova futebol clube", "o santos", "flamengos", "botafogos", "copa do brasil 1", "ec bahia", "esporte clube bahia e mais palavras longas"]
    names += ["".join(r.choices("abcd ", k=r.randrange(3, 14))) for _ in range(15)]
    return [(i, r.choice(names), r.choice("PQ"), r.choice(names), r.choice([["u"], ["v"], ["w"], ["v", "u"], ["u", "v", "u"], []])) for i in range(n)]


def test_near_matches_as_all_pairs(spark):
    """Tiers, best matches and clusters of every pair of facts, with typos, abbreviations, other predicates and no common word, by their definitions."""
    rows = _facts(random.Random(5), 260)
    facts = spark.createDataFrame(rows, "id int, subject string, predicate string, object string, domains array<string>")
    near, link, edges = {}, {}, []
    for a, b in combinations(rows, 2):
        (s1, o1), (s2, o2) = ((_norm(x[1]), _norm(x[3])) for x in (a, b))
        s, o, same = _sim(s1, s2), _sim(o1, o2), a[2] == b[2]
        d1, d2 = set(a[4]), set(b[4])
        if d1 != d2 and (kind := _near_kind(s, o, same, s1 == s2 != "", o1 == o2 != "")):
            near.setdefault(kind, []).append((a[0], b[0], max(s, o)))
        if d1 and d2 and not d1 & d2 and (s and o or s1 == s2 != "" or o1 == o2 != "") and (kind := _link_kind(s, o, same, s1 == s2, o1 == o2, _alias(s1, s2), _alias(o1, o2))):
            link[kind] = link.get(kind, 0) + 1
    grouped = U.groups(facts)
    found = U.near_matches(U.near_groups(grouped))
    assert {(r.tier, r.variant): r.n for r in U.match_report(found).collect()} == {k: len(v) for k, v in near.items()}
    assert len(near) == 5
    assert {(r.tier, r.variant): r.n for r in U.link_report(grouped).collect()} == link
    assert len(link) >= 5
    best = {}
    for (tier, _), pairs in near.items():
        for a, b, score in pairs:
            for x, y in ((a, b), (b, a)):
                best.setdefault(x, []).append(({"high": 0, "medium": 1}[tier], -score, y))
    assert {r.id: (r.match, r.tier, r.score) for r in U.best_matches(found, facts).collect()} == {k: (y, ["high", "medium"][t], -s) for k, v in best.items() for t, s, y in [min(v)]}
    edges = [(a, b) for (tier, _), v in near.items() if tier == "high" for a, b, _ in v]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    domains = {}
    for i, k in root.items():
        domains.setdefault(k, set()).update(rows[i][4])
    want = sorted((sum(1 for x in root.values() if x == k), len(d)) for k, d in domains.items() if len(d) >= 2)
    assert sorted((r.members, r.domains) for r in U.verified_clusters(found, facts, 2).collect()) == want and want


def test_near_matches_of_nothing(spark):
    facts = spark.createDataFrame([], "id int, subject string, predicate string, object string, domains array<string>")
    found = U.near_matches(U.near_groups(U.groups(facts)))
    assert U.match_report(found).collect() == U.link_report(U.groups(facts)).collect() == U.best_matches(found, facts).collect() == []


def test_consolidation_is_idempotent_unless_additive(spark):
    rel = spark.createDataFrame([("a", "p", "b", 2)], "subject string, predicate string, object string, replays bigint")
    tally = spark.createDataFrame([("a", "p", "b", 5), ("c", "p", "d", 3)], "subject string, predicate string, object string, replays bigint")
    once = M.consolidate(rel, tally)
    assert {(r.subject, r.replays) for r in M.consolidate(once, tally).collect()} == {("a", 5), ("c", 3)}
    assert {(r.subject, r.replays) for r in M.consolidate(once, tally, additive=True).collect()} == {("a", 10), ("c", 6)}


def test_rate_limit_counts_denied_attempts(spark):
    hits = spark.createDataFrame([("k", i) for i in (0, 1, 2, 3, 61)], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    rows = M.rate_limit(hits, 2, 60).orderBy("ts").collect()
    assert [(r.attempts, r.allowed) for r in rows] == [(1, True), (2, True), (3, False), (4, False), (4, False)]
    assert [r.retry_after for r in rows] == [0, 0, 58, 57, 1]


def test_tables_and_geo(spark):
    html = "<table><tr><th>C</th></tr><tr><td>Santos</td><td>Copa</td><td>1962, 1963</td></tr></table>"
    rows = X.table_rows(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string"))
    allowed = spark.createDataFrame([("SANTOS", "Copa")], "club string, competition string")
    assert sorted(r.year for r in X.honours(rows, allowed).collect()) == [1962, 1963]
