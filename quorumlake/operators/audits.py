"""Audits: near matches between facts, entity-link candidates, gates, parity, forensics and health classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.small import checkpoints
from . import graph as G

HIGH, MEDIUM = 0.85, 0.60


def similar_pairs(names: DataFrame, least: float = MEDIUM) -> DataFrame:
    """(a, b, sim): pairs of different normed names (name), in both orders, of similarity `least` (0.6 or more) or more, each worked out once.

    None is lost: names alike by their words share a word. Of names alike by their sequence of characters, of L characters together, at least
    0.3 L match in order and at most 0.4 L don't, so where L is over 10 some two neighbouring matches have at most one
    unmatched character between them on one side: two characters at distance 1 or 2 in both. Of shorter ones, one name has
    at most 5 characters and shares one with the other. Names are joined on these keys; lengths and characters in common bound the rest.
    """
    names = names.select("name").filter("name <> ''").distinct()
    keyed = names.select("name", F.length("name").alias("n"))
    chars = F.split("name", "")
    words = F.transform(S.tokens(F.col("name")), lambda w: F.concat(F.lit("w"), w))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array(F.concat(F.lit("g"), F.substr("name", i, F.lit(1)), F.substr("name", i + 1, F.lit(1))), F.concat(F.lit("g"), F.substr("name", i, F.lit(1)), F.substr("name", i + 2, F.lit(1))))))
    single = F.when(F.col("n") <= 9, F.transform(chars, lambda x: F.concat(F.lit("c"), x))).otherwise(F.array().cast("array<string>"))
    keyed = keyed.select("name", "n", F.explode(F.array_distinct(F.concat(words, grams, single))).alias("key"))
    left, right = keyed.select(F.col("name").alias("a"), F.col("n").alias("n_a"), "key"), keyed.select(F.col("name").alias("b"), F.col("n").alias("n_b"), "key")
    found = left.join(right, "key").filter("a < b").select("a", "b", "n_a", "n_b").distinct()
    # few rows, much work in each: dealt over all cores
    found = found.repartition(names.sparkSession.sparkContext.defaultParallelism, "a", "b")
    found = found.withColumn("sim", F.round(S.likeness_from(least)(F.col("a"), F.col("b")), 4)).filter(F.col("sim") >= least)
    both = F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    return found.select(F.inline(both))


def groups(facts: DataFrame) -> DataFrame:
    """(s, o, predicate, domains, n, first): facts (id, subject, predicate, object, domains) by normed names, predicate and set of domains, with their number and least id.

    Facts of one group are told apart by nothing that a match looks at, so pairs are worked out between groups.
    """
    normed = facts.select("id", "predicate", F.array_sort(F.array_distinct("domains")).alias("domains"), S.norm(F.col("subject")).alias("s"), S.norm(F.col("object")).alias("o"))
    return normed.groupBy("s", "o", "predicate", "domains").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def name_pairs(named: DataFrame, column: str, least: float = MEDIUM) -> DataFrame:
    """(a, b, sim, alias) of the names in a column: pairs of different ones, in both orders, that are similar or of which one abbreviates the other.

    Written once: all that follows joins to it. An abbreviation shares another token with what it stands for, so aliases are met there.
    """
    checkpoints(named.sparkSession)
    names = named.select(F.col(column).alias("name")).filter("name <> ''").distinct().checkpoint()
    close = similar_pairs(names, least)
    word = names.select("name", S.tokens(F.col("name")).alias("t"))
    short = word.filter(F.arrays_overlap("t", F.array(*[F.lit(x) for x in S.ABBREVIATIONS])))
    long = word.filter(F.exists(F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in S.ABBREVIATIONS.values()]), lambda ws: F.size(F.array_except(ws, F.col("t"))) == 0))
    met = short.select(F.col("name").alias("a"), F.explode("t").alias("w")).join(long.select(F.col("name").alias("b"), F.explode("t").alias("w")), "w").filter("a <> b").select("a", "b").distinct()
    met = met.filter(S.abbreviated(F.col("a"), F.col("b")))
    met = met.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct().withColumn("alias", F.lit(True))
    out = close.join(met, ["a", "b"], "full_outer")
    return out.select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("alias", F.lit(False)).alias("alias")).checkpoint()


def near_groups(grouped: DataFrame) -> DataFrame:
    """Ordered pairs (l_, r_ of groups()) with subject_sim, object_sim, s_alias, o_alias: names equal (similarity 1) or in name_pairs() on both sides.

    Groups of equal subject and object are paired too. Pairs of names are joined to groups, so a name costs its own groups, and no pair is met but those
    that are similar on both sides.
    """
    grouped = grouped.checkpoint() if checkpoints(grouped.sparkSession) else grouped
    subjects, objects = name_pairs(grouped, "s"), name_pairs(grouped, "o")
    l = grouped.select(*[F.col(c).alias(f"l_{c}") for c in grouped.columns])
    r = grouped.select(*[F.col(c).alias(f"r_{c}") for c in grouped.columns])
    s = subjects.select(F.col("a").alias("l_s"), F.col("b").alias("r_s"), F.col("sim").alias("subject_sim"), F.col("alias").alias("s_alias"))
    o = objects.select(F.col("a").alias("l_o"), F.col("b").alias("r_o"), F.col("sim").alias("object_sim"), F.col("alias").alias("o_alias"))
    one, no = F.lit(1.0), F.lit(False)
    # an empty name equals an empty name, but is like none
    both = l.join(r, (F.col("l_s") == F.col("r_s")) & (F.col("l_o") == F.col("r_o"))).filter("l_s <> ''").withColumns({"subject_sim": one, "object_sim": F.when(F.col("l_o") != "", 1.0).otherwise(0.0), "s_alias": no, "o_alias": no})
    same_s = l.filter("l_s <> ''").join(o, "l_o").join(r, (F.col("l_s") == F.col("r_s")) & (o["r_o"] == r["r_o"])).drop(o["r_o"]).withColumns({"subject_sim": one, "s_alias": no})
    same_o = l.filter("l_o <> ''").join(s, "l_s").join(r, (F.col("l_o") == F.col("r_o")) & (s["r_s"] == r["r_s"])).drop(s["r_s"]).withColumns({"object_sim": one, "o_alias": no})
    neither = l.join(s.filter("subject_sim > 0"), "l_s").join(o.filter("object_sim > 0"), "l_o").join(r, ["r_s", "r_o"])
    columns = [*l.columns, *r.columns, "subject_sim", "object_sim", "s_alias", "o_alias"]
    out = both.select(columns)
    for part in (same_s, same_o, neither):
        out = out.unionByName(part.select(columns))
    return out.withColumn("score", F.round(F.greatest("subject_sim", "object_sim"), 4))


def _told(out: DataFrame) -> DataFrame:
    out = out.filter("kind is not null")
    return out.withColumn("tier", F.split_part("kind", F.lit(":"), F.lit(1))).withColumn("variant", F.split_part("kind", F.lit(":"), F.lit(2))).drop("kind")


def near_matches(found: DataFrame, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """near_groups() of different domains with `tier` (high, medium) and `variant`; others are left out."""
    s, o = F.col("subject_sim"), F.col("object_sim")
    same, s_eq, o_eq = F.col("l_predicate") == F.col("r_predicate"), F.col("l_s") == F.col("r_s"), F.col("l_o") == F.col("r_o")
    kind = (
        F.when(~same, F.when((s >= high) & (o >= high), "medium:predicate_variant"))
        .when(s_eq & o_eq, F.lit(None))
        .when(s_eq & (o >= high), "high:object_variant")
        .when(o_eq & (s >= high), "high:subject_variant")
        .when((s >= high) & (o >= high), F.when(o <= s, "high:object_variant").otherwise("high:subject_variant"))
        .when((s >= medium) & (o >= medium), F.when(s <= o, "medium:subject_variant").otherwise("medium:object_variant"))
    )
    return _told(found.filter("l_domains <> r_domains").withColumn("kind", kind))


def _apart():
    return (F.size("l_domains") > 0) & (F.size("r_domains") > 0) & ~F.arrays_overlap("l_domains", "r_domains")


def link_kind(high: float = HIGH, medium: float = MEDIUM):
    """tier:variant of a pair of near_groups() of disjoint domains; another predicate never makes a high one; abbreviations count as equal words."""
    s, o = F.col("subject_sim"), F.col("object_sim")
    same, s_eq, o_eq = F.col("l_predicate") == F.col("r_predicate"), F.col("l_s") == F.col("r_s"), F.col("l_o") == F.col("r_o")
    weaker = F.when(s <= o, "subject_variant").otherwise("object_variant")
    equal = (
        F.when(s_eq & o_eq, F.lit(None))
        .when(s_eq & (F.col("o_alias") | (o >= high)), "high:object_variant")
        .when(o_eq & (F.col("s_alias") | (s >= high)), "high:subject_variant")
        .when((s >= high) & (o >= high), F.concat(F.lit("high:"), weaker))
        .when(s_eq, "medium:object_variant")
        .when(o_eq, "medium:subject_variant")
        .when((s >= medium) & (o >= medium), F.concat(F.lit("medium:"), weaker))
    )
    other = F.when((s >= high) & (o >= high), "medium:predicate_variant").when(s_eq | o_eq | ((s >= medium) & (o >= medium)), "low:predicate_variant")
    return F.when(same, equal).otherwise(other)


def link_candidates(found: DataFrame, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """near_groups() of disjoint domains in three tiers.

    Pairs with one name equal and the other unlike are candidates too: link_report() counts them, without a row for each.
    """
    return _told(found.filter(_apart()).withColumn("kind", link_kind(high, medium)))


def _apart_of_one(grouped: DataFrame, name: str) -> DataFrame:
    """(same, n): ordered pairs of facts with one name in common, of disjoint domains, of one predicate or of two: sums over sets of domains, not over facts."""
    sides = grouped.filter(F.col(name) != "").groupBy(name, "predicate", "domains").agg(F.sum("n").alias("n"))
    l, r = (sides.select(F.col(name).alias("k"), *[F.col(c).alias(f"{x}_{c}") for c in ("predicate", "domains", "n")]) for x in "lr")
    met = l.join(r, "k").filter(_apart())
    return met.groupBy((F.col("l_predicate") == F.col("r_predicate")).alias("same")).agg(F.sum(F.col("l_n") * F.col("r_n")).alias("n"))


def link_report(grouped: DataFrame) -> DataFrame:
    """(tier, variant, n) of link candidates between facts: similar names are met pair by pair, those with one name equal and the other unlike are what is
    left of all pairs with that name."""
    checkpoints(grouped.sparkSession)
    grouped = grouped.checkpoint()
    pair = [((F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "")).alias(f"{c}_eq") for c in "so"]
    found = near_groups(grouped).filter(_apart()).withColumn("kind", link_kind())
    # one row for each kind of pair: all that follows is sums of these
    met = found.groupBy("kind", *pair, (F.col("l_predicate") == F.col("r_predicate")).alias("same")).agg(F.sum(F.col("l_n") * F.col("r_n")).alias("n")).checkpoint()
    out = met.filter("kind is not null").select("kind", "n")
    for name, variant in (("s", "object_variant"), ("o", "subject_variant")):
        kind = F.when(F.col("same"), f"medium:{variant}").otherwise("low:predicate_variant").alias("kind")
        out = out.unionByName(_apart_of_one(grouped, name).select(kind, "n")).unionByName(met.filter(f"{name}_eq").select(kind, (-F.col("n")).alias("n")))
    return _told(out.groupBy("kind").agg((F.sum("n") / 2).cast("bigint").alias("n")).filter("n > 0")).select("tier", "variant", "n")


def match_report(matches: DataFrame) -> DataFrame:
    """(tier, variant, n): pairs of facts, of ordered pairs of groups."""
    return matches.groupBy("tier", "variant").agg((F.sum(F.col("l_n") * F.col("r_n")) / 2).cast("bigint").alias("n"))


def best_matches(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, match, tier, score): of each fact the match of highest tier, then score, then least id: worked out for groups, whose facts share it."""
    rank = F.when(F.col("tier") == "high", 3).when(F.col("tier") == "medium", 2).otherwise(1)
    best = F.min_by(F.struct(F.col("r_first").alias("match"), "tier", "score"), F.struct(-rank, -F.col("score"), "r_first"))
    best = matches.groupBy("l_s", "l_o", "l_predicate", "l_domains").agg(best.alias("b"))
    own = facts.select("id", S.norm(F.col("subject")).alias("l_s"), S.norm(F.col("object")).alias("l_o"), F.col("predicate").alias("l_predicate"), F.array_sort(F.array_distinct("domains")).alias("l_domains"))
    return own.join(best, ["l_s", "l_o", "l_predicate", "l_domains"]).select("id", "b.*")


def verified_clusters(matches: DataFrame, facts: DataFrame, quorum: int = 3) -> DataFrame:
    """Clusters of high matches that together reach the quorum of domains: (root, members, domains). A group that matches has all its facts in one cluster."""
    edges = matches.filter("tier = 'high'").select(F.col("l_first").alias("a"), F.col("r_first").alias("b"))
    roots = G.components(edges)
    key = [S.norm(F.col("subject")).alias("s"), S.norm(F.col("object")).alias("o"), "predicate", F.array_sort(F.array_distinct("domains")).alias("domains")]
    named = groups(facts).join(roots, F.col("first") == F.col("node")).select("s", "o", "predicate", "domains", "root")
    members = facts.select("id", *key).join(named, ["s", "o", "predicate", "domains"])
    out = members.groupBy("root").agg(F.count_distinct("id").alias("members"), F.size(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("domains"))
    return out.filter((F.col("members") > 1) & (F.col("domains") >= quorum))


def training_gate(records: DataFrame, least: int = 100, top_share: float = 0.5) -> DataFrame:
    """One row on records (predicate, object, domain, key): counts, largest share of a predicate, duplicates, and what blocks training."""
    per = records.groupBy("predicate").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"))
    row = records.agg(F.count("*").alias("records"), F.count_distinct("key").alias("keys"), F.count_distinct("domain").alias("domains"), F.count_if(F.col("domain").isNull()).alias("without_source")).join(per)
    share = F.round(F.expr("try_divide(top, records)"), 4)
    why = F.array(F.when(F.col("records") < least, "too_few_records"), F.when(share > top_share, "predicate_dominates"), F.when(F.col("keys") < F.col("records"), "duplicates"), F.when(F.col("without_source") > 0, "without_source"), F.when(F.col("domains") < 3, "too_few_domains"))
    return row.withColumn("top_share", share).withColumn("blocking", F.array_join(F.array_compact(why), ",")).withColumn("go", F.col("blocking") == "").drop("top")


def json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row on lines of JSON: all, blank, valid, invalid ones, mean and largest length."""
    blank = F.trim(column) == ""
    valid = F.get_json_object(column, "$").isNotNull()
    return lines.agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & valid).alias("valid"), F.count_if(~blank & ~valid).alias("invalid"), F.round(F.avg(F.length(column)), 4).alias("mean_chars"), F.max(F.length(column)).alias("max_chars"))


def productivity(pages: DataFrame) -> DataFrame:
    """pages (url, text) with counts of sentences and a class: empty, navigation_dominated, thin or productive."""
    from ..functions import text as T
    from .refine import sentence_reason

    s = T.sentences(F.col("text"))
    out = pages.withColumn("s", F.transform(s, lambda x: F.coalesce(sentence_reason(x), F.lit("ok"))))
    out = out.select("url", F.size("s").alias("sentences"), F.size(F.filter("s", lambda x: x == "ok")).alias("usable"), F.size(F.filter("s", lambda x: x == "noise_marker")).alias("noise"))
    kind = F.when(F.col("sentences") == 0, "empty").when(F.col("noise") * 2 > F.col("sentences"), "navigation_dominated").when(F.col("usable") < 3, "thin").otherwise("productive")
    return out.withColumn("class", kind)


def parity(runs: DataFrame) -> DataFrame:
    """runs (target, side a or b, key): keys of each side, shared ones and the root causes in order."""
    per = runs.groupBy("target").agg(F.collect_set(F.when(F.col("side") == "a", F.col("key"))).alias("a"), F.collect_set(F.when(F.col("side") == "b", F.col("key"))).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    why = F.array(F.when((F.size("a") == 0) & (F.size("b") == 0), "nothing_extracted"), F.when((F.size("a") == 0) != (F.size("b") == 0), "one_side_empty"), F.when((F.size("a") > 0) & (F.size("b") > 0) & (shared == 0), "no_overlap"), F.when((shared > 0) & ((F.size("a") > shared) | (F.size("b") > shared)), "partial_overlap"))
    return per.select("target", F.size("a").alias("a_keys"), F.size("b").alias("b_keys"), shared.alias("shared"), F.coalesce(F.get(F.array_compact(why), F.lit(0)), F.lit("parity")).alias("cause"))


def diagnose(status: Column, length: Column, sentences: Column, raw: Column, canonical: Column, persisted: Column) -> Column:
    """The stage at which a source's extraction failed; the first that holds."""
    return (
        F.when(status >= 400, "fetch_failed")
        .when(length == 0, "empty_page")
        .when(sentences == 0, "no_sentences")
        .when(raw == 0, "no_triples")
        .when(canonical == 0, "all_rejected")
        .when(persisted == 0, "not_persisted")
        .otherwise("ok")
    )


def hygiene(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """facts (fact_key, verified, urls) with whether they may be removed: not verified, of one url, and in no registry (fact_key)."""
    known = registry.select("fact_key", F.lit(True).alias("known")).distinct()
    out = facts.join(known, "fact_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    why = F.array(F.when(F.col("known"), "registered"), F.when(F.col("verified"), "verified"), F.when(F.col("urls") > 1, "several_urls"))
    return out.select("fact_key", F.array_join(F.array_compact(why), ",").alias("kept_for"), (F.size(F.array_compact(why)) == 0).alias("removable"))


def dominant(rows: DataFrame, by: str, kind: str, priority: dict[str, int]) -> DataFrame:
    """The most frequent kind, ties by priority (least first)."""
    order = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    n = rows.groupBy(by, kind).agg(F.count("*").alias("n"))
    best = F.max_by(kind, F.struct("n", -F.coalesce(F.try_element_at(order, F.col(kind)), F.lit(999))))
    return n.groupBy(by).agg(best.alias("dominant"), F.max("n").alias("n"))


def timeline(samples: DataFrame) -> DataFrame:
    """One row on samples (at, class): whether ever healthy, first healthy place, conclusion."""
    row = samples.agg(F.count("*").alias("samples"), F.bool_or(F.col("class") == "healthy").alias("ever"), F.min(F.when(F.col("class") == "healthy", F.col("at"))).alias("first_healthy"), F.bool_or(F.col("class") == "error").alias("errors"))
    return row.withColumn("conclusion", F.when(F.col("ever") & ~F.col("errors"), "healthy").when(F.col("ever"), "recovered").otherwise("never_healthy"))


def pressure(used: Column, limit: Column) -> Column:
    """low, medium from a half, high from four fifths."""
    ratio = F.try_divide(used.cast("double"), limit.cast("double"))
    return F.when(ratio >= 0.8, "high").when(ratio >= 0.5, "medium").otherwise("low")


def expected_facts(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (key, least) against observed (key, domains): verified, partial or missing; of several rows of one key the one of most domains."""
    best = observed.groupBy("key").agg(F.max("domains").alias("domains"))
    out = expected.join(best, "key", "left")
    return out.select("key", F.coalesce("domains", F.lit(0)).alias("domains"), F.when(F.col("domains").isNull(), "missing").when(F.col("domains") >= F.col("least"), "verified").otherwise("partial").alias("class"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """metrics (name, value) of two runs: delta and whether it fell."""
    out = before.select("name", F.col("value").alias("before")).join(after.select("name", F.col("value").alias("after")), "name", "full_outer")
    return out.withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).withColumn("regressed", F.col("delta") < 0)
