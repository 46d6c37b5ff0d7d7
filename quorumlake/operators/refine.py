"""Quality gates: sentences, predicates and spans are judged by ordered rules, each with a typed reason; the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from .containment import contained

MAX_TOKENS, MAX_CHARS = 8, 60


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any_of(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds one of the parts, in one pass over it."""
    return c.rlike("|".join(rf"\Q{p}\E" for p in parts))


def _has_marker(low: Column) -> Column:
    return _any_of(low, V.UI_MARKERS)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _in(c: Column, words: tuple[str, ...]) -> Column:
    return c.isin(*words) | T.singular(c).isin(*words)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The reason of the first rule that holds, null if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for reason, holds in rules:
        out = out.when(holds, reason)
    return out


def map_predicate(raw: Column, table: dict[str, str] | None = None) -> Column:
    """The controlled predicate of a verb, by its form or that without a plural s, else null. table: form -> predicate."""
    key, table = T.fold_span(raw), table or V.predicate_forms()
    up = F.upper(F.trim(raw))
    return F.when(up.isin(*V.PREDICATES), up).otherwise(F.coalesce(_lookup(table, key), _lookup(table, T.singular(key))))


def predicate_reason(raw: Column, table: dict[str, str] | None = None) -> Column:
    """ok, or why a verb is no predicate."""
    text, key = F.trim(F.coalesce(raw, F.lit(""))), T.fold_span(raw)
    words = F.split(key, " ")
    century = (F.get(words, F.lit(0)) == "seculo") & ((F.size(words) == 1) | ((F.size(words) == 2) & F.get(words, F.lit(1)).rlike("^[ivxlcdm0-9]+$")))
    marks = "".join("\\" + c for c in V.CODE_CHARS)
    code = text.rlike(rf"[{marks}]|::|www\.|\.(?:{'|'.join(V.CODE_SUFFIXES)})\b")
    return F.coalesce(
        first_reason(
            [
                ("invalid_predicate", text == ""),
                ("ok", map_predicate(raw, table).isNotNull()),
                ("numeric_predicate", text.rlike("^[0-9]+$") | century | key.isin("century", "decada", "decade")),
                ("url_or_code_predicate", code),
                ("invalid_predicate", F.length(key) < 2),
                ("stopword_predicate", key.isin(*V.STOPWORDS)),
                ("nonverbal_predicate", key.isin(*V.NONVERBAL)),
                ("modal_predicate", _in(key, V.MODAL)),
                ("ambiguous_predicate", _in(key, V.AMBIGUOUS)),
                ("unmapped_predicate", _in(key, V.KNOWN_VERBS)),
            ]
        ),
        F.lit("invalid_predicate"),
    )


def copular_complement(words: Column) -> Column:
    """Whether folded tokens, two or more, read like a clause after to be: they open like one, name an agent, compare, or half of them are function words."""
    opening = F.get(words, F.lit(0))
    functional = 2 * F.size(F.filter(words, lambda w: w.isin(*V.FUNCTION_WORDS))) >= F.size(words)
    agent = opening.rlike("(ed|en)$") & F.array_contains(words, "by")
    compares = F.array_contains(words, "than") & F.exists(words, lambda w: w.isin(*V.COMPARATIVES))
    return (F.size(words) >= 2) & (opening.isin(*V.COMPLEMENT_START) | functional | agent | compares)


def _dated(words: Column) -> Column:
    """A year, century, decade or `anos 90`, also after a preposition."""
    w = F.when((F.size(words) > 1) & F.get(words, F.lit(0)).isin("em", "de", "do", "da", "dos", "das", "no", "na", "por"), F.slice(words, 2, F.size(words))).otherwise(words)

    def told(x: Column) -> Column:
        head, n = F.get(x, F.lit(0)), F.size(x)
        second, third = F.get(x, F.lit(1)), F.get(x, F.lit(2))
        return F.coalesce(
            ((n == 1) & (head.rlike("^[0-9]{1,4}$") | head.isin("seculo", "decada", "anos")))
            | ((n == 2) & (head == "seculo") & second.rlike("^[ivxlcdm]+$"))
            | ((n == 2) & (head == "anos") & second.rlike("^[0-9]{1,3}$"))
            | ((n == 3) & (head == "decada") & (second == "de") & third.rlike("^[0-9]{4}$")),
            F.lit(False),
        )

    return let(w, told)


#: What a role calls a fault, where that is not role_fault.
CALLED = {
    "subject": dict.fromkeys(("punctuated", "numeric_only", "date_like", "pronoun", "clause_fragment"), "generic_phrase") | dict.fromkeys(("adverbial_phrase", "prepositional_phrase"), "starts_with_stopword"),
    "object": {"quantifier_phrase": "generic_phrase"},
}


def span_faults(raw: Column, folded: Column, words: Column) -> list[tuple[str, Column]]:
    """What may be wrong with a span, and whether it is, in the order in which the first counts."""
    opening, several = F.get(words, F.lit(0)), F.size(words) > 1
    spaced = F.concat(F.lit(" "), folded, F.lit(" "))
    starts = F.lit(False)
    for x in V.CLAUSE_START:
        starts |= folded.startswith(x)
    first_char = "".join("\\" + c for c in V.SPAN_PUNCTUATION)
    anywhere = "".join("\\" + c for c in V.SPAN_CODE)
    relative = F.array_position(F.transform(words, lambda w: w.isin(*V.RELATIVE)), True)
    return [
        ("punctuated", raw.rlike(rf"^[{first_char}]|[{anywhere}]")),
        ("numeric_only", folded.rlike("^[0-9 ]+$")),
        ("date_like", _dated(words)),
        ("generic_phrase", folded.isin(*V.DISCOURSE) | (several & opening.isin(*V.DISCOURSE_START))),
        ("quantifier_phrase", opening.isin(*V.QUANTIFIERS)),
        ("pronoun", folded.isin(*V.PRONOUNS) | (several & opening.isin(*V.PRONOUNS))),
        ("clause_fragment", starts | _any_of(spaced, V.CLAUSE_WITHIN)),
        ("clause_fragment", (F.size(words) >= 3) & (relative > 1) & (relative < F.size(words))),
        ("adverbial_phrase", opening.isin(*V.PREPOSITIONS) & opening.isin(*V.ADVERBIAL)),
        ("prepositional_phrase", opening.isin(*V.PREPOSITIONS)),
    ]


def span_reason(span: Column, role: str, known: Column | None = None, predicate: Column | None = None) -> Column:
    """Why a span names no entity, null if it may. known: whether the folded span is a known entity, which passes; predicate: of an object."""

    def judged(raw: Column, folded: Column, words: Column) -> Column:
        faults = span_faults(raw, folded, words)
        if role == "object" and predicate is not None:
            faults.append(("predicate_complement", F.coalesce(T.fold_span(predicate).isin(*V.COPULAS), F.lit(False)) & copular_complement(words)))
        faults.append(("generic_phrase", F.forall(words, lambda w: w.isin(*V.FUNCTION_WORDS))))
        faults.append(("too_long", (F.size(words) > MAX_TOKENS) | (F.length(raw) > MAX_CHARS)))
        rules = [(f"{role}_{CALLED[role].get(fault, fault)}", holds) for fault, holds in faults]
        found = F.when(F.length(folded) < 2, f"{role}_generic_phrase")
        return (found.when(known, F.lit(None).cast("string")) if known is not None else found).otherwise(first_reason(rules))

    return let(F.trim(F.coalesce(span, F.lit(""))), lambda raw: let(T.fold_span(raw), lambda folded: let(F.split(folded, " "), lambda words: judged(raw, folded, words))))


def link_entities(rows: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """rows with `out`, the canonical name of a column: by aliases (key, canonical), else the folded name in upper case."""
    key = T.fold_key(F.col(column))
    names = aliases.select(F.col("key").alias("__key"), F.col("canonical").alias("__name")).distinct()
    found = rows.withColumn("__k", key).join(names, F.col("__k") == F.col("__key"), "left")
    return found.withColumn(out, F.coalesce("__name", F.upper("__k"))).withColumn(f"{out}_known", F.col("__name").isNotNull()).drop("__k", "__key", "__name")


def alias_table(variants: DataFrame) -> DataFrame:
    """(key, canonical) from (canonical, variant); raises if one key has two names."""
    keyed = variants.select(T.fold_key(F.col("variant")).alias("key"), "canonical").union(variants.select(T.fold_key(F.col("canonical")), "canonical")).filter("key <> ''").distinct()
    per = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical"))
    clash = F.raise_error(F.concat(F.lit("two names share the key "), F.col("key")))
    return per.select("key", F.when(F.col("n") > 1, clash.cast("string")).otherwise(F.col("canonical")).alias("canonical"))


def valid_term(c: Column) -> Column:
    return (F.length(c) >= 3) & (F.size(F.split(c, " ")) <= 6) & c.rlike(r"\p{L}") & ~_has_marker(F.lower(c))


def _judged(triples: DataFrame, aliases: DataFrame, pair_aliases: DataFrame | None) -> DataFrame:
    """Distinct triples (subject, predicate, object) with c_subject, c_predicate, c_object and reason."""
    out = link_entities(link_entities(triples, "subject", aliases, "c_subject"), "object", aliases, "c_object")
    # verbs are few: each is judged once
    verbs = triples.select(F.col("predicate").alias("__verb")).distinct().select("__verb", map_predicate(F.col("__verb")).alias("c_predicate"), predicate_reason(F.col("__verb")).alias("__why"))
    out = out.join(verbs, F.col("predicate").eqNullSafe(F.col("__verb"))).drop("__verb")
    p = F.col("__why")
    # so are spans: an object once with each predicate
    out = out.withColumn("__s", F.trim(F.coalesce("subject", F.lit("")))).withColumn("__o", F.trim(F.coalesce("object", F.lit(""))))
    subjects = out.select("__s", "c_subject_known").distinct().select(F.col("__s").alias("s1"), F.col("c_subject_known").alias("s2"), span_reason(F.col("__s"), "subject", F.col("c_subject_known")).alias("__s_why"))
    objects = out.select("__o", "c_object_known", "c_predicate").distinct()
    objects = objects.select(F.col("__o").alias("o1"), F.col("c_object_known").alias("o2"), F.col("c_predicate").alias("o3"), span_reason(F.col("__o"), "object", F.col("c_object_known"), F.col("c_predicate")).alias("__o_why"))
    out = out.join(subjects, (F.col("__s") == F.col("s1")) & (F.col("c_subject_known") == F.col("s2")))
    out = out.join(objects, (F.col("__o") == F.col("o1")) & (F.col("c_object_known") == F.col("o2")) & F.col("c_predicate").eqNullSafe(F.col("o3")))
    s, o = F.col("__s_why"), F.col("__o_why")
    missing = F.when(~valid_term(F.col("c_subject")) | ~valid_term(F.col("c_object")), "missing_entity")
    loop = F.when(F.col("c_subject") == F.col("c_object"), "self_loop")
    out = out.withColumn("reason", F.coalesce(F.when(p != "ok", p), missing, s, o, loop, F.lit("ok")))
    if pair_aliases is not None:
        pairs = pair_aliases.select(F.col("subject").alias("c_subject"), F.col("object").alias("c_object"), F.col("old").alias("c_predicate"), F.col("new").alias("__new"))
        out = out.join(pairs, ["c_subject", "c_object", "c_predicate"], "left").withColumn("c_predicate", F.coalesce("__new", "c_predicate")).drop("__new")
    return out.select("subject", "predicate", "object", "c_subject", "c_predicate", "c_object", "reason")


def refine(triples: DataFrame, aliases: DataFrame, pair_aliases: DataFrame | None = None) -> DataFrame:
    """triples (subject, predicate, object, confidence) with canonical c_subject, c_predicate, c_object, clamped confidence and `reason`, ok or why not.

    Each distinct triple is judged once and joined once to its rows. pair_aliases: (subject, object, old, new): for these pairs of canonical names a predicate is renamed.
    """
    key = ["subject", "predicate", "object"]
    judged = _judged(triples.select(*key).distinct(), aliases, pair_aliases).select(*[F.col(c).alias(f"__{c}") for c in key], "c_subject", "c_predicate", "c_object", "reason")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(0.5)))), 3)
    return triples.join(judged, same).withColumn("confidence", confidence).drop(*[f"__{c}" for c in key])


def rejections(refined: DataFrame) -> DataFrame:
    """Rejected triples per reason, most first."""
    return refined.filter("reason <> 'ok'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _instruction(low: Column) -> Column:
    found = F.lit(False)
    for m in V.IMPERATIVES:
        found |= low.startswith(m)
    return found


def noisy_sentence(c: Column) -> Column:
    """The collapsed sentence, null if it is short, long, a question, an instruction or part of a page's interface."""

    def judged(x: Column) -> Column:
        bad = (F.length(x) < 15) | (F.length(x) > 320) | x.endswith("?")
        return F.when(~bad & let(F.lower(x), lambda low: ~_instruction(low) & ~_has_marker(low)), x)

    return let(_collapsed(c), judged)


def has_predicate(c: Column) -> Column:
    """Whether a token of the text maps to a controlled predicate."""
    forms = F.array(*[F.lit(k) for k in sorted(V.predicate_forms()) if " " not in k])
    return F.arrays_overlap(F.split(T.fold_span(c), " "), forms)


def sentence_score(c: Column) -> Column:
    """0 to 1: how likely a sentence states a fact."""

    def judged(x: Column, low: Column) -> Column:
        ask = _instruction(low) | x.endswith("?")
        raw = F.lit(5) + F.when(has_predicate(x), 2).otherwise(0) + F.when(F.length(x).between(40, 220), 1).otherwise(0) - F.when(_has_marker(low), 5).otherwise(0) - F.when(ask, 3).otherwise(0)
        return F.when(x == "", 0.0).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), raw)) / 10)

    return let(_collapsed(c), lambda x: let(F.lower(x), lambda low: judged(x, low)))


def sentence_reason(c: Column) -> Column:
    """Why a candidate is no sentence: too_short, noise_marker or non_propositional_fragment; null if it is one."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    alpha = F.regexp_count(x, F.lit(r"[\p{L}]{2,}"))
    noise = x.rlike(r"(?i)[\x{200b}\x{2060}\x{feff}]|\bimage (source|caption)\b|\bcopy link\b|\bshare page\b|^\W*[0-9]{4}\s*\)|^\s*(retrieved|archived) [0-9]|\bjump (up|to)\b")
    verb = x.rlike(r"(?i)\b(is|are|was|were|be|been|has|have|had|do|does|did|will|would|can|could|won|played|held|led|made|became|founded|called|born|uses|includes)\b|\p{L}{2,}(ed|ing|ou|eu|iu|ava|aram|ando|endo|indo|ado|ido|ada|ida)\b|\b(é|foi|era|são|tem|está)\b")
    nav = x.rlike(r"(?i)^\s*(see also|external links?|further reading|bibliography|contents|notes?|ver também|refer[êe]ncias|edit(ar)?\s*$|full name|nickname|date of birth)\b")
    named = (alpha >= 4) & (F.contains(x, F.lit(",")) | (F.regexp_count(x, F.lit(r"\s\p{Lu}")) >= 2))
    return F.when(alpha < 3, "too_short").when(noise, "noise_marker").when(verb, F.lit(None).cast("string")).when(nav, "noise_marker").when(F.regexp_count(x, F.lit("[0-9]+")) >= 2, "non_propositional_fragment").when(named, F.lit(None).cast("string")).otherwise("non_propositional_fragment")


# fixed values
TRUSTED_TLDS = (".edu", ".gov", ".org", ".ac.")
LOW_TRUST = ("blogspot", "wordpress", "medium.com", "tumblr", "substack")
SENSATIONAL = ("inacreditável", "urgente", "escândalo", "misterioso", "chocante", "imperdível", "surpreendente", "absurdo", "revelado", "exclusivo", "breaking", "shocking", "unbelievable", "scandal", "outrageous")


def domain_score(host: Column, reputable: tuple[str, ...] = (), technical: tuple[str, ...] = ()) -> Column:
    """0.9 by top level domain, 0.85 reputable publishers, 0.8 technical ones, 0.4 blogs, else 0.6; the first that holds."""

    def under(names: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for n in names:
            found |= (host == n) | host.endswith("." + n)
        return found

    def within(parts: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(host, p)) if parts else F.lit(False)

    return F.when(within(TRUSTED_TLDS), 0.9).when(under(reputable), 0.85).when(within(technical), 0.8).when(within(LOW_TRUST), 0.4).otherwise(0.6)


def sensationalism(c: Column) -> Column:
    """Share of sensational words, times 50, 1 at most."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(*SENSATIONAL)))
    return F.when(F.size(words) > 0, F.least(F.lit(1.0), hits / F.size(words) * 50)).otherwise(0.0)


def confidence(host: Column, c: Column, **kinds) -> Column:
    return F.round(F.greatest(F.lit(0.0), domain_score(host, **kinds) - F.when(sensationalism(c) > 0.15, 0.5).otherwise(0.0)), 3)


def contains_fact(c: Column, fact: Column) -> Column:
    """Whether half of the fact's words of 4 or more letters are in the text."""
    words = F.filter(F.split(F.lower(fact), r"\W+"), lambda w: F.length(w) >= 4)
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(F.lower(c), w))) * 2 >= F.size(words))


def containing(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, item_id): contains_fact of every text and every fact (item_id, text); ids that repeat count once.

    A word of a fact is looked for within the words of texts, each different one once: it has no other characters, so it can't reach over their ends.
    """
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) >= 4)
    told = facts.select("item_id", words.alias("words")).filter("size(words) > 0").distinct()
    spread = told.select("item_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    # a word that a fact holds twice counts twice
    spread = spread.groupBy("item_id", "n", "word").agg(F.count("*").alias("times"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("token"))
    pairs = contained(tokens.select("token").distinct(), ["token"], "token", spread.select("word").distinct(), "word", small=0)
    hit = tokens.join(pairs, "token").select("doc_id", "word").distinct()
    met = hit.join(spread, "word").groupBy("doc_id", "item_id", "n").agg(F.sum("times").alias("hits"))
    return met.filter(F.col("hits") * 2 >= F.col("n")).select("doc_id", "item_id")


#: What a text that gives a credential away holds, in any case.
SECRET_MARKERS = ("password", "passwd", "secret", "token", "authorization", "bearer ", "auth-token", "api-key", "api_key", "bolt://", "private key")


def secret_markers(c: Column, markers: tuple[str, ...] = SECRET_MARKERS) -> Column:
    """The markers that a text holds, in order of the list."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, F.lower(m)))


def date_like(c: Column) -> Column:
    return F.trim(F.lower(c)).rlike(r"^([0-9]{4}|[0-9]{1,2}[/-][0-9]{1,2}([/-][0-9]{2,4})?|([0-9]{1,2} (de )?)?(janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|may|june|july|august|september|october|november|december)( (de )?[0-9]{4})?)$")
