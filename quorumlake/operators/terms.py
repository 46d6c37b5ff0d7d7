"""Terms: clean-up of spans, gates, how strongly a span names an entity, and how sources and labels are treated.

Every function takes and gives columns; null is treated as an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from .containment import contained


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def _upper(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}")


def without_determiners(c: Column) -> Column:
    """Without leading articles and determiners, however many; empty if there is nothing else."""
    t = tokens(c)
    kept = F.array_position(F.transform(t, lambda w: ~F.lower(w).isin(*V.DETERMINERS)), True).cast("int")
    return F.when(kept > 0, F.array_join(F.slice(t, kept, F.size(t)), " ")).otherwise("")


def phrase(c: Column, most: int = 6) -> Column:
    """The first `most` tokens, without function words at their end."""
    t = F.slice(tokens(c), 1, most)
    last = F.array_max(F.filter(F.transform(t, lambda w, i: F.when(~F.lower(w).isin(*V.TRAILING), i + 1)), lambda i: i.isNotNull()))
    return F.array_join(F.slice(t, F.lit(1), F.coalesce(last, F.lit(0))), " ")


def _plain_term(c: Column) -> Column:
    low = F.lower(c)
    noise = F.lit(False)
    for m in V.TERM_NOISE:
        noise |= F.contains(low, F.lit(m))
    t = tokens(c)
    return (F.length(c) >= 3) & ~F.contains(c, F.lit("|")) & ~noise & (F.size(t) <= 5) & ~F.lower(F.get(t, F.lit(0))).isin(*V.TERM_PRONOUNS) & c.rlike(r"\p{L}")


def valid_term(c: Column) -> Column:
    """Whether a term may name an entity: short, without noise of an interface, no pronoun first, no soup of capitalised words."""
    t = tokens(c)
    soup = (F.size(t) >= 4) & (F.size(F.filter(t, _upper)) >= 3)
    return F.coalesce(_plain_term(c) & ~soup, F.lit(False))


def nominal_term(c: Column) -> Column:
    """The same for terms bounded by punctuation: names may be long, but no single character comes first and no two numbers stand in it."""
    t = tokens(c)
    initial = F.regexp_replace(F.get(t, F.lit(0)), "^[.,;:!?()'\\x{2019}\"]+|[.,;:!?()'\\x{2019}\"]+$", "").rlike(r"^[\p{L}\p{N}]$")
    return F.coalesce(_plain_term(c) & ~initial & (F.size(F.filter(t, lambda w: w.rlike("^[0-9]+$"))) < 2), F.lit(False))


def strength(c: Column, known: Column, holds_known: Column, predicate: Column) -> Column:
    """strong, generic or weak. known: whether the folded span is a known entity; holds_known: whether it holds one, which counts but for SER."""
    folded = T.fold_span(c)
    t = tokens(c)
    generic = F.arrays_overlap(F.split(folded, " "), F.array(*[F.lit(w) for w in V.GENERIC_NOUNS]))
    named = F.size(F.filter(t, _upper)) >= 2
    return (
        F.when(folded == "", "weak").when(known, "strong").when((predicate != "SER") & holds_known, "strong").when(generic, "generic")
        .when(F.get(t, F.lit(0)).rlike(r"^\p{Ll}"), "weak").when(named, "strong").otherwise("weak")
    )


def after_generic(c: Column) -> Column:
    """What follows a generic noun from its first capitalised word on (the Brazilian team Botafogo: Botafogo); the span itself without such."""
    t = tokens(c)
    at = F.array_position(F.transform(t, lambda w: F.regexp_replace(F.lower(w), "^[.,;:!?()]+|[.,;:!?()]+$", "").isin(*V.GENERIC_NOUNS)), True).cast("int")
    rest = F.slice(t, at + 1, F.size(t))
    named = F.array_position(F.transform(rest, lambda w: _upper(w) & (F.length(w) > 1)), True).cast("int")
    return F.when((at > 0) & (named > 0), F.array_join(F.slice(rest, named, F.size(rest)), " ")).otherwise(c)


def rescued_toponym(term: Column, text: Column) -> Column:
    """São <term> (or Sao) where a term of one word stands so in the text, else the term."""
    x = F.trim(F.coalesce(term, F.lit("")))
    quoted = F.concat(F.lit(r"(?U)\bS[ãa]o\s+\Q"), x, F.lit(r"\E\b"))
    found = F.regexp_substr(F.coalesce(text, F.lit("")), quoted)
    return F.when((x == "") | F.contains(x, F.lit(" ")) | found.isNull(), x).otherwise(found)


def without_parentheses(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)\s*", " "))


def club_mention(c: Column) -> Column:
    """White space collapsed, parentheses and the punctuation around gone."""
    x = without_parentheses(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.regexp_replace(x, r"^[ \x{2013}\x{2014}:;.,-]+|[ \x{2013}\x{2014}:;.,-]+$", "")


def competition_label(c: Column) -> Column:
    """Key of a competition: white space collapsed, lower case, without a colon at the end and footnote marks."""
    x = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.trim(F.regexp_replace(F.regexp_replace(x, ":+$", ""), r"\[[0-9]+\]", ""))


def url_path(url: Column) -> Column:
    """Decoded path in lower case without accents and outer slashes."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"\+", "%2B")
    return F.regexp_replace(T.unaccent(F.coalesce(F.try_url_decode(path), path)), "^/+|/+$", "")


def pinned_subjects(pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """pages (url) with `pinned`: the subject (of pos, token, subject) of the first token that is in the path; null without."""
    paths = pages.select("url").distinct().withColumn("__path", url_path(F.col("url")))
    found = contained(paths, ["url"], "__path", subjects.select("pos", F.col("token").alias("__token"), F.col("subject").alias("__subject")), "__token")
    first = found.groupBy(F.col("url").alias("__url")).agg(F.min_by("__subject", F.struct("pos", "__token", "__subject")).alias("pinned"))
    return pages.join(first, F.col("url").eqNullSafe(F.col("__url")), "left").drop("__url")


def extraction_policy(url: Column) -> Column:
    """table_only, narrative_plus_table or narrative_default, by host."""
    host = T.domain_of(url)
    only = F.lit(False)
    for d in V.TABLE_ONLY:
        only |= (host == d) | host.endswith("." + d)
    return F.when(only, "table_only").when(host.isin(*V.NARRATIVE_AND_TABLE), "narrative_plus_table").otherwise("narrative_default")


def first_targets(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (id, group, haystack) that hold an alias (group, pos, alias, target) of their group: the target of the first such alias.

    Joined on the group, so that only the aliases of a group are looked for in its facts, each alias once at its first place. What is found is
    reduced to the least place, a number, while it is read: nothing of the size of all that is found is sorted.
    """
    first = aliases.groupBy("group", "alias").agg(F.min("pos").alias("pos"))
    found = facts.join(first, "group").filter(F.contains("haystack", F.col("alias"))).groupBy("id", "group").agg(F.min("pos").alias("pos"))
    targets = aliases.groupBy("group", "pos").agg(F.min("target").alias("target"))
    return found.join(targets, ["group", "pos"], "left").select("id", "group", "target")
