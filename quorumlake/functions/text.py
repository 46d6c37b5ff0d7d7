"""Keys, folds, domains and clean-up of text, as Column -> Column functions that stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Characters that stand for one ASCII letter or digit with marks or in another shape (compatibility decomposition), and these."""
    found = {}
    for i in (*range(0xA0, 0x3000), *range(0xFF00, 0xFFF0)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            found[chr(i)] = plain
    return "".join(found), "".join(found.values())


_ACCENTED, _PLAIN = _plain_letters()
# fixed values
LEADING_ARTICLES = ("o", "a", "os", "as", "um", "uma", "uns", "umas", "the", "an", "this", "that", "these", "those")
KEYWORD_STOPWORDS = ("a", "o", "as", "os", "um", "uma", "de", "do", "da", "dos", "das", "e", "em", "no", "na", "que", "com", "por", "para", "se", "the", "of", "and", "to", "in", "is", "on", "for")


def unaccent(c: Column) -> Column:
    """Lower case without accents, composed or decomposed; other shapes of a letter become it, and ligatures of f their letters."""
    low = F.lower(c)
    x = low
    for joined, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = F.replace(x, F.lit(joined), F.lit(letters))
    # plain ASCII needs none of it
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), r"\p{M}", ""))


def fold_span(c: Column) -> Column:
    """Lower case, no accents, everything but a-z and 0-9 is one space, trimmed. Null is empty."""
    return F.trim(F.regexp_replace(unaccent(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def fold_key(c: Column) -> Column:
    """Key for dictionary lookups: unaccented; _ and - are spaces, other punctuation goes; leading articles go but for the last token."""
    x = F.regexp_replace(unaccent(F.trim(F.coalesce(c, F.lit("")))), "[_-]+", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    return F.regexp_replace(x, rf"^(?:(?:{'|'.join(LEADING_ARTICLES)}) )+(?=\S)", "")


def match_key(c: Column) -> Column:
    """Upper case letters and digits only, for tolerant matching."""
    return F.upper(F.regexp_replace(unaccent(F.coalesce(c, F.lit(""))), "[^a-z0-9]", ""))


def singular(c: Column) -> Column:
    """Without a trailing s, of more than 3 letters and not ss."""
    return F.when(c.endswith("s") & (F.length(c) > 3) & ~c.endswith("ss"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def domain_of(url: Column) -> Column:
    """Host in lower case without user, port and www."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(host, "^www[.]", "")


def base_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def fact_key(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("|", F.lower(s), F.upper(p), F.lower(o))


def fact_hash(s: Column, p: Column, o: Column) -> Column:
    return F.sha2(F.lower(F.concat_ws("|", F.trim(s), F.trim(p), F.trim(o))), 256)


def sentence_hash(s: Column, p: Column, o: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", s, p, o), 256), F.lit(1), F.lit(16))


def point_id(url: Column, ts: Column) -> Column:
    """Id of a vector, from the first 32 bits of a hash."""
    return F.conv(F.substr(F.sha2(F.concat_ws(":", url, ts), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % 100_000_000


def secret_fingerprint(c: Column) -> Column:
    return F.substr(F.sha2(c, 256), F.lit(1), F.lit(12))


def sentences(c: Column) -> Column:
    """Cut after . ! or ? and white space; blank ones go."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def keywords(c: Column, most: int = 6) -> Column:
    """The first `most` distinct words of two or more characters that aren't stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*KEYWORD_STOPWORDS))), 1, most)


def longest_keyword(words: Column) -> Column:
    """The first of the longest."""
    top = F.array_max(F.transform(words, lambda w: F.length(w)))
    return F.get(F.filter(words, lambda w: F.length(w) == top), F.lit(0))


def strip_html(c: Column) -> Column:
    """Text of HTML: scripts and styles go, tags become spaces, white space is collapsed."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))


def links(c: Column) -> Column:
    """Targets of href attributes in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit('href="([^"]+)"'), F.lit(1))


def mask_secrets(c: Column) -> Column:
    """Passwords in URIs, token headers, key=value of 8 or more characters and bearer tokens become ***."""
    x = F.regexp_replace(c, "([a-z][a-z0-9+.-]*://[^:/@ ]+:)[^@ ]+@", "$1***@")
    x = F.regexp_replace(x, "(?i)(x-[a-z-]*token: *)[^ ,;]+", "$1***")
    x = F.regexp_replace(x, "(?i)((?:password|passwd|secret|token|api_?key) *[=:] *[\"']?)[A-Za-z0-9+/_.=-]{8,}", "$1***")
    return F.regexp_replace(x, "(?i)(bearer +)[A-Za-z0-9._-]+", "$1***")


def clean_json(c: Column) -> Column:
    """The outermost braces or brackets of a text that holds JSON among prose or fences; null without."""
    found = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


def query_target(href: Column, name: str = "uddg") -> Column:
    """A redirect's decoded target in a query parameter, else the link itself."""
    found = F.try_parse_url(href, F.lit("QUERY"), F.lit(name))
    return F.coalesce(F.try_url_decode(found), href)


def strip_connectives(c: Column) -> Column:
    """Without leading connectives and a trailing verb, however many."""
    x = F.regexp_replace(c, "(?i)^(?:(?:e|ou|mas|que|and|or|but|then) )+", "")
    return F.trim(F.regexp_replace(x, "(?i)(?: (?:foi|era|ser|is|was|were|are))+$", ""))


def decode_bytes(c: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))


def region_for(kind: Column) -> Column:
    """The part of memory that a kind of memory belongs to."""
    # fixed values
    regions = {"working": "prefrontal", "episodic": "hippocampus", "semantic": "neocortex", "procedural": "basal_ganglia", "emotional": "amygdala"}
    pairs = [x for k, v in regions.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(kind)), F.lit("neocortex"))


def retry_after(seconds: Column, most: int = 60) -> Column:
    return F.least(F.greatest(F.coalesce(seconds, F.lit(1)), F.lit(1)), F.lit(most))
