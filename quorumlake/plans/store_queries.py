"""Queries that take their rows in by batches, through tables kept up with a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.small import checkpoints
from ..operators import extract as X
from ..streaming import cycle as C
from ..streaming import store as K
from .bindings import EPISODES, OCC, episode_events, occurrences
from .extract_queries import FORM_ROWS, VERB_TRIPLES_SQL
from .registry import query


def _taken(t, rows, part, batches: int, kept: K.Kept) -> str:
    """The store that holds rows after `batches` batches of them, by the number `part`."""
    store = f"{checkpoints(t.spark)}/store-{uuid.uuid4().hex}"
    for n in range(batches):
        K.apply(rows.filter(F.pmod(part, F.lit(batches)) == n), n, store, kept)
    return store


@query("x07_incremental_facts", OCC + """ SELECT fact_key, arg_min(subject, seq) AS subject, arg_min(predicate, seq) AS predicate, arg_min(object, seq) AS object, count(*) AS occurrences,
 count(DISTINCT domain) AS domains, count(DISTINCT url) AS urls, count(DISTINCT domain) >= 3 AS verified FROM occ GROUP BY fact_key""")
def _(t):
    """Facts of all line items, which arrive in three batches, each spread over all suppliers."""
    store = _taken(t, occurrences(t), F.col("seq.l_linenumber"), 3, K.FACTS)
    return K.current(t.spark, store, K.FACTS).drop("fact_hash")


_SHOWN = "fact_hash, CAST(day AS VARCHAR) AS day, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at, replays"


@query("x10_late_episodes", EPISODES + f" SELECT {_SHOWN} FROM episodes")
def _(t):
    """Episodes as put in less as taken back, over all changes: events come in three batches, each of which has late rows for days of those before."""
    store = _taken(t, episode_events(t), F.col("event_id"), 3, K.EPISODES)
    columns = [F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "last_seen_at")]]
    feed = K.changes(t.spark, store).select("fact_hash", *columns, "replays", F.when(F.col("op") == "+", 1).otherwise(-1).alias("sign"))
    net = feed.groupBy("fact_hash", "day", "created_at", "last_seen_at", "replays").agg(F.sum("sign").alias("n"))
    return net.filter("n <> 0").select("fact_hash", "day", "created_at", "last_seen_at", (F.col("replays") * F.col("n")).alias("replays"))


_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "a32_measured_cycle",
    rf"""WITH p AS (SELECT page_id, CASE WHEN strlen(url) % 11 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN strlen(url) % 11 = 0 THEN '' ELSE {_STRIPPED} END AS text FROM pages),
s AS (SELECT page_id, status, length(text)::BIGINT AS length, len(list_filter(string_split_regex(trim(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')), chr(1)), lambda x: trim(x) <> ''))::BIGINT AS sentences FROM p),
c AS (SELECT page_id AS id, unnest(string_split_regex(text, '[.;,:!?()\[\]\n\r]+')) AS c FROM p), {VERB_TRIPLES_SQL},
r AS (SELECT id, predicate, (len(string_split_regex(trim(subject), '\s+')) <= 4 AND len(string_split_regex(trim(object), '\s+')) <= 4) AS kept, lower(trim(subject)) || '|' || upper(trim(predicate)) || '|' || lower(trim(object)) AS k FROM t JOIN (VALUES {FORM_ROWS}) v(form, predicate) ON form = verb WHERE subject <> '' AND object <> ''),
g AS (SELECT id, count(*) AS raw, count(*) FILTER (kept) AS canonical, count(DISTINCT k) FILTER (kept) AS facts FROM r GROUP BY id),
z AS (SELECT page_id, status, length, sentences, coalesce(raw, 0)::BIGINT AS raw, coalesce(canonical, 0)::BIGINT AS canonical, coalesce(facts, 0)::BIGINT AS facts FROM s LEFT JOIN g ON id = page_id)
SELECT *, CASE WHEN status >= 400 THEN 'fetch_failed' WHEN length = 0 THEN 'empty_page' WHEN sentences = 0 THEN 'no_sentences' WHEN raw = 0 THEN 'no_triples' WHEN canonical = 0 THEN 'all_rejected' WHEN facts = 0 THEN 'not_persisted' ELSE 'ok' END AS stage FROM z""",
)
def _(t):
    """What became of each page in a cycle of two batches, by its own counters; pages of some lengths of url weren't found."""
    store = f"{checkpoints(t.spark)}/cycle-{uuid.uuid4().hex}"
    pages = t("pages").select("page_id", "url", F.when(F.octet_length("url") % 11 == 0, 404).otherwise(200).alias("status"), "html")
    for n in range(2):
        C.take(pages.filter(F.col("page_id") % 2 == n), n, store, lambda s, p, o: X.confidence(s, p, o) >= 0.95)
    return C.diagnosed(t.spark, store).drop("url")
