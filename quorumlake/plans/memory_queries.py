"""Queries on episodes, rate limits, working memory, chat history, vectors and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import simulate as S
from ..operators import vectors as V
from .bindings import EPISODES, episode_events
from .registry import query

_TIMES = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at"


def _shown(eps):
    return eps.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).withColumn("last_seen_at", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss"))


@query("k02_episodes", EPISODES + f" SELECT fact_hash, CAST(day AS VARCHAR) AS day, subject, predicate, object, {_TIMES}, replays, weight FROM episodes")
def _(t):
    return _shown(M.episodes(episode_events(t))).drop("source_domain", "status")


@query("a09_episode_tally", EPISODES + " SELECT subject, predicate, object, CAST(sum(replays) AS BIGINT) AS replays FROM episodes GROUP BY 1, 2, 3 HAVING sum(replays) >= 2")
def _(t):
    return M.tally(M.episodes(episode_events(t)))


@query("a10_log_replays", "WITH last AS (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 5000) SELECT upper(event_type) AS predicate, 'USER ' || (user_id % 40) AS subject, count(*) AS replays FROM last GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    last = t("events").orderBy(F.desc("ts"), "event_id").limit(5000)
    return last.groupBy(F.upper("event_type").alias("predicate"), F.concat(F.lit("USER "), F.col("user_id") % 40).alias("subject")).agg(F.count("*").alias("replays")).filter("replays >= 3")


_TALLY = ", tally AS (SELECT subject, predicate, object, CAST(sum(replays) AS BIGINT) AS replays FROM episodes GROUP BY 1, 2, 3 HAVING sum(replays) >= 3)"


@query("a11_inverse_edges", EPISODES + _TALLY + " SELECT subject, predicate, object, replays FROM tally UNION ALL SELECT object, predicate || '_by', subject, replays FROM tally WHERE predicate IN ('click', 'view')")
def _(t):
    return M.with_inverses(M.tally(M.episodes(episode_events(t)), 3), {"click": "click_by", "view": "view_by"})


@query(
    "k03_consolidate",
    EPISODES
    + _TALLY
    + """, old AS (SELECT DISTINCT subject, predicate, object, 1::BIGINT AS replays FROM ev WHERE predicate <> 'view')
SELECT subject, predicate, object, coalesce(t.replays, o.replays) AS replays, round(coalesce(t.replays, o.replays) * 0.1::DOUBLE, 4) AS weight, t.replays IS NOT NULL AS consolidated FROM old o FULL JOIN tally t USING (subject, predicate, object)""",
)
def _(t):
    ev = episode_events(t)
    old = ev.filter("predicate <> 'view'").select("subject", "predicate", "object").distinct().withColumn("replays", F.lit(1).cast("bigint"))
    return M.consolidate(old, M.tally(M.episodes(ev), 3))


@query("k04_mark_episodes", EPISODES + " SELECT fact_hash, CAST(day AS VARCHAR) AS day, CASE WHEN fact_hash IN (SELECT fact_hash FROM episodes WHERE replays > 2) THEN 'consolidated' ELSE 'new' END AS status FROM episodes")
def _(t):
    eps = M.episodes(episode_events(t))
    return _shown(M.mark(eps, eps.filter("replays > 2").select("fact_hash"))).select("fact_hash", "day", "status")


@query("k05_prune_episodes", EPISODES + f" SELECT fact_hash, CAST(day AS VARCHAR) AS day, {_TIMES} FROM episodes WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY ORDER BY episodes.last_seen_at DESC, fact_hash, day LIMIT 1000")
def _(t):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return _shown(M.prune(M.episodes(episode_events(t)), now, 10, 1000)).select("fact_hash", "day", "created_at", "last_seen_at")


@query("w01_recent_episodes", EPISODES + f" SELECT fact_hash, CAST(day AS VARCHAR) AS day, {_TIMES} FROM episodes ORDER BY episodes.last_seen_at DESC, fact_hash, day LIMIT 20")
def _(t):
    return _shown(M.recent(M.episodes(episode_events(t)))).select("fact_hash", "day", "created_at", "last_seen_at")


@query(
    "w03_volatile_episodes",
    EPISODES
    + """, tot AS (SELECT fact_hash, sum(replays) AS n FROM episodes GROUP BY 1), r AS (SELECT * FROM episodes ORDER BY last_seen_at DESC, fact_hash, day LIMIT 20)
SELECT fact_hash, CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS total, CASE WHEN n >= 3 THEN 'consolidated' WHEN n > 1 THEN 'repeated' ELSE 'new' END AS status, round(n * 0.1::DOUBLE, 2) AS weight FROM r JOIN tot USING (fact_hash)""",
)
def _(t):
    return _shown(M.volatile(M.episodes(episode_events(t)))).select("fact_hash", "day", "total", "status", "weight")


@query(
    "x01_rate_limit",
    """SELECT event_id, attempts, attempts <= 5 AS allowed, CASE WHEN attempts <= 5 THEN 0 ELSE greatest(1, ceil(3600 - (epoch_us(ts) - oldest) / 1e6)) END::INT AS retry_after FROM (
  SELECT *, count(*) OVER w AS attempts, min(epoch_us(ts)) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW))""",
)
def _(t):
    return M.rate_limit(t("events").select("event_id", F.col("user_id").alias("key"), "ts"), 5, 3600).select("event_id", "attempts", "allowed", "retry_after")


@query(
    "x05_working_memory",
    """WITH a AS (SELECT x.event_id, y.event_type AS c, max(y.ts) AS last FROM events x JOIN events y ON x.user_id % 20 = y.user_id % 20 AND y.ts <= x.ts AND y.ts >= x.ts - INTERVAL 3600 SECOND GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY last DESC) AS n FROM a) SELECT event_id, string_agg(c, ',' ORDER BY c) AS active FROM r WHERE n <= 3 GROUP BY 1""",
)
def _(t):
    acts = t("events").select("event_id", (F.col("user_id") % 20).alias("mind"), F.col("event_type").alias("concept"), "ts")
    return M.working_memory(acts, 3, 3600).select("event_id", F.array_join("active", ",").alias("active"))


@query("a42_coactivation", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM d x JOIN d y USING (user_id, day) WHERE x.event_type < y.event_type GROUP BY 1, 2")
def _(t):
    return M.coactivations(t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("active")))


@query("w11_chat_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def _(t):
    return M.history(t("conversations"), 3).select("conv_id", "turn", "role")


@query("w11_session_eviction", "SELECT conv_id, max(turn) AS last, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY last DESC, conv_id LIMIT 200")
def _(t):
    return M.sessions(t("conversations"))


@query(
    "r03_vector_top_k",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 3""",
)
def _(t):
    e = t("embeddings")
    return V.top_k(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v"))).withColumn("score", F.round("score", 4))


@query("c19_cosine_to_next", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    e = t("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 4).alias("score"))


@query("c18_hash_embedding")
def _(t):
    return t("documents").select("doc_id", V.hash_embedding(F.col("text"), 64).alias("v"))


@query("r09_resolve_entities")
def _(t):
    p = t("part").select("p_partkey", "p_name", "p_brand")
    return V.resolve_entities(p.select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), V.hash_embedding(F.col("p_name"), 64).alias("v")))


_ROUND = """r{i} AS (SELECT n.name, CASE WHEN max(o.name) IS NULL THEN max(n.stance) ELSE least(1, greatest(0, 0.65::DOUBLE * max(n.stance) + 0.35::DOUBLE * coalesce(
  sum(o.stance * o.w) FILTER (abs(o.stance - n.stance) <= 0.25::DOUBLE) / sum(o.w) FILTER (abs(o.stance - n.stance) <= 0.25::DOUBLE), sum(o.stance * o.w) / sum(o.w)))) END AS stance, max(n.w) AS w
  FROM r{j} n LEFT JOIN x ON x.name = n.name LEFT JOIN r{j} o ON o.name = x.neighbour GROUP BY n.name)"""
_SWARM = """WITH x AS (SELECT DISTINCT a AS name, b AS neighbour FROM (SELECT cn.n_nationkey AS a, sn.n_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE l_quantity >= 49 AND o_totalprice > 400000
  UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation) WHERE a <> b),
r0 AS (SELECT n_nationkey AS name, (n_nationkey % 7) / 6.0::DOUBLE AS stance, 1.0::DOUBLE + n_nationkey % 3 AS w FROM nation), """ + ", ".join(_ROUND.format(i=i, j=i - 1) for i in (1, 2, 3))


def _swarm(t):
    n = t("nation")
    big = t("orders").filter("o_totalprice > 400000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem").filter("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = big.select(F.col("c_nationkey").alias("name"), F.col("s_nationkey").alias("neighbour")).union(n.select("n_nationkey", (F.col("n_nationkey") + 1) % 25)).filter("name <> neighbour").distinct()
    key = F.col("n_nationkey")
    return n.select(key.alias("name"), (key % 7 / 6.0).alias("stance"), (1.0 + key % 3).cast("double").alias("influence")), edges


@query("r10_swarm_rounds", _SWARM + " SELECT 0 AS round, name, round(stance, 6) AS stance FROM r0 UNION ALL SELECT 1, name, round(stance, 6) FROM r1 UNION ALL SELECT 2, name, round(stance, 6) FROM r2 UNION ALL SELECT 3, name, round(stance, 6) FROM r3")
def _(t):
    agents, edges = _swarm(t)
    return S.run(agents, edges, 3).withColumn("stance", F.round("stance", 6))


@query("r11_inject", "SELECT n_nationkey AS name, CASE n_nationkey WHEN 3 THEN 1.0 WHEN 4 THEN 0.25 ELSE round((n_nationkey % 7) / 6.0::DOUBLE, 6) END AS stance FROM nation")
def _(t):
    fixed = t.spark.createDataFrame([(3, 7.0), (4, 0.25), (99, 0.5)], "name int, stance double")
    return S.inject(_swarm(t)[0], fixed).select("name", F.round("stance", 6).alias("stance"))


@query("a41_simulation_report", _SWARM + " SELECT count(*) AS agents, round(avg(stance), 3) AS mean, round(stddev_pop(stance), 3) AS std, round(greatest(0, least(1, 1 - 2 * stddev_pop(stance))), 3) AS consensus FROM r3")
def _(t):
    agents, edges = _swarm(t)
    return S.report(S.run(agents, edges, 3).filter("round = 3"), 10).select("agents", "mean", "std", "consensus")


@query("a41_stance_histogram", "SELECT bucket, count(*) AS agents FROM (SELECT round((n_nationkey % 7) / 6.0::DOUBLE, 1) AS bucket FROM nation) GROUP BY 1")
def _(t):
    return S.histogram(_swarm(t)[0])
