"""Registered queries over records: look-ups, requests, shares, sessions, feedback, stored vectors, threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.operators import embed, exchange, learning, search, sessions, store
from graphloom.plans import catalogue as c
from graphloom.plans.catalogue import query
from graphloom.sources import fixture as fx
from graphloom.sources import scratch, stores
from graphloom.streaming import access

# the graph's records


def _id_of(s: str, p: str, o: str) -> str:
    import hashlib

    return hashlib.sha256(bytes.fromhex(c.store_id(s)) + p.encode() + bytes.fromhex(c.store_id(o))).hexdigest()[:32]


@query("triple_by_id", f"WITH {c.KG} SELECT id, s, p, o FROM k WHERE s = 'customer:7' AND p = 'in_nation'")
def triple_by_id(spark, d):
    one = c.named_kg(spark, d).where("s = 'customer:7' and p = 'in_nation'").first()
    return store.by_id(c.named_kg(spark, d), _id_of(one.s, one.p, one.o)).select("id", "s", "p", "o")


@query("resolve_identifier", "SELECT substr(sha256('nation:NATION_9'), 1, 32) AS by_value, substr(sha256('nation:NATION_9'), 1, 32) AS by_id")
def resolve_identifier(spark, d):
    n = store.nodes(fx.edges(spark, d))
    found = store.resolve(n, "nation:NATION_9")
    return search.one(n, by_value=found, by_id=store.resolve(n, found))


@query("trust_edges", "SELECT 'customer:' || c_custkey AS s, 'trusts' AS p, 'nation:' || n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def trust_edges(spark, d):
    k = c.named_kg(spark, d).where("p = 'in_nation' and s like 'customer:%'")
    return store.trust(k.select(F.col("s").alias("truster"), F.col("o").alias("trusted")))


@query("shares_list", f"WITH {c.KG} SELECT id AS triple_id, 'did:peer' AS recipient, o = 'region:ASIA' AS retracted FROM k WHERE p = 'in_region'")
def shares_list(spark, d):
    t = c.kg(spark, d).where("predicate = 'in_region'")
    gone = store.revoke(t, t.where("o = 'region:ASIA'"), c.AS_OF)[1]
    return store.shares(store.share(t, "did:peer").unionByName(gone))


@query("ingest_request", f"WITH {c.KG} SELECT id AS triple_id, 'request-1' AS source_id, 'conversation' AS source_type, 'chat' AS reference FROM k WHERE p = 'has_brand'")
def ingest_request(spark, d):
    facts = fx.edges(spark, d).where("p = 'has_brand'")
    _, bridge, source = store.ingest(facts.unionByName(facts), "request-1", "conversation", "chat")
    return bridge.join(source, "source_id")


@query(
    "tension_facts",
    f"""WITH {c.TENSE}, y AS (SELECT a_id, b_id, substr(sha256(unhex(substr(sha256(a_id), 1, 32)) || encode('tension_resolved_with') || unhex(substr(sha256(b_id), 1, 32))), 1, 32) AS about FROM x)
SELECT a_id AS s, 'tension_resolved_with' AS p, b_id AS o FROM y
UNION ALL SELECT about, 'tension_resolution_action', 'keep_a' FROM y UNION ALL SELECT about, 'tension_resolution_reasoning', 'older' FROM y""",
)
def tension_facts(spark, d):
    return store.resolution_facts(store.tensions(c.kg(spark, d).where("predicate = 'contains'")), "keep_a", "older")


@query("tension_classes", f"WITH {c.KG} SELECT subject, predicate, count(*) AS members FROM k WHERE w > 0 GROUP BY ALL HAVING count(DISTINCT object) > 1")
def tension_classes(spark, d):
    return store.tension_classes(c.kg(spark, d))


@query("predicate_counts", f"WITH {c.KG}, n AS (SELECT subject, predicate, count(*) AS n FROM k GROUP BY ALL) SELECT subject, string_agg(predicate || '=' || n, ',' ORDER BY predicate) AS counts FROM n GROUP BY subject")
def predicate_counts(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return store.predicate_counts(c.kg(spark, d)).select("subject", text.alias("counts"))


@query("collect_ids", f"WITH {c.HALF} SELECT id FROM k WHERE id LIKE '%1' AND s NOT IN (SELECT s FROM pol WHERE p = 'local_only') AND s NOT IN (SELECT s FROM pol WHERE p = 'shareable_with' AND o <> 'did:a')")
def collect_ids(spark, d):
    k = c.named_kg(spark, d)
    return exchange.collected(k.select("id", "s", "p", "o"), k.where("id like '%1'"), c.policies(spark, d), "did:a").select("id")


@query("bounds_nodes", f"WITH {c.KG}, w AS (SELECT id, subject, object, w FROM k WHERE p = 'in_nation'), n AS (SELECT count(DISTINCT v) AS n FROM (SELECT subject AS v FROM w UNION ALL SELECT object FROM w)) SELECT id FROM w WHERE id NOT IN (SELECT id FROM w ORDER BY w, id LIMIT (SELECT greatest(0, n - 800) // 2 FROM n))")
def bounds_nodes(spark, d):
    return learning.enforce(c.kg(spark, d).where("predicate = 'in_nation'"), 10_000_000, max_nodes=1000).select("id")


@query(
    "durations",
    "SELECT o_orderkey, concat_ws(' ', CASE WHEN t >= 86400 THEN t // 86400 || 'd' END, CASE WHEN t >= 3600 THEN t % 86400 // 3600 || 'h' END, CASE WHEN t >= 60 THEN t % 3600 // 60 || 'm' END, t % 60 || 's') AS lasted FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders)",
)
def durations(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", scores.duration(F.floor("o_totalprice")).alias("lasted"))


# retrieval


@query("search_confidence", f"WITH {c.FACTS}, {c.CONF}, {c.NV}, n1 AS ({c.NN} ORDER BY similarity DESC, nv.node LIMIT 8), one AS (SELECT src, arg_min(confidence, id) AS confidence FROM cc GROUP BY src) SELECT n1.node, similarity, round(coalesce(one.confidence, 0), 6) AS confidence FROM n1 LEFT JOIN one ON one.src = n1.node")
def search_confidence(spark, d):
    r = search.search_confident(fx.trade(spark, d), fx.nation_vectors(spark, d), c.conf_rows(spark, d), c.START, 8)
    return r.withColumn("confidence", F.round("confidence", 6))


@query("confidence_explained", f"WITH {c.FACTS}, {c.CONF} SELECT id, round(confidence, 6) AS confidence, n_sources, round(0.5 * reliability, 6) AS from_reliability, round(0.3 * diversity, 6) AS from_diversity, round(0.2 * centrality, 6) AS from_centrality FROM cc")
def confidence_explained(spark, d):
    e = search.explained(c.conf_rows(spark, d))
    part = lambda n: F.round(F.col(f"weights.{n}") * F.col(n), 6).alias(f"from_{n}")
    return e.select("id", F.round("confidence", 6).alias("confidence"), "n_sources", part("reliability"), part("diversity"), part("centrality"))


NEAR = "near AS (SELECT node FROM (VALUES ('NATION_3'), ('NATION_5')) v(node))"


@query(
    "working_facts",
    f"""WITH {c.FACTS}, {NEAR}, en AS (SELECT id, weight, src AS node FROM f UNION SELECT id, weight, dst FROM f),
a1 AS (SELECT id, max(weight) AS w, count(*) AS n FROM en JOIN near USING (node) GROUP BY id),
ring AS (SELECT DISTINCT en.node FROM en JOIN a1 USING (id) WHERE en.node NOT IN (SELECT node FROM near)),
a2 AS (SELECT id, max(weight) AS w, count(*) AS n FROM en JOIN ring USING (node) GROUP BY id),
u AS (SELECT id, 1 AS step, w, n FROM a1 UNION ALL SELECT id, 2, 0.5 * w, n FROM a2)
SELECT id, round(arg_min(w, step), 6) AS confidence, CAST(sum(n) AS BIGINT) AS times FROM u GROUP BY id""",
)
def working_facts(spark, d):
    near = spark.sql("SELECT 'NATION_3' AS node UNION ALL SELECT 'NATION_5'")
    return search.working_facts(near, c.trade_facts(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("working_pruned", f"WITH RECURSIVE {c.WSG}, z AS (SELECT node, 0.5 * confidence + 0.3 * exp(-1.0) + 0.2 * ln(1 + times) / ln(11.0) AS a FROM ws) SELECT node, round(a, 6) AS activation FROM z WHERE a >= 0.72")
def working_pruned(spark, d):
    ws = search.graph_working_set(c.trade_facts(spark, d), c.START, 2)
    return sessions.pruned(ws, F.lit(1800.0), 1800.0, 0.72).select("node", F.round("activation", 6).alias("activation"))


# sessions

SES = """ss AS (SELECT conv_id AS session_id, ['api', 'chat', 'room'][conv_id % 3 + 1] AS platform, 'p' || conv_id % 5 AS project, 'r' || conv_id % 7 AS room,
  CASE WHEN arg_max(role, (turn, role)) = 'assistant' THEN 'ended' ELSE 'active' END AS status, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 7 % 1000 AS INTEGER)) AS created FROM conversations GROUP BY conv_id)"""


def held(spark, d):
    """(session_id, platform, project, room, status, created, updated, ended, summary, themes): a session a conversation."""
    s, i = learning.sessions(fx.table(spark, d, "conversations")), F.col("session_id")
    created = F.timestamp_add("MINUTE", i * 7 % 1000, F.lit("2024-01-01").cast("timestamp_ntz"))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = F.array(F.lit("api"), F.lit("chat"), F.lit("room"))
    tag = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    return s.select("session_id", F.element_at(kinds, (i % 3 + 1).cast("int")).alias("platform"), tag("p", 5).alias("project"), tag("r", 7).alias("room"), "status", created.alias("created"), created.alias("updated"), none("timestamp_ntz").alias("ended"), none("string").alias("summary"), F.array().cast("array<string>").alias("themes"))


@query("sessions_filtered", f"WITH {SES} SELECT session_id, created FROM ss WHERE status = 'active' AND platform = 'chat' AND project = 'p1' ORDER BY created DESC, session_id DESC LIMIT 20")
def sessions_filtered(spark, d):
    return sessions.listed(held(spark, d), "active", "chat", "p1", 20).select("session_id", "created")


@query("session_in_room", f"WITH {SES} SELECT session_id, room FROM ss WHERE room = 'r3' AND status = 'active' ORDER BY created DESC, session_id DESC LIMIT 1")
def session_in_room(spark, d):
    return sessions.active_in(held(spark, d), "r3").select("session_id", "room")


@query("session_update", f"WITH {SES} SELECT session_id, CASE WHEN room = 'r2' THEN 'moved' ELSE project END AS project FROM ss UNION ALL SELECT -1, 'new'")
def session_update(spark, d):
    s = held(spark, d)
    new = sessions.get(s, 1).limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "project": F.lit("new")})
    return sessions.update(sessions.create(s, new), s.where("room = 'r2'").withColumn("project", F.lit("moved"))).select("session_id", "project")


@query("session_ended", f"WITH {SES} SELECT session_id, CASE WHEN session_id = 1 THEN 'ended' ELSE status END AS status, CASE WHEN session_id = 1 THEN 'done' END AS summary, CASE WHEN session_id = 1 THEN 'a,b' ELSE '' END AS themes, CASE WHEN session_id = 1 THEN TIMESTAMP '{c.AS_OF}' END AS ended FROM ss")
def session_ended(spark, d):
    return sessions.end(held(spark, d), 1, c.as_of(), "done", ["a", "b"]).select("session_id", "status", "summary", F.array_join("themes", ",").alias("themes"), "ended")


@query("exchanges_add", "SELECT conv_id AS session_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user' FROM conversations GROUP BY conv_id")
def exchanges_add(spark, d):
    rows = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role")
    new = rows.groupBy("session_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("user"))
    return sessions.add(rows, new, held(spark, d))


@query("insights_list", "SELECT turn AS insight_id, conv_id AS session_id, substr(text, 1, 20) AS content FROM conversations WHERE role = 'assistant' AND conv_id = 1 ORDER BY 1")
def insights_list(spark, d):
    found = fx.table(spark, d, "conversations").where("role = 'assistant'").select(F.col("turn").alias("insight_id"), F.col("conv_id").alias("session_id"), F.substring("text", 1, 20).alias("content"))
    return sessions.insights(sessions.add(found.limit(0), found, held(spark, d)), 1)


@query("session_start", f"WITH {c.FACTS}, {c.NV}, q AS (SELECT vec FROM nv WHERE node = '{c.START}') SELECT node, round(list_cosine_similarity(nv.vec, q.vec), 6) AS similarity FROM nv CROSS JOIN q ORDER BY similarity DESC, node LIMIT 20")
def session_start(spark, d):
    """The twenty nearest nodes that a new session's working set begins with."""
    return search.search(fx.trade(spark, d), fx.nation_vectors(spark, d), c.START, 20)


@query("patterns_filtered", "WITH pt AS (SELECT p_partkey AS id, lower(p_type) AS description, p_brand AS type, (p_size % 20) / 20.0::DOUBLE AS confidence, CASE WHEN p_size % 11 = 0 THEN 'archived' ELSE 'emerging' END AS status FROM part) SELECT id, confidence FROM (SELECT * FROM pt WHERE contains(description, 'e') AND status = 'emerging' AND type = (SELECT min(p_brand) FROM part) ORDER BY confidence DESC, id LIMIT 30) WHERE confidence >= 0.2")
def patterns_filtered(spark, d):
    part = fx.table(spark, d, "part")
    p = c.patterns(spark, d).join(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type")), "id")
    return learning.search_patterns(p, "E", 30, 0.2, "emerging", part.agg(F.min("p_brand")).first()[0]).select("id", "confidence")


# feedback and rates


@query("feedback_lookup", f"WITH {c.LOG} SELECT event_id, context, ref FROM log WHERE signal IS NOT NULL AND ref = 7 UNION ALL SELECT event_id, context, ref FROM log WHERE signal IS NOT NULL AND context = (SELECT min(context) FROM log)")
def feedback_lookup(spark, d):
    log = fx.access_log(spark, d)
    first = log.agg(F.min("context")).first()[0]
    return learning.feedback_of(log, ref=7).unionByName(learning.feedback_of(log, context=first)).select("event_id", "context", "ref")


@query("feedback_events", f"WITH {c.LOG}, cx AS (SELECT DISTINCT context, ref FROM log WHERE signal IN ('cited', 'relevant')) {c.PC.format('cx')}")
def feedback_events(spark, d):
    return learning.pair_counts(learning.positive_events(fx.access_log(spark, d)))


@query(
    "recompute_schedule",
    """WITH RECURSIVE w AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS start FROM events GROUP BY 1 HAVING count(*) / 10.0 * 1000 >= 100 AND count(*) / 10.0 * 1000 < 500),
r AS (SELECT min(start) AS start FROM w UNION ALL SELECT (SELECT min(w.start) FROM w WHERE w.start >= r.start + INTERVAL 86400 SECOND) FROM r WHERE r.start IS NOT NULL)
SELECT start FROM r WHERE start IS NOT NULL""",
)
def recompute_schedule(spark, d):
    rates = learning.insert_rates(fx.table(spark, d, "events")).withColumn("rate", F.col("rate") * 1000)
    return learning.recomputed(rates, "spectral", 86_400)


# stored vectors


@query("vectors_recomputed", f"WITH {c.THREE} SELECT id AS node, strategy, round(CASE WHEN strategy = 'spectral' THEN 2 ELSE 1 END * list_sum(vec), 4) AS total FROM lf")
def vectors_recomputed(spark, d):
    long, path = embed.long_form(fx.vectors(spark, d)).withColumnRenamed("id", "node"), scratch.new_dir(spark, "vectors")
    stores.save_vectors(long, path, 64)
    new = long.where("strategy = 'spectral'").withColumn("vec", F.transform("vec", lambda x: x * 2))
    back = embed.recompute(spark, path, new, "spectral", 64)
    return back.select("node", "strategy", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("first_vectors", f"WITH {c.T}, {c.NV}, kn AS (SELECT * FROM nv WHERE node NOT IN ('NATION_3', 'NATION_5')), e AS (SELECT src AS node, dst AS other FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst), m AS (SELECT e.node, avg(list_sum(kn.vec)) AS total FROM e JOIN kn ON kn.node = e.other WHERE e.node IN ('NATION_3', 'NATION_5') GROUP BY e.node) SELECT node, round(list_sum(vec), 4) AS total FROM kn UNION ALL SELECT node, round(total, 4) FROM m")
def first_vectors(spark, d):
    t, v = fx.trade(spark, d), fx.nation_vectors(spark, d)
    got = embed.first_vectors(v, t, v.where("node not in ('NATION_3', 'NATION_5')"), 64)
    return got.select("node", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# threads of a stream


@query(
    "stream_threads",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, g""",
)
def stream_threads(spark, d):
    return access.stream_threads(spark, d)


