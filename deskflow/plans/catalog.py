"""All queries of the library's own operators, with the SQL of those that SQL can express.

The driver's tables are not agents' data. Each query runs an operator over columns that stand in for it, which its
docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.functions import config_text, schedule
from deskflow.functions import text as T
from deskflow.operators import capabilities, health, memory, messages, routing
from deskflow.plans.registry import ORACLE_SQL, QUERIES, query, table, values  # noqa: F401
from deskflow.session import ship

_CLASS = T.WHITE


def _js_trim(s: str) -> str:
    return f"regexp_replace({s}, '\\A{_CLASS}+|{_CLASS}+\\z', '', 'g')"


# --- messages -------------------------------------------------------------------------------------------------------


@query(f"""
WITH l AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) AS raw FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
t AS (SELECT conv_id, {_js_trim('raw')} AS reply FROM l)
SELECT conv_id, CASE WHEN length(reply) <= 1900 THEN reply ELSE substr(reply, 1, 1900) || '…' END AS reply FROM t WHERE length(reply) > 0
""")
def final_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final replies of conversations."""
    return messages.final_replies(table(spark, sf_dir, "conversations"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of listed types, types standing in for channels."""
    listed = values(spark, "('click'), ('view')", "channel")
    return messages.allowed(table(spark, sf_dir, "events"), listed, "event_type").select("event_id", "event_type")


@query("SELECT event_type, count(*) FILTER (event_type IN ('click', 'view')) AS n_sent, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_rejected FROM events GROUP BY event_type")
def outbound_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of listed types count as sent, all others as rejected."""
    sent, rejected = messages.split_outbound(table(spark, sf_dir, "events").select("event_id", "event_type"), values(spark, "('click'), ('view')", "channel"), "event_type")
    both = sent.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)
    return both.groupBy("event_type").agg(F.count_if(F.col("error").isNull()).alias("n_sent"), F.count_if(F.col("error").isNotNull()).alias("n_rejected"))


@query(f"""
WITH m AS (SELECT doc_id, source, doc_id % 2 = 0 AS mentions, '<@!' || doc_id || '>  ' || CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS content FROM documents),
p AS (SELECT doc_id, {_js_trim("regexp_replace(content, '<@!?[0-9]+>" + _CLASS + "*', '', 'g')")} AS prompt FROM m WHERE mentions AND source IN ('src0', 'src1', 'src2', 'src3') AND doc_id <> 6)
SELECT doc_id, prompt FROM p WHERE length(prompt) > 0
""")
def gate_and_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as channel messages: source is the channel, even ids mention us, id 6 is our own."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.lit("<@!"), F.col("doc_id"), F.lit(">  "), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")))
    rows = docs.select("doc_id", F.col("source").alias("channelId"), F.col("doc_id").cast("string").alias("authorId"), content.alias("content"), (F.col("doc_id") % 2 == 0).alias("mentionsBot"))
    listed = values(spark, "('src0'), ('src1'), ('src2'), ('src3')", "channel")
    return messages.prompts(rows, listed, own="6").select("doc_id", "prompt")


@query("SELECT event_id, user_id FROM events WHERE user_id <> 7")
def self_loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of other users than 7."""
    return table(spark, sf_dir, "events").where(messages.not_own(F.col("user_id").cast("string"), "7")).select("event_id", "user_id")


@query("""
SELECT conv_id::VARCHAR || '-' || turn AS id, conv_id::VARCHAR AS "channelId", role AS "authorId", upper(role) AS "authorName", text AS content, turn % 3 = 0 AS "mentionsBot" FROM conversations
""")
def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as raw API messages, every third mentioning the bot 999, flattened."""
    t = table(spark, sf_dir, "conversations")
    mentions = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("999").alias("id")))).otherwise(F.array(F.struct(F.lit("1").alias("id"))))
    raw = t.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("channel_id"), F.struct(F.col("role").alias("id"), F.upper("role").alias("username")).alias("author"), F.col("text").alias("content"), mentions.alias("mentions"))
    return messages.from_raw(raw, "999")


@query("""
WITH o AS (SELECT user_id, ts, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM events WHERE event_type IN ('click', 'purchase')),
g AS (SELECT user_id, epoch, (arg_max(event_id, (ts, event_id)) FILTER (event_type = 'click')) AS inbound_id, max(event_id) FILTER (event_type = 'purchase') AS end_id FROM o GROUP BY user_id, epoch)
SELECT user_id, inbound_id, end_id FROM g WHERE inbound_id IS NOT NULL AND end_id IS NOT NULL
""")
def pending_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are inbound messages, purchases are turn ends, a user is an agent."""
    kind = F.col("event_type")
    return routing.pending_replies(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", kind == "click", kind == "purchase")


@query("SELECT event_type, event_id, ts, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS rn FROM events) WHERE rn <= 20")
def fetch_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 events of each type."""
    return messages.newest(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_type", "event_id", "ts", "rn")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
r AS (SELECT event_type, string_agg('[' || event_id || '] ' || user_id || ': ' || props, chr(10) ORDER BY rn) AS rendered FROM n WHERE rn <= 50 GROUP BY event_type)
SELECT w.event_type, coalesce(r.rendered, '(no messages)') AS rendered FROM (VALUES ('click'), ('error'), ('nothing')) w(event_type) LEFT JOIN r USING (event_type)
""")
def fetch_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events of a type as lines; 200 are asked for and 50 given."""
    rows = messages.newest(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", 200)
    lines = messages.rendered(rows, "event_type", "event_id", "user_id", "props")
    return messages.with_default(lines, values(spark, "('click'), ('error'), ('nothing')", "event_type"), "event_type", "rendered", "(no messages)")


@query("""
SELECT conv_id, coalesce(nullif(string_agg(text, '' ORDER BY turn) FILTER (conv_id % 3 <> 0), ''), arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant')) AS captured FROM conversations GROUP BY conv_id
""")
def text_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text deltas; every third conversation has none and falls back to its last assistant turn."""
    t = table(spark, sf_dir, "conversations")
    deltas = t.where("conv_id % 3 <> 0").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("delta"))
    everyone = t.select("conv_id").distinct()
    return everyone.join(messages.captured_text(deltas, t), "conv_id", "left").select("conv_id", "captured")


@query("SELECT conv_id, turn, upper(role) || text AS flat FROM conversations")
def content_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as arrays of blocks, one of which is no text."""
    blocks = F.array(*[F.struct(F.lit(k).alias("type"), v.alias("text")) for k, v in (("text", F.upper("role")), ("image", F.lit("skip")), ("text", F.col("text")))])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.flatten_content(blocks).alias("flat"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 60)::VARCHAR ELSE '?' END AS retry_after FROM events WHERE event_type = 'error'")
def throttle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as responses of status 429, every second with a retry-after header."""
    e = table(spark, sf_dir, "events")
    header = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("retry-after"), (F.col("event_id") % 60).cast("string"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    rows = e.select("event_id", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), header.alias("headers"))
    return messages.throttled(rows).select("event_id", "retry_after")


# --- memory ---------------------------------------------------------------------------------------------------------


@query("""
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE e.vec_id <> 0 ORDER BY score DESC, e.vec_id LIMIT 5
""")
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as memories, vector 0 as the query; cosine is this library's choice of a score."""
    v = table(spark, sf_dir, "embeddings")
    return memory.recall(v.where("vec_id <> 0"), v.where("vec_id = 0"))


_FIXED = "CASE WHEN part > 0.5 OR (part = 0.5 AND err >= 0) THEN floor(p) + 1 ELSE floor(p) END::BIGINT"


@query(f"""
WITH s AS (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE e.vec_id <> 0 ORDER BY score DESC, e.vec_id LIMIT 25),
a AS (SELECT *, abs(score) * 1000.0::DOUBLE AS p, abs(score) * 134217729.0::DOUBLE AS c FROM s),
b AS (SELECT *, c - (c - abs(score)) AS high FROM a),
d AS (SELECT *, (high * 1000.0::DOUBLE - p) + (abs(score) - high) * 1000.0::DOUBLE AS err, p - floor(p) AS part FROM b),
n AS (SELECT *, {_FIXED} AS n FROM d),
l AS (SELECT vec_id, score, '[' || CASE WHEN score < 0 THEN '-' ELSE '' END || (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') || '] 2024-05-0' || (vec_id % 9 + 1) || ' mem-' || vec_id || ': memory ' || vec_id AS line FROM n)
SELECT string_agg(line, chr(10) ORDER BY score DESC, 'mem-' || vec_id) AS rendered FROM l
""")
def recall_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as lines; 999 are asked for and 25 given."""
    v = table(spark, sf_dir, "embeddings")
    top = memory.recall(v.where("vec_id <> 0"), v.where("vec_id = 0"), 999)
    ident = F.col("vec_id").cast("string")
    created = F.concat(F.lit("2024-05-0"), (F.col("vec_id") % 9 + 1).cast("string"), F.lit("T00:00:00Z"))
    return memory.render_hits(top.select(F.concat(F.lit("mem-"), ident).alias("id"), F.concat(F.lit("memory "), ident).alias("content"), created.alias("createdAt"), "score"))


@query("SELECT w.doc_id, coalesce(d.text, '(not found)') AS text FROM (VALUES (5::BIGINT), (17), (123456789)) w(doc_id) LEFT JOIN documents d USING (doc_id)")
def memory_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by id, one of which isn't there."""
    return memory.get(table(spark, sf_dir, "documents"), values(spark, "(5L), (17L), (123456789L)", "doc_id"), "doc_id", "text")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def memory_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as writes of one memory each conversation; the last one is its value."""
    return memory.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""
SELECT 'user' || user_id || '-' || (epoch_us(ts) // 1000) AS id, 'user' || user_id AS "agentId", event_type AS content, CASE WHEN event_id % 2 = 0 THEN 'persistent' ELSE 'standard' END AS durability, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "createdAt", NULL::VARCHAR AS supersedes FROM events WHERE event_type = 'signup'
""")
def memory_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as memories to write."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return memory.new_memory(e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("agentId"), ms.alias("ms"), F.col("event_type").alias("content"), F.when(F.col("event_id") % 2 == 0, "persistent").alias("durability"), F.lit(None).cast("string").alias("supersedes")))


@query("SELECT coalesce(c, '') AS content, CASE WHEN vec_id % 4 = 0 THEN '' ELSE 'm' || vec_id END AS id, NULL::VARCHAR AS \"createdAt\", CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id / 8.0::DOUBLE END AS score FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'c' END AS c FROM embeddings)")
def hit_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as search results whose fields may be missing or no numbers."""
    v, n = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    score = F.when(n % 5 == 0, "high").otherwise((n / F.lit(8.0)).cast("string"))
    return memory.hits(v.select(F.when(n % 4 != 0, F.concat(F.lit("m"), n.cast("string"))).alias("id"), F.when(n % 3 != 0, "c").alias("content"), F.lit(None).cast("string").alias("createdAt"), score.alias("score")))


# --- health ---------------------------------------------------------------------------------------------------------

_CHECKS = "SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'skip' WHEN l.toxic = 1 THEN 'fail' WHEN l.quality = 0 THEN 'warn' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in health.STATUSES)


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as checks: without a label skipped, toxic failed, of low quality warned."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    status = F.when(F.col("there").isNull(), "skip").when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warn").otherwise("ok")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", status.alias("status"))


@query(f"SELECT source, {_COUNTS} FROM ({_CHECKS}) GROUP BY source")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of documents by source."""
    return health.summary(_checks(spark, sf_dir), "source")


@query(f"""
SELECT *, CASE WHEN n_fail > 0 THEN n_fail || ' of ' || (n_ok + n_fail + n_skip + n_warn) || ' checks FAILING. See above for fixes.'
  WHEN n_warn > 0 THEN n_warn || ' warning' || CASE WHEN n_warn > 1 THEN 's' ELSE '' END || ', but no hard failures.' ELSE 'All green.' END AS verdict, (n_fail > 0)::INTEGER AS exit_code
FROM (SELECT doc_id % 97 AS agent, {_COUNTS} FROM ({_CHECKS}) GROUP BY doc_id % 97)
""")
def health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of documents dealt to 97 agents."""
    return health.verdict(health.summary(_checks(spark, sf_dir).withColumn("agent", F.col("doc_id") % 97), "agent"))


def _part_checks(parts: DataFrame, agent: Column) -> DataFrame:
    """Parts as checks: every fourth fails and names a fix, every second has a detail."""
    key = F.col("p_partkey")
    return parts.select(agent.alias("agent"), key.alias("pos"), F.col("p_brand").alias("name"), F.when(key % 4 == 0, "fail").otherwise("ok").alias("status"), F.when(key % 2 == 0, F.col("p_type")).otherwise("").alias("detail"), F.when(key % 4 == 0, F.concat(F.lit("see "), F.col("p_name"))).alias("fix"))


@query("""
WITH c AS (SELECT p_size % 7 AS agent, p_partkey AS pos, p_brand AS name, CASE WHEN p_partkey % 4 = 0 THEN 'fail' ELSE 'ok' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS detail, CASE WHEN p_partkey % 4 = 0 THEN 'see ' || p_name END AS fix FROM part WHERE p_partkey <= 60),
w AS (SELECT agent, max(length(name)) AS w FROM c GROUP BY agent)
SELECT agent, string_agg('  ' || rpad(name, w::INTEGER, ' ') || '  ' || upper(status) || CASE WHEN detail <> '' THEN ' — ' || detail ELSE '' END || CASE WHEN coalesce(fix, '') <> '' THEN chr(10) || '  ' || repeat(' ', w) || '        fix: ' || fix ELSE '' END, chr(10) ORDER BY pos) AS report
FROM c JOIN w USING (agent) GROUP BY agent
""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts up to number 60 as checks, rendered; ``health_report_all`` renders every part."""
    return health.report(_part_checks(table(spark, sf_dir, "part").where("p_partkey <= 60"), F.col("p_size") % 7))


@query("""
WITH c AS (SELECT p_partkey // 100 AS agent, p_partkey AS pos, p_brand AS name, CASE WHEN p_partkey % 4 = 0 THEN 'fail' ELSE 'ok' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS detail, CASE WHEN p_partkey % 4 = 0 THEN 'see ' || p_name END AS fix FROM part),
w AS (SELECT agent, max(length(name)) AS w FROM c GROUP BY agent)
SELECT agent, string_agg('  ' || rpad(name, w::INTEGER, ' ') || '  ' || upper(status) || CASE WHEN detail <> '' THEN ' — ' || detail ELSE '' END || CASE WHEN coalesce(fix, '') <> '' THEN chr(10) || '  ' || repeat(' ', w) || '        fix: ' || fix ELSE '' END, chr(10) ORDER BY pos) AS report
FROM c JOIN w USING (agent) GROUP BY agent
""")
def health_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a check, rendered; a hundred consecutive numbers are an agent, so reports don't grow with the table."""
    return health.report(_part_checks(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 100)))


@query("SELECT event_id, lpad(to_base(event_id % 512, 8), 3, '0') AS mode, ((event_id % 512) & 73) = 0 AS not_executable, (event_id % 512) <> 384 AS not_private FROM events")
def mode_octal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids as file modes."""
    mode = F.col("event_id") % 512
    return table(spark, sf_dir, "events").select("event_id", T.octal_mode(mode).alias("mode"), T.not_executable(mode).alias("not_executable"), T.not_private(mode).alias("not_private"))


@query(f"SELECT doc_id, coalesce(sha256(text), '') AS before_sha256, sha256({_js_trim('text')}) AS after_sha256, text <> {_js_trim('text')} AS changed FROM documents")
def persona_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts before and after trimming."""
    return health.drift(table(spark, sf_dir, "documents"), F.col("text"), T.js_trim(F.col("text"))).select("doc_id", "before_sha256", "after_sha256", "changed")


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def inbox_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, errors as poison."""
    return health.counters(table(spark, sf_dir, "events"), F.col("event_type") == "error", "user_id")


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS n_new, count(*) FILTER (event_id % 3 <> 0) AS n_cur FROM events")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files, a third of them new."""
    return health.folder_counts(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "new").otherwise("cur").alias("folder")))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, to_json({'id': event_id, 'k': json_extract_string(props, '$.k')::BIGINT})::VARCHAR AS body FROM events")
def json_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties parsed and written as JSON."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("body"))


@query("SELECT 'new/' || event_id || CASE WHEN event_id % 5 = 0 THEN '.txt' ELSE '.json' END AS file FROM events WHERE event_id % 5 <> 0 AND event_type <> 'view'")
def unseen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files; every fifth has another suffix, views have been seen."""
    from deskflow.sources import files

    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    named = e.select(F.concat(F.lit("new/"), n.cast("string"), F.when(n % 5 == 0, ".txt").otherwise(".json")).alias("file"), "event_type")
    return files.unseen(named.select("file"), named.where("event_type = 'view'"))


# --- schedules ------------------------------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 09:00:00', TIMESTAMP '2024-01-31 09:00:00', INTERVAL 1 DAY)) AS tick)
SELECT 'brief' AS name, k.tick, count(e.event_id) AS n_events FROM k LEFT JOIN events e ON e.ts <= k.tick AND (e.ts > k.tick - INTERVAL 1 DAY OR k.tick = TIMESTAMP '2024-01-01 09:00:00') GROUP BY k.tick
""")
def cron_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ticks of January 2024 with the events since the tick before; bad entries don't hinder the good one."""
    entries = values(spark, "('brief', '0 9 * * *', 'Brief me.'), ('bad', 'not a cron expr', 'x'), ('odd', '@@@', 'x'), ('empty', '* * * * *', '')", "name, schedule, prompt")
    return schedule.events_per_tick(schedule.ticks(entries, "2024-01-01 00:00:00", "2024-02-01 00:00:00"), table(spark, sf_dir, "events"))


@query("""
WITH RECURSIVE t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02 23:55:00', INTERVAL 5 MINUTE)) AS tick),
b AS (SELECT tick, ((date_part('epoch', tick)::BIGINT // 300) * 37 % 1000) AS seconds FROM t),
f AS (SELECT tick, seconds FROM b WHERE tick = TIMESTAMP '2024-01-01'
  UNION ALL SELECT n.tick, n.seconds FROM (SELECT f.tick AS was, min(b.tick) AS next FROM f JOIN b ON b.tick > f.tick + to_seconds(f.seconds) GROUP BY f.tick) x JOIN b n ON n.tick = x.next)
SELECT 'poll' AS name, tick FROM f
""")
def cron_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks every five minutes of two days, each fire busy for a made-up time; ticks meanwhile are skipped."""
    entries = values(spark, "('poll', '*/5 * * * *', 'Poll.')", "name, schedule, prompt")
    ticks = schedule.ticks(entries, "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    busy = ticks.withColumn("seconds", F.expr("(unix_timestamp(cast(tick as timestamp)) div 300) * 37 % 1000"))
    return schedule.coalesced(ticks, busy).select("name", "tick")


# --- configuration, capabilities and text ------------------------------------------------------------------------------

_CATALOG = "('chat', '/pkg/chat', false), ('recall', '/pkg/recall', false), ('mail', '/pkg/mail', true), ('fixture', '/pkg/fixture', false)"


@query("""
SELECT * FROM VALUES ('a', '/pkg/chat,/pkg/recall', NULL::VARCHAR), ('b', NULL, 'capability "chat" is declared twice'), ('c', NULL, 'capability "nope" is unknown'),
  ('d', NULL, 'capability "mail" is not there yet'), ('e', '', NULL), ('f', NULL, 'capability "chat" config is invalid: missing property /channel'), ('g', NULL, 'capability "zip" is unknown') AS t(agent, packages, error)
""")
def resolve_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared capabilities of seven agents against a catalog; the first offender is reported."""
    agents = values(
        spark,
        "('a', array('chat', 'recall'), map('channel', '1')), ('b', array('chat', 'recall', 'chat'), map('channel', '1')), ('c', array('chat', 'nope', 'mail'), map('channel', '1')), "
        "('d', array('mail'), map('channel', '1')), ('e', cast(array() as array<string>), map('channel', '1')), ('f', array('chat'), map('flag', 'true')), ('g', array('zip', 'chat'), map('other', '1'))",
        "agent, names, config",
    )
    error = capabilities.config_error(F.col("config"), {"channel": (capabilities.DIGITS, True), "flag": (capabilities.FLAG, False)})
    agents = agents.withColumn("config_errors", F.when(error.isNull(), F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.lit("chat"), error)))
    return capabilities.resolve(agents.drop("config"), values(spark, _CATALOG, "name, package, not_yet"))


@query("""SELECT * FROM VALUES (1, NULL::VARCHAR), (2, 'missing property /channel'), (3, 'invalid value at /channel'), (4, 'unexpected property /secret'), (5, 'invalid value at /flag') AS t(id, error)""")
def config_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations under rules that reject what they don't know."""
    rows = values(spark, "(1, map('channel', '12', 'flag', 'true')), (2, map('flag', 'true')), (3, map('channel', 'x1')), (4, map('channel', '1', 'secret', 's')), (5, map('channel', '1', 'flag', 'yes'))", "id, config")
    return rows.select("id", capabilities.config_error(F.col("config"), {"channel": (capabilities.DIGITS, True), "flag": (capabilities.FLAG, False)}).alias("error"))


@query("SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation whose segment was seen before."""
    return capabilities.duplicates(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_nationkey", "c_mktsegment", "c_custkey")


@query("SELECT 'a' AS agent, unnest(['APP_CAP_CHAT_1', 'APP_CAP_X']) AS key, unnest(['{\"k\":\"3\"}', '{\"k\":\"2\"}']) AS value")
def capability_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of capabilities; chat-1 and chat_1 clash and the last wins."""
    rows = values(spark, "('a', 0, 'chat-1', map('k', '1')), ('a', 1, 'x', map('k', '2')), ('a', 2, 'chat_1', map('k', '3'))", "agent, pos, name, config")
    return capabilities.config_env(rows, "APP_CAP_").select("agent", F.explode("env").alias("key", "value"))


@query("SELECT * FROM VALUES ('app', 'lib', '^1.0.0', '1.2.0'), ('tool', 'lib', '1.1.9', '1.2.0') AS t(package, dep, declared, shipped)")
def dep_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four packages, two of which declare another version than ships; in one a later section decides."""
    rows = values(
        spark,
        "('app', '2.0.0', map('lib', '^1.0.0', 'left', '1'), cast(map() as map<string,string>), null), ('lib', '1.2.0', null, map('app', 'workspace:*'), null), "
        "('tool', '0.1.0', map('lib', '^1.2.0'), map('lib', '1.1.9'), null), ('kit', '0.1.0', map('lib', '1.0'), null, map('lib', 'workspace:^'))",
        "name, version, dependencies, devDependencies, peerDependencies",
    )
    return capabilities.lockstep(rows)


@query("SELECT n_nationkey, CASE WHEN n_name = 'FRANCE' THEN 'GERMANY' ELSE n_name END AS mapped, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'override' END, n_name) AS model, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS captured FROM nation")
def provider_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as providers; one maps to another, every third model is overridden, every second output is kept."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", T.mapped(name, {"FRANCE": "GERMANY"}).alias("mapped"), T.override(F.when(key % 3 == 0, F.lit("override")), name).alias("model"), T.only_if(key % 2 == 0, name).alias("captured"))


@query("""
SELECT p_partkey, regexp_matches(lower(p_brand), '\\A[a-z0-9-]+\\z') AS valid, 'CAP_' || regexp_replace(upper(p_name), '[^A-Z0-9]', '_', 'g') AS env, upper(substr(lower(p_name), 1, 1)) || substr(lower(p_name), 2) AS capital,
  replace(replace(replace(replace(replace('<' || p_name || '> & "' || p_type || '''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
  rtrim(p_name || repeat('/', p_size % 4), '/') AS url, 'gui/' || p_size AS domain, 'unit-' || p_partkey || '.service' AS unit, CASE WHEN p_size % 2 = 0 THEN '/home/u' || '/' || p_name ELSE p_name END AS path, substr(repeat(p_type, 20), 1, 200) AS short_error FROM part
""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions for names over parts."""
    key, name, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size")
    home = F.when(size % 2 == 0, F.concat(F.lit("~/"), name)).otherwise(name)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        capabilities.valid_name(F.lower("p_brand")).alias("valid"),
        T.env_var_name(name, "CAP_").alias("env"),
        T.capitalised(F.lower(name)).alias("capital"),
        T.xml_escape(F.concat(F.lit("<"), name, F.lit('> & "'), F.col("p_type"), F.lit("'"))).alias("xml"),
        T.without_trailing_slashes(F.concat(name, F.repeat(F.lit("/"), size % 4))).alias("url"),
        F.concat(F.lit("gui/"), size.cast("string")).alias("domain"),
        F.concat(F.lit("unit-"), key, F.lit(".service")).alias("unit"),
        T.expand_home(home, F.lit("/home/u")).alias("path"),
        T.bounded_error(F.repeat(F.col("p_type"), F.lit(20))).alias("short_error"),
    )


@query("""SELECT * FROM VALUES (1, 'string', 'true'), (2, 'boolean', 'true'), (3, 'number', '-42'), (4, 'string', 'plain # kept'), (5, 'string', '111'), (6, 'string', '4.2'), (7, 'number', '7'), (8, 'string', '') AS t(id, kind, value)""")
def scalar_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare values of configuration text and their kinds."""
    rows = values(spark, """(1, '"true"'), (2, ' true '), (3, '-42'), (4, 'plain # kept'), (5, "'111'"), (6, '4.2'), (7, '"7'), (8, '')""", "id, raw")
    return rows.select("id", T.coerce_scalar(F.col("raw")).alias("c")).select("id", "c.kind", "c.value")


@query("SELECT * FROM VALUES (1, 'a|b c|d', 'b c d'), (2, '', NULL::VARCHAR), (3, '111', NULL) AS t(id, parts, rest)")
def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in text; and the words after the first on end."""
    rows = values(spark, """(1, ' a, "b c" ,, d'), (2, ' , '), (3, "'111'")""", "id, raw")
    parts = T.split_list(F.col("raw"))
    return rows.select("id", F.array_join(parts, "|").alias("parts"), T.rest_of_words(parts).alias("rest"))


@query("SELECT * FROM VALUES ('a b!(~)*', 'a%20b!(~)*'), ('👍', '%F0%9F%91%8D'), ('x/y?z=1&w', 'x%2Fy%3Fz%3D1%26w') AS t(raw, encoded)")
def url_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL components."""
    return values(spark, "('a b!(~)*'), ('👍'), ('x/y?z=1&w')", "raw").select("raw", T.url_component(F.col("raw")).alias("encoded"))


@query("SELECT * FROM VALUES (1, '0.063'), (2, '1.000'), (3, '0.910'), (4, '?'), (5, '-0.125'), (6, '12.346') AS t(id, shown)")
def score_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to three decimals of their exact binary value."""
    return values(spark, "(1, 0.0625D), (2, 1.0005D), (3, 0.91D), (4, cast(null as double)), (5, -0.125D), (6, 12.3456D)", "id, score").select("id", T.fixed3(F.col("score")).alias("shown"))


_TEXT = """# an agent
name: helper
capabilities:
  - chat
  # a comment
  - "recall"
chat:
  channelIds:
    - "111"
    - 222
  dispatchAll: true
  nested:
    deep: 5
provider:
  name: 'gateway'
  model: m-1
cron:
  - name: brief
    schedule: "0 9 * * *"
    prompt: "Compose the brief."
  - name: broken
    schedule: x
chat:
  dispatchAll: false
  inline: [1, two, "3"]
"""


@query()
def config_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readers of configuration text over one document, as (reader, name, pos, kind, value)."""
    config_text.register(ship(spark))
    doc = spark.createDataFrame([(_TEXT,)], "text string")
    doc.createOrReplaceTempView("deskflow_config_doc")
    return spark.sql("""
      SELECT 'capabilities' AS reader, r.name, r.pos, 'string' AS kind, r.name AS value FROM deskflow_config_doc, LATERAL read_capabilities(text) r
      UNION ALL SELECT 'block', r.key, r.pos, r.kind, r.value FROM deskflow_config_doc, LATERAL read_block(text, 'chat') r
      UNION ALL SELECT 'cron', r.name, r.pos, r.schedule, r.prompt FROM deskflow_config_doc, LATERAL read_cron(text) r
      UNION ALL SELECT 'provider', 'model', NULL, 'string', r.value FROM deskflow_config_doc, LATERAL read_provider_field(text, 'model') r
    """)
