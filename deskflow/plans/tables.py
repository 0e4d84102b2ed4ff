"""Queries that run operators with few rows of their own over whole driver tables, and sources over files made of them.

As in ``catalog``, columns stand in for agents' data; each docstring says which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.functions import config_text, schedule
from deskflow.functions import text as T
from deskflow.operators import capabilities, messages
from deskflow.plans.registry import query, table, values
from deskflow.session import scratch, ship
from deskflow.sources import files, outbox


def text_of(*parts: str | Column) -> Column:
    """Parts on end: columns as text, strings as they are."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- configuration and capabilities ----------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unexpected property /secret' WHEN event_id % 5 = 0 THEN 'missing property /channel'
  WHEN event_id % 7 = 0 THEN 'invalid value at /channel' WHEN event_id % 6 = 0 THEN 'invalid value at /flag' END AS error FROM events
""")
def config_check_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as configurations: some lack a channel, hold a bad one, a bad flag or a key that no rule knows."""
    n = F.col("event_id")
    entries = [
        F.when(n % 5 != 0, F.struct(F.lit("channel").alias("key"), text_of(F.when(n % 7 == 0, "x").otherwise(""), F.col("user_id")).alias("value"))),
        F.when(n % 2 == 0, F.struct(F.lit("flag").alias("key"), F.when(n % 6 == 0, "yes").otherwise("true").alias("value"))),
        F.when(n % 11 == 0, F.struct(F.lit("secret").alias("key"), F.lit("s").alias("value"))),
    ]
    config = F.map_from_entries(F.array_compact(F.array(*entries)))
    return table(spark, sf_dir, "events").select("event_id", capabilities.config_error(config, {"channel": (capabilities.DIGITS, True), "flag": (capabilities.FLAG, False)}).alias("error"))


@query("""
WITH a AS (SELECT c_custkey AS agent, c_custkey % 7 AS x, c_custkey // 7 % 7 AS y FROM customer),
e AS (SELECT *, CASE WHEN x > 4 THEN 'capability "r' || x || '" is unknown' WHEN x = 4 THEN 'capability "r4" is not there yet' WHEN y = x THEN 'capability "r' || y || '" is declared twice'
  WHEN y > 4 THEN 'capability "r' || y || '" is unknown' WHEN y = 4 THEN 'capability "r4" is not there yet' END AS error FROM a)
SELECT agent, CASE WHEN error IS NULL THEN '/pkg/r' || x || ',/pkg/r' || y END AS packages, error FROM e
""")
def resolve_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents that declare two capabilities each; regions are the catalog, of which the last isn't there yet."""
    key = F.col("c_custkey")
    agents = table(spark, sf_dir, "customer").select(key.alias("agent"), F.array(text_of("r", key % 7), text_of("r", F.floor(key / 7) % 7)).alias("names"))
    region = F.col("r_regionkey")
    return capabilities.resolve(agents, table(spark, sf_dir, "region").select(text_of("r", region).alias("name"), text_of("/pkg/r", region).alias("package"), (region == 4).alias("not_yet")))


@query("""
SELECT c_nationkey AS agent, 'APP_CAP_' || regexp_replace(upper(c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '-1' ELSE '_1' END), '[^A-Z0-9]', '_', 'g') AS key, arg_max('{"k":"' || c_custkey || '"}', c_custkey) AS value
FROM customer GROUP BY ALL
""")
def capability_env_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as agents, their customers as capabilities, named by segment with a hyphen or an underscore, which clash."""
    key = F.col("c_custkey")
    name = text_of(F.col("c_mktsegment"), F.when(key % 2 == 0, "-1").otherwise("_1"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("agent"), key.alias("pos"), name.alias("name"), F.create_map(F.lit("k"), key.cast("string")).alias("config"))
    return capabilities.config_env(rows, "APP_CAP_").select("agent", F.explode("env").alias("key", "value"))


@query("""
WITH m AS (SELECT s_suppkey AS k, 'lib' || s_suppkey AS name, '1.' || (s_suppkey % 10) || '.0' AS version, 'lib' || (s_suppkey * 7 % 50 + 1) AS dep, CASE WHEN s_suppkey % 4 = 0 THEN 'workspace:*' ELSE '^1.' || (s_suppkey % 3) || '.0' END AS declared FROM supplier)
SELECT m.name AS package, m.dep, m.declared, o.version AS shipped FROM m JOIN m o ON o.name = m.dep WHERE m.declared <> 'workspace:*' AND NOT contains(m.declared, o.version)
""")
def lockstep_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages that depend on another one; in every fourth a later section declares a workspace marker."""
    key = F.col("s_suppkey")
    dep = text_of("lib", key * 7 % 50 + 1)
    none = F.lit(None).cast("map<string,string>")
    return capabilities.lockstep(
        table(spark, sf_dir, "supplier").select(
            text_of("lib", key).alias("name"),
            text_of("1.", key % 10, ".0").alias("version"),
            F.create_map(dep, text_of("^1.", key % 3, ".0")).alias("dependencies"),
            F.when(key % 4 == 0, F.create_map(dep, F.lit("workspace:*"))).otherwise(none).alias("devDependencies"),
            none.alias("peerDependencies"),
        )
    )


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 3 = 0")
def env_config_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as configuration in JSON; every third is cut short and gives none, shown as -1."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("raw"))
    return files.env_config(rows, "raw", "k long").select("event_id", F.coalesce("config.k", F.lit(-1)).alias("k"))


@query("SELECT c_custkey AS agent, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, '') AS text FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def personas_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents, names of every second nation as personas."""
    texts = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("agent"), F.col("n_name").alias("text"))
    agents = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("agent"))
    return capabilities.personas(agents, texts).select(F.col("c_custkey").alias("agent"), "text")


# --- text ------------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 5 THEN 'number' ELSE 'string' END AS kind,
  CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'true' WHEN 2 THEN '-' || p_size WHEN 3 THEN p_type || ' # kept' WHEN 4 THEN p_partkey::VARCHAR ELSE p_size::VARCHAR END AS value FROM part
""")
def scalar_coerce_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bare values: quoted names, booleans, negative numbers, plain text, quoted numbers, unbalanced quotes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kinds = [text_of('"', F.col("p_name"), '"'), F.lit("  true "), text_of("-", size), text_of(F.col("p_type"), " # kept"), text_of("'", key, "'"), text_of('"', size)]
    raw = F.element_at(F.array(*kinds), (key % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.coerce_scalar(raw).alias("c")).select("p_partkey", "c.kind", "c.value")


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size AS parts, p_type || ' ' || p_size AS rest FROM part")
def split_list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, type and size of parts as a list in text with quotes, spaces and empty places."""
    parts = T.split_list(text_of(" ", F.col("p_brand"), ', "', F.col("p_type"), '",, ', F.col("p_size"), " ,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"), T.rest_of_words(parts).alias("rest"))


@query("SELECT p_partkey, replace(replace(replace(replace(url_encode(p_name || '/é?=&+~ (' || p_size || ')!'), '%21', '!'), '%28', '('), '%29', ')'), '%7E', '~') AS encoded FROM part")
def url_encoding_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with reserved characters as URL components."""
    return table(spark, sf_dir, "part").select("p_partkey", T.url_component(text_of(F.col("p_name"), "/é?=&+~ (", F.col("p_size"), ")!")).alias("encoded"))


@query("""
WITH a AS (SELECT o_orderkey, o_totalprice / 128.0::DOUBLE - 500 AS x FROM orders),
b AS (SELECT *, abs(x) * 1000.0::DOUBLE AS p, abs(x) * 134217729.0::DOUBLE AS c FROM a),
d AS (SELECT *, c - (c - abs(x)) AS high, p - floor(p) AS part FROM b),
e AS (SELECT *, (high * 1000.0::DOUBLE - p) + (abs(x) - high) * 1000.0::DOUBLE AS err FROM d),
n AS (SELECT *, CASE WHEN part > 0.5 OR (part = 0.5 AND err >= 0) THEN floor(p) + 1 ELSE floor(p) END::BIGINT AS n FROM e)
SELECT o_orderkey, CASE WHEN x < 0 THEN '-' ELSE '' END || (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') AS shown FROM n
""")
def score_format_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders, scaled to both signs, as scores to three decimals."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.fixed3(F.col("o_totalprice") / 128.0 - 500).alias("shown"))


# --- configuration text ----------------------------------------------------------------------------------------------------


def _documents(parts: DataFrame) -> DataFrame:
    """(p_partkey, text): a configuration document of each part, with a block list or an inline one."""
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    listed = text_of("capabilities:\n  - ", F.col("p_brand"), '\n  # a comment\n\n  - "c', size, '"\n')
    inline = text_of("capabilities: [ ", F.col("p_brand"), ", 'c", size, "' ]\n")
    rest = text_of(
        "chat:\n  channelIds:\n    - \"", key, "\"\n    - ", size, "\n  dispatchAll: true\n  label: ", name, "\nprovider:\n  name: 'gateway'\n  model: ", F.col("p_type"),
        "\ncron:\n  - name: brief\n    schedule: \"0 9 * * *\"\n    prompt: \"", name, "\"\n  - name: j", size, "\n    schedule: */5 * * * *\nchat:\n  dispatchAll: false\n",
    )
    return parts.select("p_partkey", text_of("# an agent\nname: helper\n", F.when(key % 2 == 0, listed).otherwise(inline), rest).alias("text"))


@query("""
SELECT p_partkey, 'capabilities' AS reader, p_brand AS name, 0 AS pos, 'string' AS kind, p_brand AS value FROM part
UNION ALL SELECT p_partkey, 'capabilities', 'c' || p_size, 1, 'string', 'c' || p_size FROM part
UNION ALL SELECT p_partkey, 'block', 'channelIds', 0, 'string', p_partkey::VARCHAR FROM part
UNION ALL SELECT p_partkey, 'block', 'channelIds', 1, 'number', p_size::VARCHAR FROM part
UNION ALL SELECT p_partkey, 'block', 'dispatchAll', -1, 'boolean', 'false' FROM part
UNION ALL SELECT p_partkey, 'block', 'label', -1, 'string', p_name FROM part
UNION ALL SELECT p_partkey, 'cron', 'brief', 0, '0 9 * * *', p_name FROM part
UNION ALL SELECT p_partkey, 'cron', 'j' || p_size, 1, '*/5 * * * *', NULL FROM part
UNION ALL SELECT p_partkey, 'provider', 'model', -1, 'string', p_type FROM part
""")
def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readers of configuration text over a document of every part, as (p_partkey, reader, name, pos, kind, value); without a position it is -1."""
    config_text.register(ship(spark))
    docs = _documents(table(spark, sf_dir, "part"))
    return spark.sql(
        """
      SELECT p_partkey, 'capabilities' AS reader, r.name, r.pos, 'string' AS kind, r.name AS value FROM {docs}, LATERAL read_capabilities(text) r
      UNION ALL SELECT p_partkey, 'block', r.key, coalesce(r.pos, -1), r.kind, r.value FROM {docs}, LATERAL read_block(text, 'chat') r
      UNION ALL SELECT p_partkey, 'cron', r.name, r.pos, r.schedule, r.prompt FROM {docs}, LATERAL read_cron(text) r
      UNION ALL SELECT p_partkey, 'provider', 'model', -1, 'string', r.value FROM {docs}, LATERAL read_provider_field(text, 'model') r
    """,
        docs=docs,
    )


# --- messages --------------------------------------------------------------------------------------------------------------


@query("""
SELECT conv_id::VARCHAR || '-' || turn AS id, conv_id::VARCHAR AS "channelId", role AS "authorId", upper(role) AS "authorName", text AS content, turn % 3 = 0 AS "mentionsBot" FROM conversations WHERE role <> 'system'
""")
def gateway_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as gateway events, the bot being ``system``, which every third turn mentions; its own turns are left out."""
    t = table(spark, sf_dir, "conversations")
    users = F.when(F.col("turn") % 3 == 0, F.create_map(F.lit("system"), F.lit("S"))).otherwise(F.create_map(F.lit("user"), F.lit("U")))
    raw = t.select(text_of(F.col("conv_id"), "-", F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("channelId"), F.struct(F.col("role").alias("id"), F.upper("role").alias("username")).alias("author"), F.col("text").alias("content"), F.struct(users.alias("users")).alias("mentions"))
    return messages.from_gateway(raw, "system")


@query("""
SELECT conv_id::VARCHAR AS "channelId", CASE WHEN length(text) <= 1900 THEN text ELSE substr(text, 1, 1900) || '…' END AS content, turn::VARCHAR AS reply_to FROM conversations WHERE role = 'assistant' AND length(text) > 0
""")
def outbox_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as replies, written to an outbox by batch and read back."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = t.select(F.col("conv_id").cast("string").alias("channelId"), "text", F.col("turn").cast("string").alias("inbound_id"))
    return _through_outbox(outbox.replies(rows), "replies")


@query("SELECT event_type AS \"channelId\", event_id::VARCHAR AS \"messageId\", CASE event_id % 3 WHEN 0 THEN '%F0%9F%91%8D' WHEN 1 THEN 'ok%3A' || user_id ELSE '%E2%9C%85' END AS emoji FROM events")
def outbox_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reactions to messages, written to an outbox by batch and read back."""
    n = F.col("event_id")
    emoji = F.when(n % 3 == 0, F.lit("👍")).when(n % 3 == 1, text_of("ok:", F.col("user_id"))).otherwise(F.lit("✅"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("channelId"), n.cast("string").alias("messageId"), emoji.alias("emoji"))
    return _through_outbox(outbox.reactions(rows), "reactions")


def _through_outbox(rows: DataFrame, name: str) -> DataFrame:
    """Rows as two batches of an outbox, the second of which is written twice."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    write, half = outbox.append_to(path), F.pmod(F.hash(*rows.columns), F.lit(2))
    for number in (0, 1, 1):
        write(rows.where(half == number), number)
    return spark.read.parquet(path).select(rows.columns)


# --- files -----------------------------------------------------------------------------------------------------------------


def _write_files(rows: DataFrame, folder: str, name: str) -> None:
    """One file for each row of (path, content), below ``folder``, by the driver's file system; for few small files."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in rows.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.path}/{name}")
        stream = path.getFileSystem(conf).create(path)
        stream.write(bytearray(r.content.encode()))
        stream.close()


@query("SELECT 'm' || n_nationkey AS id, n_name AS body, n_regionkey::VARCHAR AS channel, false AS poison FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT NULL, NULL, NULL, true FROM nation WHERE n_nationkey % 6 = 0")
def inbox_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as message files of an inbox, every sixth of them broken, next to files with another suffix."""
    key, folder = F.col("n_nationkey"), scratch(spark, "inbox")
    good = F.to_json(F.struct(text_of("m", key).alias("id"), F.col("n_name").alias("body"), F.create_map(F.lit("channel"), F.col("n_regionkey").cast("string")).alias("headers")))
    rows = table(spark, sf_dir, "nation").select(text_of("n", key).alias("path"), F.when(key % 6 == 0, "{broken").otherwise(good).alias("content"))
    _write_files(rows, folder, "mail.json")
    _write_files(rows, folder, "note.txt")
    found = files.inbox(spark, f"{folder}/*")
    mail = lambda c: F.when(~F.col("poison"), c)
    return found.select(mail(F.col("mail.id")).alias("id"), mail(F.col("mail.body")).alias("body"), mail(F.col("mail.headers")["channel"]).alias("channel"), "poison")


@query("SELECT 'role' || n_nationkey AS role, 'You are ' || n_name AS text, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0")
def role_files_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as role folders; every third lacks its text, every fourth its settings."""
    n, key, folder = table(spark, sf_dir, "nation"), F.col("n_nationkey"), scratch(spark, "roles")
    path = text_of("role", key).alias("path")
    _write_files(n.where(key % 3 != 0).select(path, text_of("You are ", F.col("n_name")).alias("content")), folder, "soul.md")
    _write_files(n.where(key % 4 != 0).select(path, F.to_json(F.struct(F.col("n_name").alias("name"))).alias("content")), folder, "role.json")
    return files.role_files(spark, folder).select("role", "text", "name")


@query("SELECT 'pkg' || n_nationkey AS name, '1.' || n_regionkey || '.0' AS version, 'lib' AS dep, '^' || n_regionkey AS declared, length('pkg' || n_nationkey) + 0 AS n FROM nation")
def manifest_files_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as packages with a manifest file each."""
    key, region, folder = F.col("n_nationkey"), F.col("n_regionkey"), scratch(spark, "packages")
    body = F.to_json(F.struct(text_of("pkg", key).alias("name"), text_of("1.", region, ".0").alias("version"), F.create_map(F.lit("lib"), text_of("^", region)).alias("dependencies")))
    _write_files(table(spark, sf_dir, "nation").select(text_of("p", key).alias("path"), body.alias("content")), folder, "package.json")
    found = files.manifests(spark, folder)
    return found.select("name", "version", F.explode("dependencies").alias("dep", "declared"), F.length("name").cast("long").alias("n"))


@query("SELECT 'conf' || r_regionkey AS folder, '# ' || r_name || chr(10) || 'name: ' || lower(r_name) AS text, length('# ' || r_name || chr(10) || 'name: ' || lower(r_name)) AS size FROM region")
def config_files_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as configuration files, read whole, with what the file system says of them."""
    key, folder = F.col("r_regionkey"), scratch(spark, "conf")
    _write_files(table(spark, sf_dir, "region").select(text_of("conf", key).alias("path"), text_of("# ", F.col("r_name"), "\nname: ", F.lower("r_name")).alias("content")), folder, "agent.yaml")
    texts = files.config_text(spark, f"{folder}/*/agent.yaml").select(files.folder_of(F.col("path")).alias("folder"), "text")
    facts = files.file_facts(spark, folder).select(files.folder_of(F.col("path")).alias("folder"), F.col("length").alias("size"))
    return texts.join(facts, "folder")


# --- schedules -------------------------------------------------------------------------------------------------------------

_SECONDS = "(date_part('epoch', tick)::BIGINT // 60) * 37 % 1300"


@query(f"""
WITH RECURSIVE k AS (
  SELECT 'a' AS name, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 23:59:00', INTERVAL 5 MINUTE)) AS tick
  UNION ALL SELECT 'b', unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 23:59:00', INTERVAL 1 MINUTE))
  UNION ALL SELECT 'c', unnest(generate_series(TIMESTAMP '2024-01-01 00:30:00', TIMESTAMP '2024-01-01 23:59:00', INTERVAL 1 HOUR))
), t AS (
  SELECT name, tick, row_number() OVER (ORDER BY tick, name) AS i, to_seconds({_SECONDS}) AS busy FROM k WHERE name <> 'b' OR minute(tick) % 7 = 0
), f AS (
  SELECT 0::BIGINT AS i, ''::VARCHAR AS name, NULL::TIMESTAMP AS tick, NULL::TIMESTAMP AS started, NULL::TIMESTAMP AS free, NULL::TIMESTAMP AS fa, NULL::TIMESTAMP AS fb, NULL::TIMESTAMP AS fc
  UNION ALL
  SELECT i, name, tick, started, CASE WHEN fires THEN done ELSE free END, CASE WHEN fires AND name = 'a' THEN done ELSE fa END, CASE WHEN fires AND name = 'b' THEN done ELSE fb END, CASE WHEN fires AND name = 'c' THEN done ELSE fc END
  FROM (
    SELECT t.i, t.name, t.tick, f.free, f.fa, f.fb, f.fc, o.fires, CASE WHEN o.fires THEN greatest(t.tick, coalesce(f.free, t.tick)) END AS started, greatest(t.tick, coalesce(f.free, t.tick)) + t.busy AS done
    FROM f JOIN t ON t.i = f.i + 1, LATERAL (SELECT coalesce(t.tick > CASE t.name WHEN 'a' THEN f.fa WHEN 'b' THEN f.fb ELSE f.fc END, true) AS fires) o
  )
)
SELECT name, tick, started FROM f WHERE started IS NOT NULL
""")
def cron_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries of one agent whose fires take made-up times: a busy one delays the others, and skips its own ticks."""
    entries = values(spark, "('a', '*/5 * * * *', 'A.'), ('b', '*/7 * * * *', 'B.'), ('c', '30 * * * *', 'C.')", "name, schedule, prompt")
    ticks = schedule.ticks(entries, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    return schedule.coalesced(ticks, ticks.withColumn("seconds", F.expr("(unix_timestamp(cast(tick as timestamp)) div 60) * 37 % 1300")))
