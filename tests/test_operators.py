"""The small cases of the surveyed project's own tests, and properties of the text functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskflow.functions import config_text, schedule
from deskflow.functions import text as T
from deskflow.operators import health, memory, messages, routing
from deskflow.sources import files, outbox


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "channel, content, mentions, every, prompt",
    [
        ("channel-A", "<@123> what's the brief?", True, False, "what's the brief?"),
        ("not-listed", "<@123> hi", True, False, None),
        ("channel-A", "ambient chatter", False, False, None),
        ("channel-A", "ambient", False, True, "ambient"),
        ("not-listed", "ambient", False, True, None),
        ("channel-A", "<@123>", True, False, None),
    ],
)
def test_prompts(spark, channel, content, mentions, every, prompt):
    rows = spark.createDataFrame([("1", channel, "u", "n", content, mentions)], "id string, channelId string, authorId string, authorName string, content string, mentionsBot boolean")
    listed = spark.createDataFrame([("channel-A",), ("channel-B",)], "channel string")
    assert [r.prompt for r in messages.prompts(rows, listed, every).collect()] == ([prompt] if prompt else [])


def test_pending_slot(spark):
    e = [(1, 1, "in"), (1, 2, "in"), (1, 3, "end"), (1, 4, "end"), (2, 5, "end"), (2, 6, "in"), (1, 7, "in")]
    rows = spark.createDataFrame(e, "agent long, ident long, kind string")
    got = routing.pending_replies(rows, "agent", ["ident"], "ident", F.col("kind") == "in", F.col("kind") == "end")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3)]


def test_bounds(spark):
    long = one(spark, T.bounded(F.lit("y" * 5000)))
    assert len(long) == 1901 and long.endswith("…")
    assert messages.limit_of(999, memory.RECALL_DEFAULT, memory.RECALL_MOST) == 25
    empty = spark.createDataFrame([], "id string, content string, createdAt string, score double")
    assert memory.render_hits(empty).first().rendered == "(no memories found)"
    hit = spark.createDataFrame([("pulse-1", "moved", "2026-05-29T00:00:00Z", 0.91)], empty.schema)
    assert memory.render_hits(hit).first().rendered == "[0.910] 2026-05-29 pulse-1: moved"


def test_recall_takes_one_query(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in memory.recall(v, v.where("vec_id = 3"), 2).collect()] == [3, 2]
    assert memory.recall(v, v.where("vec_id > 9")).count() == 0
    with pytest.raises(Exception, match="one query vector"):
        memory.recall(v, v.where("vec_id > 1")).collect()


def test_new_memory(spark):
    rows = spark.createDataFrame([("pulse", 1700000000000, "c", None, None)], "agentId string, ms long, content string, durability string, supersedes string")
    r = memory.new_memory(rows).first()
    assert (r.id, r.durability, r.createdAt) == ("pulse-1700000000000", "standard", "2023-11-14T22:13:20.000Z")


def test_missing_root(spark):
    rows = spark.createDataFrame([("a", 0, "fail"), ("a", 1, "ok"), ("b", 0, "ok"), ("b", 1, "warn")], "agent string, pos int, status string")
    assert sorted((r.agent, r.pos) for r in health.only_root_if_missing(rows).collect()) == [("a", 0), ("b", 0), ("b", 1)]


def test_require_allowed(spark):
    assert one(spark, messages.require_allowed(F.lit("a"), ["a"])) == "a"
    with pytest.raises(Exception, match="channel not allowed"):
        one(spark, messages.require_allowed(F.lit("b"), ["a"]))


@pytest.mark.parametrize(
    "cron, fine", [("0 9 * * *", True), ("not a cron expr", False), ("@@@", False), ("*/5 * * * *", True), ("0 25 * * *", False), ("0 9 * * 5", True), ("1-5,30 0-23/2 1 1 7", True), ("* * * *", False)]
)
def test_cron_grammar(spark, cron, fine):
    assert (one(spark, schedule.parsed(F.lit(cron))) is not None) == fine


def test_cron_ticks(spark):
    rows = spark.createDataFrame([("weekly", "0 9 * * 5", "p"), ("sunday", "30 1 * * 7", "p"), ("either", "0 0 15 * 1", "p")], "name string, schedule string, prompt string")
    got = {}
    for r in schedule.ticks(rows, "2024-01-01 00:00:00", "2024-01-31 00:00:00").collect():
        got.setdefault(r.name, []).append(r.tick.day)
    assert {k: sorted(v) for k, v in got.items()} == {"weekly": [5, 12, 19, 26], "sunday": [7, 14, 21, 28], "either": [1, 8, 15, 22, 29]}


def test_config_text():
    text = 'capabilities: [a, "b", ]\ndiscord:\n  ids: [111, 222]\n  empty:\n  flag: true\ncapabilities:\n  - z\n'
    assert config_text.capabilities(text) == ["a", "b"]
    assert config_text.block(text, "discord") == {"ids": [("number", "111"), ("number", "222")], "empty": [], "flag": ("boolean", "true")}
    assert config_text.block(text, "none") is None and config_text.block("x:\n", "x") == {}
    assert config_text.cron_entries("cron:\n  - name: a\n    schedule: '0 9 * * 5'\n  - prompt: p\nend: 1\n") == [{"name": "a", "schedule": "0 9 * * 5"}, {"prompt": "p"}]
    assert config_text.provider_field("provider:\n  name: \"x\"\n", "name") == "x"


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60))
def test_scalar_matches_column(spark, s):
    r = spark.createDataFrame([(s,)], "s string").select(T.coerce_scalar(F.col("s")).alias("c"), T.js_trim(F.col("s")).alias("t")).first()
    assert r.t == s.strip(config_text.SPACES)
    assert (r.c.kind, r.c.value) == config_text.scalar(s) or "\n" in s.strip(config_text.SPACES)


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_clean_is_idempotent_on_plain_text(spark, s):
    once = one(spark, T.clean_mentions(F.lit(s)))
    assert one(spark, T.clean_mentions(F.lit(once))) == once or "<@" in s


def test_inbox(spark, tmp_path):
    new = tmp_path / "new"
    new.mkdir()
    for name, body in (("1.json", '{"id": "m1", "body": "hello"}'), ("2.json", ""), ("3.json", "null"), ("4.json", "{bad"), ("note.txt", "x")):
        (new / name).write_text(body)
    got = {r.file.rpartition("/")[2]: (r.poison, r.mail.body if r.mail else None) for r in files.inbox(spark, str(new)).collect()}
    assert got["1.json"] == (False, "hello") and got["3.json"][0] and got["4.json"][0] and len(got) == 3
    empty = spark.createDataFrame([("2.json", "")], "path string, content string")
    assert files.parse_mail(empty).first().poison


def test_mail_consumer(spark, tmp_path):
    from deskflow.streaming import mail

    new, out, mark = tmp_path / "new", str(tmp_path / "out"), str(tmp_path / "mark")
    new.mkdir()
    (new / "1.json").write_text('{"id": "m1", "body": "hello"}')
    (new / "2.json").write_text("{bad")
    (new / "ignore.txt").write_text("x")
    for late in (None, "3.json"):
        if late:
            (new / late).write_text('{"id": "m3", "body": "boom"}')
        mail.consume(spark, str(new), out, mark, lambda rows: rows.withColumn("ok", F.col("mail.body") != "boom")).awaitTermination(120)
    assert tuple(mail.stats(spark, out).first()) == (1, 2)


def test_streamed_replies(spark, tmp_path):
    from deskflow.streaming import replies

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "agent long, ts long, ident long, is_in boolean, is_end boolean"
    src = str(tmp_path / "src")
    for batch in ([(1, 1, 1, True, False), (1, 2, 2, True, False)], [(1, 3, 3, False, True), (1, 4, 4, False, True), (2, 5, 5, False, True)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        q = replies.pending_replies(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2, 3)]


def test_outbox(spark, tmp_path):
    rows = spark.createDataFrame([("c", "y" * 2000, "m1"), ("c", "", "m2")], "channelId string, text string, inbound_id string")
    got = outbox.replies(rows)
    for _ in range(2):  # a batch that is run again isn't doubled
        outbox.append_to(str(tmp_path / "box"))(got, 0)
    assert [len(r.content) for r in spark.read.parquet(str(tmp_path / "box")).collect()] == [1901]
