"""The mail consumer, streamed schedules, and sources that tests alone can set up."""

import datetime
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskflow.functions import schedule
from deskflow.operators import memory, messages
from deskflow.sources import files
from deskflow.streaming import mail, replies


def test_handler_runs_once_a_batch(spark, tmp_path):
    new, out, log = tmp_path / "new", str(tmp_path / "out"), tmp_path / "log"
    new.mkdir(), log.mkdir()
    for i in range(3):
        (new / f"{i}.json").write_text(f'{{"id": "m{i}", "body": "{"boom" if i == 1 else "hello"}"}}')
    (new / "bad.json").write_text("{bad")

    def handler(rows):
        folder = str(log)

        def act(batches):
            for b in batches:
                for f in b["file"]:
                    with open(f"{folder}/{os.path.basename(f)}", "a") as seen:
                        seen.write("x")
                yield pd.DataFrame({"file": b["file"], "ok": [not x for x in b["body"].str.contains("boom")]})

        return rows.select("file", "mail.body").mapInPandas(act, "file string, ok boolean")

    query = mail.consume(spark, str(new), out, str(tmp_path / "mark"), handler, files_per_batch=10)
    query.awaitTermination(120)
    assert {p.name: p.read_text() for p in log.iterdir()} == {f"{i}.json": "x" for i in range(3)}
    assert tuple(mail.stats(spark, out).first()) == (2, 2)
    dead = {os.path.basename(r.file): (r.content, r.reason, r.attempt) for r in mail.dead_letters(spark, out).collect()}
    assert dead == {"bad.json": ("{bad", "not a message", 1), "1.json": ('{"id": "m1", "body": "boom"}', "handler failed", 1)}
    assert mail.retry(spark, out, handler) == 2 and mail.retry(spark, out, handler) == 3 and mail.retry(spark, out, handler) == 0
    assert (log / "1.json").read_text() == "xxx" and (log / "0.json").read_text() == "x"
    mail.stop(query), mail.stop(query)


def test_retry_can_succeed(spark, tmp_path):
    new, out = tmp_path / "new", str(tmp_path / "out")
    new.mkdir()
    (new / "1.json").write_text('{"id": "m1", "body": "later"}')
    mail.consume(spark, str(new), out, str(tmp_path / "mark"), lambda rows: rows.withColumn("ok", F.lit(False))).awaitTermination(120)
    assert mail.retry(spark, out, lambda rows: rows.withColumn("ok", F.lit(True))) == 2
    assert mail.dead_letters(spark, out).count() == 0 and spark.read.parquet(f"{out}/cur").first().mail.body == "later"


def test_a_checkpoint_has_one_owner(spark, tmp_path):
    new = tmp_path / "new"
    new.mkdir()
    first = mail.consume(spark, str(new), str(tmp_path / "out"), str(tmp_path / "mark"), every="1 second")
    second = None
    try:
        second = mail.consume(spark, str(new), str(tmp_path / "out2"), str(tmp_path / "mark"), every="1 second")
    except Exception as refused:  # either the newcomer is refused, or it takes over
        assert "already active" in str(refused)
    try:
        first.awaitTermination(10)
        assert [first.isActive, bool(second and second.isActive)].count(True) == 1
    finally:
        mail.stop(first)
        if second:
            mail.stop(second)


def chain(rows):
    """(name, tick, start) of fires, minute by minute: a timer for each entry, and one queue."""
    at, queue, free, out = dict.fromkeys({r[0] for r in rows}), [], 0, []
    for name, tick, seconds in sorted(rows, key=lambda r: (r[1], r[0])):
        if at[name] is not None and tick <= at[name]:
            continue
        queue.append((name, tick, seconds))
        name, tick, seconds = queue.pop(0)
        start = max(tick, free)
        free = at[name] = start + seconds
        out.append((name, tick, start))
    return out


def test_one_chain_for_all_entries(spark, tmp_path):
    rows = [(n, 60 * m, (m * 37 + k * 11) % 400) for k, (n, step) in enumerate((("a", 1), ("b", 3), ("c", 7))) for m in range(0, 120, step)]
    base = datetime.datetime(2024, 1, 1)
    stamp = lambda s: base + datetime.timedelta(seconds=s)
    frame = spark.createDataFrame([("x", n, stamp(t), s) for n, t, s in rows] + [("y", "a", stamp(0), 10**6), ("y", "b", stamp(60), 0)], "agent string, name string, tick timestamp, seconds long")
    got = schedule.coalesced(frame.select("agent", "name", "tick"), frame, "agent").collect()
    want = sorted((n, stamp(t), stamp(s)) for n, t, s in chain(rows))
    assert sorted((r.name, r.tick, r.started) for r in got if r.agent == "x") == want
    assert sorted((r.name, r.started) for r in got if r.agent == "y") == [("a", base), ("b", stamp(10**6))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for half in (F.col("tick") < F.lit(stamp(3600)), F.col("tick") >= F.lit(stamp(3600))):
        frame.where(half).coalesce(1).write.mode("append").parquet(src)
        stream = replies.coalesced(spark.readStream.schema(frame.schema).parquet(src))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", out).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.parquet(out).where("agent = 'x'").collect()
    assert sorted((r.name, r.tick, r.started) for r in got) == want


def test_events_per_tick(spark):
    t = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m, seconds=s)
    ticks = spark.createDataFrame([("a", t(5)), ("a", t(3000)), ("b", t(1439)), ("b", t(1440)), ("c", t(10))], "name string, tick timestamp_ntz")
    events = [t(-5000), t(4, 59), t(5), t(5, 1), t(1439), t(1439, 30), t(1440), t(2999, 59), t(3000), t(3000, 1), None]
    got = {(r.name, r.tick): r.n_events for r in schedule.events_per_tick(ticks, spark.createDataFrame([(e,) for e in events], "ts timestamp_ntz")).collect()}
    assert got == {("a", t(5)): 3, ("a", t(3000)): 6, ("b", t(1439)): 5, ("b", t(1440)): 2, ("c", t(10)): 4}
    assert "CartesianProduct" not in (plan := schedule.events_per_tick(ticks, events_frame(spark))._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def events_frame(spark):
    return spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "ts timestamp_ntz")


def test_probe(spark, tmp_path):
    (tmp_path / "run").write_text("x")
    (tmp_path / "run").chmod(0o640)
    (tmp_path / "box").mkdir()
    for i in range(3):
        (tmp_path / "box" / str(i)).write_text("")
    got = {os.path.basename(r.path): (r.there, r.n_files) for r in files.probe(spark, [str(tmp_path / n) for n in ("run", "box", "none")]).collect()}
    assert got == {"run": (True, None), "box": (True, 3), "none": (False, None)}
    from deskflow.functions import text as T

    mode = files.probe(spark, [str(tmp_path / "run")]).select(T.octal_mode(F.col("mode")).alias("o"), T.not_executable(F.col("mode")).alias("x"), T.not_private(F.col("mode")).alias("p")).first()
    assert tuple(mode) == ("640", True, True)


def test_ties(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (1, 4, "z")], "id long, at long, text string").repartition(3)
    assert [tuple(r) for r in memory.latest(rows, "id", "at").collect()] == [(1, 5, "c")]
    turns = spark.createDataFrame([(1, 2, "assistant", "x"), (1, 2, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert messages.last_assistant(turns).first().raw == "y"


def test_missing_configuration_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.config_text(spark, str(tmp_path / "none.yaml")).collect()
