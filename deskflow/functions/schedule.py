"""Cron schedules as tables of ticks, in UTC.

Expressions have five fields of ``*``, ``*/n``, numbers, ranges and lists. A field becomes the array of values that it
allows, so a minute matches if five array lookups do; nothing is evaluated row by row in Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
ITEM = r"(?:\*|\d{1,2}(?:-\d{1,2})?)(?:/[1-9]\d?)?"
FIELD = rf"\A{ITEM}(?:,{ITEM})*\z"


def _values(field: Column, low: int, high: int) -> Column:
    def of(item: Column) -> Column:
        step = F.coalesce(F.try_element_at(F.split(item, "/"), F.lit(2)).cast("int"), F.lit(1))
        span = F.element_at(F.split(item, "/"), 1)
        bounds = F.split(span, "-")
        first = F.when(span == "*", low).otherwise(F.try_to_number(bounds[0], F.lit("99")).cast("int"))
        stepped = F.contains(item, F.lit("/"))
        last = F.when(span == "*", high).otherwise(F.coalesce(F.try_to_number(F.try_element_at(bounds, F.lit(2)), F.lit("99")).cast("int"), F.when(stepped, high).otherwise(first)))
        return F.when((first >= low) & (last <= high) & (first <= last), F.filter(F.sequence(F.lit(low), F.lit(high)), lambda v: (v >= first) & (v <= last) & ((v - first) % step == 0)))

    return F.when(field.rlike(FIELD), F.flatten(F.transform(F.split(field, ","), of)))


def parsed(schedule: Column) -> Column:
    """A struct of the values of each field, or null if the expression is not valid."""
    parts = F.split(F.trim(schedule), r"\s+")
    fields = [_values(F.get(parts, i), low, high) for i, (_, low, high) in enumerate(FIELDS)]
    fine = F.size(parts) == 5
    for f in fields:
        fine = fine & f.isNotNull()
    free = [F.get(parts, i) == "*" for i in (2, 4)]
    return F.when(fine, F.struct(*[f.alias(n) for f, (n, _, _) in zip(fields, FIELDS, strict=True)], free[0].alias("any_day"), free[1].alias("any_weekday")))


def filled(entries: DataFrame) -> DataFrame:
    """Entries whose name, schedule and prompt are all there."""
    return entries.where("length(name) > 0 and length(schedule) > 0 and length(prompt) > 0")


def valid(entries: DataFrame) -> DataFrame:
    """Filled entries with a valid schedule, with ``plan``; others are left out and don't hinder them."""
    return filled(entries).withColumn("plan", parsed(F.col("schedule"))).where("plan is not null")


def matches(at: Column, plan: Column) -> Column:
    """Whether a timestamp is a tick. If both day fields are restricted, either may match."""
    weekday = F.dayofweek(at) - 1
    has = lambda field, v: F.array_contains(plan[field], v)
    by_day, by_weekday = has("day", F.dayofmonth(at)), has("weekday", weekday) | (weekday.eqNullSafe(0) & has("weekday", F.lit(7)))
    day = F.when(plan["any_day"] | plan["any_weekday"], by_day & by_weekday).otherwise(by_day | by_weekday)
    return has("minute", F.minute(at)) & has("hour", F.hour(at)) & has("month", F.month(at)) & day


def ticks(entries: DataFrame, begin: str, end: str) -> DataFrame:
    """(name, tick): all ticks from ``begin`` (inclusive) to ``end`` (exclusive).

    Days are matched before their minutes are made, so sparse schedules stay small.
    """
    days = F.sequence(F.date_trunc("day", F.lit(begin).cast("timestamp_ntz")).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("interval 1 day"))
    minutes = F.flatten(F.transform(F.col("plan.hour"), lambda h: F.transform(F.col("plan.minute"), lambda m: h * 60 + m)))
    rows = valid(entries).select("name", "plan", F.explode(days).alias("day"), minutes.alias("minutes"))
    at = F.expr("timestampadd(MINUTE, minute_of_day, day)")
    rows = rows.select("name", "plan", "day", F.explode(F.array_distinct("minutes")).alias("minute_of_day")).select("name", "plan", at.alias("tick"))
    return rows.where(matches(F.col("tick"), F.col("plan")) & (F.col("tick") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("tick") < F.lit(end).cast("timestamp_ntz"))).select("name", "tick")


def _minute(ts: Column) -> Column:
    """Whole minutes since 1970, rounded up; ticks lie on whole minutes, so this is the first that can count a row."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.ceil(micros / 60_000_000)


def events_per_tick(ticked: DataFrame, events: DataFrame, ts: str = "ts") -> DataFrame:
    """(name, tick, n_events): events since the tick before (exclusive) up to the tick (inclusive); a schedule's first tick
    counts all that came before it.

    Events are counted by minute before anything is shuffled, so what is joined is bounded by the minutes of the period.
    Ticks and minutes are merged in one ordering by day; a tick's count is the difference of two running totals. Days,
    a row each, carry the totals from one day to the next.
    """
    counted = events.where(F.col(ts).isNotNull()).groupBy(_minute(F.col(ts)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    merged = counted.unionByName(ticked.select(_minute(F.col("tick")).alias("minute"), F.lit(0).cast("long").alias("n")).distinct())
    merged = merged.withColumn("day", F.floor(F.col("minute") / 1440))
    days = merged.groupBy("day").agg(F.sum("n").alias("in_day"))
    days = days.select("day", F.coalesce(F.sum("in_day").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("day").orderBy("minute").rangeBetween(Window.unboundedPreceding, 0))
    totals = merged.withColumn("inside", inside).where("n = 0").join(days, "day").select("minute", (F.col("before") + F.col("inside")).alias("upto"))
    placed = ticked.withColumn("minute", _minute(F.col("tick"))).join(totals, "minute")
    earlier = F.lag("upto", 1, 0).over(Window.partitionBy("name").orderBy("tick"))
    return placed.select("name", "tick", (F.col("upto") - earlier).alias("n_events"))


def coalesced(ticked: DataFrame, busy: DataFrame, *chain: str) -> DataFrame:
    """(chain, name, tick, started) of ticks that fire when each fire takes ``busy`` (chain, name, tick, seconds).

    All entries of a chain fire one after another, in the order of their ticks and then names: a tick whose entry is due
    waits until the fires before it have settled. An entry's next run is computed when its own fire settles, so its ticks
    that pass meanwhile are skipped. Without ``chain`` all entries are one. A chain is one agent's ticks of a period, folded
    in one task; agents are folded side by side.
    """
    keys = [*chain, "name", "tick"]
    rows = ticked.join(busy, keys, "left").select(*keys, F.coalesce("seconds", F.lit(0)).cast("long").alias("seconds"))
    kinds = dict(rows.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        settled, free, fired = {}, None, []
        for r in frame.sort_values(["tick", "name"]).to_dict("records"):
            own = settled.get(r["name"])
            if own is not None and r["tick"] <= own:
                continue
            start = r["tick"] if free is None else max(r["tick"], free)
            free = settled[r["name"]] = start + pd.Timedelta(seconds=int(r["seconds"]))
            fired.append([*[r[k] for k in keys], start])
        return pd.DataFrame(fired, columns=[*keys, "started"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", started {kinds['tick']}"
    return rows.groupBy(*chain).applyInPandas(fold, schema)
