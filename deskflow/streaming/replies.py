"""Reply correlation and schedules over a stream, with state for each agent: the pending message, when fires settle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class PendingSlot(StatefulProcessor):
    """Rows (agent, ts, ident, is_in, is_end) to (agent, inbound_id, end_id). All rows of a key in a batch are sorted first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", "inbound_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = self.slot.get()[0] if self.slot.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "ident"]).itertuples():
            if r.is_in:
                pending = int(r.ident)
            if r.is_end and pending is not None:
                out.append((key[0], pending, int(r.ident)))
                pending = None
        if pending is None:
            self.slot.clear()
        else:
            self.slot.update((pending,))
        yield pd.DataFrame(out, columns=["agent", "inbound_id", "end_id"])

    def close(self) -> None:
        pass


def pending_replies(events: DataFrame) -> DataFrame:
    """Needs the RocksDB state store. A row that is both an end and an inbound fills the slot first."""
    return events.groupBy("agent").transformWithStateInPandas(PendingSlot(), outputStructType="agent long, inbound_id long, end_id long", outputMode="Append", timeMode="none")


class ScheduleState(StatefulProcessor):
    """Ticks (agent, name, tick, seconds) to those that fire, one after another; see ``schedule.coalesced``.

    State: when the chain is free, and when each entry's last fire settled. All rows of a key in a batch are sorted first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", "at timestamp")
        self.settled = handle.getMapState("settled", "name string", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free = pd.Timestamp(self.free.get()[0]) if self.free.exists() else None
        fired = []
        for r in pd.concat(list(rows)).sort_values(["tick", "name"]).itertuples(index=False):
            if self.settled.containsKey((r.name,)) and r.tick <= pd.Timestamp(self.settled.getValue((r.name,))[0]):
                continue
            start = r.tick if free is None else max(r.tick, free)
            free = start + pd.Timedelta(seconds=int(r.seconds))
            self.settled.updateValue((r.name,), (free.to_pydatetime(),))
            fired.append((key[0], r.name, r.tick, start))
        if free is not None:
            self.free.update((free.to_pydatetime(),))
        yield pd.DataFrame(fired, columns=["agent", "name", "tick", "started"])

    def close(self) -> None:
        pass


def coalesced(ticks: DataFrame) -> DataFrame:
    """(agent, name, tick, started); needs the RocksDB state store."""
    schema = "agent string, name string, tick timestamp, started timestamp"
    return ticks.groupBy("agent").transformWithStateInPandas(ScheduleState(), outputStructType=schema, outputMode="Append", timeMode="none")
