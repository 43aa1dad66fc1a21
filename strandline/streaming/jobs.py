"""Status of jobs from a stream of their events: progress that never falls, terminal states that stay, each event once.

An event that is sent again within the watermark is dropped; each job's state is kept by the stream's state store and so
survives a restart from the checkpoint. Each batch's changed states go to a keyed table, once however often it is retried.
A job without events for ``QUIET`` of event time is given up by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.sinks.keyed import KeyedTable

EVENT = "event_id LONG, job_id LONG, ts TIMESTAMP, kind STRING, progress DOUBLE"
STATUS = "job_id long, status string, progress int, events long, last_event long, last_ts timestamp, silent boolean"
#: What ends a job, the most that a running job has done, and the provider that keeps states.
TERMINAL = {"done": "done", "error": "error"}
MOST = 99
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUIET_MS = 7 * 24 * 3600 * 1000


class JobStatus(StatefulProcessor):
    """One job's status. The last event by (time, number) of an end decides how it ended; others only add progress."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "progress int, events long, last_event long, last_ms long, ended string, ended_at long, ended_event long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        progress, events, last_event, last_ms, ended, ended_at, ended_event = known or (0, 0, -1, -1, None, -1, -1)
        timer = int(last_ms) + QUIET_MS if known and ended is None else None  # the only one that can be there
        for pdf in rows:
            if pdf.empty:
                continue
            ms, numbers = pdf["ts"].to_numpy().astype("datetime64[ms]").astype("int64"), pdf["event_id"].to_numpy()
            done = np.clip(np.nan_to_num(pdf["progress"].to_numpy(float)), 0, MOST).astype(int).max()
            progress, events, latest = max(int(progress), int(done)), int(events) + len(pdf), ms.max()
            last_ms, last_event = max((int(last_ms), int(last_event)), (int(latest), int(numbers[ms == latest].max())))
            for i, kind in enumerate(pdf["kind"].tolist()):
                if kind in TERMINAL and (ms[i], numbers[i]) > (ended_at, ended_event):
                    ended, ended_at, ended_event = TERMINAL[kind], int(ms[i]), int(numbers[i])
        self.state.update((int(progress), int(events), int(last_event), int(last_ms), ended, int(ended_at), int(ended_event)))
        wanted = int(last_ms) + QUIET_MS if ended is None else None
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)
        yield self._row(key, progress, events, last_event, last_ms, ended, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if known:
            progress, events, last_event, last_ms, ended, *_ = known
            yield self._row(key, progress, events, last_event, last_ms, ended, ended is None)

    def _row(self, key, progress, events, last_event, last_ms, ended, silent) -> pd.DataFrame:
        shown = 100 if ended == "done" else int(progress)
        return pd.DataFrame({"job_id": [key[0]], "status": [ended or "running"], "progress": [shown], "events": [int(events)], "last_event": [int(last_event)], "last_ts": [pd.Timestamp(int(last_ms), unit="ms")], "silent": [bool(silent)]})

    def close(self) -> None:
        pass


def job_status(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The stream of changed statuses of the jobs of ``events`` (EVENT); an event that comes again within ``late`` is dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("job_id").transformWithStateInPandas(JobStatus(), STATUS, "Update", "EventTime")


def keep_status(status: DataFrame, table: KeyedTable, checkpoint: str):
    """Starts what there is now of the stream into ``table`` (by job_id), a batch at a time."""

    def put(batch: DataFrame, number: int) -> None:
        table.merge(batch, order=F.struct(F.col("events"), F.col("silent")), batch=(checkpoint, number))

    return status.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
