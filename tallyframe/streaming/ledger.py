"""The run ledger as a stream: the latest state of each run, updated as events come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import FINAL

STATE = "started_at timestamp, updated_at timestamp, ended_at timestamp, last_event string, events long, rows_written long"


def latest_runs_stream(events: DataFrame) -> DataFrame:
    """One row for each run that got events, in update mode.

    ``events`` has ``run_id``, ``timestamp``, ``event`` and ``rows_written``. The state of a run is a row of fixed size;
    events may come in any order.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, end, event, n, rows = state.get if state.exists else (None, None, None, None, 0, None)
        at = last
        for part in parts:
            for t, e, r in part.sort_values("timestamp")[["timestamp", "event", "rows_written"]].itertuples(index=False):
                n += 1
                start = t if start is None or t < start else start
                if last is None or t >= last:
                    last, event = t, e
                if not pd.isna(r) and (rows is None or at is None or t >= at):
                    rows, at = int(r), t
                if e in FINAL and (end is None or t > end):
                    end = t
        state.update((start, last, end, event, n, rows))
        yield pd.DataFrame({"run_id": [key[0]], "started_at": [start], "updated_at": [last], "ended_at": [end], "last_event": [event], "events": [n], "rows_written": [rows]})

    rows = events.select("run_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "event", F.col("rows_written").cast("long").alias("rows_written"))
    return rows.groupBy("run_id").applyInPandasWithState(fold, f"run_id string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
