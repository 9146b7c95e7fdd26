"""Meters of streaming queries and of batches: what Spark reports, kept as rows."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METERS = "query string, event string, batch long, input_rows long, state_rows long, dropped_late long, batch_ms long, watermark string, error string"


class Meters(StreamingQueryListener):
    """Started, progressed and terminated queries, one row each; the newest ``keep`` stay, so a driver
    that runs for months holds a bounded list."""

    def __init__(self, keep: int = 10_000):
        self.keep, self.rows, self.lock = keep, [], threading.Lock()

    def _add(self, *row) -> None:
        with self.lock:
            self.rows.append(row)
            del self.rows[: -self.keep]

    def onQueryStarted(self, event):
        self._add(str(event.id), "started", None, None, None, None, None, None, None)

    def onQueryProgress(self, event):
        p = event.progress
        state = [(s.numRowsTotal, s.numRowsDroppedByWatermark) for s in p.stateOperators]
        times = json.loads(p.json).get("eventTime", {})
        self._add(str(p.id), "progress", p.batchId, p.numInputRows, sum(s[0] for s in state), sum(s[1] for s in state), p.batchDuration, times.get("watermark"), None)

    def onQueryIdle(self, event):
        self._add(str(event.id), "idle", None, None, None, None, None, None, None)

    def onQueryTerminated(self, event):
        self._add(str(event.id), "terminated", None, None, None, None, None, None, event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), METERS)


def metered(df: DataFrame, name: str, size: str = "bytes") -> tuple[DataFrame, Observation]:
    """df, and an observation of its rows and bytes that is there when df has been written or collected:
    nothing is computed twice for it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max(F.col(size)).alias("largest")), seen
