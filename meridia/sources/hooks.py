"""Webhook deliveries of events: signed envelopes, retried, with one outcome row each.

Sending is a function that the caller gives: it gets the headers and the body and returns a status,
or raises. Each event is sent by the task that holds it; a task that runs again sends again under the
same id, so receivers tell repeats by ``webhook-id``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import http

OUTCOMES = "event_id string, subject string, outcome string, attempts int, status int, error string"


def envelopes(events: DataFrame, key: bytes, source: str, id_col: str, subject_col: str, kind_col: str, seconds_col: str, fields: list[str]) -> DataFrame:
    """(event_id, subject, seconds, body, signature) of each event: a CloudEvents body as JSON, and its HMAC signature."""
    event_id = F.col(id_col).cast("string")
    body = F.to_json(
        F.struct(
            F.lit("1.0").alias("specversion"), event_id.alias("id"), F.lit(source).alias("source"), F.col(kind_col).alias("type"), F.col(subject_col).cast("string").alias("subject"),
            F.date_format(F.timestamp_seconds(F.col(seconds_col)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.struct(*fields).alias("data"),
        )
    )
    rows = events.select(event_id.alias("event_id"), F.col(subject_col).cast("string").alias("subject"), F.col(seconds_col).cast("long").alias("seconds"), body.alias("body"))
    return rows.withColumn("signature", http.webhook_signature(key, F.col("event_id"), F.col("seconds"), F.col("body")))


def deliver(rows: DataFrame, send: Callable[[dict, str], int], attempts: int = 5, pause: float = 1.0, longest: float = 60.0) -> DataFrame:
    """The outcome of each envelope: delivered at 2xx; 408, 425, 429, 5xx and exceptions are tried again after
    a doubling pause; other statuses reject. A subject's events go in order of their time and id."""

    def one(event_id: str, subject: str, seconds: int, body: str, signature: str) -> tuple:
        headers = {"content-type": "application/cloudevents+json", "webhook-id": event_id, "webhook-timestamp": str(seconds), "webhook-signature": signature}
        status, error = None, None
        for n in range(1, attempts + 1):
            try:
                status, error = send(headers, body), None
            except OSError as e:
                status, error = None, type(e).__name__
            if status is not None and 200 <= status < 300:
                return event_id, subject, "delivered", n, status, None
            if status is not None and status < 500 and status not in (408, 425, 429):
                return event_id, subject, "rejected", n, status, None
            if n < attempts:
                time.sleep(min(longest, pause * 2 ** (n - 1)))
        return event_id, subject, "exhausted", attempts, status, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            got = [one(*row) for row in zip(*(c.to_pylist() for c in b.columns))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=[x.split()[0] for x in OUTCOMES.split(", ")])

    rows = rows.select("event_id", "subject", "seconds", "body", "signature")
    return rows.repartition("subject").sortWithinPartitions("subject", "seconds", "event_id").mapInArrow(run, OUTCOMES)
