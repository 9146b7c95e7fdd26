"""Streaming forms: late rows, restarts from a checkpoint, a packet stream, and a store with two drivers."""

import json
import random
import shutil
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meridia.operators import folds
from meridia.sources import store
from meridia.sources.packets import PacketSource
from meridia.streaming import jobs

HOUR = 3600 * 10**6
DAY0 = 1_704_067_200_000_000


def write(folder, name, rows):
    """Events of (id, hour, user)."""
    cols = list(zip(*rows))
    t = pa.table(
        {
            "event_id": pa.array(cols[0], pa.int64()), "ts": pa.array([DAY0 + int(h * HOUR) for h in cols[1]], pa.int64()).cast(pa.timestamp("us")), "user_id": pa.array(cols[2], pa.int64()),
            "event_type": pa.array(["view"] * len(rows)), "value": pa.array([1.0] * len(rows)), "props": pa.array(["{}"] * len(rows)),
        }
    )
    pq.write_table(t, f"{folder}/{name}.parquet")


def test_late_rows_and_a_restart(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def run():
        got = jobs.drain(jobs.windows(spark, f"{source}/*.parquet", "4 hours", "2 hours", 1), "append", root)
        return sorted(((x.start - DAY0) // HOUR, x.stream, x.packets) for x in got.collect())

    write(source, "a", [(1, 0, 1), (2, 1, 1), (3, 3, 2), (4, 9, 1)])  # the watermark is at 7: the first window is sealed
    assert run() == [(0, 1, 2), (0, 2, 1)]
    write(source, "b", [(5, 2, 1), (6, 8, 2), (7, 15, 1)])  # 2 is in a sealed window and is dropped, 8 is not
    assert run() == [(0, 1, 2), (0, 2, 1), (8, 1, 1), (8, 2, 1)]
    assert run() == [(0, 1, 2), (0, 2, 1), (8, 1, 1), (8, 2, 1)]  # nothing new: nothing again


def test_state_goes_on_after_a_restart(spark, tmp_path):
    hours = [(i, h, i % 2) for i, h in enumerate((0, 1, 5, 6, 20, 26, 27, 30, 49, 55, 80, 81))]
    whole, parts, root = tmp_path / "whole", tmp_path / "parts", str(tmp_path / "state")
    whole.mkdir()
    parts.mkdir()
    write(whole, "a", hours)
    want = sorted(map(tuple, jobs.drain(jobs.density(spark, f"{whole}/*.parquet", 24 * HOUR * 1000), "append").collect()))
    for k in range(3):
        write(parts, f"p{k}", hours[4 * k : 4 * k + 4])
        got = jobs.drain(jobs.density(spark, f"{parts}/*.parquet", 24 * HOUR * 1000), "append", root)
    assert sorted(map(tuple, got.collect())) == want and want


def test_packet_stream(spark, tmp_path):
    spark.dataSource.register(PacketSource)
    folder, root = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def put(name, n):
        (tmp_path / "x").write_text("".join(json.dumps({"stream": n, "pts": i}) + "\n" for i in range(n)))
        shutil.move(tmp_path / "x", folder / name)  # whole when it appears

    def run():
        rows = spark.readStream.format("packets").option("folder", str(folder)).option("files", "1").load()
        return sorted((x.stream, x.pts) for x in jobs.drain(rows.select("stream", "pts"), "append", root).collect())

    put("a.jsonl", 2)
    put("b.jsonl", 3)
    first = run()
    put("c.jsonl", 1)
    want = [(n, i) for n in (1, 2, 3) for i in range(n)]
    # a trigger for what is there takes in a batch, so what is left comes with the next ones
    for _ in range(4):
        got = run()
    assert set(first) <= set(got) and got == want


def test_two_drivers_commit_one_batch_once(spark, tmp_path):
    root, done = str(tmp_path / "store"), []
    frames = [spark.range(100).selectExpr("id", f"{k} as who") for k in range(4)]
    threads = [threading.Thread(target=lambda f=f: done.append(store.commit(f, root, 7))) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.read(spark, root, "id long, who int").collect()
    assert done.count(True) == 1 and len(rows) == 100 and len({x.who for x in rows}) == 1 and {x.batch for x in rows} == {7}
    assert not store.commit(frames[0], root, 7) and store.commit(frames[0], root, 8)


def test_meters(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from meridia.streaming.meters import Meters, metered

    meters, source = Meters(keep=50), tmp_path / "in"
    source.mkdir()
    spark.streams.addListener(meters)
    try:
        write(source, "a", [(1, 0, 1), (2, 9, 1)])
        write(source, "b", [(3, 30, 1)])
        write(source, "c", [(4, 1, 1)])  # late by the watermark of the batch before
        jobs.drain(jobs.windows(spark, f"{source}/*.parquet", "4 hours", "2 hours", 1), "append", str(tmp_path / "state"))
        for _ in range(50):
            if any(r[1] == "terminated" for r in meters.rows):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(meters)
    got = meters.table(spark).groupBy("event").agg(F.sum("input_rows").alias("rows"), F.max("dropped_late").alias("late")).collect()
    by = {x.event: x for x in got}
    assert by["progress"].rows == 4 and by["progress"].late == 1 and "started" in by and "terminated" in by
    df, seen = metered(spark.range(10).select((F.col("id") * 2).alias("bytes")), "sizes")
    assert df.count() == 10 and seen.get == {"rows": 10, "bytes": 90, "largest": 18}


def test_deliveries(spark):
    import hashlib
    import hmac
    from base64 import b64encode

    from meridia.sources import hooks

    key = b"k" * 32
    events = spark.createDataFrame([(i, i % 3, "ready", 1000 + i, 7) for i in range(6)], "id long, stream long, kind string, at long, bytes long")
    rows = hooks.envelopes(events, key, "node/1", "id", "stream", "kind", "at", ["bytes"])
    for r in rows.collect():
        want = b64encode(hmac.new(key, f"{r.event_id}.{r.seconds}.{r.body}".encode(), hashlib.sha256).digest()).decode()
        assert r.signature == "v1," + want
        assert json.loads(r.body) == {"specversion": "1.0", "id": r.event_id, "source": "node/1", "type": "ready", "subject": r.subject, "time": f"1970-01-01T00:16:4{r.seconds - 1000}Z", "data": {"bytes": 7}}

    def send(headers, body, tries={}):
        n = int(headers["webhook-id"])
        tries[n] = tries.get(n, 0) + 1
        if n == 4:
            raise ConnectionError
        return {0: 204, 1: 404, 2: 503 if tries[n] < 3 else 200, 3: 429, 5: 200}[n]

    got = {x.event_id: (x.outcome, x.attempts, x.status, x.error) for x in hooks.deliver(rows, send, attempts=3, pause=0.001).collect()}
    assert got == {
        "0": ("delivered", 1, 204, None), "1": ("rejected", 1, 404, None), "2": ("delivered", 3, 200, None), "3": ("exhausted", 3, 429, None), "4": ("exhausted", 3, None, "ConnectionError"), "5": ("delivered", 1, 200, None),
    }


H = HOUR * 1000
FOLDS = {
    "density": (folds.density(24 * H, 4), "stream long, start long, packets long, dense boolean"),
    "floor": (folds.floor_windows(10 * H, 1, 2), "stream long, start long, elapsed long, media long, slow boolean"),
    "drift": (folds.drift(10 * H, (9, 10), (19, 20)), "stream long, arrival long, had long, gained long, behind boolean"),
    "gaps": (folds.gaps(H), "stream long, arrival long, kind string, expected long, off long"),
    "cadence": (folds.cadence(4 * H, H, 2, False), "stream long, arrival long, kind string, due long, off long"),
    "greedy": (folds.greedy_parts(9 * H), "stream long, part long, start long, size long, units long, why string"),
    "planned": (folds.planned_parts(9 * H), "stream long, segment long, part long, start long, size long, units long, error string"),
    "takeover": (folds.takeover(6 * H), "stream long, arrival long, verdict string"),
    "queue": (folds.bounded_queue(2, 9 * H), "stream long, arrival long, outcome string, waited long"),
    "ledger": (folds.ledger(300), "stream long, arrival long, held long, refused boolean"),
    "spill": (folds.spill(500), "stream long, arrival long, cause long, held long"),
    "permits": (folds.permits(2), "stream long, arrival long, status int, held int"),
    "lru": (folds.lru(300), "stream long, arrival long, victim string, stale boolean"),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_folds_as_streams(spark, tmp_path, name):
    """Over three batches, with a restart after each, a stream tells what the fold tells of all rows, but for its end."""
    r, source, root = random.Random(41), tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    kinds = "stream long, arrival long, t long, dur long, media long, held long, ra boolean, kind string, bytes long, entry string, epoch long, start long, segment long, independent boolean, can_end boolean"
    rows, clock = [], 0
    for i in range(90):
        clock += r.randint(0, 5) * H
        rows.append((i % 2, i, clock, r.randint(1, 5) * H, r.randint(1, 5) * H, r.randint(0, 1) * H, r.random() < 0.4, r.choice(["view", "signup", "error"]), r.randint(0, 200), r.choice("abcdef"), i // 20, clock, clock // (60 * H), r.random() < 0.3, True))
    make, schema = FOLDS[name]
    step_only = lambda key: (make(key)[0], lambda: [])
    want = sorted(map(repr, folds.fold(spark.createDataFrame(rows, kinds), "stream", ["arrival"], step_only, schema).collect()))
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], kinds).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kinds).parquet(str(source))
        got = jobs.drain(jobs.fold(stream, "stream", ["arrival"], make, schema), "append", root)
    assert sorted(map(repr, got.collect())) == want and want
