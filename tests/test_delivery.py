"""Stores, tiers, validators, signatures and caption packets against brute force and the standard library."""

import base64
import hashlib
import hmac
import random
import zlib

from pyspark.sql import functions as F

from meridia.functions import http
from meridia.operators import captions, folds
from meridia.plans import registry
from meridia.plans.delivery import KEY
from meridia.sources import store
from meridia.streaming import jobs

DIR = "/root/testdata/sf0.001"


def test_signature(spark):
    for key in (KEY, b"k", bytes(range(200))):
        df = spark.createDataFrame([("event-1", 1700000000, '{"x":1}'), ("é", 0, "")], "id string, at long, body string")
        got = [r.s for r in df.select(http.webhook_signature(key, F.col("id"), F.col("at"), F.col("body")).alias("s")).collect()]
        want = [hmac.new(key, m.encode(), hashlib.sha256).digest() for m in ('event-1.1700000000.{"x":1}', "é.0.")]
        assert got == ["v1," + base64.b64encode(w).decode() for w in want]


def test_entity_tags(spark):
    bodies = ["", "#EXTM3U\n", "é" * 5000]
    df = spark.createDataFrame([(b, i % 2 == 0) for i, b in enumerate(bodies)], "body string, gz boolean")
    got = [r.t for r in df.select(http.entity_tag(F.col("body"), F.col("gz")).alias("t")).collect()]
    assert got == [f'"{zlib.crc32(b.encode()):08x}-{len(b.encode()):x}{"-gz" if i % 2 == 0 else ""}"' for i, b in enumerate(bodies)]


def test_none_match(spark):
    cases = [(None, False), ("", False), ("*", True), ('"a"', True), ('W/"a"', True), ('"b" ,  W/"a"', True), ('"b", *', True), ('"b"', False), ("a", False)]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h string")
    assert [r.x for r in df.select(http.not_modified(F.col("h"), F.lit('"a"')).alias("x")).collect()] == [w for _, w in cases]


def test_etag_query(spark):
    assert {(r.page_id % 5, r.not_modified) for r in registry.queries()["fn13_etag"](spark, DIR).collect()} == {(0, True), (1, True), (2, True), (3, False), (4, False)}


def named(packet):
    found, rest = set(), list(packet)
    while rest and rest[0]:
        head = rest.pop(0)
        number, size = divmod(head, 32)
        if number == 7 and size:
            if not rest:
                break
            number = rest.pop(0) % 64
        if size > len(rest):
            break
        if number:
            found.add(number)
        del rest[:size]
    return sorted(found)


def test_services(spark):
    rng = random.Random(7)
    packets = [[], [0], [0x21, 9], [0x22, 9], [0xE1], [0xE1, 0x48, 5], [0xE1, 0, 5], [0xE0, 0x21, 1], [0x20, 0, 0x41, 1], [3, 1, 1, 1, 0x21, 4]]
    packets += [[rng.choice([0, 1, 33, 34, 66, 225, 226, 200, 7]) for _ in range(rng.randrange(1, 128))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(packets)), "i int, p array<int>")
    got = {r.i: r.s for r in df.select("i", captions.services(F.col("p")).alias("s")).collect()}
    assert [got[i] for i in range(len(packets))] == [named(p) for p in packets]


def test_reassembly(spark):
    rng = random.Random(8)
    rows, want = [], []
    for key in range(6):
        packet, owed, number, done = None, 0, 0, True
        for at in range(400):
            start = at in (5, 200) if key == 0 else rng.random() < (0.05, 0.1, 0.2, 0.5, 0, 1)[key]
            header = 0x40 if key == 0 else rng.choice([0x40, 1, 2, 0x43, 10])  # 0x40: the longest
            b1, b2 = header if start else rng.randrange(256), rng.randrange(256)
            rows.append((key, at, start, b1, b2))
            if start:
                number, packet, done, size = number + 1, [], False, b1 % 64
                owed = 2 * size - 1 if size else 127
            for b in (b2,) if start else (b1, b2):
                if not done:
                    packet.append(b)
                    if len(packet) == owed:
                        done = True
                        want.append((key, number, packet))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, at int, start boolean, b1 int, b2 int")
    got = sorted((r.key, r.number, r.packet) for r in captions.reassemble(df, "key", ["at"]).collect())
    assert got == sorted(want) and any(len(p) == 127 for _, _, p in got)
    assert captions.reassemble(df.where("at < 0"), "key", ["at"]).count() == 0


def test_spill(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.choice([0, 10, 150, 700, 5000])) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, arrival int, bytes int")
    got = sorted((r.k, r.cause, r.arrival, r.held) for r in folds.fold(df, "k", ["arrival"], folds.spill(1600), "k int, arrival int, cause int, held int").collect())
    want = []
    for k in range(3):
        here = []
        for _, i, size in (r for r in rows if r[0] == k):
            here += [(i, size)] if size else []
            if sum(s for _, s in here) > 1300:  # 1600 less an eighth and a sixteenth
                while sum(s for _, s in here) > 1200:
                    gone = here.pop(0)
                    want.append((k, i, gone[0], sum(s for _, s in here)))
    assert got == sorted(want)


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    assert store.read(spark, root, "x long, y string").count() == 0
    assert store.commit(rows, root, 3) and not store.commit(rows.limit(1), root, 3)
    assert store.commit(rows.where("x > 9"), root, 4)  # an empty batch
    rows.write.parquet(f"{root}/_attempts/1")  # an attempt that was lost before its rename
    assert sorted(tuple(r) for r in store.read(spark, root, "x long, y string").collect()) == [(1, "a", 3), (2, None, 3)]
    assert store.commit(rows, root, 5) and store.read(spark, root, "x long, y string").count() == 4


def test_store_sink(spark, tmp_path):
    root = str(tmp_path / "s")
    for _ in range(2):  # without a checkpoint the second run repeats the batch
        q = jobs.events(spark, f"{DIR}/event[s].parquet").select("event_id").writeStream.foreachBatch(store.sink(root)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert store.read(spark, root, "event_id long").count() == spark.read.parquet(f"{DIR}/events.parquet").count()


def test_permits(spark):
    rng = random.Random(10)
    rows = [(k, t, t, rng.choice([0, 1, 3, 9])) for k in range(3) for t in range(150)]
    df = spark.createDataFrame(rows, "k int, arrival int, t int, dur int")
    got = {(r.k, r.arrival): (r.status, r.held) for r in folds.fold(df, "k", ["t"], folds.permits(2), "k int, arrival int, status int, held int").collect()}
    for k in range(3):
        taken = []
        for _, arrival, t, dur in (r for r in rows if r[0] == k):
            busy = sum(e > t for e in taken)
            if busy < 2:
                taken.append(t + dur)
            assert got[k, arrival] == ((200, busy + 1) if busy < 2 else (503, 2))
    assert {s for s, _ in got.values()} == {200, 503}
