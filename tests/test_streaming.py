import json
import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from netquarry.operators.rules import RULES
from netquarry.streaming import cases as SC
from netquarry.streaming import detect as SD
from netquarry.streaming import ingest as SI
from tests.cases import START, Case



def as_of():
    return F.lit("2026-09-05 12:00:00").cast("timestamp")


def drain(df, tmp, name, mode="append", sink=None):
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp / f"cp-{name}"))
    q = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    try:
        assert q.awaitTermination(150), "stream did not end"
    finally:
        q.stop()


def put(folder, name, text, order):
    """Files are taken in the order of their modification time."""
    (folder / name).write_text(text)
    stamp = time.time() - 1000 + order * 10
    os.utime(folder / name, (stamp, stamp))


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    root = tmp_path_factory.mktemp("feed")
    scan = Case("D-001", "positive", "s", "10.10.0.21")
    for i in range(40):
        scan.flow(i * 3, "10.10.0.21", "10.10.0.5", 1000 + i, answered=False)
    auth = Case("D-002", "positive", "a", "10.10.0.66")
    for i in range(60):
        auth.auth(i * 1.6, "10.10.0.66", "10.10.0.5", 22, "SSH Brute Force", 1)
    late = Case("D-001", "negative", "l")
    late.flow(3 * 3600, "10.10.0.9", "10.10.0.5", 443)
    put(root, "a.ndjson", "\n".join(scan.lines + ["{broken", ""] + scan.lines[:5]) + "\n", 0)
    put(root, "b.ndjson", "\n".join(auth.lines) + "\n", 1)
    put(root, "z.ndjson", "\n".join(late.lines) + "\n", 2)
    return root


def test_storage_branch_is_idempotent_and_windows_close(spark, feed, tmp_path):
    events, rejects = SI.stream_normalize(spark, str(feed), as_of(), max_files=1)
    store = SI.store_batch(str(tmp_path / "events"))
    run = SD.detect_closed_windows(
        store, str(tmp_path / "events"), str(tmp_path / "alerts"), str(tmp_path / "edges"),
        [RULES["D-001"], RULES["D-002"]])

    def twice(batch, epoch):
        run(batch, epoch)
        store(batch, epoch)

    drain(events, tmp_path, "events", sink=twice)
    stored = spark.read.parquet(str(tmp_path / "events"))
    assert stored.count() == stored.select("event_hash").distinct().count() == 101
    alerts = {(r.rule_id, r.entity_value) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert alerts == {("D-001", "10.10.0.21"), ("D-002", "10.10.0.66")}
    drain(rejects, tmp_path, "rejects")
    assert [r.reason_code for r in spark.table("rejects").collect()] == ["json_parse"]

    again = str(tmp_path / "swept")
    sweep = SD.sweep_batch(str(tmp_path / "events"), again, lambda epoch: START + timedelta(minutes=61),
                           rules=[RULES["D-001"], RULES["D-002"]])
    sweep(stored, 0)
    sweep(stored, 1)
    swept = spark.read.parquet(again)
    assert sorted(r.rule_id for r in swept.collect()) == ["D-001", "D-002"]


def test_native_port_scan_equals_batch(spark, feed, tmp_path):
    events, _ = SI.stream_normalize(spark, str(feed), as_of(), max_files=1)
    fired = SD.stream_port_scan(SI.dedup_for_detection(events), delay=None)
    drain(fired, tmp_path, "scans")
    got = spark.table("scans").collect()
    assert [(r.entity_value, r.ports, r.hosts, r.event_count, r.confidence) for r in got] == [("10.10.0.21", 40, 1, 40, 1.0)]


def alert_files(path, batches):
    path.mkdir()
    for i, rows in enumerate(batches):
        put(path, f"{i}.json", "\n".join(json.dumps(r) for r in rows) + "\n", i)


def iso(seconds):
    return (datetime(2026, 9, 1, tzinfo=UTC) + timedelta(seconds=seconds)).isoformat()


def alert(i, who, s, e):
    return {"alert_id": f"a{i}", "rule_id": "D-001", "severity": 3, "entity_type": "src_ip", "entity_value": who,
            "first_seen": iso(s), "last_seen": iso(e)}


ALERTS = ("alert_id string, rule_id string, severity int, entity_type string, entity_value string, first_seen timestamp,"
          " last_seen timestamp")


def test_sessions(spark, tmp_path):
    alert_files(tmp_path / "in", [
        [alert(1, "x", 0, 60), alert(2, "x", 3660, 3700), alert(3, "y", 10, 20)],
        [alert(4, "x", 20000, 20010)], [alert(5, "x", 90000, 90000)]])
    rows = spark.readStream.schema(ALERTS).option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    drain(SC.stream_sessions(rows), tmp_path, "sessions")
    got = sorted((r.entity_value, r.alerts) for r in spark.table("sessions").collect())
    assert got == [("x", 1), ("x", 2), ("y", 1)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SC.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_workflow(spark, tmp_path, rocks):
    moves = [("a", 0, 1, "triaging"), ("a", 60, 3, "contained_recommended"), ("b", 5, 4, "contained_recommended")]
    later = [("a", 30, 2, "investigating"), ("zz", 90000, 9, "triaging")]
    path = tmp_path / "moves"
    path.mkdir()
    for i, part in enumerate([moves, later, [("zz", 90001, 10, "triaging")]]):
        put(path, f"{i}.json", "\n".join(json.dumps(
            {"incident_id": c, "requested_at": iso(s), "request_id": r, "to_status": t}) for c, s, r, t in part) + "\n", i)
    rows = spark.readStream.schema("incident_id string, requested_at timestamp, request_id long, to_status string").option(
        "maxFilesPerTrigger", "1").json(str(path))
    drain(SC.stream_workflow(rows), tmp_path, "moves")
    got = {r.request_id: (r.from_status, r.outcome) for r in spark.table("moves").collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {
        1: ("new", "moved"), 2: ("triaging", "moved"), 3: ("investigating", "moved"), 4: ("new", "illegal")}


def test_capped_sessions(spark, tmp_path, rocks):
    alert_files(tmp_path / "in", [
        [alert(1, "x", 0, 10), alert(3, "x", 200, 210)], [alert(2, "x", 100, 110), alert(4, "x", 300, 310)],
        [alert(9, "z", 90000, 90001)], [alert(10, "z", 190000, 190001)]])
    rows = spark.readStream.schema(ALERTS).option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    drain(SC.stream_capped_sessions(rows, max_n=3), tmp_path, "capped")
    got = {r.alert_id: r.part for r in spark.table("capped").collect()}
    assert {k: got[k] for k in ("a1", "a2", "a3", "a4")} == {"a1": 1, "a2": 1, "a3": 1, "a4": 2}


class _Calls:
    """State of one key, counting what is asked of it."""

    def __init__(self):
        self.timers, self.chunks, self.value, self.calls = set(), {}, None, 0

    def getMapState(self, *_):
        held = self

        class Map:
            def updateValue(self, key, value):
                held.calls += 1
                held.chunks[key] = value

            def getValue(self, key):
                held.calls += 1
                return held.chunks[key]

            def removeKey(self, key):
                held.calls += 1
                del held.chunks[key]

            def containsKey(self, key):
                held.calls += 1
                return key in held.chunks

            def keys(self):
                held.calls += 1
                return iter(list(held.chunks))

        return Map()

    def getValueState(self, *_):
        held = self

        class Value:
            def exists(self):
                held.calls += 1
                return held.value is not None

            def get(self):
                held.calls += 1
                return held.value

            def update(self, value):
                held.calls += 1
                held.value = value

        return Value()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_ordered_state_takes_few_calls_and_keeps_event_order():
    """5,000 requests of one case at as many times arrive out of order in three batches."""
    handle, machine = _Calls(), SC._Workflow()
    machine.init(handle)
    order = [(i * 2003) % 5000 for i in range(5000)]
    rows = [Row(us=i * 1_000_000, request_id=i, to_status="triaging", reason=None) for i in order]
    got = []
    for at, mark in ((0, 0), (2000, 0), (4000, 2_500_500)):
        list(machine.handleInputRows(("a",), iter(rows[at : at + 2000]), _Mark(mark)))
        assert len(handle.timers) == 1
    for mark in (2_500_500, 9_000_000):
        (timer,) = handle.timers
        assert timer < mark
        handle.timers.clear()
        got.append([r["request_id"] for r in machine.handleExpiredTimer(("a",), _Mark(mark), None)])
    assert got[0] + got[1] == list(range(5000)) and len(got[0]) == 2501
    assert not handle.timers and not handle.chunks
    assert handle.calls < 100
