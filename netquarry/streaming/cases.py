"""Streaming sessions and streaming workflow."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netquarry.operators.cases import apply_move, clean_reason
from netquarry.schemas import CLOSED_STATUSES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_sessions(
    alerts: DataFrame, gap_seconds: int = 3600, delay: str | None = "60 minutes"
) -> DataFrame:
    """Sessions of alerts per entity without caps: each alert keeps its session open until the
    gap after its own end. An alert beginning exactly at that moment still joins."""
    rows = alerts.withWatermark("first_seen", delay) if delay else alerts
    length = F.concat(
        (F.unix_micros("last_seen") - F.unix_micros("first_seen") + F.lit(gap_seconds * 1_000_000)).cast("string"),
        F.lit(" microseconds"),
    )
    return (
        rows.groupBy(
            F.session_window("first_seen", length).alias("w"), "entity_type", "entity_value"
        )
        .agg(
            F.count("*").alias("alerts"),
            F.max("severity").alias("member_max"),
            F.array_sort(F.collect_set("rule_id")).alias("rules"),
            F.max("last_seen").alias("window_end"),
        )
        .select(
            "entity_type",
            "entity_value",
            F.col("w.start").alias("window_start"),
            "window_end",
            "alerts",
            "member_max",
            "rules",
        )
    )


CHUNK = 1024


def _place(item: tuple) -> tuple:
    return tuple((x is not None, x) for x in item)


class _Ordered(StatefulProcessor):
    """Applies ``step`` to a key's rows in event order; the first of ``columns`` is the time. Rows wait
    in sorted chunks under the millisecond of their first row. A key has one timer, at its earliest row;
    it takes out all that the watermark has passed, chunk by chunk, and does not read chunks that
    begin later. What stays per key is one small value."""

    buffer_schema: str
    value_schema: str
    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", "ms long, number long", f"items array<struct<{self.buffer_schema}>>"
        )
        self.value = handle.getValueState("value", f"{self.value_schema}, first_ms long, number long")

    def _read(self) -> tuple[tuple | None, int | None, int]:
        """The value, the earliest waiting millisecond, the last chunk's number: one read, since
        each call to the state costs more than a row."""
        held = self.value.get()
        if held is None:
            return None, None, 0
        *state, first, number = held
        return (None if state[0] is None else tuple(state)), first, number or 0

    def _write(self, state: tuple | None, first: int | None, number: int) -> None:
        empty = (None,) * len(self.value_schema.split(","))
        self.value.update((*(empty if state is None else state), first, number))

    def _keep(self, items: list[tuple], number: int) -> tuple[int | None, int]:
        """Store sorted rows; the first millisecond among them and the last chunk's number."""
        for at in range(0, len(items), CHUNK):
            number += 1
            chunk = items[at : at + CHUNK]
            self.waiting.updateValue((int(chunk[0][0]) // 1000, number), (chunk,))
        return (int(items[0][0]) // 1000 if items else None), number

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state, due, number = self._read()
        first = due
        # a key's rows may be many
        while batch := list(islice(rows, 8 * CHUNK)):
            items = sorted((tuple(row[c] for c in self.columns) for row in batch), key=_place)
            ms, number = self._keep(items, number)
            first = min((x for x in (first, ms) if x is not None), default=None)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due + 1)
            self.handle.registerTimer(first + 1)
        self._write(state, first, number)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        state, _, number = self._read()
        later = None
        due = []
        for ms, chunk in self.waiting.keys():
            if ms < mark:
                due.append((ms, chunk))
            else:
                later = ms if later is None else min(later, ms)
        due.sort(reverse=True)
        ready: list[tuple[tuple, tuple]] = []
        left: list[tuple] = []
        while due or ready:
            # every chunk that may hold the next row
            while due and (not ready or due[-1][0] <= ready[0][1][0] // 1000):
                chunk = due.pop()
                for item in map(tuple, self.waiting.getValue(chunk)[0]):
                    if item[0] // 1000 < mark:
                        heapq.heappush(ready, (_place(item), item))
                    else:
                        left.append(item)
                self.waiting.removeKey(chunk)
            state, produced = self.step(key, state, heapq.heappop(ready)[1])
            yield Row(**dict(zip(self.output, produced, strict=True)))
        ms, number = self._keep(sorted(left, key=_place), number)
        first = min((x for x in (ms, later) if x is not None), default=None)
        if first is not None:
            self.handle.registerTimer(first + 1)
        self._write(state, first, number)

    output: list[str]

    def step(self, key: Any, state: Any, item: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Workflow(_Ordered):
    buffer_schema = "us: long, request_id: long, to_status: string, reason: string"
    value_schema = "status string, closed_us long, closure_reason string"
    columns = ("us", "request_id", "to_status", "reason")
    output = [
        "incident_id", "us", "request_id", "from_status", "to_status", "outcome", "status",
        "closed_us", "closure_reason",
    ]

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._write((str(initialState["status"]), None, None), None, 0)

    def step(self, key: Any, state: Any, item: tuple) -> tuple[tuple, tuple]:
        status, closed, why = state if state is not None else ("new", None, None)
        us, request, target, reason = item
        verdict = apply_move(status, target)
        before = status
        if verdict == "moved":
            shut = target in CLOSED_STATUSES
            status, closed, why = target, us if shut else None, reason if shut else None
        after = (status, closed, why)
        return after, (key[0], us, request, before, target, verdict, *after)


def stream_workflow(
    transitions: DataFrame, delay: str = "10 minutes", cases: DataFrame | None = None
) -> DataFrame:
    """Status requests applied per case in time order as they arrive, each with the case as it
    leaves it: ``status``, and while closed ``closed_us`` and ``closure_reason`` (from a ``reason``
    column, where there is one). A case begins with its status in ``cases`` (a table of
    ``incident_id``, ``status``) or else as ``new``. Needs the RocksDB state store
    (:data:`ROCKSDB`)."""
    given = F.col("reason") if "reason" in transitions.columns else F.lit(None).cast("string")
    rows = (
        transitions.withWatermark("requested_at", delay)
        .withColumn("us", F.unix_micros("requested_at"))
        .withColumn("reason", clean_reason(given))
    )
    return rows.groupBy("incident_id").transformWithState(
        statefulProcessor=_Workflow(),
        outputStructType="incident_id string, us long, request_id long, from_status string,"
        " to_status string, outcome string, status string, closed_us long, closure_reason string",
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if cases is None else cases.select("incident_id", "status").groupBy("incident_id"),
    )


class _Sessions(_Ordered):
    buffer_schema = "us: long, end_us: long, alert_id: string"
    value_schema = "start_us long, end_us long, n long, part long"
    columns = ("us", "end_us", "alert_id")
    output = ["correlation_key", "alert_id", "part"]

    def __init__(self, gap_us: int, span_us: int, cap: int) -> None:
        self.gap_us, self.span_us, self.cap = gap_us, span_us, cap

    def step(self, key: Any, state: Any, item: tuple) -> tuple[tuple, tuple]:
        us, end, alert = item
        if state is not None:
            start, reach, n, part = state
            if us - reach <= self.gap_us and max(reach, end) - start <= self.span_us and n < self.cap:
                return (start, max(reach, end), n + 1, part), (key[0], alert, part)
        else:
            part = 0
        return (us, end, 1, part + 1), (key[0], alert, part + 1)


def stream_capped_sessions(
    alerts: DataFrame,
    gap_seconds: int = 3600,
    max_span_seconds: int = 86_400,
    max_n: int = 500,
    delay: str = "60 minutes",
) -> DataFrame:
    """``(correlation_key, alert_id, part)``: capped sessions as alerts arrive. The state per
    entity is the open session's start, end and size, and the alerts the watermark has not
    passed yet."""
    rows = alerts.withWatermark("first_seen", delay).select(
        F.concat_ws("=", "entity_type", "entity_value").alias("correlation_key"),
        "first_seen",
        F.unix_micros("first_seen").alias("us"),
        F.unix_micros("last_seen").alias("end_us"),
        F.col("alert_id").cast("string").alias("alert_id"),
    )
    return rows.groupBy("correlation_key").transformWithState(
        statefulProcessor=_Sessions(gap_seconds * 1_000_000, max_span_seconds * 1_000_000, max_n),
        outputStructType="correlation_key string, alert_id string, part long",
        outputMode="Append",
        timeMode="EventTime",
    )
