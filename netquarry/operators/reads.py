"""Filters, pages and counts over the stored tables. Filters compare stored columns with
literals wherever they can, so they reach the parquet scan; nothing here shuffles unless it
counts or sorts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.ip import ip_in
from netquarry.operators.pieces import MICRO, carry_in, with_piece
from netquarry.operators.prefix import memberships
from netquarry.schemas import CLOSED_STATUSES
from netquarry.session import materialize


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _end_matches(column: str, wanted: str) -> Column:
    """An address is compared as text; a network by range."""
    return ip_in(F.col(column), wanted) if "/" in wanted else F.col(column) == wanted


def query_events(
    events: DataFrame,
    start: datetime,
    end: datetime,
    types: Sequence[str] | None = None,
    src: str | None = None,
    dest: str | None = None,
    src_port: int | None = None,
    dest_port: int | None = None,
    flow_id: int | None = None,
    batch_id: str | None = None,
    payload: bool = False,
) -> DataFrame:
    """Events of an interval, both its ends included, matching every filter given. The day partition is filtered as well when the table has one, and the record itself
    is read only on request."""
    if end < start:
        raise ValueError("the interval ends before it starts")
    tests = [F.col("event_time") >= F.lit(start), F.col("event_time") <= F.lit(end)]
    if "event_date" in events.columns:
        tests += [
            F.col("event_date") >= F.lit(start.date()),
            F.col("event_date") <= F.lit(end.date()),
        ]
    if types:
        tests.append(F.col("event_type").isin(*types))
    exact = {
        "src_port": src_port, "dest_port": dest_port, "flow_id": flow_id, "batch_id": batch_id
    }
    tests += [F.col(name) == value for name, value in exact.items() if value is not None]
    for column, wanted in (("src_ip", src), ("dest_ip", dest)):
        if wanted is not None:
            tests.append(_end_matches(column, wanted))
    found = events.filter(_all(tests))
    return found if payload or "payload" not in events.columns else found.drop("payload")


def events_of_asset(events: DataFrame, networks: DataFrame, asset_id: str) -> DataFrame:
    """Events with either end inside a network of the asset."""
    return events_of_networks(events, networks.filter(F.col("asset_id") == asset_id))


def events_of_networks(events: DataFrame, networks: DataFrame) -> DataFrame:
    """Events with either end inside any of the networks: the addresses inside are found once,
    and the events are read once and met with them at both ends."""
    ends = events.select("src_ip").union(events.select("dest_ip")).toDF("address").distinct()
    inside = materialize(memberships(ends, "address", networks).select("address").distinct())
    src = inside.select(F.col("address").alias("src_ip"), F.lit(True).alias("_src"))
    dest = inside.select(F.col("address").alias("dest_ip"), F.lit(True).alias("_dest"))
    met = events.join(src, "src_ip", "left").join(dest, "dest_ip", "left")
    return met.filter(F.col("_src") | F.col("_dest")).select(*events.columns)


def keyset_page(
    df: DataFrame,
    order: Sequence[str],
    limit: int,
    after: Sequence[object] | None = None,
    descending: bool = True,
) -> DataFrame:
    """The page of ``limit`` rows after the row ``after``, newest first, with ``has_more``. The
    order columns must identify a row. One top-k over the filter; nothing is skipped by offset."""
    if after is not None:
        clauses = []
        for i, column in enumerate(order):
            same = _all([F.col(c) == F.lit(v) for c, v in zip(order[:i], after)])
            value = F.lit(after[i])
            clauses.append(
                same & (F.col(column) < value if descending else F.col(column) > value)
            )
        df = df.filter(reduce(lambda a, b: a | b, clauses))
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    top = df.orderBy(*keys).limit(limit + 1)
    # at most limit + 1 rows are left
    place = Window.orderBy(*keys)
    everything = Window.partitionBy(F.lit(1))
    return (
        top.withColumn("_r", F.row_number().over(place))
        .withColumn("has_more", F.count("*").over(everything) > limit)
        .filter(F.col("_r") <= limit)
        .drop("_r")
    )


def filter_alerts(
    alerts: DataFrame,
    severity_min: int | None = None,
    rule_id: str | None = None,
    entity_type: str | None = None,
    entity_value: str | None = None,
    status: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    tests = []
    if severity_min is not None:
        tests.append(F.col("severity") >= severity_min)
    exact = {
        "rule_id": rule_id, "entity_type": entity_type, "entity_value": entity_value,
        "status": status,
    }
    tests += [F.col(n) == v for n, v in exact.items() if v is not None]
    if start is not None:
        tests.append(F.col("first_seen") >= F.lit(start))
    if end is not None:
        tests.append(F.col("first_seen") < F.lit(end))
    return alerts.filter(_all(tests))


def filter_incidents(
    incidents: DataFrame,
    status: str | None = None,
    open_only: bool = False,
    severity_min: int | None = None,
    correlation_key: str | None = None,
) -> DataFrame:
    tests = []
    if status is not None:
        tests.append(F.col("status") == status)
    if open_only:
        tests.append(~F.col("status").isin(*CLOSED_STATUSES))
    if severity_min is not None:
        tests.append(F.col("severity") >= severity_min)
    if correlation_key is not None:
        tests.append(F.col("correlation_key") == correlation_key)
    return incidents.filter(_all(tests))


def filter_assets(
    assets: DataFrame,
    active: bool | None = True,
    environment: str | None = None,
    criticality_min: int | None = None,
    tag: str | None = None,
    hostname_part: str | None = None,
) -> DataFrame:
    """``hostname_part`` is a plain substring in any case; no character in it is a wildcard."""
    tests = []
    if active is not None:
        tests.append(F.col("is_active") == active)
    if environment is not None:
        tests.append(F.col("environment") == environment)
    if criticality_min is not None:
        tests.append(F.col("criticality") >= criticality_min)
    if tag is not None:
        tests.append(F.array_contains("tags", tag))
    if hostname_part is not None:
        tests.append(F.lower("hostname").contains(hostname_part.lower()))
    return assets.filter(_all(tests))


def filter_batches(
    batches: DataFrame,
    status: str | None = None,
    source_label: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    tests = []
    if status is not None:
        tests.append(F.col("status") == status)
    if source_label is not None:
        tests.append(F.col("source_label") == source_label)
    if start is not None:
        tests.append(F.col("started_at") >= F.lit(start))
    if end is not None:
        tests.append(F.col("started_at") < F.lit(end))
    return batches.filter(_all(tests))


def filter_rejects(rejects: DataFrame, batch_id: str, reason_code: str | None = None) -> DataFrame:
    """One batch's rejects; page them with :func:`keyset_page` on ``line_number`` ascending."""
    tests = [F.col("batch_id") == batch_id]
    if reason_code is not None:
        tests.append(F.col("reason_code") == reason_code)
    return rejects.filter(_all(tests))


def filter_audit(
    audit: DataFrame,
    action: str | None = None,
    actor: str | None = None,
    result: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    exact = {"action": action, "actor": actor, "result": result}
    tests = [F.col(n) == v for n, v in exact.items() if v is not None]
    if start is not None:
        tests.append(F.col("occurred_at") >= F.lit(start))
    if end is not None:
        tests.append(F.col("occurred_at") < F.lit(end))
    return audit.filter(_all(tests))


def newest_n_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 200
) -> DataFrame:
    """The newest ``n`` rows per key with ``position`` (oldest first, from 1) and ``truncated``.
    One row more than asked decides ``truncated``, so the limit is pushed below the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    near = df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n + 1)
    whole = Window.partitionBy(*keys)
    seen = near.withColumn("_seen", F.max("_r").over(whole))
    return seen.filter(F.col("_r") <= n).select(
        *df.columns,
        (F.least(F.col("_seen"), F.lit(n)) - F.col("_r") + 1).alias("position"),
        (F.col("_seen") > n).alias("truncated"),
    )


def event_stats(events: DataFrame) -> DataFrame:
    """``(kind, label, n)``: counts by type and by UTC hour and in total. Rows are counted once
    by (type, hour); the three views are sums of that small table."""
    cells = events.groupBy(
        "event_type", F.date_format(F.date_trunc("hour", "event_time"), "yyyy-MM-dd HH").alias("hour")
    ).agg(F.count("*").alias("n"))
    views = F.explode(
        F.array(
            F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("label")),
            F.struct(F.lit("hour").alias("kind"), F.col("hour").alias("label")),
            F.struct(F.lit("total").alias("kind"), F.lit("").alias("label")),
        )
    )
    return (
        cells.select(views.alias("v"), "n")
        .groupBy("v.kind", "v.label")
        .agg(F.sum("n").alias("n"))
        .select("kind", "label", "n")
    )


def batch_span(events: DataFrame, hours: int = 24) -> DataFrame:
    """``(batch_id, first_event, last_event, sweep_from, sweep_to)``: the hour-aligned intervals
    of at most ``hours`` that cover each batch, the last ending with the hour after its end."""
    spans = events.groupBy("batch_id").agg(
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")
    )
    step = hours * 3600
    low = F.unix_timestamp(F.date_trunc("hour", "first_event"))
    high = F.unix_timestamp(F.date_trunc("hour", "last_event")) + 3600
    return (
        spans.withColumn("_hi", high)
        .withColumn("_s", F.explode(F.sequence(low, high - 1, F.lit(step).cast("bigint"))))
        .select(
            "batch_id",
            "first_event",
            "last_event",
            F.timestamp_seconds("_s").alias("sweep_from"),
            F.timestamp_seconds(F.least(F.col("_s") + step, F.col("_hi"))).alias("sweep_to"),
        )
    )


def latest_version(
    versions: DataFrame, keys: Sequence[str], version: str = "version"
) -> DataFrame:
    """The newest version per key and the number the next one will have."""
    others = [c for c in versions.columns if c not in keys]
    return (
        versions.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), version).alias("v"))
        .select(*keys, "v.*", (F.col(f"v.{version}") + 1).alias("next_version"))
    )


def quota_replay(
    hits: DataFrame,
    subject: Sequence[str],
    at: str,
    limit: int,
    window_seconds: int,
    order: Sequence[str],
    cost: str | None = None,
) -> DataFrame:
    """A fixed-window counter replayed over a request log: per hit ``used``, ``allowed``,
    ``remaining`` and ``retry_after`` (whole seconds past the window's end, 0 when allowed).
    A refused hit counts too. The running sum is taken in pieces of a window, with what earlier
    pieces used carried in, so one busy subject is spread over tasks."""
    us = F.unix_micros(F.col(at))
    span = window_seconds * MICRO
    price = F.lit(1) if cost is None else F.col(cost)
    keyed = hits.withColumns(
        {"_us": us, "_w": F.floor(us / span).cast("bigint"), "_cost": price.cast("bigint")}
    )
    keys = [*subject, "_w"]
    cut = with_piece(keyed, "_us", max(1, window_seconds // 16))
    earlier = carry_in(cut, keys, F.sum("_cost"), "sum", "_before")
    local = (
        Window.partitionBy(*keys, "_piece")
        .orderBy("_us", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    used = F.col("_before") + F.col("_mine")
    left = F.floor(((F.col("_w") + 1) * span - F.col("_us")) / F.lit(MICRO)) + 1
    return (
        cut.withColumn("_mine", F.sum("_cost").over(local))
        .join(earlier, [*keys, "_piece"])
        .select(
            *hits.columns,
            used.alias("used"),
            (used <= limit).alias("allowed"),
            F.greatest(F.lit(limit) - used, F.lit(0)).alias("remaining"),
            F.when(used > limit, F.greatest(left, F.lit(1))).otherwise(F.lit(0)).alias("retry_after"),
        )
    )


__all__ = [
    "batch_span", "event_stats", "events_of_asset", "events_of_networks", "filter_alerts",
    "filter_assets", "filter_audit", "filter_batches", "filter_incidents", "filter_rejects",
    "keyset_page", "latest_version", "newest_n_in_order", "query_events",
    "quota_replay",
]
