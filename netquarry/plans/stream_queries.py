"""Registered queries: the streaming operators run to the end of the available data, packets and
reports over the cases the orders make."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netquarry.operators.correlate import propose_cases
from netquarry.operators.packets import evidence_packets, packet_parts
from netquarry.operators.reports import case_reports, report_rows
from netquarry.operators.rules import PortScanParams
from netquarry.plans import adapters as A
from netquarry.plans import case_queries as CQ
from netquarry.plans import ingest_queries as IQ
from netquarry.plans.registry import query
from netquarry.session import checkpoint_dir, materialize
from netquarry.sources.normalize import judge_lines
from netquarry.streaming import cases as SC
from netquarry.streaming.detect import stream_port_scan


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as a file stream."""
    shape = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(shape).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(sf_dir)


class _StreamTables:
    """Lets the adapters read streams in place of tables."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path: str) -> DataFrame:
        folder, name = os.path.split(path)
        return _stream(self.spark, folder, name.removesuffix(".parquet"))


def _drain(out: DataFrame, base: str) -> None:
    """Run to the end of what the sources hold now; a second call goes on from the first."""
    running = (
        out.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def _run(
    spark: SparkSession,
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    closing: dict[str, object] | None = None,
    rocks: bool = False,
) -> DataFrame:
    """Run ``build(source)`` to the end of the input into a table in the shared folder, then read
    the table. With ``closing``, a row with these values follows the input: its time lies past all
    others, so the watermark passes them and nothing stays open but that row."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if rocks:
        spark.conf.set(key, SC.ROCKSDB)
    try:
        if closing is None:
            out = build(source)
            _drain(out, base)
        else:
            shape = StructType([StructField(f.name, f.dataType) for f in source.schema])
            last = f"{base}/closing"
            spark.createDataFrame([], shape).write.parquet(last)
            out = build(source.unionByName(spark.readStream.schema(shape).parquet(last)))
            _drain(out, base)
            row = [tuple(closing.get(name) for name in shape.names)]
            spark.createDataFrame(row, shape).write.mode("append").parquet(last)
            _drain(out, base)
    finally:
        if rocks:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


FAR = datetime(2200, 1, 1, tzinfo=UTC)


@query(
    "stream_normalize",
    f"SELECT event_id AS line_number, {IQ._REASONS_SQL}[event_id % 12 + 1] AS outcome FROM events",
)
def q_stream_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = IQ.raw_lines(_StreamTables(spark), sf_dir)
    judged = judge_lines(lines, F.lit(IQ.AS_OF).cast("timestamp"))
    return _run(
        spark,
        judged,
        lambda rows: rows.select("line_number", F.coalesce("reason", F.lit("event")).alias("outcome")),
    )


@query(
    "stream_port_scan",
    f"""WITH {A.FLOWS_SQL}, f AS (SELECT *, t - t % 600 AS b FROM flows)
    SELECT src AS entity_value, b AS bucket, count(*) AS event_count, count(DISTINCT dest_port) AS ports, count(DISTINCT dest) AS hosts
    FROM f GROUP BY 1, 2
    HAVING count(*) >= 20 AND (count(DISTINCT dest_port) >= 20 OR count(DISTINCT dest) >= 15)""",
)
def q_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = {
        "event_type": "flow", "src_ip": "0.0.0.0", "dest_ip": "0.0.0.0", "dest_port": 0,
        "event_time": FAR,
    }
    flows = A.flows(_StreamTables(spark), sf_dir)
    fired = _run(spark, flows, lambda rows: stream_port_scan(rows, PortScanParams()), closing)
    return fired.select(
        "entity_value",
        F.unix_seconds("window_bucket").alias("bucket"),
        "event_count",
        F.col("ports").cast("bigint").alias("ports"),
        F.col("hosts").cast("bigint").alias("hosts"),
    )


@query(
    "stream_sessions",
    CQ._ISLANDS_SQL
    + """, g AS (SELECT entity_value, island, count(*) AS alerts, min(s) AS start_s, max(e) AS end_s FROM i GROUP BY 1, 2)
    SELECT entity_value, alerts, start_s, end_s FROM g""",
)
def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.order_alerts(_StreamTables(spark), sf_dir)
    closing = {"entity_type": "end", "entity_value": "end", "first_seen": FAR, "last_seen": FAR}
    out = _run(spark, alerts, lambda rows: SC.stream_sessions(rows, 30 * A.DAY), closing)
    return out.select(
        "entity_value",
        "alerts",
        F.unix_seconds("window_start").alias("start_s"),
        F.unix_seconds("window_end").alias("end_s"),
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CQ.requests(_stream(spark, sf_dir, "orders")).withColumn(
        "incident_id", F.col("incident_id").cast("string")
    )


_LAST_REQUEST = {"incident_id": "end", "requested_at": FAR, "request_id": -1, "to_status": "new"}


@query(
    "stream_workflow",
    CQ._WORKFLOW_SQL,
)
def q_stream_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, _requests(spark, sf_dir), SC.stream_workflow, _LAST_REQUEST, rocks=True)
    return out.select("request_id", "from_status", "outcome")


@query("stream_workflow_final", CQ.moved_sql())
def q_stream_workflow_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a status of their own, and how the last request leaves them."""
    cases = CQ.started_cases(A.table(spark, sf_dir, "orders")).withColumn(
        "incident_id", F.col("incident_id").cast("string")
    )
    out = _run(
        spark,
        _requests(spark, sf_dir),
        lambda rows: SC.stream_workflow(rows, cases=cases),
        _LAST_REQUEST,
        rocks=True,
    )
    last = out.groupBy("incident_id").agg(
        F.max_by(F.struct("status", "closed_us", "closure_reason"), F.struct("us", "request_id")).alias("l")
    )
    return last.select(
        F.col("incident_id").cast("bigint").alias("incident_id"),
        "l.status",
        F.floor(F.col("l.closed_us") / 1_000_000).alias("closed_s"),
        "l.closure_reason",
    )


@query(
    "stream_capped_sessions",
    CQ._CAPPED_SQL
    + """, x AS (SELECT w.alert_id, w.entity_value, w.grp FROM w)
    SELECT CAST(alert_id AS VARCHAR) AS alert_id, grp AS part FROM x""",
)
def q_stream_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids are padded so that their text order is their number order
    alerts = A.order_alerts(_StreamTables(spark), sf_dir).withColumn(
        "alert_id", F.lpad(F.col("alert_id").cast("string"), 15, "0")
    )
    closing = {
        "entity_type": "end", "entity_value": "end", "alert_id": "0", "first_seen": FAR, "last_seen": FAR
    }
    out = _run(
        spark,
        alerts,
        lambda rows: SC.stream_capped_sessions(rows, 30 * A.DAY, 90 * A.DAY, 6),
        closing,
        rocks=True,
    )
    return out.select(F.col("alert_id").cast("bigint").cast("string").alias("alert_id"), "part")


# ------------------------------------------------------------------ packets and reports


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cases, alerts with their case, timeline)`` from the orders."""
    alerts = A.order_alerts(spark, sf_dir)
    proposals, members = propose_cases(alerts, CQ.TIGHT)
    case_id = F.concat_ws("/", "correlation_key", F.col("island").cast("string"), F.col("part").cast("string"))
    cases = materialize(
        proposals.select(
            case_id.alias("incident_id"),
            F.concat(F.lit("CASE-"), case_id).alias("case_number"),
            "correlation_key",
            "title",
            "severity",
            F.to_json(F.struct("member_max", "distinct_rule_count")).alias("severity_rationale"),
            F.lit("new").alias("status"),
            "distinct_rule_count",
            "window_start",
            "window_end",
            F.col("window_end").alias("created_at"),
            F.col("window_end").alias("updated_at"),
            F.col("entity_value").alias("subject"),
        )
    )
    key = F.col("alert_id")
    facts = F.to_json(
        F.struct(
            (key % 50).alias("flows"),
            F.array(A.dotted(key % 1000 + A.OUTSIDE), F.col("entity_value")).alias("sample_dest_hosts"),
            F.lit("tls").alias("app_proto"),
            F.lit("x").alias("unlisted"),
        )
    )
    linked = members.select("alert_id", case_id.alias("incident_id")).join(
        alerts.withColumns(
            {
                "confidence": F.lit(0.75),
                "event_count": key % 50 + 1,
                "evidence": facts,
                "rule_version": F.lit(1),
            }
        ),
        "alert_id",
    ).withColumn("status", F.lit("correlated"))
    timeline = linked.select(
        "incident_id",
        F.col("first_seen").alias("occurred_at"),
        F.lpad(key.cast("string"), 15, "0").alias("entry_id"),
        F.lit("alert_fired").alias("entry_type"),
        F.concat(F.col("rule_id"), F.lit(" fired on src_ip "), F.col("entity_value")).alias("summary"),
    )
    return cases, materialize(linked), timeline


@query(
    "evidence_packets",
    CQ._PROPOSALS_SQL
    + """ SELECT entity_value AS subject, start_s, CAST(alerts AS INTEGER) AS alerts, CAST(alerts AS INTEGER) AS lines,
                 false AS truncated, CAST(alerts AS INTEGER) AS withheld, false AS leaks FROM props""",
)
def q_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, alerts, timeline = _cases(spark, sf_dir)
    packets, _ = evidence_packets(cases, alerts, timeline)
    doc = F.try_parse_json("packet_json")
    return packets.join(cases.select("incident_id", "subject", "window_start"), "incident_id").select(
        "subject",
        F.unix_seconds("window_start").alias("start_s"),
        F.size(F.try_variant_get(doc, "$.alerts", "ARRAY<VARIANT>")).alias("alerts"),
        F.size(F.try_variant_get(doc, "$.timeline", "ARRAY<STRING>")).alias("lines"),
        "truncated",
        F.size("dropped").alias("withheld"),
        F.regexp_replace("packet_json", '"case_number":"[^"]*"', "").contains(F.col("subject")).alias("leaks"),
    )


# packets so small that a case takes several: the fixed facts of a packet, its room, its items
_STAMP = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_PARTS_SQL = (
    CQ._PROPOSALS_SQL
    + f""",
a AS (SELECT m.*, g.start_s, {A.dotted_sql(f"(alert_id % 1000 + {A.OUTSIDE})")} AS dest,
             row_number() OVER (PARTITION BY m.entity_value, m.grp ORDER BY s, alert_id) AS place
      FROM m JOIN g ON g.entity_value = m.entity_value AND g.grp = m.grp),
firsts AS (SELECT entity_value, grp, dest, row_number() OVER (PARTITION BY entity_value, grp ORDER BY min(place)) AS token FROM a GROUP BY 1, 2, 3),
items AS (
  SELECT a.entity_value, a.start_s, 0 AS part, place,
         '{{"confidence":0.75,"entity":"asset-A","event_count":' || (alert_id % 50 + 1) || ',"evidence":{{"app_proto":"tls","flows":' || (alert_id % 50)
         || ',"sample_dest_hosts":["ext-' || token || '","asset-A"]}},"first_seen":"' || {_STAMP.format("s")} || '","last_seen":"' || {_STAMP.format("e")}
         || '","rule_id":"' || rule_id || '","severity":' || severity || '}}' AS text
  FROM a JOIN firsts f ON f.entity_value = a.entity_value AND f.grp = a.grp AND f.dest = a.dest
  UNION ALL
  SELECT entity_value, start_s, 1, place, '"' || rule_id || ' fired on src_ip asset-A"' FROM a),
laid AS (SELECT *, strlen(text) + 1 AS size, sum(strlen(text) + 1) OVER (PARTITION BY entity_value, start_s ORDER BY part, place) - strlen(text) - 1 AS start FROM items),
cut AS (SELECT *, start // 600 AS stretch, start + size > (start // 600 + 1) * 600 AS across FROM laid),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY entity_value, start_s ORDER BY stretch, across) AS packet_no FROM cut)
SELECT entity_value AS subject, start_s, packet_no, coalesce(string_agg(text, ',' ORDER BY place) FILTER (WHERE part = 0), '') AS alerts,
       coalesce(string_agg(text, ',' ORDER BY place) FILTER (WHERE part = 1), '') AS lines, false AS oversize, true AS fits FROM numbered GROUP BY 1, 2, 3"""
)


@query("packet_parts", _PARTS_SQL)
def q_packet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, alerts, timeline = _cases(spark, sf_dir)
    parts, _, _ = packet_parts(cases, alerts, timeline, 1100, room=600)
    return parts.join(cases.select("incident_id", "subject", "window_start"), "incident_id").select(
        "subject",
        F.unix_seconds("window_start").alias("start_s"),
        "packet_no",
        F.array_join("alerts", ",").alias("alerts"),
        F.array_join("lines", ",").alias("lines"),
        "oversize",
        (F.octet_length("packet_json") <= 1100).alias("fits"),
    )


@query(
    "case_reports",
    CQ._PROPOSALS_SQL
    + """ SELECT entity_value AS subject, start_s, alerts * 2 AS mentions, true AS ends_well FROM props""",
)
def q_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, alerts, timeline = _cases(spark, sf_dir)
    reports = case_reports(cases, alerts, timeline=timeline)
    counted = F.size(F.regexp_extract_all("markdown", F.lit(r"(?m)^(### D|- Alert: )"), F.lit(1)))
    return reports.join(cases.select("case_number", "subject", "window_start"), "case_number").select(
        "subject",
        F.unix_seconds("window_start").alias("start_s"),
        counted.cast("bigint").alias("mentions"),
        (F.col("markdown").endswith("\n") & ~F.col("markdown").endswith("\n\n")).alias("ends_well"),
    )


def _md(text: str) -> str:
    return f"""regexp_replace({text}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"""


def _day(seconds: str) -> str:
    return f"strftime(to_timestamp({seconds}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%SZ')"


# sections and rows of the reports, but for the first text, which has the numbers of islands
_ROWS_SQL = (
    CQ._PROPOSALS_SQL
    + f""",
a AS (SELECT m.*, g.start_s,
             row_number() OVER (PARTITION BY m.entity_value, m.grp ORDER BY s, rule_id, CAST(alert_id AS VARCHAR)) AS place,
             row_number() OVER (PARTITION BY m.entity_value, m.grp ORDER BY s, alert_id) AS entry
      FROM m JOIN g ON g.entity_value = m.entity_value AND g.grp = m.grp),
frames(section, text) AS (VALUES
  (10, '## Inventory matches' || chr(10) || chr(10) || '_None._'),
  (20, '## Alerts' || chr(10) || chr(10) || '| Rule | Severity | Confidence | Entity | Events | First seen | Last seen |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- |'),
  (30, '## Timeline' || chr(10) || chr(10) || '| When | What | Summary |' || chr(10) || '| --- | --- | --- |'),
  (40, '## Notes' || chr(10) || chr(10) || '_Empty._'),
  (50, '## Model briefs' || chr(10) || chr(10) || '_None on file._'),
  (60, '## Reading guide' || chr(10) || chr(10) || '- Rules measure traffic. Their results need a reader''s judgement.' || chr(10)
       || '- Each alert covers one time window of one rule.' || chr(10) || '- The inventory knows no owner for these addresses.'),
  (70, '## Ingest batches' || chr(10) || chr(10) || '_Unknown._')),
texts AS (
  SELECT entity_value, start_s, section, 0 AS position, text FROM g, frames
  UNION ALL
  SELECT entity_value, start_s, 21, place, '| ' || {_md("rule_id")} || ' v1 | ' || severity || ' | 0.75 | ' || {_md("'src_ip=' || entity_value")}
         || ' | ' || (alert_id % 50 + 1) || ' | ' || {_day("s")} || ' | ' || {_day("e")} || ' |' FROM a
  UNION ALL
  SELECT entity_value, start_s, 22, place, '### ' || {_md("rule_id")} || ' on ' || {_md("entity_value")} || chr(10) || chr(10) || '- Alert: `' || alert_id || '`' || chr(10)
         || '- Status: `correlated`' || chr(10) || chr(10) || 'What the rule measured:' || chr(10) || chr(10) || '```json' || chr(10)
         || '{{"app_proto":"tls","flows":' || (alert_id % 50) || ',"sample_dest_hosts":["' || {A.dotted_sql(f"(alert_id % 1000 + {A.OUTSIDE})")} || '","' || entity_value
         || '"],"unlisted":"x"}}' || chr(10) || '```' FROM a
  UNION ALL
  SELECT entity_value, start_s, 31, entry, '| ' || {_day("s")} || ' | alert\\_fired | ' || {_md("rule_id || ' fired on src_ip ' || entity_value")} || ' |' FROM a)
SELECT entity_value AS subject, start_s, section, position, text FROM texts"""
)


@query("report_rows", _ROWS_SQL)
def q_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, alerts, timeline = _cases(spark, sf_dir)
    rows = report_rows(cases, alerts, timeline=timeline).filter("section > 0")
    named = cases.select("case_number", "subject", "window_start")
    return rows.join(named, "case_number").select(
        "subject", F.unix_seconds("window_start").alias("start_s"), "section", "position", "text"
    )
