"""Registered queries: correlation, cases, retention, the sweep."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import cases as C
from netquarry.operators import evaluation
from netquarry.operators import retention as X
from netquarry.operators.correlate import (
    GapRules,
    correlation_summary,
    gap_groups,
    propose_cases,
    severity_rollup,
)
from netquarry.operators.sweep import sweep
from netquarry.plans import adapters as A
from netquarry.plans.detect_queries import FIRING_SQL, samples_sql
from netquarry.plans.registry import query

# a month's gap and no cap that bites: plain islands
LOOSE = GapRules(30 * A.DAY, 20 * 365 * A.DAY, 500, piece_seconds=90 * A.DAY)
# caps that bite often
TIGHT = GapRules(30 * A.DAY, 90 * A.DAY, 6, piece_seconds=90 * A.DAY)

_ISLANDS_SQL = f"""
WITH RECURSIVE {A.ALERTS_SQL},
p AS (SELECT *, max(e) OVER (PARTITION BY entity_value ORDER BY s, e, alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM alerts),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > {30 * A.DAY} THEN 1 ELSE 0 END)
               OVER (PARTITION BY entity_value ORDER BY s, e, alert_id ROWS UNBOUNDED PRECEDING) AS island FROM p)"""

_CAPPED_SQL = f"""
WITH RECURSIVE {A.ALERTS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY entity_value ORDER BY s, e, alert_id) AS k FROM alerts),
w AS (SELECT entity_value, alert_id, k, s AS gs, e AS ge, 1 AS n, 1 AS grp FROM o WHERE k = 1
      UNION ALL
      SELECT o.entity_value, o.alert_id, o.k,
             CASE WHEN o.s - w.ge <= {30 * A.DAY} AND greatest(w.ge, o.e) - w.gs <= {90 * A.DAY} AND w.n < 6 THEN w.gs ELSE o.s END,
             CASE WHEN o.s - w.ge <= {30 * A.DAY} AND greatest(w.ge, o.e) - w.gs <= {90 * A.DAY} AND w.n < 6 THEN greatest(w.ge, o.e) ELSE o.e END,
             CASE WHEN o.s - w.ge <= {30 * A.DAY} AND greatest(w.ge, o.e) - w.gs <= {90 * A.DAY} AND w.n < 6 THEN w.n + 1 ELSE 1 END,
             CASE WHEN o.s - w.ge <= {30 * A.DAY} AND greatest(w.ge, o.e) - w.gs <= {90 * A.DAY} AND w.n < 6 THEN w.grp ELSE w.grp + 1 END
      FROM w JOIN o ON o.entity_value = w.entity_value AND o.k = w.k + 1)"""


@query(
    "gap_islands",
    _ISLANDS_SQL
    + """ SELECT entity_value, island, count(*) AS n, min(s) AS start_s, max(e) AS end_s FROM i GROUP BY 1, 2""",
)
def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.order_alerts(spark, sf_dir)
    found = gap_groups(alerts, ["entity_value"], "first_seen", "last_seen", "alert_id", LOOSE)
    return (
        found.join(alerts.drop("entity_value"), "alert_id")
        .groupBy("entity_value", "island")
        .agg(
            F.count("*").alias("n"),
            F.unix_seconds(F.min("first_seen")).alias("start_s"),
            F.unix_seconds(F.max("last_seen")).alias("end_s"),
        )
    )


_FIRST_SQL = """
SELECT w.alert_id, min(w.alert_id) OVER (PARTITION BY entity_value, grp) AS group_label,
       count(*) OVER (PARTITION BY entity_value, grp) AS group_size FROM w"""


@query("capped_sessions", _CAPPED_SQL + _FIRST_SQL)
def q_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.order_alerts(spark, sf_dir)
    found = gap_groups(alerts, ["entity_value"], "first_seen", "last_seen", "alert_id", TIGHT)
    group = ["entity_value", "island", "part"]
    sizes = found.groupBy(*group).agg(
        F.min("alert_id").alias("group_label"), F.count("*").alias("group_size")
    )
    return found.join(sizes, group).select("alert_id", "group_label", "group_size")


_PROPOSALS_SQL = (
    _CAPPED_SQL
    + """,
m AS (SELECT a.*, w.grp FROM w JOIN alerts a USING (alert_id)),
g AS (SELECT entity_value, grp, count(*) AS alerts, max(severity) AS member_max, count(DISTINCT rule_id) AS rules,
             array_to_string(list_sort(list_distinct(list(rule_id))), '|') AS names, min(s) AS start_s, max(e) AS end_s
      FROM m GROUP BY 1, 2),
props AS (SELECT *, CAST(least(5, member_max + CASE WHEN rules >= 3 THEN 1 ELSE 0 END) AS INTEGER) AS severity,
             CASE WHEN rules = 1 THEN names || ' on ' || entity_value
                  WHEN rules = 2 THEN replace(names, '|', ' and ') || ' on ' || entity_value
                  ELSE rules || ' rules on ' || entity_value || ': ' || replace(names, '|', ', ') END AS title FROM g)"""
)


@query(
    "propose_cases",
    _PROPOSALS_SQL
    + " SELECT entity_value, alerts, severity, rules >= 3 AS escalated, title, start_s, end_s FROM props",
)
def q_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, _ = propose_cases(A.order_alerts(spark, sf_dir), TIGHT)
    return proposals.select(
        "entity_value",
        "alerts",
        "severity",
        "escalated",
        "title",
        F.unix_seconds("window_start").alias("start_s"),
        F.unix_seconds("window_end").alias("end_s"),
    )


@query(
    "correlation_summary",
    _PROPOSALS_SQL
    + """ SELECT count(*) AS proposals, CAST(sum(alerts) AS BIGINT) AS alerts, count(*) FILTER (WHERE rules >= 3) AS escalated,
                 count(DISTINCT entity_value) AS entities FROM props""",
)
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, _ = propose_cases(A.order_alerts(spark, sf_dir), TIGHT)
    return correlation_summary(proposals)


@query(
    "severity_rollup",
    f"""WITH {A.ALERTS_SQL} SELECT entity_value, count(*) AS alerts, max(severity) AS member_max,
        CAST(least(5, max(severity) + CASE WHEN count(DISTINCT rule_id) >= 3 THEN 1 ELSE 0 END) AS INTEGER) AS severity
        FROM alerts GROUP BY 1""",
)
def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = severity_rollup(
        A.order_alerts(spark, sf_dir).withColumn("who", F.col("entity_value")), ["who"]
    )
    return rolled.select("entity_value", "alerts", "member_max", "severity")


@query(
    "grouping_metrics",
    """WITH a AS (SELECT o_orderkey AS id, o_custkey % 97 AS g FROM orders WHERE o_orderkey % 10 <> 3),
       t AS (SELECT o_orderkey AS id, o_custkey % 61 AS s FROM orders),
       j AS (SELECT t.id, g, s FROM t LEFT JOIN a USING (id)),
       c AS (SELECT g, s, count(*) AS n FROM j GROUP BY 1, 2),
       x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c WHERE g IS NOT NULL) AS tp,
                    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c WHERE g IS NOT NULL GROUP BY g)) AS pred,
                    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY s)) AS act,
                    (SELECT count(DISTINCT g) FROM c WHERE g IS NOT NULL) AS produced,
                    (SELECT count(*) FROM (SELECT g FROM c WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1)) AS bad,
                    (SELECT count(*) FROM t) AS alerts)
       SELECT alerts, CAST(tp AS BIGINT) AS pair_tp, CAST(pred - tp AS BIGINT) AS pair_fp, CAST(act - tp AS BIGINT) AS pair_fn,
              CAST(tp / pred AS DOUBLE) AS precision, CAST(tp / act AS DOUBLE) AS recall,
              CAST(2 * (tp / pred) * (tp / act) / (tp / pred + tp / act) AS DOUBLE) AS f1,
              produced / 61.0 AS fragmentation, CAST(bad AS DOUBLE) / produced AS contamination FROM x""",
)
def q_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey").alias("alert_id"), F.col("o_custkey")
    got = orders.filter("o_orderkey % 10 <> 3").select(key, (cust % 97).alias("group_id"))
    truth = orders.select(key, (cust % 61).alias("scenario_id"))
    return evaluation.grouping_metrics(got, truth, 61)


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping scenarios per customer number, listed by position."""
    cust = A.table(spark, sf_dir, "customer").select("c_custkey")
    both = cust.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    day = F.lit(A.DAY)
    start = F.lit(820454400) + F.col("half") * 300 * day  # 1996-01-01
    return both.select(
        (F.col("c_custkey") * 2 + F.col("half")).alias("position"),
        F.concat_ws("-", F.lit("s"), "c_custkey", "half").alias("scenario_id"),
        F.concat(F.lit("c="), F.col("c_custkey").cast("string")).alias("entity"),
        F.timestamp_seconds(start).alias("window_from"),
        F.timestamp_seconds(start + 400 * day).alias("window_to"),
        F.array(F.lit("D-001"), F.lit("D-002")).alias("expected_rules"),
    )


_LABEL_SQL = f"""
WITH sc AS (SELECT c_custkey * 2 + h AS position, 's-' || c_custkey || '-' || h AS scenario_id, c_custkey AS entity,
                   820454400 + h * {300 * A.DAY} AS f, 820454400 + h * {300 * A.DAY} + {400 * A.DAY} AS t
            FROM customer, (SELECT unnest([0, 1]) AS h)),
al AS (SELECT o_orderkey AS alert_id, o_custkey AS entity, 'D-00' || CAST(1 + o_orderkey % 5 AS VARCHAR) AS rule_id,
              epoch_us(o_orderdate) // 1000000 AS s FROM orders),
lb AS (SELECT alert_id, al.rule_id, arg_min(scenario_id, position) AS scenario_id
       FROM al JOIN sc ON al.entity = sc.entity AND s >= f AND s < t GROUP BY 1, 2)"""


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    alerts = A.table(spark, sf_dir, "orders").select(
        key.alias("alert_id"),
        F.concat(F.lit("D-00"), (F.lit(1) + key % 5).cast("string")).alias("rule_id"),
        F.concat(F.lit("c="), F.col("o_custkey").cast("string")).alias("entity_key"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen"),
    )
    return evaluation.label_by_interval(alerts, _scenarios(spark, sf_dir))


@query("label_by_interval", _LABEL_SQL + " SELECT alert_id, scenario_id FROM lb")
def q_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0].select("alert_id", "scenario_id")


@query(
    "label_unclaimed",
    _LABEL_SQL + " SELECT alert_id, rule_id FROM al WHERE alert_id NOT IN (SELECT alert_id FROM lb)",
)
def q_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[1].select("alert_id", "rule_id")


@query(
    "label_absent_rules",
    _LABEL_SQL
    + """ SELECT scenario_id, r AS rule_id FROM sc, (SELECT unnest(['D-001', 'D-002']) AS r)
          WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.scenario_id = sc.scenario_id AND lb.rule_id = r)""",
)
def q_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[2]


# ------------------------------------------------------------------ cases

_STATUS = {"O": "new", "F": "closed_benign", "P": "investigating"}
_STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'closed_benign' ELSE 'investigating' END"


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    mapping = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    return A.table(spark, sf_dir, "orders").select(
        F.lpad(key.cast("string"), 12, "0").alias("incident_id"),
        F.concat(F.lit("CASE-"), key.cast("string")).alias("case_number"),
        F.concat(F.lit("src_ip="), A.dotted(F.lit(A.SITE) + F.col("o_custkey") % 300)).alias(
            "correlation_key"
        ),
        F.element_at(mapping, F.col("o_orderstatus")).alias("status"),
        start.alias("window_start"),
        F.timestamp_seconds(F.unix_seconds(start) + (key % 5) * A.DAY).alias("window_end"),
        start.alias("created_at"),
    )


_ASOF_SQL = f"""
WITH {A.ALERTS_SQL},
c AS (SELECT {A.dotted_sql(f"{A.SITE} + o_custkey % 300")} AS entity_value, 'CASE-' || o_orderkey AS case_number,
             {_STATUS_SQL} AS status, epoch_us(o_orderdate) // 1000000 AS cs,
             epoch_us(o_orderdate) // 1000000 + (o_orderkey % 5) * {A.DAY} AS ce, o_orderkey FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_value ORDER BY ce DESC, cs DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) AS r
      FROM c WHERE status {{test}} 'closed_benign')
SELECT a.alert_id, CASE WHEN a.s - n.ce <= {30 * A.DAY} THEN n.case_number END AS previous_case,
       coalesce(a.s - n.ce <= {30 * A.DAY} AND greatest(n.ce, a.e) - n.cs <= {90 * A.DAY}, false) AS continues
FROM alerts a LEFT JOIN n ON n.entity_value = a.entity_value AND r = 1"""


def _asof(spark: SparkSession, sf_dir: str, open_cases: bool) -> DataFrame:
    asked = A.order_alerts(spark, sf_dir).select(
        "alert_id",
        F.concat(F.lit("src_ip="), F.col("entity_value")).alias("correlation_key"),
        F.col("first_seen").alias("window_start"),
        F.col("last_seen").alias("window_end"),
    )
    found = C.latest_case_asof(asked, _incidents(spark, sf_dir), open_cases, TIGHT)
    return found.select("alert_id", "previous_case", "continues")


@query("latest_open_case", _ASOF_SQL.format(test="<>"))
def q_asof_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, True)


@query("latest_closed_case", _ASOF_SQL.format(test="="))
def q_asof_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, False)


# With no cases to begin with, filing merges neighbouring proposals that fit together again.
_FILED_SQL = (
    _PROPOSALS_SQL
    + f""",
q AS (SELECT *, row_number() OVER (PARTITION BY entity_value ORDER BY start_s, grp) AS k FROM props),
f AS (SELECT entity_value, grp, k, start_s AS cs, end_s AS ce, 1 AS cno, start_s AS ls, end_s AS le, 1 AS nxt FROM q WHERE k = 1
      UNION ALL
      SELECT q.entity_value, q.grp, q.k,
             CASE WHEN q.start_s - f.ce <= {30 * A.DAY} AND greatest(f.ce, q.end_s) - f.cs <= {90 * A.DAY} THEN f.cs
                  WHEN q.end_s >= f.ce THEN q.start_s ELSE f.cs END,
             CASE WHEN q.start_s - f.ce <= {30 * A.DAY} AND greatest(f.ce, q.end_s) - f.cs <= {90 * A.DAY} THEN greatest(f.ce, q.end_s)
                  WHEN q.end_s >= f.ce THEN q.end_s ELSE f.ce END,
             CASE WHEN q.start_s - f.ce <= {30 * A.DAY} AND greatest(f.ce, q.end_s) - f.cs <= {90 * A.DAY} THEN f.cno
                  WHEN q.end_s >= f.ce THEN f.nxt + 1 ELSE f.cno END,
             q.start_s, q.end_s,
             CASE WHEN q.start_s - f.ce <= {30 * A.DAY} AND greatest(f.ce, q.end_s) - f.cs <= {90 * A.DAY} THEN f.nxt ELSE f.nxt + 1 END
      FROM f JOIN q ON q.entity_value = f.entity_value AND q.k = f.k + 1),
h AS (SELECT f.entity_value, f.grp,
             CASE WHEN f.nxt > coalesce(lag(f.nxt) OVER (PARTITION BY f.entity_value ORDER BY f.k), 0) THEN f.nxt ELSE f.cno END AS home
      FROM f),
mm AS (SELECT a.*, h.home FROM w JOIN alerts a USING (alert_id) JOIN h ON h.entity_value = a.entity_value AND h.grp = w.grp)
SELECT entity_value, min(s) AS start_s, max(e) AS end_s, count(*) AS alerts,
       CAST(least(5, max(severity) + CASE WHEN count(DISTINCT rule_id) >= 3 THEN 1 ELSE 0 END) AS INTEGER) AS severity,
       CAST(count(DISTINCT rule_id) AS INTEGER) AS distinct_rule_count
FROM mm GROUP BY entity_value, home"""
)


@query("file_cases", _FILED_SQL)
def q_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.order_alerts(spark, sf_dir)
    none = _incidents(spark, sf_dir).filter(F.lit(False))
    links = none.select("incident_id", F.lit(0).cast("bigint").alias("alert_id"))
    out = C.file_cases(
        alerts, none, links, F.lit("2026-09-02 00:00:00").cast("timestamp"), rules=TIGHT
    )
    sizes = out["links"].groupBy("incident_id").agg(F.count("*").alias("alerts"))
    return out["incidents"].join(sizes, "incident_id").select(
        F.substring_index("correlation_key", "=", -1).alias("entity_value"),
        F.unix_seconds("window_start").alias("start_s"),
        F.unix_seconds("window_end").alias("end_s"),
        "alerts",
        "severity",
        "distinct_rule_count",
    )


@query(
    "case_detail",
    f"""WITH {A.ALERTS_SQL} SELECT entity_value AS incident_id, alert_id, rule_id,
        row_number() OVER (PARTITION BY entity_value ORDER BY s, alert_id) AS position, 'Rule ' || rule_id AS rule_name FROM alerts""",
)
def q_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.order_alerts(spark, sf_dir)
    cases = alerts.select(F.col("entity_value").alias("incident_id")).distinct().withColumn(
        "case_number", F.concat(F.lit("CASE-"), F.col("incident_id"))
    )
    links = alerts.select(F.col("entity_value").alias("incident_id"), "alert_id")
    rules = alerts.select("rule_id").distinct().withColumn(
        "name", F.concat(F.lit("Rule "), F.col("rule_id"))
    )
    found = C.case_detail(cases, links, alerts.drop("entity_value"), rules)
    return found.select("incident_id", "alert_id", "rule_id", "position", "rule_name")


@query(
    "trace_provenance",
    """SELECT DISTINCT o_custkey AS incident_id, p_partkey % 23 AS batch_id, true AS complete
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
)
def q_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders")
    alerts = orders.select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_orderdate").alias("first_seen")
    )
    links = orders.select(
        F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("alert_id")
    )
    part = F.col("l_partkey")
    sampled = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"), part.alias("event_id")
    ).distinct()
    events = A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 23).alias("batch_id")
    )
    batches = events.select("batch_id").distinct()
    return C.trace_provenance(links, alerts, sampled, events, batches).select(
        "incident_id", "batch_id", "complete"
    )


@query(
    "case_assets",
    f"""WITH {A.ALERTS_SQL}, {A.NETWORKS_SQL},
    x AS (SELECT DISTINCT o_custkey % 11 AS c, {A.SITE} + o_custkey % 300 AS num FROM orders),
    b AS (SELECT num, asset_id, row_number() OVER (PARTITION BY num ORDER BY masklen DESC, is_primary DESC, born, asset_id) AS r
          FROM (SELECT DISTINCT num FROM x) JOIN networks ON num BETWEEN lo AND hi WHERE is_active)
    SELECT DISTINCT c AS incident_id, asset_id FROM x JOIN b USING (num) WHERE r = 1""",
)
def q_case_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders")
    links = orders.select(
        (F.col("o_custkey") % 11).alias("incident_id"), F.col("o_orderkey").alias("alert_id")
    )
    alerts = A.order_alerts(spark, sf_dir)
    return C.case_assets(links, alerts, A.networks(spark, sf_dir))


@query(
    "timeline_entries",
    f"""WITH {A.ALERTS_SQL} SELECT entity_value AS incident_id, 'alert_fired' AS entry_type, s AS at_s,
        rule_id || ' fired on src_ip ' || entity_value AS summary, CAST(alert_id AS VARCHAR) AS alert_id
        FROM alerts WHERE alert_id % 4 <> 0
        UNION ALL SELECT CAST(event_id AS VARCHAR), 'note_added', epoch_us(ts) // 1000000, 'A note was added', NULL FROM events""",
)
def q_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.order_alerts(spark, sf_dir).withColumn("incident_id", F.col("entity_value"))
    known = alerts.filter("alert_id % 4 = 0").select(
        "incident_id",
        F.lit("alert_fired").alias("entry_type"),
        F.col("alert_id").cast("string").alias("alert_id"),
    )
    notes = A.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("incident_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    out = C.timeline_entries(alerts, notes=notes, existing=known)
    return out.select(
        "incident_id", "entry_type", F.unix_seconds("occurred_at").alias("at_s"), "summary", "alert_id"
    )


@query(
    "assign_ordinals",
    """SELECT o_orderkey AS incident_id, 100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders""",
)
def q_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
    )
    return C.assign_ordinals(rows, "us", ["incident_id"], 100).drop("us")


# Requests come from orders in date order; the recursion is the state machine.
_MOVES = [
    "triaging", "investigating", "contained_recommended", "closed_benign", "closed_true_positive"
]
_WALK_SQL = """
WITH RECURSIVE legal(f, t) AS (VALUES
  ('new','triaging'),('new','investigating'),('new','closed_true_positive'),('new','closed_false_positive'),('new','closed_benign'),
  ('triaging','investigating'),('triaging','contained_recommended'),('triaging','closed_true_positive'),
  ('triaging','closed_false_positive'),('triaging','closed_benign'),
  ('investigating','triaging'),('investigating','contained_recommended'),('investigating','closed_true_positive'),
  ('investigating','closed_false_positive'),('investigating','closed_benign'),
  ('contained_recommended','investigating'),('contained_recommended','closed_true_positive'),
  ('contained_recommended','closed_false_positive'),('contained_recommended','closed_benign'),
  ('closed_true_positive','investigating'),('closed_false_positive','investigating'),('closed_benign','investigating')),
q AS (SELECT o_custkey AS c, o_orderkey AS request_id,
             ['triaging','investigating','contained_recommended','closed_benign','closed_true_positive'][1 + o_orderkey % 5] AS target,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
s AS (SELECT c, 0 AS k, CAST(NULL AS BIGINT) AS request_id, 'new' AS was, 'new' AS status, CAST(NULL AS VARCHAR) AS outcome
      FROM (SELECT DISTINCT o_custkey AS c FROM orders)
      UNION ALL
      SELECT q.c, q.k, q.request_id, s.status,
             CASE WHEN EXISTS (SELECT 1 FROM legal WHERE f = s.status AND t = q.target) THEN q.target ELSE s.status END,
             CASE WHEN s.status = q.target THEN 'same'
                  WHEN EXISTS (SELECT 1 FROM legal WHERE f = s.status AND t = q.target) THEN 'moved' ELSE 'illegal' END
      FROM s JOIN q ON q.c = s.c AND q.k = s.k + 1)"""
_WORKFLOW_SQL = _WALK_SQL + " SELECT request_id, was AS from_status, outcome FROM s WHERE k > 0"
# the statuses that cases start in, and what their requests give as a reason
_STATUSES = list(C.LEGAL_MOVES)
_START_SQL = "[" + ", ".join(f"'{s}'" for s in _STATUSES) + "][1 + o_custkey % 7]"
_REASON_SQL = "CASE WHEN request_id % 7 > 0 THEN 'reason ' || (request_id % 7) END"


def requests(orders: DataFrame) -> DataFrame:
    moves = F.array(*[F.lit(m) for m in _MOVES])
    number = F.col("o_orderkey") % 7
    return orders.select(
        F.col("o_custkey").alias("incident_id"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        F.col("o_orderkey").alias("request_id"),
        F.element_at(moves, (F.lit(1) + F.col("o_orderkey") % 5).cast("int")).alias("to_status"),
        F.when(number > 0, F.concat(F.lit(" reason "), number.cast("string"))).otherwise(F.lit(" \n")).alias("reason"),
    )


@query("replay_workflow", _WORKFLOW_SQL)
def q_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders")
    cases = orders.select(F.col("o_custkey").alias("incident_id")).distinct().withColumn("status", F.lit("new"))
    outcomes, _ = C.replay_workflow(cases, requests(orders))
    return outcomes.select("request_id", "from_status", "outcome")


def started_cases(orders: DataFrame) -> DataFrame:
    """The cases of the requests, each with a status of its own."""
    statuses = F.array(*[F.lit(s) for s in _STATUSES])
    first = F.element_at(statuses, (F.lit(1) + F.col("incident_id") % 7).cast("int")).alias("status")
    return orders.select(F.col("o_custkey").alias("incident_id")).distinct().select("incident_id", first)


def moved_sql() -> str:
    """How the requests leave those cases."""
    walk = _WALK_SQL.replace("'new' AS was, 'new' AS status", f"{_START_SQL} AS was, {_START_SQL} AS status")
    walk = walk.replace("SELECT DISTINCT o_custkey AS c FROM", "SELECT DISTINCT o_custkey AS c, o_custkey FROM")
    return (
        walk
        + f""", f AS (SELECT c, max_by(status, k) AS status, max_by(request_id, k) FILTER (WHERE outcome = 'moved') AS request_id FROM s GROUP BY 1)
    SELECT c AS incident_id, status, CASE WHEN status LIKE 'closed%' THEN epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 END AS closed_s,
           CASE WHEN status LIKE 'closed%' THEN {_REASON_SQL} END AS closure_reason
    FROM f LEFT JOIN orders ON o_orderkey = request_id"""
    )


@query("workflow_final", moved_sql())
def q_workflow_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders")
    _, final = C.replay_workflow(started_cases(orders), requests(orders))
    return final.select("incident_id", "status", F.unix_seconds("closed_at").alias("closed_s"), "closure_reason")


@query(
    "clean_notes",
    r"""WITH n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g'), '^\s+|\s+$', '', 'g') AS c
                   FROM conversations)
        SELECT conv_id, turn, CASE WHEN c = '' THEN 'empty' WHEN length(c) > 300 THEN 'too_long' END AS refused,
               CASE WHEN c <> '' AND length(c) <= 300 THEN md5(c) END AS digest FROM n""",
)
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = A.table(spark, sf_dir, "conversations")
    out = C.clean_notes(notes, "text", 300)
    return out.select("conv_id", "turn", "refused", F.md5("clean").alias("digest"))


# ------------------------------------------------------------------ retention


@query(
    "retention_plan",
    """SELECT 'events' AS "table", count(*) AS rows FROM events e WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
         AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = e.event_id)
       UNION ALL SELECT 'audit_log', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2024-01-31' - INTERVAL 9500 DAY""",
)
def q_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "events": A.table(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("event_time")
        ),
        "audit_log": A.table(spark, sf_dir, "orders").select(
            F.col("o_orderdate").cast("timestamp").alias("occurred_at")
        ),
    }
    cited = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return X.retention_plan(tables, X.policy(10, 1, 1, 9500), now, cited).select("table", "rows")


_PRUNE = "ts >= TIMESTAMP '2024-01-21' OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = e.event_id)"


@query("prune_kept", f"SELECT event_id AS id FROM events e WHERE {_PRUNE}")
def q_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prune(spark, sf_dir)[0].select("id")


@query(
    "prune_counts",
    f"""SELECT count(*) FILTER (WHERE NOT ({_PRUNE})) AS removed,
               count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-21' AND ({_PRUNE})) AS remaining FROM events e""",
)
def q_prune_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prune(spark, sf_dir)[1]


def _prune(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = A.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("event_time")
    )
    cited = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return X.prune(events, "event_time", F.lit("2024-01-21 00:00:00").cast("timestamp"), cited)


# ------------------------------------------------------------------ sweep


def sweep_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(networks, baselines)`` that the sweeps resolve and compare with."""
    nets = A.networks(spark, sf_dir)
    history = nets.filter(F.col("cidr").endswith("/32")).select(
        "asset_id",
        F.lit("outbound_bytes_per_hour").alias("metric"),
        F.lit(7).alias("window_days"),
        F.lit(4e9).alias("mean"),
        F.lit(5e8).alias("stddev"),
        F.lit(5e9).alias("p95"),
        F.lit(168).cast("bigint").alias("sample_count"),
    )
    return nets, history


def _sweep(spark: SparkSession, sf_dir: str):
    nets, history = sweep_history(spark, sf_dir)
    start = datetime.fromtimestamp(A.BASE, tz=UTC)
    end = datetime.fromtimestamp(A.BASE + 7200, tz=UTC)
    return sweep(A.every_feed(spark, sf_dir), start, end, nets, history)


# All five rules over all four feeds, scored with the criticality of the resolved asset.
_NUM = "+".join(f"(CAST(split_part(src, '.', {i + 1}) AS BIGINT) << {24 - 8 * i})" for i in range(4))
_ALERTS_SQL = f"""
WITH {FIRING_SQL.format(span=7200)}, {A.NETWORKS_SQL},
own AS (SELECT src, bytes_out, t FROM links WHERE bytes_out > 0),
seen AS (SELECT DISTINCT src, {_NUM} AS num FROM (
           SELECT src FROM own UNION SELECT src FROM d1 UNION SELECT src FROM d2 UNION SELECT src FROM d3 UNION SELECT src FROM d4)),
m AS (SELECT src AS address, asset_id, criticality,
             row_number() OVER (PARTITION BY src ORDER BY masklen DESC, is_primary DESC, born, asset_id) AS r
      FROM seen JOIN networks ON num BETWEEN lo AND hi WHERE is_active),
d5 AS (SELECT 'D-005' AS rule_id, 3 AS base, src, t - t % 3600 AS b, count(*) AS n, CAST(sum(bytes_out) AS DOUBLE) / 1e10 AS ratio
       FROM own JOIN m ON src = address AND r = 1 AND asset_id LIKE 'host-%'
       GROUP BY src, t - t % 3600 HAVING sum(bytes_out) >= 1e10),
f AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5),
alerts AS (
SELECT rule_id || ':src_ip=' || src || ':' || strftime(to_timestamp(b) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS dedup_key,
       rule_id, src AS entity_value, b, n AS event_count, asset_id,
       CAST(least(5, greatest(1, floor(base + 0.5 * (coalesce(criticality, 3) - 3)
            + 2 * (round_even(least(1.0, ratio / 3.0), 4) - 0.5) + 0.5))) AS INTEGER) AS severity
FROM f LEFT JOIN m ON src = address AND r = 1)"""


@query(
    "sweep_alerts",
    _ALERTS_SQL
    + " SELECT dedup_key, rule_id, severity, entity_value, event_count, 'open' AS status FROM alerts",
)
def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, _, _, _ = _sweep(spark, sf_dir)
    return alerts.select("dedup_key", "rule_id", "severity", "entity_value", "event_count", "status")


@query(
    "sweep_runs",
    _ALERTS_SQL
    + """, e AS (SELECT (SELECT count(*) FROM links) + (SELECT count(*) FROM auth) + (SELECT count(*) FROM events) AS n),
    r AS (SELECT unnest(['D-001', 'D-002', 'D-003', 'D-004', 'D-005']) AS rule_id)
    SELECT r.rule_id, 'success' AS status, e.n AS events_examined, count(a.dedup_key) AS alerts_created
    FROM r CROSS JOIN e LEFT JOIN alerts a ON a.rule_id = r.rule_id GROUP BY ALL""",
)
def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, runs = _sweep(spark, sf_dir)
    return runs.select("rule_id", "status", "events_examined", "alerts_created")


@query("sweep_scored", _ALERTS_SQL + " SELECT dedup_key, event_count, severity FROM alerts")
def q_sweep_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, _, _, _ = _sweep(spark, sf_dir)
    return alerts.select("dedup_key", "event_count", "severity")


@query(
    "sweep_links",
    _ALERTS_SQL + " SELECT dedup_key, asset_id, 'source' AS role FROM alerts WHERE asset_id IS NOT NULL",
)
def q_sweep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, _, links, _ = _sweep(spark, sf_dir)
    return alerts.select("alert_id", "dedup_key").join(links, "alert_id").drop("alert_id")


# The rows behind each alert, with their time and weight; D-004 shows its best destination only.
_SAMPLES_SQL = (
    _ALERTS_SQL
    + f""",
best AS (SELECT src, b, arg_min(place, struct_pack(j := round_even(jit, 4), c := -n, p := place)) AS place
         FROM jit WHERE jit <= 0.15 GROUP BY src, b),
behind AS (
  SELECT 'D-001' AS rule_id, src, t - t % 600 AS b, id, t, 0 AS weight FROM links
  UNION ALL SELECT 'D-002', src, t - t % 600, '1-' || id, t, 0 FROM auth
  UNION ALL SELECT 'D-003', client, t - t % 600, '2-' || id, t, 0 FROM (WITH {A.DNS_SQL} SELECT * FROM dns)
  UNION ALL SELECT 'D-004', g.src, g.b, id, t, 0 FROM gaps g JOIN best ON best.src = g.src AND best.b = g.b AND best.place = g.place
  UNION ALL SELECT 'D-005', src, t - t % 3600, id, t, bytes_out FROM links WHERE bytes_out > 0),
chosen AS (SELECT dedup_key, id, t, weight FROM alerts a JOIN behind h ON h.rule_id = a.rule_id AND h.src = a.entity_value AND h.b = a.b),"""
    + samples_sql("chosen", "dedup_key", "weight")
)


@query("sweep_samples", _SAMPLES_SQL)
def q_sweep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, samples, _, _ = _sweep(spark, sf_dir)
    return alerts.select("alert_id", "dedup_key").join(samples, "alert_id").drop("alert_id")
