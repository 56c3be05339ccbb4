"""Registered queries: prefix joins, baselines, filters, pages, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scoring import dedup_key, severity_score
from netquarry.operators import baselines as B
from netquarry.operators import reads as R
from netquarry.operators.prefix import (
    longest_match,
    memberships,
    network_overlaps,
    overlap_witnesses,
    resolve_assets,
)
from netquarry.operators.sets import drop_known, missing_from
from netquarry.plans import adapters as A
from netquarry.plans.registry import query

# ------------------------------------------------------------------ prefix joins

_BEST_SQL = f"""
WITH {A.FLOWS_SQL}, {A.NETWORKS_SQL},
a AS (SELECT DISTINCT src AS address, src_num AS num FROM flows),
m AS (SELECT address, asset_id, criticality, masklen,
             row_number() OVER (PARTITION BY address ORDER BY masklen DESC, is_primary DESC, born, asset_id) AS r
      FROM a JOIN networks ON num BETWEEN lo AND hi WHERE is_active)"""


@query(
    "longest_prefix_match",
    _BEST_SQL + " SELECT address, asset_id, criticality, masklen FROM m WHERE r = 1",
)
def q_lpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match(A.flows(spark, sf_dir), "src_ip", A.networks(spark, sf_dir))


@query(
    "resolve_assets",
    _BEST_SQL
    + """ SELECT coalesce(m.asset_id, 'unknown') AS asset, count(*) AS flows, sum(bytes_out) AS bytes
          FROM flows LEFT JOIN m ON flows.src = m.address AND r = 1 GROUP BY 1""",
)
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = A.flows(spark, sf_dir)
    resolved = resolve_assets(flows, "src_ip", A.networks(spark, sf_dir))
    return resolved.groupBy(F.coalesce("asset_id", F.lit("unknown")).alias("asset")).agg(
        F.count("*").alias("flows"), F.sum("bytes_toserver").alias("bytes")
    )


@query(
    "network_memberships",
    f"""WITH {A.FLOWS_SQL}, {A.NETWORKS_SQL}
    SELECT DISTINCT src AS address, asset_id FROM flows JOIN networks ON src_num BETWEEN lo AND hi""",
)
def q_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(A.flows(spark, sf_dir), "src_ip", A.networks(spark, sf_dir))


_FRESH_SQL = f"""WITH {A.NETWORKS_SQL}, c AS (
      SELECT 'new-' || CAST(s_suppkey AS VARCHAR) AS asset_id, (s_suppkey * 37) % 4096 * 16 + {A.SITE} AS lo,
             (s_suppkey * 37) % 4096 * 16 + {A.SITE} + 7 AS hi FROM supplier),
    o AS (SELECT asset_id, lo, hi FROM networks UNION ALL SELECT asset_id, lo, hi FROM c)"""


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return A.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("new-"), key.cast("string")).alias("asset_id"),
        F.concat(A.dotted((key * 37) % 4096 * 16 + A.SITE), F.lit("/29")).alias("cidr"),
    )


@query(
    "network_overlaps",
    _FRESH_SQL
    + f""" SELECT DISTINCT c.asset_id, {A.dotted_sql("c.lo")} || '/29' AS cidr, o.asset_id AS other_asset_id,
           {A.dotted_sql("o.lo")} AS other_start
    FROM c JOIN o ON c.lo <= o.hi AND o.lo <= c.hi WHERE c.asset_id <> o.asset_id""",
)
def q_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network_overlaps(_fresh(spark, sf_dir), A.networks(spark, sf_dir))
    return found.select(
        "asset_id",
        "cidr",
        "other_asset_id",
        F.substring_index("other_cidr", "/", 1).alias("other_start"),
    )


@query(
    "overlap_witnesses",
    _FRESH_SQL
    + f""" SELECT DISTINCT c.asset_id, {A.dotted_sql("c.lo")} || '/29' AS cidr, true AS other
    FROM c JOIN o ON c.lo <= o.hi AND o.lo <= c.hi WHERE c.asset_id <> o.asset_id""",
)
def q_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap_witnesses(_fresh(spark, sf_dir), A.networks(spark, sf_dir))
    return found.select("asset_id", "cidr", (F.col("other_asset_id") != F.col("asset_id")).alias("other"))


@query(
    "events_of_asset",
    f"""WITH {A.FLOWS_SQL}, {A.NETWORKS_SQL},
    n AS (SELECT lo, hi FROM networks WHERE asset_id = 'block-000000001')
    SELECT id, src, dest FROM flows WHERE EXISTS (SELECT 1 FROM n WHERE src_num BETWEEN lo AND hi)
       OR EXISTS (SELECT 1 FROM n WHERE dest_num BETWEEN lo AND hi)""",
)
def q_events_of_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.events_of_asset(
        A.flows(spark, sf_dir), A.networks(spark, sf_dir), "block-000000001"
    )
    return found.select("id", F.col("src_ip").alias("src"), F.col("dest_ip").alias("dest"))


@query(
    "events_of_networks",
    f"""WITH {A.FLOWS_SQL}, {A.NETWORKS_SQL}, n AS (SELECT lo, hi FROM networks WHERE criticality >= 4)
    SELECT id, src, dest FROM flows WHERE EXISTS (SELECT 1 FROM n WHERE src_num BETWEEN lo AND hi)
       OR EXISTS (SELECT 1 FROM n WHERE dest_num BETWEEN lo AND hi)""",
)
def q_events_of_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    important = A.networks(spark, sf_dir).filter("criticality >= 4")
    found = R.events_of_networks(A.flows(spark, sf_dir), important)
    return found.select("id", F.col("src_ip").alias("src"), F.col("dest_ip").alias("dest"))


# ------------------------------------------------------------------ baselines

_HOURLY_SQL = f"""
WITH {A.FLOWS_SQL}, {A.NETWORKS_SQL},
h AS (SELECT asset_id, t - t % 3600 AS hour, CAST(sum(bytes_out) AS BIGINT) AS bytes
      FROM flows JOIN networks ON src_num BETWEEN lo AND hi GROUP BY 1, 2)"""


@query("hourly_outbound_bytes", _HOURLY_SQL + " SELECT asset_id, hour, bytes FROM h")
def q_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hourly_outbound_bytes(A.flows(spark, sf_dir), A.networks(spark, sf_dir))


@query(
    "summarize",
    """SELECT o_custkey % 50 AS grp, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS stddev,
              quantile_disc(o_totalprice, 0.95) AS p95, count(*) AS sample_count
       FROM orders GROUP BY 1""",
)
def q_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey") % 50)
    return B.summarize(orders, ["grp"], "o_totalprice")


@query(
    "recompute_baselines",
    _HOURLY_SQL
    + f""" SELECT asset_id, 'outbound_bytes_per_hour' AS metric, 7 AS window_days, avg(bytes) AS mean,
              stddev_pop(bytes) AS stddev, CAST(quantile_disc(bytes, 0.95) AS DOUBLE) AS p95,
              count(*) AS sample_count
           FROM h WHERE hour < {A.BASE + 7200} AND hour >= {A.BASE + 7200 - 7 * 86400} GROUP BY asset_id""",
)
def q_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.timestamp_seconds(F.lit(A.BASE + 7200 + 59))
    return B.recompute_baselines(A.flows(spark, sf_dir), A.networks(spark, sf_dir), until)


@query(
    "attach_baselines",
    _BEST_SQL
    + """, b AS (SELECT asset_id, 7 AS days, CAST(born AS DOUBLE) AS mean FROM networks
               UNION ALL SELECT asset_id, 30, CAST(born * 2 AS DOUBLE) FROM networks WHERE masklen = 32 AND born % 3 = 0),
         w AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY days DESC) AS k FROM b)
         SELECT address, days AS window_days, mean FROM m JOIN w USING (asset_id) WHERE r = 1 AND k = 1""",
)
def q_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = A.networks(spark, sf_dir)
    born = F.unix_seconds("created_at")

    def rows(df: DataFrame, days: int, factor: int) -> DataFrame:
        return df.select(
            "asset_id",
            F.lit(B.METRIC).alias("metric"),
            F.lit(days).alias("window_days"),
            (born * factor).cast("double").alias("mean"),
            F.lit(0.0).alias("stddev"),
            F.lit(0.0).alias("p95"),
            F.lit(0).cast("bigint").alias("sample_count"),
        )

    stored = rows(nets, 7, 1).unionByName(
        rows(nets.filter(F.col("cidr").endswith("/32") & (born % 3 == 0)), 30, 2)
    )
    found = B.attach_baselines(A.flows(spark, sf_dir), "src_ip", nets, stored)
    return found.select("address", "window_days", "mean")


# ------------------------------------------------------------------ filters and pages

_FROM, _TO = datetime(2026, 9, 1, 10, 10), datetime(2026, 9, 1, 11, 20)
_FROM_S, _TO_S = A.BASE + 600, A.BASE + 4800


@query(
    "query_events",
    f"""WITH {A.FLOWS_SQL} SELECT id, t, src, dest, dest_port FROM flows
    WHERE t BETWEEN {_FROM_S} AND {_TO_S} AND src_num BETWEEN {A.SITE + 32} AND {A.SITE + 47}
      AND dest_num BETWEEN {A.OUTSIDE} AND {A.OUTSIDE + 7} AND dest_port = 1026""",
)
def q_query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.query_events(
        A.flows(spark, sf_dir), _FROM, _TO, types=["flow", "dns"], src="10.10.0.32/28",
        dest="203.0.113.0/29", dest_port=1026,
    )
    return found.select(
        "id",
        F.unix_seconds("event_time").alias("t"),
        F.col("src_ip").alias("src"),
        F.col("dest_ip").alias("dest"),
        "dest_port",
    )


@query(
    "keyset_page",
    f"""WITH {A.FLOWS_SQL} SELECT id, t, true AS has_more FROM flows
    WHERE t < {A.BASE + 3000} OR (t = {A.BASE + 3000} AND id < '8') ORDER BY t DESC, id DESC LIMIT 50""",
)
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.flows(spark, sf_dir).select("id", F.unix_seconds("event_time").alias("t"))
    return R.keyset_page(rows, ["t", "id"], 50, after=[A.BASE + 3000, "8"])


@query(
    "filter_alerts",
    f"""WITH {A.ALERTS_SQL} SELECT alert_id, rule_id, severity, entity_value FROM alerts
    WHERE severity >= 3 AND rule_id = 'D-004' AND s >= epoch_us(TIMESTAMP '1996-01-01') // 1000000
      AND s < epoch_us(TIMESTAMP '1997-01-01') // 1000000""",
)
def q_filter_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.filter_alerts(
        A.order_alerts(spark, sf_dir), severity_min=3, rule_id="D-004",
        start=datetime(1996, 1, 1), end=datetime(1997, 1, 1),
    )
    return found.select("alert_id", "rule_id", "severity", "entity_value")


def _order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(
        F.create_map(
            *[F.lit(x) for x in ("O", "new", "F", "closed_benign", "P", "investigating")]
        ),
        F.col("o_orderstatus"),
    )
    return A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        status.alias("status"),
        (F.lit(1) + F.col("o_orderkey") % 5).cast("int").alias("severity"),
        F.concat(F.lit("src_ip="), F.col("o_custkey").cast("string")).alias("correlation_key"),
        F.col("o_orderdate").cast("timestamp").alias("window_end"),
    )


@query(
    "filter_incidents",
    """SELECT o_orderkey AS incident_id, CAST(1 + o_orderkey % 5 AS INTEGER) AS severity
       FROM orders WHERE o_orderstatus <> 'F' AND 1 + o_orderkey % 5 >= 4""",
)
def q_filter_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.filter_incidents(_order_cases(spark, sf_dir), open_only=True, severity_min=4)
    return found.select("incident_id", "severity")


@query(
    "filter_assets",
    """SELECT c_custkey AS asset_id, lower(c_name) AS hostname FROM customer
       WHERE c_custkey % 9 <> 0 AND 1 + c_custkey % 5 >= 3 AND c_nationkey % 2 = 0
         AND contains(lower(c_name), 'r#0000001')""",
)
def q_filter_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    assets = A.table(spark, sf_dir, "customer").select(
        key.alias("asset_id"),
        F.lower("c_name").alias("hostname"),
        (key % 9 != 0).alias("is_active"),
        (F.lit(1) + key % 5).cast("int").alias("criticality"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("even"), F.lit("x")))
        .otherwise(F.array(F.lit("odd")))
        .alias("tags"),
    )
    found = R.filter_assets(assets, criticality_min=3, tag="even", hostname_part="R#0000001")
    return found.select("asset_id", "hostname")


@query(
    "filter_audit",
    """SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id % 3 = 1
       AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'""",
)
def q_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("actor-"), (F.col("user_id") % 3).cast("string")).alias("actor"),
    )
    found = R.filter_audit(
        log, action="click", actor="actor-1", start=datetime(2024, 1, 2), end=datetime(2024, 1, 20)
    )
    return found.select("event_id", "user_id")


@query(
    "filter_batches",
    """SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus = 'F'
       AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1995-01-01'""",
)
def q_filter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("batch_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("complete")).otherwise(F.lit("failed")).alias("status"),
        F.col("o_orderpriority").alias("source_label"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )
    found = R.filter_batches(
        batches, status="complete", source_label="1-URGENT", start=datetime(1995, 1, 1)
    )
    return found.select("batch_id")


@query(
    "newest_n_in_order",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
                         count(*) OVER (PARTITION BY user_id) AS n FROM events)
       SELECT user_id, event_id, least(n, 20) - k + 1 AS position, n > 20 AS truncated FROM r WHERE k <= 20""",
)
def q_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return R.newest_n_in_order(rows, ["user_id"], ["ts", "event_id"], 20).drop("ts")


# ------------------------------------------------------------------ counts


@query(
    "event_stats",
    """SELECT 'type' AS kind, event_type AS label, count(*) AS n FROM events GROUP BY 2
       UNION ALL SELECT 'hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H'), count(*) FROM events GROUP BY 2
       UNION ALL SELECT 'total', '', count(*) FROM events""",
)
def q_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("event_time")
    )
    return R.event_stats(events)


@query(
    "batch_span",
    """WITH b AS (SELECT user_id % 7 AS batch_id, epoch_us(min(ts)) // 1000000 AS lo, epoch_us(max(ts)) // 1000000 AS hi
                  FROM events GROUP BY 1),
       s AS (SELECT batch_id, lo, hi, unnest(generate_series(lo - lo % 3600, hi - hi % 3600 + 3599, 86400)) AS f FROM b)
       SELECT batch_id, lo AS first_s, hi AS last_s, f AS from_s, least(f + 86400, hi - hi % 3600 + 3600) AS to_s FROM s""",
)
def q_batch_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("batch_id"), F.col("ts").cast("timestamp").alias("event_time")
    )
    spans = R.batch_span(events)
    names = {
        "first_s": "first_event", "last_s": "last_event", "from_s": "sweep_from", "to_s": "sweep_to"
    }
    return spans.select("batch_id", *[F.unix_seconds(c).alias(n) for n, c in names.items()])


@query(
    "latest_version",
    """WITH r AS (SELECT o_custkey AS incident_id, o_orderkey AS version, o_orderstatus AS status,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
       SELECT incident_id, version, status, version + 1 AS next_version FROM r WHERE k = 1""",
)
def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    briefs = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("incident_id"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderstatus").alias("status"),
    )
    return R.latest_version(briefs, ["incident_id"])


@query(
    "quota_replay",
    """WITH h AS (SELECT event_id, user_id % 25 AS subject, epoch_us(ts) AS us, 1 + event_id % 3 AS cost FROM events),
       u AS (SELECT *, us // 86400000000 AS w FROM h),
       c AS (SELECT *, sum(cost) OVER (PARTITION BY subject, w ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS used FROM u)
       SELECT event_id, CAST(used AS BIGINT) AS used, used <= 20 AS allowed, CAST(greatest(20 - used, 0) AS BIGINT) AS remaining,
              CASE WHEN used > 20 THEN greatest(1, ((w + 1) * 86400000000 - us) // 1000000 + 1) ELSE 0 END AS retry_after
       FROM c""",
)
def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 25).alias("subject"),
        F.col("ts").cast("timestamp").alias("at"),
        (F.lit(1) + F.col("event_id") % 3).alias("cost"),
    )
    out = R.quota_replay(hits, ["subject"], "at", 20, 86400, ["event_id"], cost="cost")
    return out.select("event_id", "used", "allowed", "remaining", "retry_after")


# ------------------------------------------------------------------ sets, severity, keys


@query(
    "drop_known",
    """SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS
       (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.event_type = e.event_type AND k.event_id % 5 = 0)""",
)
def q_drop_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    known = rows.filter("event_id % 5 = 0")
    return drop_known(rows.drop("event_id"), known, ["user_id", "event_type"])


@query(
    "missing_from",
    """SELECT user_id FROM (SELECT DISTINCT user_id FROM events) EXCEPT SELECT user_id FROM events WHERE event_id % 31 = 0""",
)
def q_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select("user_id", "event_id")
    return missing_from(rows, rows.filter("event_id % 31 = 0"), ["user_id"])


@query(
    "severity_score",
    """SELECT l_orderkey % 5 + 1 AS base, CAST(floor(l_quantity) AS INTEGER) AS q,
              CAST(least(5, greatest(1, floor((l_orderkey % 5 + 1) + 0.5 * (CASE WHEN l_partkey % 6 = 5 THEN 0 ELSE l_partkey % 6 + 1 - 3 END)
                   + 2 * (floor(l_quantity) / 64.0 - 0.5) + 0.5))) AS INTEGER) AS severity, count(*) AS n
       FROM lineitem GROUP BY 1, 2, 3""",
)
def q_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_partkey") % 6
    rows = A.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5 + 1).alias("base"),
        F.floor("l_quantity").cast("int").alias("q"),
        F.when(kind != 5, (kind + 1).cast("int")).alias("criticality"),
    )
    scored = rows.withColumn(
        "severity",
        severity_score(F.col("base"), F.col("q") / 64.0, F.col("criticality"))["value"],
    )
    return scored.groupBy("base", "q", "severity").agg(F.count("*").alias("n"))


@query(
    "dedup_keys",
    f"""WITH {A.FLOWS_SQL} SELECT DISTINCT 'D-001:src_ip=' || src || ':' ||
        strftime(to_timestamp(t - t % 600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS dedup_key FROM flows""",
)
def q_dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquarry.functions.timing import window_bucket

    return (
        A.flows(spark, sf_dir)
        .select(
            dedup_key(
                F.lit("D-001"), F.lit("src_ip"), F.col("src_ip"), window_bucket(F.col("event_time"), 600)
            ).alias("dedup_key")
        )
        .distinct()
    )
