"""Registered queries: rules, their window functions, baselines, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scoring import severity_score
from netquarry.functions.timing import bucket_seconds
from netquarry.operators import evaluation
from netquarry.operators.pieces import densest_span, interval_stats, sample_contributors
from netquarry.operators.rules import (
    AuthBurstParams,
    DnsParams,
    PortScanParams,
    VolumeParams,
    detect_auth_burst,
    detect_beaconing,
    detect_dns_anomaly,
    detect_port_scan,
    detect_volume_anomaly,
)
from netquarry.plans import adapters as A
from netquarry.plans.registry import query
from netquarry.session import materialize


def _common(df: DataFrame, *extra: Column) -> DataFrame:
    severity = severity_score(F.lit(3), F.col("signal_strength"), F.lit(None).cast("int"))["value"]
    return df.select(
        "entity_value",
        F.unix_seconds("window_bucket").alias("bucket"),
        F.unix_seconds("first_seen").alias("first_s"),
        F.unix_seconds("last_seen").alias("last_s"),
        "event_count",
        "signal_strength",
        "confidence",
        severity.alias("severity3"),
        *extra,
    )


def _listed(column: str) -> Column:
    return F.array_join(F.transform(F.col(column), lambda x: x.cast("string")), ",")


_SEVERITY3 = """CAST(least(5, greatest(1, floor(3 + 2 * (signal_strength - 0.5) + 0.5))) AS INTEGER)
                AS severity3"""


# ------------------------------------------------------------------ D-001

_SCAN_SQL = """
WITH {flows},
f AS (SELECT *, t - t % 600 AS b FROM flows),
g AS (SELECT src, b, min(t) AS lo, max(t) AS hi, count(*) AS n,
             count(DISTINCT dest_port) AS ports, count(DISTINCT dest) AS hosts,
             count(DISTINCT dest || ':' || dest_port) AS targets,
             count(*) FILTER (WHERE back = 0) AS silent,
             array_to_string(list_sort(list_distinct(list(dest_port)))[1:20], ',') AS sample_ports,
             array_to_string(list_sort(list_distinct(list(dest)))[1:10], ',') AS sample_hosts
      FROM f GROUP BY src, b
      HAVING count(*) >= 20 AND (count(DISTINCT dest_port) >= {p} OR count(DISTINCT dest) >= {h})),
s AS (SELECT *, round_even(least(1.0, greatest(ports / {p}.0, hosts / {h}.0) / 3.0), 4) AS signal_strength FROM g)
SELECT src AS entity_value, b AS bucket, lo AS first_s, hi AS last_s, n AS event_count,
       signal_strength, round_even(0.5 + 0.5 * silent / n, 4) AS confidence, {sev},
       ports, hosts, targets, silent AS unanswered, sample_ports, sample_hosts
FROM s"""


def port_scan(spark: SparkSession, sf_dir: str, ports: int, hosts: int) -> DataFrame:
    found = detect_port_scan(
        A.flows(spark, sf_dir), PortScanParams(distinct_ports=ports, distinct_hosts=hosts),
        detail=False,
    )
    return _common(
        found,
        F.col("evidence.distinct_dest_ports").alias("ports"),
        F.col("evidence.distinct_dest_hosts").alias("hosts"),
        F.col("evidence.distinct_targets").alias("targets"),
        F.col("evidence.unanswered_flows").alias("unanswered"),
        _listed("evidence.sample_dest_ports").alias("sample_ports"),
        _listed("evidence.sample_dest_hosts").alias("sample_hosts"),
    )


@query("detect_port_scan", _SCAN_SQL.format(flows=A.FLOWS_SQL, p=20, h=15, sev=_SEVERITY3))
def q_port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return port_scan(spark, sf_dir, 20, 15)


@query("detect_port_scan_low", _SCAN_SQL.format(flows=A.FLOWS_SQL, p=10, h=10, sev=_SEVERITY3))
def q_port_scan_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return port_scan(spark, sf_dir, 10, 10)


def samples_sql(source: str, key: str, peak: str | None) -> str:
    """F8 in SQL: first, last, peak, then an even spread of the rest up to twenty rows."""
    pos = (
        f"row_number() OVER (PARTITION BY {key} ORDER BY {peak} DESC, t, id)" if peak else "NULL"
    )
    return f"""
r AS (SELECT {key}, id, row_number() OVER (PARTITION BY {key} ORDER BY t, id) - 1 AS i,
             count(*) OVER (PARTITION BY {key}) AS n, {pos} AS p FROM {source}),
q AS (SELECT *, CASE WHEN p = 1 THEN i END AS top FROM r),
w AS (SELECT *, max(top) OVER (PARTITION BY {key}) AS pk FROM q),
x AS (SELECT *, (pk IS NOT NULL AND pk > 0 AND pk < n - 1) AS inner_pk FROM w),
y AS (SELECT *, least(n, 2) + CASE WHEN inner_pk THEN 1 ELSE 0 END AS taken,
             i - 1 - CASE WHEN inner_pk AND i > pk THEN 1 ELSE 0 END AS m FROM x),
z AS (SELECT *, CASE WHEN i = 0 THEN 'first' WHEN i = n - 1 THEN 'last'
                     WHEN inner_pk AND i = pk THEN 'peak'
                     WHEN m % greatest(1, (n - taken) // (20 - taken)) = 0
                      AND m // greatest(1, (n - taken) // (20 - taken)) < 20 - taken THEN 'sample' END AS role
      FROM y)
SELECT {key}, id AS event_id, role FROM z WHERE role IS NOT NULL"""


@query(
    "sample_contributors",
    f"WITH {A.FLOWS_SQL}, f AS (SELECT *, t - t % 600 AS bucket, src AS entity_value FROM flows),"
    + samples_sql("f", "entity_value, bucket", None),
)
def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.flows(spark, sf_dir).select(
        F.col("src_ip").alias("entity_value"),
        bucket_seconds(F.col("event_time"), 600).alias("bucket"),
        F.unix_micros("event_time").alias("us"),
        "id",
    )
    picked = sample_contributors(rows, ["entity_value", "bucket"], "us", "id", 20)
    return picked.select("entity_value", "bucket", F.explode("samples").alias("s")).select(
        "entity_value", "bucket", "s.event_id", "s.role"
    )


@query(
    "sample_contributors_peak",
    f"WITH {A.FLOWS_SQL}, f AS (SELECT *, t - t % 3600 AS bucket, src AS entity_value FROM flows),"
    + samples_sql("f", "entity_value, bucket", "bytes_out"),
)
def q_samples_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.flows(spark, sf_dir).select(
        F.col("src_ip").alias("entity_value"),
        bucket_seconds(F.col("event_time"), 3600).alias("bucket"),
        F.unix_micros("event_time").alias("us"),
        "id",
        "bytes_toserver",
    )
    picked = sample_contributors(
        rows, ["entity_value", "bucket"], "us", "id", 120, peak="bytes_toserver"
    )
    return picked.select("entity_value", "bucket", F.explode("samples").alias("s")).select(
        "entity_value", "bucket", "s.event_id", "s.role"
    )


# ------------------------------------------------------------------ D-002

_BURST_SQL = f"""
WITH {A.AUTH_SQL},
a AS (SELECT *, t - t % 600 AS b FROM auth),
w AS (SELECT *, count(*) OVER (PARTITION BY src, b ORDER BY t RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS burst
      FROM a)"""


@query(
    "densest_span",
    _BURST_SQL + " SELECT src AS entity_value, b AS bucket, max(burst) AS max_burst FROM w GROUP BY src, b",
)
def q_densest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.auth_alerts(spark, sf_dir).select(
        F.col("src_ip").alias("entity_value"),
        bucket_seconds(F.col("event_time"), 600).alias("bucket"),
        F.unix_micros("event_time").alias("us"),
    )
    return densest_span(rows, ["entity_value", "bucket"], "us", 120)


@query(
    "detect_auth_burst",
    _BURST_SQL
    + f""",
g AS (SELECT src, b, min(t) AS lo, max(t) AS hi, count(*) AS n, max(burst) AS max_burst,
             count(DISTINCT dest || ':' || dest_port) AS targets,
             array_to_string(list_sort(list_distinct(list(dest || ':' || dest_port)))[1:10], ',') AS sample_targets,
             array_to_string(list_sort(list_distinct(list(sid)))[1:10], ',') AS signature_ids
      FROM w GROUP BY src, b HAVING count(*) >= 10 AND max(burst) >= 5),
s AS (SELECT *, round_even(least(1.0, max_burst / 5.0 / 3.0), 4) AS signal_strength FROM g)
SELECT src AS entity_value, b AS bucket, lo AS first_s, hi AS last_s, n AS event_count, signal_strength,
       round_even(0.5 + 0.5 * max_burst / n, 4) AS confidence, {_SEVERITY3},
       max_burst, targets, sample_targets, signature_ids
FROM s""",
)
def q_auth_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_auth_burst(
        A.auth_alerts(spark, sf_dir), AuthBurstParams(failures=10, burst=5), detail=False
    )
    return _common(
        found,
        F.col("evidence.max_burst").alias("max_burst"),
        F.col("evidence.distinct_targets").alias("targets"),
        _listed("evidence.sample_targets").alias("sample_targets"),
        _listed("evidence.signature_ids").alias("signature_ids"),
    )


# ------------------------------------------------------------------ D-003

_DNS_DETECT_SQL = f"""
WITH {A.DNS_SQL},
d AS (SELECT *, t - t % 600 AS b FROM dns),
names AS (SELECT client, b, name, min(CAST(t AS VARCHAR) || id) AS seen
          FROM d WHERE NOT reply GROUP BY client, b, name),
labels AS (SELECT DISTINCT name, string_split(name, '.')[1] AS label FROM names),
chars AS (SELECT name, length(label) AS len, unnest(string_split(label, '')) AS ch FROM labels),
freq AS (SELECT name, len, ch, count(*) AS k FROM chars GROUP BY name, len, ch),
ent AS (SELECT name, len, -sum(k / len * log2(k / len)) AS h FROM freq GROUP BY name, len),
judged AS (SELECT n.*, regexp_extract(n.name, '([^.]+[.][^.]+)$', 1) AS domain,
                  (e.len >= 16 AND e.h >= 3.5) AS rnd, e.len >= {{long}} AS lng
           FROM names n JOIN ent e USING (name)),
dom AS (SELECT client, b, domain, count(*) AS names, count(*) FILTER (WHERE rnd) AS random,
               count(*) FILTER (WHERE lng) AS long, min(seen) AS seen
        FROM judged GROUP BY client, b, domain),
top AS (SELECT *, row_number() OVER (PARTITION BY client, b ORDER BY names DESC, seen) AS r FROM dom),
per AS (SELECT client, b, sum(names) AS distinct_names, sum(long) AS long_names,
               max(names) FILTER (WHERE names >= 50 AND random * 2 >= names) AS tunnel,
               max(domain) FILTER (WHERE r = 1) AS top_domain, max(names) FILTER (WHERE r = 1) AS top_names,
               max(random) FILTER (WHERE r = 1) AS top_random
        FROM top GROUP BY client, b),
tot AS (SELECT client, b, min(t) AS lo, max(t) AS hi, count(*) AS n, count(*) FILTER (WHERE reply) AS answers
        FROM d GROUP BY client, b),
sig AS (SELECT tot.*, coalesce(distinct_names, 0) AS distinct_names, coalesce(long_names, 0) AS long_names,
               top_domain, top_names, top_random, tunnel / 50.0 AS s1,
               CASE WHEN answers >= {{nx}} THEN answers / {{nx}}.0 END AS s2,
               CASE WHEN coalesce(long_names, 0) >= {{count}} THEN long_names / {{count}}.0 END AS s3
        FROM tot LEFT JOIN per USING (client, b)),
s AS (SELECT *, round_even(least(1.0, greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0)) / 3.0), 4) AS signal_strength,
             concat_ws(',', CASE WHEN s3 IS NOT NULL THEN 'long_labels' END,
                       CASE WHEN s2 IS NOT NULL THEN 'nxdomain' END, CASE WHEN s1 IS NOT NULL THEN 'tunnel' END) AS signals,
             (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS k
      FROM sig WHERE s1 IS NOT NULL OR s2 IS NOT NULL OR s3 IS NOT NULL)
SELECT client AS entity_value, b AS bucket, lo AS first_s, hi AS last_s, n AS event_count, signal_strength,
       round_even(least(1.0, 0.6 + 0.2 * (k - 1)), 4) AS confidence, {_SEVERITY3}, signals,
       CAST(distinct_names AS BIGINT) AS distinct_names, answers AS nxdomain,
       coalesce(top_domain, '') AS top_domain, CAST(coalesce(top_names, 0) AS BIGINT) AS top_names,
       CAST(coalesce(top_random, 0) AS BIGINT) AS top_random, CAST(long_names AS BIGINT) AS long_names
FROM s"""


def _dns(spark: SparkSession, sf_dir: str, params: DnsParams) -> DataFrame:
    found = detect_dns_anomaly(A.dns_events(spark, sf_dir), params, detail=False)
    return _common(
        found,
        F.array_join("evidence.signals", ",").alias("signals"),
        F.col("evidence.distinct_names").alias("distinct_names"),
        F.col("evidence.nxdomain_answers").alias("nxdomain"),
        F.col("evidence.top_domain").alias("top_domain"),
        F.col("evidence.top_domain_names").alias("top_names"),
        F.col("evidence.top_domain_suspicious").alias("top_random"),
        F.col("evidence.long_names").alias("long_names"),
    )


@query("detect_dns_anomaly", _DNS_DETECT_SQL.format(long=40, count=20, nx=10))
def q_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dns(spark, sf_dir, DnsParams(nxdomain_failures=10))


@query("detect_dns_long_labels", _DNS_DETECT_SQL.format(long=20, count=15, nx=10))
def q_dns_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dns(
        spark, sf_dir, DnsParams(nxdomain_failures=10, long_label_chars=20, long_queries=15)
    )


# ------------------------------------------------------------------ D-004

_INTERVALS_SQL = f"""
WITH {A.BEACON_SQL},
f AS (SELECT *, t - t % 3600 AS b, t - lag(t) OVER (PARTITION BY src, t - t % 3600 ORDER BY t) AS d FROM beacons),
g AS (SELECT src, b, min(t) AS lo, max(t) AS hi, count(*) AS n, sum(d) AS total,
             sum(CAST(d AS HUGEINT) * d) AS sq, sum(bytes_out) AS bytes_out
      FROM f GROUP BY src, b),
m AS (SELECT *, CAST((CAST(total AS DOUBLE) * 1000000 / (n - 1)) / 1000000 AS DOUBLE) AS mean_s,
             (sqrt(CAST(((n - 1) * sq - CAST(total AS HUGEINT) * total) * 1000000000000 AS DOUBLE)) / (n - 1)) AS sd_us
      FROM g WHERE n > 1),
j AS (SELECT *, CASE WHEN total > 0 THEN sd_us / (CAST(total AS DOUBLE) * 1000000 / (n - 1)) END AS jit FROM m)"""


@query(
    "interval_stats",
    _INTERVALS_SQL
    + """ SELECT src AS entity_value, b AS bucket, n AS connections,
                 CAST(floor(mean_s * 1000 + 0.5) AS BIGINT) AS mean_ms,
                 CAST(floor(jit * 1000000 + 0.5) AS BIGINT) AS jitter_ppm FROM j""",
)
def q_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.beacon_flows(spark, sf_dir).select(
        F.col("src_ip").alias("entity_value"),
        bucket_seconds(F.col("event_time"), 3600).alias("bucket"),
        F.unix_micros("event_time").alias("us"),
    )
    return (
        interval_stats(rows, ["entity_value", "bucket"], "us", 120)
        .filter("connections > 1")
        .select(
            "entity_value",
            "bucket",
            "connections",
            F.floor(F.col("mean_interval") * 1000 + 0.5).alias("mean_ms"),
            F.floor(F.col("jitter") * 1000000 + 0.5).alias("jitter_ppm"),
        )
    )


@query(
    "detect_beaconing",
    _INTERVALS_SQL
    + f""",
s AS (SELECT *, round_even(least(1.0, n / 10.0 / 3.0), 4) AS signal_strength, round_even(jit, 4) AS jitter
      FROM j WHERE n >= 10 AND mean_s >= 5 AND jit <= 0.15)
SELECT src AS entity_value, b AS bucket, lo AS first_s, hi AS last_s, n AS event_count, signal_strength,
       round_even(least(1.0, greatest(0.5, 1.0 - jitter / 0.15 * 0.5)), 4) AS confidence, {_SEVERITY3},
       jitter, round_even(mean_s, 2) AS mean_interval, CAST(bytes_out AS BIGINT) AS bytes_out
FROM s""",
)
def q_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_beaconing(A.beacon_flows(spark, sf_dir), detail=False)
    return _common(
        found,
        F.col("evidence.jitter").alias("jitter"),
        F.col("evidence.mean_interval_seconds").alias("mean_interval"),
        F.col("evidence.bytes_out").alias("bytes_out"),
    )


# ------------------------------------------------------------------ D-005

_VOLUME_SQL = f"""
WITH {A.FLOWS_SQL}, {A.BASELINES_SQL},
g AS (SELECT src, t - t % 3600 AS b, min(t) AS lo, max(t) AS hi, count(*) AS n, sum(bytes_out) AS bytes_out,
             count(DISTINCT dest) AS dests,
             array_to_string(list_sort(list_distinct(list(dest)))[1:10], ',') AS sample_dests
      FROM flows WHERE bytes_out > 0 GROUP BY src, t - t % 3600),
l AS (SELECT g.*, samples, CAST(floor(greatest(mean + 3 * stddev, 2 * p95, 52428800)) AS BIGINT) AS lim
      FROM g JOIN baselines ON src = address WHERE samples >= 24),
s AS (SELECT *, round_even(least(1.0, CAST(bytes_out AS DOUBLE) / lim / 3.0), 4) AS signal_strength FROM l WHERE bytes_out >= lim)
SELECT src AS entity_value, b AS bucket, lo AS first_s, hi AS last_s, n AS event_count, signal_strength,
       round_even(0.5 + 0.5 * least(1.0, samples / 168.0), 4) AS confidence, {_SEVERITY3},
       CAST(bytes_out AS BIGINT) AS bytes_out, lim AS threshold_bytes, dests, sample_dests
FROM s"""


@query("detect_volume_anomaly", _VOLUME_SQL)
def q_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_volume_anomaly(
        A.flows(spark, sf_dir), A.address_baselines(spark, sf_dir), VolumeParams(), detail=False
    )
    return _common(
        found,
        F.col("evidence.bytes_out").alias("bytes_out"),
        F.col("evidence.threshold_bytes").alias("threshold_bytes"),
        F.col("evidence.distinct_destinations").alias("dests"),
        F.array_join("evidence.sample_destinations", ",").alias("sample_dests"),
    )


# ------------------------------------------------------------------ scoring

_TRUTH_SQL = f"""
WITH {A.FLOWS_SQL},
c AS (SELECT src, t - t % 600 AS b, count(*) AS n, count(DISTINCT dest_port) AS p, count(DISTINCT dest) AS h
      FROM flows GROUP BY 1, 2),
fired AS (SELECT src FROM c WHERE n >= 20 AND (p >= 25 OR h >= 20)),
k AS (SELECT s_suppkey, {A.dotted_sql(f"{A.SITE} + s_suppkey")} AS entity, s_suppkey % 3 = 0 AS positive FROM supplier),
v AS (SELECT k.*, (SELECT count(*) FROM fired WHERE src = entity) AS hits FROM k)
"""


def _expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per supplier: its own traffic, expected to fire for every third."""
    key = F.col("s_suppkey")
    return A.table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("case_id"),
        F.lit("D-001").alias("rule_id"),
        F.when(key % 3 == 0, F.lit("detection")).otherwise(F.lit("no_detection")).alias("expected"),
        F.lit("src_ip").alias("entity_type"),
        A.dotted(F.lit(A.SITE) + key).alias("entity_value"),
        F.lit(1).alias("min_severity"),
    )


def _case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_port_scan(
        A.flows(spark, sf_dir), PortScanParams(distinct_ports=25, distinct_hosts=20), detail=False
    )
    cases = _expectations(spark, sf_dir).select("case_id", F.col("entity_value").alias("_e"))
    return found.join(cases, F.col("entity_value") == F.col("_e"))


@query(
    "judge_cases",
    _TRUTH_SQL
    + """SELECT CAST(s_suppkey AS VARCHAR) AS case_id, 'D-001' AS rule_id, hits AS fired,
         CASE WHEN positive THEN hits = 1 ELSE hits = 0 END AS matched,
         CASE WHEN positive THEN CASE WHEN hits = 1 THEN 'TP' ELSE 'FN' END
              ELSE CASE WHEN hits > 0 THEN 'FP' ELSE 'TN' END END AS verdict,
         CASE WHEN positive AND hits = 0 THEN 'nothing fired'
              WHEN positive AND hits > 1 THEN 'the expected entity fired in ' || hits || ' windows'
              WHEN NOT positive AND hits > 0 THEN hits || ' firings where none was expected'
              ELSE '' END AS reason FROM v""",
)
def q_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judge_cases(_expectations(spark, sf_dir), _case_results(spark, sf_dir))


#: Flows and beacon flows as one feed of connections, and the windows in which each rule fires.
FIRING_SQL = f"""{A.FLOWS_SQL}, {A.BEACON_SQL}, {A.AUTH_SQL},
links AS (SELECT '0-' || id AS id, t, src, dest, dest_port, bytes_out FROM flows
          UNION ALL SELECT '3-' || id, t, src, dest, dest_port, bytes_out FROM beacons WHERE t < {A.BASE} + {{span}}),
d1 AS (SELECT 'D-001' AS rule_id, 3 AS base, src, t - t % 600 AS b, count(*) AS n,
              greatest(count(DISTINCT dest_port) / 20.0, count(DISTINCT dest) / 15.0) AS ratio
       FROM links GROUP BY src, t - t % 600
       HAVING count(*) >= 20 AND (count(DISTINCT dest_port) >= 20 OR count(DISTINCT dest) >= 15)),
runs AS (SELECT *, t - t % 600 AS b, count(*) OVER (PARTITION BY src, t - t % 600 ORDER BY t RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS burst
      FROM auth),
d2 AS (SELECT 'D-002' AS rule_id, 3 AS base, src, b, count(*) AS n, max(burst) / 10.0 AS ratio
       FROM runs GROUP BY src, b HAVING max(burst) >= 10),
d3 AS (SELECT 'D-003' AS rule_id, 3 AS base, entity_value AS src, bucket AS b, event_count AS n, signal_strength * 3 AS ratio
       FROM ({_DNS_DETECT_SQL.format(long=40, count=20, nx=50)})),
gaps AS (SELECT *, dest || ':' || dest_port AS place, t - t % 3600 AS b,
                t - lag(t) OVER (PARTITION BY src, dest, dest_port, t - t % 3600 ORDER BY t) AS d FROM links),
per AS (SELECT src, b, place, count(*) AS n, sum(d) AS total, sum(CAST(d AS HUGEINT) * d) AS sq
        FROM gaps GROUP BY src, b, place HAVING count(*) >= 10 AND sum(d) >= 5 * (count(*) - 1)),
jit AS (SELECT *, sqrt(CAST(((n - 1) * sq - CAST(total AS HUGEINT) * total) * 1000000000000 AS DOUBLE)) / (n - 1)
                  / (CAST(total AS DOUBLE) * 1000000 / (n - 1)) AS jit FROM per),
d4 AS (SELECT 'D-004' AS rule_id, 4 AS base, src, b, CAST(sum(n) AS BIGINT) AS n,
              arg_min(n, struct_pack(j := round_even(jit, 4), c := -n, p := place)) / 10.0 AS ratio
       FROM jit WHERE jit <= 0.15 GROUP BY src, b)"""


@query(
    "benign_noise",
    f"""WITH {FIRING_SQL.format(span=10**8)},
    e AS (SELECT (SELECT count(*) FROM links) + (SELECT count(*) FROM auth) + (SELECT count(*) FROM events) AS events)
    SELECT 'D-001' AS rule_id, events, (SELECT count(*) FROM d1) AS alerts FROM e
    UNION ALL SELECT 'D-002', events, (SELECT count(*) FROM d2) FROM e
    UNION ALL SELECT 'D-003', events, (SELECT count(*) FROM d3) FROM e
    UNION ALL SELECT 'D-004', events, (SELECT count(*) FROM d4) FROM e
    UNION ALL SELECT 'D-005', events, 0 FROM e""",
)
def q_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.benign_noise(A.every_feed(spark, sf_dir))


@query(
    "detector_metrics",
    _TRUTH_SQL
    + """, j AS (SELECT CASE WHEN positive THEN CASE WHEN hits = 1 THEN 'TP' ELSE 'FN' END
              ELSE CASE WHEN hits > 0 THEN 'FP' ELSE 'TN' END END AS verdict FROM v),
    x AS (SELECT count(*) FILTER (WHERE verdict = 'TP') AS tp, count(*) FILTER (WHERE verdict = 'FP') AS fp,
                 count(*) FILTER (WHERE verdict = 'FN') AS fn, count(*) FILTER (WHERE verdict = 'TN') AS tn,
                 (SELECT count(*) FROM flows) AS ev, (SELECT count(*) FROM fired) AS al FROM j),
    y AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS p,
                 CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM x)
    SELECT 'D-001' AS rule_id, tp, fp, fn, tn, p AS precision, r AS recall,
           CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1, CAST(al AS DOUBLE) * 10000 / ev AS alerts_per_10k FROM y""",
)
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rule runs once, for both the verdicts and the noise
    results = materialize(_case_results(spark, sf_dir))
    outcomes = evaluation.judge_cases(_expectations(spark, sf_dir), results)
    flows = A.flows(spark, sf_dir)
    noise = (
        results.agg(F.count("*").alias("alerts"))
        .crossJoin(flows.agg(F.count("*").alias("events")))
        .select(F.lit("D-001").alias("rule_id"), "events", "alerts")
    )
    return evaluation.detector_metrics(outcomes, noise)
