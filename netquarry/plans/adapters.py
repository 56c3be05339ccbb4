"""The supplied tables seen as network telemetry.

Each adapter exists twice, as DataFrame expressions and as a SQL common table expression, in
the same integer arithmetic, so that both engines start from equal rows. Every adapter maps
every row of its table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1788256800  # 2026-09-01T10:00:00Z
SITE = 168427520  # 10.10.0.0
OUTSIDE = 3405803776  # 203.0.113.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dotted(value: Column) -> Column:
    v = value.cast("bigint")
    return F.concat_ws(
        ".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def dotted_sql(value: str) -> str:
    return "||'.'||".join(f"((({value}) >> {s}) & 255)" for s in (24, 16, 8, 0))


def _null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def _event_columns(df: DataFrame) -> DataFrame:
    """All event columns the rules read, NULL where the adapter has none."""
    wanted = {
        "id": "string", "event_time": "timestamp", "event_type": "string", "flow_id": "bigint",
        "src_ip": "string", "dest_ip": "string", "src_port": "int", "dest_port": "int",
        "proto": "string", "app_proto": "string", "bytes_toserver": "bigint",
        "bytes_toclient": "bigint", "pkts_toserver": "bigint", "pkts_toclient": "bigint",
        "dns_query": "string", "dns_rrtype": "string", "dns_rcode": "string",
        "sig_signature": "string", "sig_category": "string", "sig_signature_id": "bigint",
    }
    return df.select(
        *[F.col(n).cast(t).alias(n) if n in df.columns else _null(t, n) for n, t in wanted.items()]
    )


# ------------------------------------------------------------------ flows from lineitem

FLOWS_SQL = f"""flows AS (
  SELECT md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       CAST(floor(l_extendedprice * 1000) AS BIGINT), epoch_us(l_shipdate))) AS id,
         {BASE} + (l_orderkey * 7 + l_linenumber * 13) % 7200 AS t,
         {SITE} + l_suppkey AS src_num,
         {OUTSIDE} + l_partkey % (3 + l_suppkey % 25) AS dest_num,
         {dotted_sql(f"{SITE} + l_suppkey")} AS src,
         {dotted_sql(f"{OUTSIDE} + l_partkey % (3 + l_suppkey % 25)")} AS dest,
         CAST(1024 + l_partkey % (5 + l_suppkey % 40) AS INTEGER) AS dest_port,
         CAST(floor(l_extendedprice * 1000) AS BIGINT) AS bytes_out,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS back,
         l_orderkey
  FROM lineitem)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    spent = F.floor(F.col("l_extendedprice") * 1000).cast("bigint")
    key = [
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        spent.cast("string"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("string"),
    ]
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return _event_columns(
        df.select(
            F.md5(F.concat_ws("-", *key)).alias("id"),
            F.timestamp_seconds(
                F.lit(BASE) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 7200
            ).alias("event_time"),
            F.lit("flow").alias("event_type"),
            F.col("l_orderkey").alias("flow_id"),
            dotted(F.lit(SITE) + supp).alias("src_ip"),
            dotted(F.lit(OUTSIDE) + part % (F.lit(3) + supp % 25)).alias("dest_ip"),
            (F.lit(1024) + part % (F.lit(5) + supp % 40)).cast("int").alias("dest_port"),
            spent.alias("bytes_toserver"),
            F.when(F.col("l_returnflag") == "R", F.lit(0))
            .otherwise(F.floor("l_quantity"))
            .cast("bigint")
            .alias("pkts_toclient"),
        )
    )


# ------------------------------------------------------------------ from events

_EID = "lpad(CAST(event_id AS VARCHAR), 12, '0')"

AUTH_SQL = f"""auth AS (
  SELECT {_EID} AS id, {BASE} + (event_id * 11) % 3600 AS t,
         {dotted_sql(f"{SITE} + user_id % 40")} AS src,
         {dotted_sql(f"{SITE} + 4096 + event_id % 7")} AS dest,
         CAST(CASE WHEN event_id % 2 = 0 THEN 22 ELSE 3389 END AS INTEGER) AS dest_port,
         2000 + event_id % 5 AS sid
  FROM events WHERE event_type = 'error')"""


def _event_id() -> Column:
    return F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id")


def auth_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    eid = F.col("event_id")
    return _event_columns(
        df.select(
            _event_id(),
            F.timestamp_seconds(F.lit(BASE) + (eid * 11) % 3600).alias("event_time"),
            F.lit("alert").alias("event_type"),
            dotted(F.lit(SITE) + F.col("user_id") % 40).alias("src_ip"),
            dotted(F.lit(SITE + 4096) + eid % 7).alias("dest_ip"),
            F.when(eid % 2 == 0, 22).otherwise(3389).alias("dest_port"),
            F.lit("SSH brute force").alias("sig_signature"),
            (F.lit(2000) + eid % 5).alias("sig_signature_id"),
        )
    )


BEACON_SQL = f"""beacons AS (
  SELECT {_EID} AS id,
         {BASE} + (event_id // 150) * 60
           + CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id * 37) % (event_id % 150 + 1) END AS t,
         {dotted_sql(f"{SITE} + event_id % 150")} AS src, '203.0.113.200' AS dest, 443 AS dest_port,
         event_id % 1000 AS bytes_out
  FROM events)"""


def beacon_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    wobble = F.when(eid % 3 == 0, F.lit(0)).otherwise((eid * 37) % (eid % 150 + 1))
    return _event_columns(
        df.select(
            _event_id(),
            F.timestamp_seconds(
                F.lit(BASE) + F.floor(eid / 150).cast("bigint") * 60 + wobble
            ).alias("event_time"),
            F.lit("flow").alias("event_type"),
            dotted(F.lit(SITE) + eid % 150).alias("src_ip"),
            F.lit("203.0.113.200").alias("dest_ip"),
            F.lit(443).alias("dest_port"),
            (eid % 1000).alias("bytes_toserver"),
        )
    )


_DNS_NAME = """(CASE WHEN user_id % 20 < 8 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 20)
                ELSE 'host' || CAST(event_id % 30 AS VARCHAR) END)
               || '.c' || CAST(user_id % 2 AS VARCHAR) || '.test'"""
_DNS_REPLY = "(event_type = 'error' AND user_id % 3 = 0)"

DNS_SQL = f"""dns AS (
  SELECT {_EID} AS id, {BASE} + event_id % 1200 AS t, {dotted_sql(f"{SITE} + user_id % 20")} AS client,
         {_DNS_NAME} AS name, {_DNS_REPLY} AS reply
  FROM events)"""


def dns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    client = dotted(F.lit(SITE) + uid % 20)
    resolver = F.lit("10.10.255.53")
    reply = (F.col("event_type") == "error") & (uid % 3 == 0)
    head = F.when(uid % 20 < 8, F.substring(F.md5(eid.cast("string")), 1, 20)).otherwise(
        F.concat(F.lit("host"), (eid % 30).cast("string"))
    )
    return _event_columns(
        df.select(
            _event_id(),
            F.timestamp_seconds(F.lit(BASE) + eid % 1200).alias("event_time"),
            F.lit("dns").alias("event_type"),
            F.when(reply, resolver).otherwise(client).alias("src_ip"),
            F.when(reply, client).otherwise(resolver).alias("dest_ip"),
            F.concat(head, F.lit(".c"), (uid % 2).cast("string"), F.lit(".test")).alias("dns_query"),
            F.when(reply, F.lit("NXDOMAIN")).alias("dns_rcode"),
        )
    )


def every_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows, authentication alerts, DNS and beacon flows in one table, with ids of their own."""
    frames = [
        make(spark, sf_dir).withColumn("id", F.concat(F.lit(f"{i}-"), F.col("id")))
        for i, make in enumerate((flows, auth_alerts, dns_events, beacon_flows))
    ]
    return reduce(DataFrame.unionByName, frames)


# ------------------------------------------------------------------ assets from supplier

NETWORKS_SQL = f"""networks AS (
  SELECT 'host-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS asset_id, {SITE} + s_suppkey AS lo,
         {SITE} + s_suppkey AS hi, 32 AS masklen, s_suppkey % 2 = 0 AS is_primary,
         s_suppkey % 7 <> 0 AS is_active, s_suppkey AS born,
         CAST(1 + s_suppkey % 5 AS INTEGER) AS criticality
  FROM supplier
  UNION ALL
  SELECT DISTINCT 'block-' || lpad(CAST(s_suppkey // 16 AS VARCHAR), 9, '0'), {SITE} + (s_suppkey // 16) * 16,
         {SITE} + (s_suppkey // 16) * 16 + 15, 28, true, true, 0,
         CAST(1 + (s_suppkey // 16) % 5 AS INTEGER)
  FROM supplier
  UNION ALL
  SELECT DISTINCT 'site-' || CAST((s_suppkey // 65536) AS VARCHAR), {SITE} + (s_suppkey // 65536) * 65536,
         {SITE} + (s_suppkey // 65536) * 65536 + 65535, 16, true, true, 0, 2
  FROM supplier)"""


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One /32 per supplier, one /28 per block of sixteen, one /16 per site over them."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select("s_suppkey")

    def group(size: int) -> DataFrame:
        return base.select(F.floor(key / size).cast("bigint").alias("g")).distinct()

    epoch = F.timestamp_seconds(F.lit(0))
    hosts = base.select(
        F.concat(F.lit("host-"), F.lpad(key.cast("string"), 9, "0")).alias("asset_id"),
        F.concat(dotted(F.lit(SITE) + key), F.lit("/32")).alias("cidr"),
        (key % 2 == 0).alias("is_primary"),
        (key % 7 != 0).alias("is_active"),
        F.timestamp_seconds(key).alias("created_at"),
        (F.lit(1) + key % 5).cast("int").alias("criticality"),
    )
    blocks = group(16).select(
        F.concat(F.lit("block-"), F.lpad(F.col("g").cast("string"), 9, "0")).alias("asset_id"),
        F.concat(dotted(F.lit(SITE) + F.col("g") * 16), F.lit("/28")).alias("cidr"),
        F.lit(True).alias("is_primary"),
        F.lit(True).alias("is_active"),
        epoch.alias("created_at"),
        (F.lit(1) + F.col("g") % 5).cast("int").alias("criticality"),
    )
    sites = group(65536).select(
        F.concat(F.lit("site-"), F.col("g").cast("string")).alias("asset_id"),
        F.concat(dotted(F.lit(SITE) + F.col("g") * 65536), F.lit("/16")).alias("cidr"),
        F.lit(True).alias("is_primary"),
        F.lit(True).alias("is_active"),
        epoch.alias("created_at"),
        F.lit(2).alias("criticality"),
    )
    return hosts.unionByName(blocks).unionByName(sites)


BASELINES_SQL = f"""baselines AS (
  SELECT {dotted_sql(f"{SITE} + s_suppkey")} AS address, 4e9 * (s_suppkey % 5 + 1) AS mean,
         CAST(5e8 AS DOUBLE) AS stddev, 5e9 * (s_suppkey % 4 + 1) AS p95,
         CAST(10 + s_suppkey % 200 AS BIGINT) AS samples
  FROM supplier)"""


def address_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        dotted(F.lit(SITE) + key).alias("address"),
        F.lit("outbound_bytes_per_hour").alias("metric"),
        F.lit(7).alias("window_days"),
        (F.lit(4e9) * (key % 5 + 1)).alias("mean"),
        F.lit(5e8).alias("stddev"),
        (F.lit(5e9) * (key % 4 + 1)).alias("p95"),
        (F.lit(10) + key % 200).cast("bigint").alias("sample_count"),
    )


# ------------------------------------------------------------------ alerts from orders

DAY = 86400

ALERTS_SQL = f"""alerts AS (
  SELECT o_orderkey AS alert_id, 'D-00' || CAST(1 + o_orderkey % 5 AS VARCHAR) AS rule_id,
         CAST(1 + o_orderkey % 5 AS INTEGER) AS severity,
         {dotted_sql(f"{SITE} + o_custkey % 300")} AS entity_value,
         epoch_us(o_orderdate) // 1000000 AS s,
         epoch_us(o_orderdate) // 1000000 + (o_orderkey % 5) * {DAY} AS e
  FROM orders)"""


def order_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        key.alias("alert_id"),
        F.concat(F.lit("D-00"), (F.lit(1) + key % 5).cast("string")).alias("rule_id"),
        (F.lit(1) + key % 5).cast("int").alias("severity"),
        F.lit("src_ip").alias("entity_type"),
        dotted(F.lit(SITE) + F.col("o_custkey") % 300).alias("entity_value"),
        F.timestamp_seconds(start).alias("first_seen"),
        F.timestamp_seconds(start + (key % 5) * DAY).alias("last_seen"),
    )
