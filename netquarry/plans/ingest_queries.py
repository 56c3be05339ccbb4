"""Registered queries: normalising, ingest, inventory, expressions over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import dns, ip, markdown, scoring, text, timing
from netquarry.functions.secrets import bounded_detail
from netquarry.operators.inventory import upsert_assets
from netquarry.plans import adapters as A
from netquarry.plans.registry import query
from netquarry.sources.datasets import corpus_profile
from netquarry.sources.ingest import Provenance, ingest
from netquarry.sources.normalize import judge_lines, normalize, outcomes_of

AS_OF = "2026-09-05 12:00:00"
STAMP = "2026-09-01T10:00:00.000000+0000"

# Twelve shapes of line, chosen by event_id % 12; each takes its numbers from the row.
_OK = '{"timestamp":"' + STAMP + '","event_type":"flow","flow_id":#,"src_ip":"10.0.0.1","dest_ip":"203.0.113.9","dest_port":443,"flow":{"bytes_toserver":#}}'
_SHAPES = [
    (_OK, None),
    (_OK.replace('"dest_port":443', '"dest_port":70000'), "schema_invalid"),
    ('{"event_type":"flow","flow_id":#}', "missing_required"),
    (_OK + " #", "json_parse"),
    (_OK.replace('"flow",', '"stats",'), "unsupported_event_type"),
    (_OK.replace("2026-09-01", "1999-09-01"), "timestamp_out_of_range"),
    ("[#]", "schema_invalid"),
    (_OK.replace("+0000", ""), "schema_invalid"),
    ("{\"a\":" * 13 + "#" + "}" * 13, "too_deep"),
    (_OK.replace('"10.0.0.1"', '"10.0.0.999"'), "schema_invalid"),
    (_OK.replace('"flow_id":#', '"flow_id":#,"flow_id":1'), "json_parse"),
    (_OK.replace('"event_type":"flow"', '"event_type":"quic"'), None),
]
_REASONS_SQL = "[" + ", ".join(f"'{r or 'event'}'" for _, r in _SHAPES) + "]"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    shapes = F.array(*[F.lit(s) for s, _ in _SHAPES])
    line = F.replace(
        F.element_at(shapes, (eid % 12 + 1).cast("int")), F.lit("#"), (eid % 1000).cast("string")
    )
    return A.table(spark, sf_dir, "events").select(
        F.lit("events").alias("file"), eid.alias("line_number"), line.alias("raw")
    )


@query(
    "normalize",
    f"SELECT event_id AS line_number, {_REASONS_SQL}[event_id % 12 + 1] AS outcome FROM events",
)
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_lines(raw_lines(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return outcomes_of(judged).select(
        "line_number", F.coalesce("reason_code", F.lit("event")).alias("outcome")
    )


_KEPT = "event_id % 12 IN (0, 11)"


@query(
    "normalized_events",
    f"""SELECT event_id AS line_number, CASE WHEN event_id % 12 = 0 THEN 'flow' ELSE 'other' END AS event_type,
        event_id % 1000 AS flow_id, '10.0.0.1' AS src_ip, 443 AS dest_port, event_id % 1000 AS bytes_toserver,
        {A.BASE} AS event_s FROM events WHERE {_KEPT}""",
)
def q_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = normalize(raw_lines(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return events.select(
        "line_number", "event_type", "flow_id", "src_ip", "dest_port", "bytes_toserver",
        F.unix_seconds("event_time").alias("event_s"),
    )


def _ingest(spark: SparkSession, sf_dir: str):
    lines = raw_lines(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("timestamp")
    stored, _ = normalize(lines.filter("line_number % 12 = 0 AND line_number % 1000 < 100"), as_of)
    return ingest(lines, stored.select("event_hash"), Provenance("b-1", "orders feed"), as_of)


_FIRSTS = f"""
WITH e AS (SELECT event_id, event_id % 12 AS shape, event_id % 1000 AS n FROM events WHERE {_KEPT}),
f AS (SELECT shape, n, min(event_id) AS line_number FROM e GROUP BY 1, 2),
g AS (SELECT * FROM f WHERE NOT (shape = 0 AND n IN (SELECT event_id % 1000 FROM events WHERE event_id % 12 = 0 AND event_id % 1000 < 100)))"""


@query("ingest_events", _FIRSTS + " SELECT line_number, n AS flow_id, 'b-1' AS batch_id FROM g")
def q_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _, _ = _ingest(spark, sf_dir)
    return new.select("line_number", "flow_id", "batch_id")


@query(
    "ingest_batch",
    _FIRSTS
    + f""" SELECT 'complete' AS status, (SELECT count(*) FROM events) AS received, (SELECT count(*) FROM g) AS stored,
           (SELECT count(*) FROM e) - (SELECT count(*) FROM g) AS duplicate,
           (SELECT count(*) FROM events WHERE NOT ({_KEPT})) AS rejected""",
)
def q_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, batch = _ingest(spark, sf_dir)
    return batch.select("status", "received", "stored", "duplicate", "rejected")


@query(
    "corpus_profile",
    """SELECT count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, epoch_us(min(ts)) // 1000000 AS first_s,
              epoch_us(max(ts)) // 1000000 AS last_s, epoch_us(date_trunc('hour', min(ts))) // 1000000 AS from_s,
              epoch_us(date_trunc('hour', max(ts))) // 1000000 + 3600 AS to_s FROM events""",
)
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    profile = corpus_profile(events)
    return profile.select(
        "events",
        F.element_at("counts_by_type", "error").alias("errors"),
        F.unix_seconds("first_event").alias("first_s"),
        F.unix_seconds("last_event").alias("last_s"),
        F.unix_seconds("sweep_from").alias("from_s"),
        F.unix_seconds("sweep_to").alias("to_s"),
    )


# ------------------------------------------------------------------ inventory


@query(
    "upsert_assets",
    """SELECT 'host-' || c_custkey || '.example.test' AS hostname,
              CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE CAST(1 + c_custkey % 5 AS INTEGER) END AS criticality,
              c_custkey % 3 = 0 OR c_custkey % 2 = 0 AS is_active,
              CASE WHEN c_custkey % 3 = 0 THEN '/31' ELSE '/32' END AS width
       FROM customer""",
)
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cust = A.table(spark, sf_dir, "customer").select("c_custkey")
    host = F.concat(F.lit("host-"), key.cast("string"), F.lit(".example.test"))
    address = A.dotted(F.lit(A.SITE) + key * 2)
    assets = cust.filter("c_custkey % 6 <> 0").select(
        F.concat(F.lit("a-"), key.cast("string")).alias("asset_id"),
        host.alias("hostname"),
        F.lit("lab").alias("environment"),
        F.lit(None).cast("string").alias("owner"),
        (F.lit(1) + key % 5).cast("int").alias("criticality"),
        F.array(F.lit("x")).alias("tags"),
        F.lit(None).cast("string").alias("description"),
        (key % 2 == 0).alias("is_active"),
        F.timestamp_seconds(key).alias("created_at"),
    )
    nets = cust.filter("c_custkey % 6 <> 0").select(
        F.concat(F.lit("a-"), key.cast("string")).alias("asset_id"),
        F.concat(address, F.lit("/32")).alias("cidr"),
        F.lit(True).alias("is_primary"),
    )
    seed = cust.filter("c_custkey % 3 = 0").select(
        F.concat(F.lit(" "), F.upper(host)).alias("hostname"),
        F.lit("prod_sim").alias("environment"),
        F.lit("ops").alias("owner"),
        F.lit(5).alias("criticality"),
        F.array(F.lit("Web")).alias("tags"),
        F.lit(None).cast("string").alias("description"),
        F.array(
            F.struct(F.concat(address, F.lit("/31")).alias("cidr"), F.lit(True).alias("is_primary"))
        ).alias("networks"),
    )
    after, after_nets, _ = upsert_assets(assets, nets, seed, F.lit(AS_OF).cast("timestamp"))
    return after.join(after_nets, "asset_id").select(
        "hostname",
        "criticality",
        "is_active",
        F.concat(F.lit("/"), F.substring_index("cidr", "/", -1)).alias("width"),
    )


# ------------------------------------------------------------------ expressions


@query(
    "line_measures",
    """SELECT event_id, octet_length(encode(props || repeat('{', CAST(event_id % 5 AS INTEGER)))) AS bytes,
              CAST(greatest(1, event_id % 5) AS INTEGER) AS depth FROM events""",
)
def q_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("props", F.repeat(F.lit("{"), (F.col("event_id") % 5).cast("int")))
    return A.table(spark, sf_dir, "events").select(
        "event_id", text.line_bytes(raw).alias("bytes"), text.bracket_depth(raw).alias("depth")
    )


@query(
    "clean_text",
    r"""SELECT page_id, md5(regexp_replace(html, '[\x00-\x08\x0a-\x1f\x7f-\x9f]', '', 'g')) AS digest FROM pages""",
)
def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(text.clean_text(F.col("html"))).alias("digest")
    )


@query(
    "parse_sensor_time",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_partkey % 4 < 3 THEN {A.BASE} + l_suppkey % 3600 - CASE l_partkey % 4 WHEN 2 THEN 7200 ELSE 0 END END AS s
        FROM lineitem""",
)
def q_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.date_format(
        F.timestamp_seconds(F.lit(A.BASE) + F.col("l_suppkey") % 3600), "yyyy-MM-dd'T'HH:mm:ss"
    )
    zones = F.array(*[F.lit(z) for z in ("Z", "+0000", "+02:00", "")])
    stamp = F.concat(local, F.element_at(zones, (F.col("l_partkey") % 4 + 1).cast("int")))
    return A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.unix_seconds(timing.parse_sensor_time(stamp)).alias("s"),
    )


_ADDRESS_SQL = "(l_partkey * 2654435761 + l_suppkey * 40503) % 4294967296"


@query(
    "address_classes",
    f"""WITH a AS (SELECT DISTINCT {_ADDRESS_SQL} AS n FROM lineitem)
    SELECT {A.dotted_sql("n")} AS address, printf('%08x', n) AS hex,
      (n >> 24) IN (0, 10, 127) OR (n >> 24) >= 224 OR (n >> 22) = 401 OR (n >> 16) = 43518 OR (n >> 20) = 2753 OR (n >> 16) = 49320 AS internal,
      (n >> 28) = 10 AS in_160_4
    FROM a""",
)
def q_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("l_partkey") * 2654435761 + F.col("l_suppkey") * 40503) % 4294967296
    rows = A.table(spark, sf_dir, "lineitem").select(A.dotted(n).alias("address")).distinct()
    at = F.col("address")
    return rows.select(
        "address",
        ip.ip_hex(at).alias("hex"),
        ip.is_internal(at).alias("internal"),
        ip.ip_in(at, "160.0.0.0/4").alias("in_160_4"),
    )


@query(
    "dns_names",
    f"""WITH {A.DNS_SQL}, n AS (SELECT DISTINCT name FROM dns),
    c AS (SELECT name, length(string_split(name, '.')[1]) AS len, unnest(string_split(string_split(name, '.')[1], '')) AS ch FROM n),
    f AS (SELECT name, len, ch, count(*) AS k FROM c GROUP BY 1, 2, 3)
    SELECT name, regexp_extract(name, '([^.]+[.][^.]+)$', 1) AS base, CAST(floor(-sum(k / len * log2(k / len)) * 1000000 + 0.5) AS BIGINT) AS micro_bits
    FROM f GROUP BY name""",
)
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.dns_events(spark, sf_dir).select(F.col("dns_query").alias("name")).distinct()
    label = dns.longest_label(F.col("name"))
    return names.select(
        "name",
        dns.base_domain(F.col("name")).alias("base"),
        F.floor(dns.shannon_entropy(label) * 1000000 + 0.5).alias("micro_bits"),
    )


@query(
    "auth_signatures",
    """SELECT p_partkey, p_partkey % 5 IN (1, 2) AS failure FROM part""",
)
def q_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(
        *[F.lit(s) for s in ("GET ", "SSH Brute Force ", "Invalid USER ", "brut ", "Auth ok ")]
    )
    signature = F.concat(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), "p_name")
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", scoring.is_auth_failure(signature, F.col("p_type")).alias("failure")
    )


def _visible_sql(text: str) -> str:
    """Controls gone, invisible code points written out, as in functions.markdown."""
    out = rf"regexp_replace({text}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    for low, high in markdown._INVISIBLE_RANGES:
        for point in range(low, high + 1):
            out = f"replace({out}, chr({point}), '<U+{point:04X}>')"
    return out


@query(
    "markdown_cells",
    "SELECT doc_id, md5(regexp_replace(trim(regexp_replace("
    + _visible_sql("text")
    + r""", '[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')),
               '([!-/:-@\[-`{-~])', '\\\1', 'g')) AS digest FROM documents""",
)
def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(markdown.md_cell(F.col("text"))).alias("digest")
    )


@query("markdown_blocks")
def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("html")
    return A.table(spark, sf_dir, "pages").select(
        "page_id",
        F.md5(markdown.md_fence(body, "html")).alias("fence"),
        F.md5(markdown.md_prose(body)).alias("prose"),
        markdown.md_code(F.col("url")).alias("code"),
    )


@query(
    "bounded_detail",
    """SELECT o_orderkey, 2 AS keys, o_orderpriority AS priority FROM orders""",
)
def q_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.create_map(
        F.lit("priority"), F.col("o_orderpriority"), F.lit("api_key"), F.lit("x"),
        F.lit("Session-Token"), F.lit("y"), F.lit("status"), F.col("o_orderstatus"),
    )
    kept = A.table(spark, sf_dir, "orders").withColumn("d", bounded_detail(detail))
    return kept.select(
        "o_orderkey", F.size("d").alias("keys"), F.element_at("d", "priority").alias("priority")
    )
