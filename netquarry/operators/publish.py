"""Whether a corpus may be published, and the form of it that may."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.binding import let
from netquarry.functions.ip import hex_in, ip_hex
from netquarry.schemas import SENSOR_TYPES
from netquarry.session import materialize

# fixed value: the deepest level that may be published
MAX_DEPTH = 24

# fixed values: keys that can carry captured content or identity, and prefixes of such keys
CONTENT_KEYS = frozenset(
    {
        "payload", "payload_printable", "packet", "packet_info", "http_request_body",
        "http_request_body_printable", "http_response_body", "http_response_body_printable",
        "request_body", "response_body", "request_headers", "response_headers", "file_data",
        "content", "certificate", "chain", "subject", "issuerdn", "serial", "fingerprint", "ja3",
        "ja3s", "ja4", "ja3_string", "ja3s_string", "email", "smtp", "smb", "krb5", "snmp", "ftp",
        "ftp_data", "ssh", "ike", "rdp", "mqtt", "sip", "filename", "magic", "md5", "sha1",
        "sha256", "host", "hostname_original", "capture_file", "pcap_filename", "user", "username",
        "password", "credentials", "command_data", "software_version", "banner", "cookie",
        "set_cookie", "authorization", "proxy_authorization", "referer", "http_refer", "redirect",
        "vars", "metadata",
    }
)
CONTENT_PREFIXES = ("payload", "packet", "body", "raw_", "pass", "secret", "token", "key_")

# fixed values: keys reviewed and allowed
PUBLISHED_KEYS = frozenset(
    {
        "timestamp", "event_type", "flow_id", "in_iface", "ip_v", "pkt_src", "direction", "src_ip",
        "src_port", "dest_ip", "dest_port", "proto", "app_proto", "tx_id", "pcap_cnt",
        "community_id", "tenant_id", "alert", "action", "gid", "signature_id", "rev", "signature",
        "category", "severity", "flow", "pkts_toserver", "pkts_toclient", "bytes_toserver",
        "bytes_toclient", "start", "end", "age", "state", "reason", "alerted", "tx_cnt", "min_ttl",
        "max_ttl", "tcp", "tcp_flags", "tcp_flags_ts", "tcp_flags_tc", "syn", "fin", "rst", "psh",
        "ack", "urg", "ecn", "cwr", "ttl", "ts_progress", "tc_progress", "ts_max_regions",
        "tc_max_regions", "ts_gap", "tc_gap", "http", "http_port", "http_method", "http_user_agent",
        "http_content_type", "protocol", "status", "length", "url", "hostname",
        "http_response_status", "dns", "type", "id", "version", "flags", "qr", "rd", "ra", "opcode",
        "rcode", "queries", "answers", "grouped", "rrname", "rrtype", "rdata", "ttl_dns", "aa",
        "tc", "A", "AAAA", "CNAME", "MX", "NS", "PTR", "SOA", "SRV", "TXT", "anomaly", "event",
        "layer", "code",
    }
)

# fixed values: address space and names that may appear in published data
PUBLIC_NETWORKS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "192.0.2.0/24",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "0.0.0.0/32",
    "::1/128",
    "::/128",
    "fe80::/10",
    "fc00::/7",
)
PUBLIC_DOMAINS = ("example.test", "example.com")
CHECKED_TLDS = (
    "com", "net", "org", "test", "example", "io", "dev", "local", "gov", "edu", "mil", "info",
    "biz", "co", "uk", "de", "fr", "nl", "eu", "ru", "cn", "jp", "us", "ca", "au", "ch", "se",
    "no", "es", "it", "pl", "br", "in", "xyz", "online", "site", "top", "cloud", "app", "ai",
    "me", "tv", "cc", "ly", "sh", "id",
)
# fixed values: what counts as an address, a name or a secret parameter in a value
ADDRESS_TOKEN = r"(?i)[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
HOST_TOKEN = r"(?i)(?:[a-z0-9_-]{1,63}\.)+[a-z]{2,24}"
SECRET_PARAMETER = (
    r"(?i)[?&;]\s*(?:pass|passwd|password|pwd|token|api[_-]?key|apikey|secret|auth|authorization"
    r"|session|sid|sig|signature|access[_-]?key|client[_-]?secret|code)\s*="
)

NODES = (
    "path string, key string, keys array<string>, depth int, type string, value string"
)


def _walk(text: str) -> Iterator[tuple]:
    """Every node of one JSON text from the root on, parents first, at any depth. A node just
    beyond the limit is reported as ``too_deep`` besides."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError, TypeError):
        yield ("", None, [], 0, "invalid", None)
        return
    stack = [("", None, (), 0, root)]
    while stack:
        path, key, keys, depth, node = stack.pop()
        if depth == MAX_DEPTH + 1:
            yield (path, key, list(keys), depth, "too_deep", None)
        if isinstance(node, dict):
            yield (path, key, list(keys), depth, "object", None)
            members = [
                (f"{path}.{k}" if path else k, k, (*keys, k), depth + 1, v) for k, v in node.items()
            ]
            stack.extend(reversed(members))
        elif isinstance(node, list):
            yield (path, key, list(keys), depth, "array", None)
            items = [(f"{path}[{i}]", None, keys, depth + 1, v) for i, v in enumerate(node)]
            stack.extend(reversed(items))
        elif isinstance(node, bool):
            yield (path, key, list(keys), depth, "boolean", "true" if node else "false")
        elif node is None:
            yield (path, key, list(keys), depth, "null", None)
        elif isinstance(node, str):
            yield (path, key, list(keys), depth, "string", node)
        else:
            yield (path, key, list(keys), depth, "number", json.dumps(node))


def flatten_json(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """``(id, path, key, keys, depth, type, value)``, one row per node at any depth. This is the
    one place where a record is walked in Python; what follows is relational."""
    kind = dict(df.dtypes)[id_col]
    names = [c.split()[0] for c in NODES.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (ident, *node)
                for ident, text in zip(pdf[id_col], pdf[json_col])
                for node in _walk(text)
            ]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    return df.select(id_col, json_col).mapInPandas(walk, f"{id_col} {kind}, {NODES}")


def is_content_key(key: Column) -> Column:
    low = F.lower(key)
    out = low.isin(*sorted(CONTENT_KEYS))
    for prefix in CONTENT_PREFIXES:
        out = out | low.startswith(prefix)
    return out


def is_published_key(key: Column) -> Column:
    names = sorted(PUBLISHED_KEYS)
    return key.isin(*names) | F.lower(key).isin(*names)


def has_foreign_address(text: Column) -> Column:
    def foreign(h: Column) -> Column:
        known = F.lit(False)
        for cidr in PUBLIC_NETWORKS:
            known = known | hex_in(h, cidr)
        return h.isNotNull() & ~known

    tokens = F.regexp_extract_all(text, F.lit(ADDRESS_TOKEN), F.lit(0))
    return F.exists(
        tokens, lambda t: F.coalesce(let(ip_hex(F.lower(t)), foreign), F.lit(False))
    )


def has_foreign_name(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(HOST_TOKEN), F.lit(0))
    allowed = "|".join(d.replace(".", r"\.") for d in PUBLIC_DOMAINS)
    return F.exists(
        tokens,
        lambda t: F.substring_index(F.lower(t), ".", -1).isin(*CHECKED_TLDS)
        & ~F.lower(t).rlike(rf"(?:^|\.)(?:{allowed})$"),
    )


def publish_audit(
    lines: DataFrame, json_col: str, id_col: str, strict_keys: bool = True
) -> DataFrame:
    """``(id, path, problem)``: every reason a record may not be published, judged as it is.
    Below a key that is refused nothing more is reported."""
    return problems_of(materialize(flatten_json(lines, json_col, id_col)), id_col, strict_keys)


def problems_of(nodes: DataFrame, id_col: str, strict_keys: bool = True) -> DataFrame:
    """:func:`publish_audit` on nodes already walked (and stored: they are read more than once)."""
    content, known = is_content_key(F.col("key")), is_published_key(F.col("key"))

    def refused(k: Column) -> Column:
        return is_content_key(k) | ~is_published_key(k)

    if strict_keys:
        owner = F.when(
            F.col("key").isNotNull(), F.slice("keys", F.lit(1), F.size("keys") - 1)
        ).otherwise(F.col("keys"))
        above = F.exists(owner, refused)
        key_problem = F.when(
            F.col("key").isNotNull(),
            F.when(content, F.lit("content_key")).when(~known, F.lit("unclassified_key")),
        )
    else:
        above, key_problem = F.lit(False), F.lit(None).cast("string")
    text = F.col("type") == "string"
    value = F.col("value")
    top_kind = (F.col("path") == "event_type") & text
    root = F.col("depth") == 0
    found = F.array_compact(
        F.array(
            F.when(F.col("type") == "invalid", F.lit("not_json")),
            F.when(root & ~F.col("type").isin("object", "invalid"), F.lit("not_an_object")),
            F.when(F.col("type") == "too_deep", F.lit("too_deep")),
            F.when(
                top_kind & F.lower(F.trim(value)).isin(*SENSOR_TYPES), F.lit("sensor_record")
            ),
            key_problem,
            F.when(text & key_problem.isNull() & has_foreign_address(value), F.lit("address")),
            F.when(text & key_problem.isNull() & has_foreign_name(value), F.lit("name")),
            F.when(text & key_problem.isNull() & value.rlike(SECRET_PARAMETER), F.lit("secret_parameter")),
        )
    )
    problems = nodes.filter(~above).select(
        id_col, "path", F.explode(found).alias("problem")
    )
    kinds = nodes.filter((F.col("path") == "event_type") & (F.trim("value") != "")).select(id_col)
    untyped = (
        nodes.filter(root & (F.col("type") == "object"))
        .select(id_col)
        .join(kinds, id_col, "left_anti")
        .select(id_col, F.lit("").alias("path"), F.lit("no_event_type").alias("problem"))
    )
    return problems.unionByName(untyped)


def refusals_of(nodes: DataFrame, id_col: str) -> DataFrame:
    """``(id, reason)``, one row per record that cannot be published in any form: the first of
    not readable, not an object, too deep, no type, a sensor's own record."""
    root, kind = F.col("depth") == 0, F.col("type")
    named = (F.col("path") == "event_type") & (F.size("keys") == 1) & (kind == "string")
    told = nodes.groupBy(id_col).agg(
        F.bool_or(kind == "invalid").alias("invalid"),
        F.bool_or(root & (kind != "object")).alias("other"),
        F.bool_or(kind == "too_deep").alias("deep"),
        F.bool_or(named & (F.trim("value") != "")).alias("typed"),
        F.bool_or(named & F.lower(F.trim("value")).isin(*SENSOR_TYPES)).alias("sensor"),
    )
    reason = (
        F.when(F.col("invalid"), "unreadable")
        .when(F.col("other"), "not_an_object")
        .when(F.col("deep"), "too_deep")
        .when(~F.coalesce("typed", F.lit(False)), "no_event_type")
        .when(F.col("sensor"), "sensor_record")
    )
    return told.select(id_col, reason.alias("reason")).filter(F.col("reason").isNotNull())


def strip_content(
    lines: DataFrame, json_col: str, id_col: str, max_string: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(leaves, dropped)``: records as leaf rows without content-bearing keys at any depth, and
    counts of the records left out by reason. A record that is left out gives no leaf at all.
    Strings are cut only where ``max_string`` asks for it."""
    nodes = materialize(flatten_json(lines, json_col, id_col))
    refused = materialize(refusals_of(nodes, id_col))
    value = F.col("value")
    if max_string is not None:
        value = F.when(F.col("type") == "string", F.substring("value", 1, max_string)).otherwise(
            value
        )
    leaves = (
        nodes.filter(~F.col("type").isin("object", "array", "invalid", "too_deep"))
        .filter(~F.exists("keys", is_content_key))
        .join(refused, id_col, "left_anti")
        .select(id_col, "path", "type", value.alias("value"))
    )
    return leaves, refused.groupBy("reason").agg(F.count("*").alias("n"))


def sanitize(
    lines: DataFrame, json_col: str, id_col: str, strict_keys: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(leaves, dropped, problems)``: :func:`strip_content`, and what :func:`publish_audit` still
    finds in the leaves that are left. A corpus may go out when ``problems`` has no row."""
    leaves, dropped = strip_content(lines, json_col, id_col)
    text, key = F.col("type") == "string", F.element_at(F.split(F.col("path"), r"\.|\["), -1)
    bare = F.when(~key.endswith("]"), key)
    found = F.array_compact(
        F.array(
            F.when(F.lit(strict_keys) & ~is_published_key(bare), F.lit("unclassified_key")),
            F.when(text & has_foreign_address(F.col("value")), F.lit("address")),
            F.when(text & has_foreign_name(F.col("value")), F.lit("name")),
            F.when(text & F.col("value").rlike(SECRET_PARAMETER), F.lit("secret_parameter")),
        )
    )
    return leaves, dropped, leaves.select(id_col, "path", F.explode(found).alias("problem"))
