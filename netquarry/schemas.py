"""Explicit schemas of the stored tables. Nothing is inferred."""

from __future__ import annotations

EVENTS = """
    id STRING, batch_id STRING, event_hash STRING, event_time TIMESTAMP, event_type STRING,
    flow_id BIGINT, src_ip STRING, dest_ip STRING, src_port INT, dest_port INT, proto STRING,
    app_proto STRING, bytes_toserver BIGINT, bytes_toclient BIGINT, pkts_toserver BIGINT,
    pkts_toclient BIGINT, dns_query STRING, dns_rrtype STRING, dns_rcode STRING,
    http_host STRING, http_url_path STRING, sig_signature STRING, sig_category STRING,
    sig_signature_id BIGINT, sig_severity INT
"""

REJECTS = "file STRING, line_number BIGINT, reason_code STRING, detail STRING, raw_excerpt STRING"

ASSETS = """
    asset_id STRING, hostname STRING, environment STRING, owner STRING, criticality INT,
    tags ARRAY<STRING>, description STRING, is_active BOOLEAN, created_at TIMESTAMP
"""

NETWORKS = """
    asset_id STRING, cidr STRING, is_primary BOOLEAN, is_active BOOLEAN, created_at TIMESTAMP,
    criticality INT
"""

BASELINES = """
    asset_id STRING, metric STRING, window_days INT, mean DOUBLE, stddev DOUBLE, p95 DOUBLE,
    sample_count BIGINT
"""

ADDRESS_BASELINES = """
    address STRING, metric STRING, window_days INT, mean DOUBLE, stddev DOUBLE, p95 DOUBLE,
    sample_count BIGINT
"""

ALERTS = """
    id STRING, dedup_key STRING, rule_id STRING, rule_version INT, severity INT,
    confidence DECIMAL(3,2), severity_rationale STRING, entity_type STRING, entity_value STRING,
    first_seen TIMESTAMP, last_seen TIMESTAMP, evidence STRING, event_count BIGINT, status STRING
"""

INCIDENTS = """
    incident_id STRING, case_number STRING, correlation_key STRING, title STRING, severity INT,
    status STRING, window_start TIMESTAMP, window_end TIMESTAMP, distinct_rule_count INT,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""

INCIDENT_ALERTS = "incident_id STRING, alert_id STRING"

TIMELINE = """
    incident_id STRING, occurred_at TIMESTAMP, entry_type STRING, summary STRING, alert_id STRING
"""

LABELLED = """
    case_id STRING, rule_id STRING, expected STRING, entity_type STRING, entity_value STRING,
    min_severity INT
"""

# fixed values: closed vocabularies
EVENT_TYPES = ("alert", "dns", "http", "flow", "tls", "fileinfo", "anomaly", "ssh")
SENSOR_TYPES = ("stats", "engine")
REJECT_REASONS = (
    "json_parse",
    "schema_invalid",
    "missing_required",
    "timestamp_out_of_range",
    "too_large",
    "too_deep",
    "unsupported_event_type",
)
CLOSED_STATUSES = ("closed_true_positive", "closed_false_positive", "closed_benign")
