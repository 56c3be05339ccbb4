import json

from pyspark.sql import functions as F

from netquarry.sources.lines import read_lines
from netquarry.sources.normalize import Limits, normalize

AS_OF = "2026-09-05 12:00:00"
T = "2026-09-01T10:00:00.000000+0000"


def run(spark, lines, **kw):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_number long, raw string")
    events, rejects = normalize(df, F.lit(AS_OF).cast("timestamp"), **kw)
    out = {r.line_number: ("event", r) for r in events.collect()}
    out.update({r.line_number: (r.reason_code, r) for r in rejects.collect()})
    assert len(out) == len(lines)
    return [out[i] for i in range(len(lines))]


def rec(**kw):
    return json.dumps({"timestamp": T, "event_type": "flow", **kw})


HOSTILE = [
    (rec(http={"url": "/a\u0001b\tc"}), "event"),
    (json.dumps({"event_type": "flow"}), "missing_required"),
    (json.dumps({"timestamp": T}), "missing_required"),
    (json.dumps({"src_port": "x"}), "missing_required"),
    (rec(timestamp="2026-09-01T10:00:00"), "schema_invalid"),
    (rec(timestamp=None), "schema_invalid"),
    (rec(event_type="stats"), "unsupported_event_type"),
    (rec(event_type=""), "schema_invalid"),
    (rec(event_type="x" * 65), "schema_invalid"),
    (rec(src_ip="not-an-address"), "schema_invalid"),
    (rec(src_port=70000), "schema_invalid"),
    (rec(src_port=-1), "schema_invalid"),
    (rec(src_port=80.5), "schema_invalid"),
    (rec(src_port=80.0), "event"),
    (rec(src_port="443"), "event"),
    (rec(proto=6), "schema_invalid"),
    (rec(alert="x"), "schema_invalid"),
    (rec(alert={"signature_id": -4}), "schema_invalid"),
    (rec(dns={"queries": [{"rrname": 5}]}), "schema_invalid"),
    (rec(dns={"answers": ["x"]}), "schema_invalid"),
    ("[1,2]", "schema_invalid"),
    ("3", "schema_invalid"),
    ('{"timestamp": "x"', "json_parse"),
    (rec() + " tail", "json_parse"),
    (rec() + " {}", "json_parse"),
    ('{"a":1,"a":2}', "json_parse"),
    (rec(timestamp="1999-01-01T00:00:00Z"), "timestamp_out_of_range"),
    (rec(timestamp="2036-01-01T00:00:00Z"), "timestamp_out_of_range"),
    (rec(timestamp="2026-09-06T12:00:00Z"), "event"),
    (rec(timestamp="2026-09-06T12:00:00.000001Z"), "timestamp_out_of_range"),
    (rec(flow={"start": "1999-01-01T00:00:00Z"}), "timestamp_out_of_range"),
    (rec(flow={"start": "garbage"}), "event"),
    ("{" * 13 + "}" * 13, "too_deep"),
    ('{"a":' * 11 + "[]" + "}" * 11, "missing_required"),
    (rec(**{f"k{i}": 1 for i in range(199)}), "too_large"),
    (rec(**{f"k{i}": 1 for i in range(198)}), "event"),
    (rec(a=[1] * 1001), "too_large"),
    (rec(a="x" * 65537), "too_large"),
    (rec(event_type="quic"), "event"),
    (rec(unknown={"kept": True}), "event"),
]


def test_reasons(spark):
    got = run(spark, [line for line, _ in HOSTILE])
    assert [(line[:60], kind) for (line, _), (kind, _) in zip(HOSTILE, got)] == [
        (line[:60], want) for line, want in HOSTILE]
    by = {line: row for (line, _), (_, row) in zip(HOSTILE, got)}
    assert by[HOSTILE[0][0]].http_url_path == "/ab\tc"
    assert by[HOSTILE[14][0]].src_port == 443
    assert by[rec(event_type="quic")].event_type == "other"
    assert by[HOSTILE[3][0]].detail == "absent: event_type, timestamp"
    assert "src_ip" in by[rec(src_ip="not-an-address")].detail
    assert "not-an-address" not in by[rec(src_ip="not-an-address")].detail


def test_fields(spark):
    lines = [
        rec(flow_id=7, src_ip="2001:DB8:0:0::1", dest_ip="10.0.0.9", src_port=1, dest_port=2, proto="TCP",
            flow={"start": "2026-09-01T09:59:00.5+0000", "bytes_toserver": 10, "pkts_toclient": 0}),
        rec(event_type="dns", dns={"type": "query", "rrname": "A.test", "rrtype": "TXT", "rcode": "NOERROR"}),
        rec(event_type="dns", dns={"type": "response", "queries": [{"rrname": "q.test", "rrtype": "A"}], "rcode": "NXDOMAIN"}),
        rec(event_type="dns", dns={"rrname": "q.test", "rcode": "SERVFAIL"}),
        rec(event_type="alert", alert={"signature": "S" * 600, "category": "c", "signature_id": 9, "severity": 2},
            flow={"start": "2026-09-01T09:00:00Z"}),
    ]
    flow, ask, reply, bare, alert = [r for _, r in run(spark, lines)]
    assert (flow.src_ip, flow.dest_ip, flow.flow_id, flow.dest_port) == ("2001:db8::1", "10.0.0.9", 7, 2)
    assert str(flow.event_time) == "2026-09-01 09:59:00.500000"
    assert (flow.bytes_toserver, flow.pkts_toclient, flow.pkts_toserver) == (10, 0, None)
    assert (ask.dns_query, ask.dns_rrtype, ask.dns_rcode) == ("A.test", "TXT", None)
    assert (reply.dns_query, reply.dns_rrtype, reply.dns_rcode) == ("q.test", "A", "NXDOMAIN")
    assert bare.dns_rcode == "SERVFAIL"
    # whole text, and cut only where a length is asked for
    assert alert.sig_signature == "S" * 600 and str(alert.event_time) == "2026-09-01 10:00:00"
    (_, short), = run(spark, lines[-1:], limits=Limits(max_string=512))
    assert short.sig_signature == "S" * 512


def test_hash_ignores_spelling(spark):
    same = [
        '{"timestamp":"2026-09-01T10:00:00+0000","event_type":"flow","src_ip":"2001:db8::1","flow":{"age":1,"state":"x"}}',
        '{"event_type":"flow", "flow":{"state":"x","age":1}, "timestamp":"2026-09-01T12:00:00.000+02:00", "src_ip":"2001:DB8:0::1"}',
        '{"event_type":"flow", "flow":{"state":"x","age":1}, "timestamp":"2026-09-01T10:00:00Z", "src_ip":"2001:db8::1", "note":"unhashed"}',
    ]
    other = same[0].replace('"age":1', '"age":2')
    hashes = [r.event_hash for _, r in run(spark, [*same, other])]
    assert len(set(hashes[:3])) == 1 and hashes[3] != hashes[0]
    ids = [r.id for _, r in run(spark, same[:1])]
    assert len(ids[0]) == 36 and ids[0].replace("-", "") == hashes[0][:32]


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = []
    for i in range(3000):
        lines.append("" if i % 7 == 3 else f"line-{i + 1}" + "x" * (i % 50))
    path = tmp_path / "in.ndjson"
    path.write_bytes(("\r\n".join(lines)).encode() + b"\n\xff\xfe tail\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = read_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.line_number: r.raw for r in rows}
    want = {i + 1: x for i, x in enumerate(lines) if x}
    tail = got.pop(3001)
    assert got == want and tail.endswith(" tail") and "�" in tail
