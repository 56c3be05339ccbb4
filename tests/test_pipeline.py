"""The whole way: lines, events, baselines, sweep, cases; and the pieces of text handling."""

import hashlib
import json
from collections import Counter
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from netquarry.operators.baselines import recompute_baselines
from netquarry.operators.cases import file_cases
from netquarry.operators.documents import admit_documents
from netquarry.operators.evaluation import grouping_metrics
from netquarry.operators.publish import publish_audit, strip_content
from netquarry.operators.redact import pseudonymize
from netquarry.operators.retention import prune_days
from netquarry.operators.rules import RULES, Rule
from netquarry.operators.sweep import sweep
from netquarry.session import checkpoint_dir
from netquarry.sources.datasets import verify_datasets
from netquarry.sources.ingest import Provenance, append_events, ingest
from tests.cases import MIB, START, Case

HOST, OTHER = "10.10.0.42", "10.10.0.77"


def scenario():
    c = Case("S", "positive", "s")
    for h in range(1, 24 * 7):
        c.flow(-h * 3600 + 60, HOST, "203.0.113.8", 443, out=10 * MIB + (h % 5) * 1000)
    for i in range(40):
        c.flow(i * 3, HOST, "10.10.0.5", 1000 + i, answered=False)
    for i in range(12):
        c.auth(300 + i * 7, HOST, "10.10.0.5", 22, "SSH brute force", 7)
    for i in range(14):
        c.flow(600 + i * 60, HOST, "203.0.113.50", 8443)
    c.flow(2400, HOST, "203.0.113.60", 443, out=400 * MIB)
    for i in range(40):
        c.flow(1200 + i * 3, OTHER, "10.10.0.6", 1000 + i)
    for i in range(40):
        c.flow(6 * 3600 + i * 3, HOST, "10.10.0.7", 1000 + i)
    return c.lines


def test_scenario(spark, tmp_path):
    lines = scenario()
    raw = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines + lines[:9] + ["{bad"])],
                                "file string, line_number long, raw string")
    as_of = F.lit("2026-09-05 12:00:00").cast("timestamp")
    none = spark.createDataFrame([], "event_hash string")
    new, rejects, batch = ingest(raw, none, Provenance("b1", "lab"), as_of)
    row = batch.first()
    assert (row.status, row.received, row.stored, row.duplicate, row.rejected) == ("complete", len(lines) + 10, len(lines), 9, 1)
    append_events(new, str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    again, _, second = ingest(raw, events.select("event_hash"), Provenance("b2", "lab"), as_of)
    assert again.count() == 0
    row = second.first()
    assert (row.status, row.received, row.stored, row.duplicate) == ("complete", len(lines) + 10, 0, len(lines) + 9)

    nets = spark.createDataFrame(
        [("web", HOST + "/32", True, True, START, 5), ("site", "10.10.0.0/16", True, True, START, 3)],
        "asset_id string, cidr string, is_primary boolean, is_active boolean, created_at timestamp, criticality int")
    stats = recompute_baselines(events, nets, F.lit(START))
    assert {r.asset_id: r.sample_count for r in stats.collect()} == {"web": 167, "site": 167}

    end = START + timedelta(hours=7)
    broken = Rule("D-009", "Broken", 3, 600, lambda *a, **k: 1 / 0, RULES["D-001"].params)
    alerts, samples, links, runs = sweep(events, START, end, nets, stats, rules=[*RULES.values(), broken])
    got = {r.rule_id: (r.status, r.alerts_created) for r in runs.collect()}
    assert got == {"D-001": ("success", 3), "D-002": ("success", 1), "D-003": ("success", 0), "D-004": ("success", 1),
                   "D-005": ("success", 1), "D-009": ("error", 0)}
    assert links.filter("asset_id = 'web' AND role = 'source'").count() == 5
    assert samples.groupBy("alert_id").count().agg(F.max("count")).first()[0] <= 20
    repeat = sweep(events, START, end, nets, stats, existing=alerts)
    assert repeat[0].count() == 0

    none_cases = spark.createDataFrame([], "incident_id string, case_number string, correlation_key string, status string,"
                                       " window_start timestamp, window_end timestamp, created_at timestamp")
    filed = file_cases(alerts, none_cases, spark.createDataFrame([], "incident_id string, alert_id string"), F.lit(end))
    cases = sorted((r.severity, r.distinct_rule_count) for r in filed["incidents"].collect())
    assert len(cases) == 3 and cases[-1] == (5, 4)
    truth = alerts.select(
        "alert_id",
        F.when(F.col("entity_value") == OTHER, "b").when(F.col("first_seen") >= F.lit(START + timedelta(hours=5)), "c")
        .otherwise("a").alias("scenario_id"))
    score = grouping_metrics(filed["links"].select("alert_id", F.col("incident_id").alias("group_id")), truth, 3).first()
    assert (score.pair_tp, score.precision, score.recall, score.fragmentation, score.contamination) == (6, 1.0, 1.0, 1.0, 0.0)


def test_pseudonyms_do_not_touch_longer_names(spark):
    rows = [("c", 1, "10.0.0.10 then 10.0.0.1 and WWW.example.com", "10.0.0.1"), ("c", 2, "10.0.0.1;fe80::1 10.0.0.10", "10.0.0.1"),
            ("d", 1, "8.8.8.8", "x"), ("d", 2, "nothing here", "x")]
    df = spark.createDataFrame(rows, "case string, n int, text string, subject string")
    out, mapping = pseudonymize(df, "case", "text", ["n"], "subject")
    got = {(r.case, r.n): r.text for r in out.collect()}
    assert got == {("c", 1): "int-1 then asset-A and domain-1", ("c", 2): "asset-A;int-2 int-1", ("d", 1): "ext-1", ("d", 2): "nothing here"}
    assert mapping.count() == 5


def test_every_name_gets_a_token(spark):
    df = spark.createDataFrame([("c", 1, " ".join(f"203.0.{i // 250}.{i % 250}" for i in range(205)))], "case string, n int, text string")
    out, mapping = pseudonymize(df, "case", "text", ["n"])
    words = out.first().text.split(" ")
    assert words[:2] == ["ext-1", "ext-2"] and words[199:] == [f"ext-{n}" for n in range(200, 206)] and mapping.count() == 205


def test_lines_with_equal_names_are_stored_once(spark):
    rows = [(i % 2, i, f"10.0.0.{i % 2} to 8.8.8.8 and 10.0.0.{i % 2}, {i}") for i in range(400)]
    rows += [(0, 400, None), (0, 401, "no name"), (None, 402, "of 8.8.4.4"), (1, -1, "8.8.4.4"), (1, -1, "8.8.4.4")]
    folder = Path(checkpoint_dir(spark)) / "stored"
    before = set(folder.glob("*"))
    out, mapping = pseudonymize(spark.createDataFrame(rows, "case int, n int, text string"), "case", "text", ["n"])
    got = Counter((r.case, r.n, r.text) for r in out.collect())
    want = Counter((c, n, f"int-1 to ext-{c + 1} and int-1, {n}") for c, n, _ in rows[:400])
    assert got == want + Counter(rows[400:403]) + Counter({(1, -1, "ext-1"): 2})
    assert {tuple(r) for r in mapping.collect()} >= {(0, "int-1", "10.0.0.0"), (0, "ext-1", "8.8.8.8"), (1, "ext-1", "8.8.4.4"), (1, "ext-2", "8.8.8.8")}
    kept = [spark.read.parquet(str(f)) for f in set(folder.glob("*")) - before]
    lists = [f for f in kept if "_names" in f.columns]
    # each list of names of a case once, with the lists that are empty; nothing larger is stored
    assert len(lists) == 1 and lists[0].filter("size(_names) > 0").count() == 4
    assert max(f.count() for f in kept) <= 7


def test_publication(spark):
    deep = "1"
    for _ in range(26):
        deep = "[" + deep + "]"
    lines = ['{"event_type":"dns","dns":{"grouped":{"A":["10.0.0.1",["9.9.9.9"]]}}}', '{"event_type":"tls","tls":{"subject":"CN=mail.acme.org"}}',
             '{"event_type":"flow","Payload_x":{"src_ip":"9.9.9.9"}}', '{"src_ip":"10.0.0.1"}', "[]", '{"event_type":"flow","state":' + deep + "}",
             '{"event_type":"http","url":"/a?b=1&Session=2","hostname":"x.example.test"}', '{"event_type":"flow","reason":"http.server v1.2.3.4567"}']
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    got = {}
    for r in publish_audit(df, "line", "id").collect():
        got.setdefault(r.id, []).append((r.path, r.problem))
    assert got == {0: [("dns.grouped.A[1][0]", "address")], 1: [("tls", "unclassified_key")], 2: [("Payload_x", "content_key")],
                   3: [("", "no_event_type")], 4: [("", "not_an_object")], 5: [("state" + "[0]" * 24, "too_deep")],
                   6: [("url", "secret_parameter")]}
    leaves, _ = strip_content(df, "line", "id")
    kept = {(r.id, r.path) for r in leaves.collect()}
    assert (2, "event_type") in kept and not any(i == 2 and "Payload" in p for i, p in kept) and (1, "tls.subject") not in kept


def test_documents(spark):
    good = {"summary": "s", "claims": [{"text": "t", "kind": "external", "citations": [1]}], "recommendations": [{"action": "monitor"}],
            "citations": [{"id": 1, "url": "https://a.test/x", "title": "T"}], "limitations": "none"}
    def but(**kw):
        return json.dumps({**good, **kw})
    rows = [
        (but(), None), (but(claims=[{"text": "t", "kind": "external"}]), "unverified"),
        (but(claims=[{"text": "t", "kind": "observed", "citations": [3]}]), "dangling_citation"),
        (but(citations=[{"id": 1, "url": "http://a.test/x", "title": "T"}]), "schema"),
        (but(citations=[{"id": 1, "url": "https://u@a.test/x", "title": "T"}]), "schema"),
        (but(summary="We should immediately block it"), "safety:automated_blocking"), (but(extra=1), "schema"),
        (but(recommendations=[{"action": "block"}]), "schema"), ("{nope", "not_json"), ("[]", "schema"), (but(summary=""), "schema"),
        (but(summary="x" * 1201), "schema"), (but(claims=[{"text": " \u0001 ", "kind": "observed"}]), "schema"),
        (but(limitations="scan the host"), "safety:active_scanning"), (json.dumps({"summary": "only"}), None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, body string")
    admitted, refused = admit_documents(df, "body")
    got = {r.i: ("unverified" if r.has_unverified else None) for r in admitted.collect()} | {r.i: r.reason for r in refused.collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_pruning_in_place(spark, tmp_path):
    path = str(tmp_path / "events")
    days = spark.range(200).selectExpr("id", "timestamp_seconds(1767225600 + id * 3600 * 3) AS event_time")  # 2026-01-01, 8 a day
    append_events(days.unionByName(spark.createDataFrame([(999, None)], "id long, event_time timestamp")), path)

    def files():
        return {str(f.relative_to(path)): f.read_bytes() for f in (tmp_path / "events").rglob("*.parquet")}

    first = files()
    before = F.lit("2026-01-10 12:00:00").cast("timestamp")
    cited = spark.createDataFrame([(3,), (17,), (17,), (190,), (12345,), *((i,) for i in range(32, 40))], "id long")
    manifest = {str(r.event_date)[8:]: (r.action, r.removed, r.remaining, r.stays) for r in
                prune_days(spark, path, "event_time", before, cited).collect()}
    gone = {f"{d:02d}": ("dropped", 8, 0, 0) for d in (2, 4, 6, 7, 8, 9)}
    assert manifest == gone | {"01": ("rewritten", 7, 1, 1), "03": ("rewritten", 7, 1, 1), "05": ("kept", 0, 8, 8),
                               "10": ("rewritten", 4, 0, 4)}
    left = sorted(r.id for r in spark.read.parquet(path).collect())
    assert left == [3, 17, *range(32, 40), *range(76, 200), 999]
    now = files()
    young = {f for f in first if f[11:21] > "2026-01-10" or "2026-01-05" in f or "HIVE" in f}
    assert len(young) > 15 and all(now[f] == first[f] for f in young)
    assert not any(f"2026-01-{d}" in f for f in now for d in gone)
    # again, with the days of the evidence at hand: nothing is left to do
    dated = days.join(cited, "id").selectExpr("id", "to_date(event_time) AS event_date")
    again = prune_days(spark, path, "event_time", before, dated).collect()
    assert {r.action for r in again} == {"kept"} and files() == now
    assert prune_days(spark, path, "event_time", F.lit("2020-01-01").cast("timestamp")).count() == 0
    swept = prune_days(spark, path, "event_time", F.lit("2027-01-01").cast("timestamp"))
    assert {r.action for r in swept.collect()} == {"dropped"}
    assert [r.id for r in spark.read.parquet(path).collect()] == [999]


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"changed")
    digest = hashlib.sha256(b"abc").hexdigest()
    registry = spark.createDataFrame([("a", "a.bin", digest), ("b", "b.bin", digest), ("c", "gone.bin", digest)],
                                     "id string, path string, sha256 string")
    got = {r.id: (r.ok, r.sha256 is not None) for r in verify_datasets(spark, registry, str(tmp_path)).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, False)}


def test_sweep_alerts_know_the_beacon_feed(spark):
    from netquarry.plans.case_queries import q_sweep

    alerts = q_sweep(spark, "/root/testdata/sf0.01").select("rule_id").distinct().collect()
    assert "D-004" in {r.rule_id for r in alerts}
