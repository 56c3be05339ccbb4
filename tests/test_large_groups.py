"""Numbering, interval labels and the shared scan against plain Python and the rules alone."""

import random
from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from netquarry.operators import evaluation, rules as rules_module
from netquarry.operators.evaluation import label_by_interval
from netquarry.operators.pieces import densest_span, interval_stats, numbered, sample_contributors
from netquarry.operators.rules import RULES, AuthBurstParams, DnsParams, PortScanParams, run_rules
from netquarry.plans import adapters, detect_queries

START = datetime(2026, 9, 1, 10)


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, 1, 2]), i, rng.randrange(50)) for i in range(900)]
    got = numbered(
        spark.createDataFrame(rows, "g string, h int, id int, o int").repartition(7), ["g", "h"], ["o", "id"], "place"
    ).collect()
    groups = defaultdict(list)
    for g, h, i, o in rows:
        groups[g, h].append((o, i))
    want = {i: n + 1 for group in groups.values() for n, (_, i) in enumerate(sorted(group))}
    assert {r.id: r.place for r in got} == want and len(got) == len(rows)
    assert numbered(spark.createDataFrame([], "g string, o int"), ["g"], ["o"], "place").count() == 0


def test_labels_of_overlapping_windows(spark):
    rng = random.Random(2)
    at = lambda s: START + timedelta(seconds=s)
    alerts = [(i, rng.choice(["hot", "hot", "x", None]), "D-001", at(rng.randrange(100_000))) for i in range(400)]
    alerts += [(400, "hot", "D-001", None), (401, "edge", "D-002", at(50)), (402, "edge", "D-002", at(60))]
    windows = []
    for p in range(120):
        low = rng.randrange(100_000)
        length = rng.choice([0, 1, 60, 3600, 40_000, 10_000_000])
        windows.append((p, f"s{p}", rng.choice(["hot", "x", "y"]), at(low), at(low + length), ["D-001"]))
    windows += [(120, "open", "hot", at(0), None, ["D-009"]), (121, "one", "edge", at(50), at(60), ["D-002"])]
    windows.append((122, "back", "hot", at(9), at(3), []))
    a = spark.createDataFrame(alerts, "alert_id int, entity_key string, rule_id string, first_seen timestamp")
    w = spark.createDataFrame(
        windows,
        "position int, scenario_id string, entity string, window_from timestamp, window_to timestamp, expected_rules array<string>",
    )
    labelled, unclaimed, absent = label_by_interval(a, w)
    want = {}
    for i, entity, _, seen in alerts:
        own = [s for p, s, e, lo, hi, _ in windows if e == entity and seen and hi and lo <= seen < hi]
        if own:
            want[i] = own[0]
    assert {r.alert_id: r.scenario_id for r in labelled.collect()} == want
    assert {r.alert_id for r in unclaimed.collect()} == {x[0] for x in alerts} - set(want)
    got = {(r.scenario_id, r.rule_id) for r in absent.collect()}
    assert ("open", "D-009") in got and ("one", "D-002") not in got
    none = label_by_interval(a, w.limit(0))
    assert none[0].count() == 0 and none[1].count() == len(alerts)


def test_weights_stand_for_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), rng.randrange(400) * 1_000_000) for _ in range(300)]
    each = spark.createDataFrame(rows, "k string, us long")
    packed = each.groupBy("k", "us").agg(F.count("*").alias("n"))
    for make in (lambda d, w: densest_span(d, ["k"], "us", 30, weight=w), lambda d, w: interval_stats(d, ["k"], "us", 40, weight=w)):
        assert sorted(make(each, None).collect()) == sorted(make(packed, "n").collect())


def test_shared_scan_equals_rules_alone(spark, sf):
    events = adapters.every_feed(spark, sf).cache()
    rules = [
        replace(RULES["D-001"], params=PortScanParams(distinct_ports=8, distinct_hosts=8)),
        replace(RULES["D-002"], params=AuthBurstParams(failures=3, burst=2)),
        replace(RULES["D-003"], params=DnsParams(unique_subdomains=5, nxdomain_failures=5)),
        RULES["D-004"],
    ]
    together, total = run_rules(events, rules, every=True)
    assert total == events.count()
    for rule in rules:
        alone = rule.run(events)
        text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())
        got = text(together[rule.rule_id])
        assert got == text(alone), rule.rule_id
    assert together["D-001"].count() > 0 and together["D-002"].count() > 0 and together["D-003"].count() > 0
    events.unpersist()


def test_samples_with_a_peak_shuffle_their_rows_once(spark, capsys):
    """The peak, earliest of equals, is a sample of its own, and finding it moves no row again."""
    rows = spark.createDataFrame(
        [("a", i * 40_000_000, f"{i:03}", 9 if i in (30, 70) else 1) for i in range(100)]
        + [("b", 0, "x", None), ("b", None, "y", 5), (None, 0, "z", 1)],
        "who string, us long, id string, w long",
    )
    out = sample_contributors(rows, ["who"], "us", "id", 300, 5, "w")
    got = {r.who: [(s.event_id, s.role) for s in r.samples] for r in out.collect()}
    assert got["a"] == [("000", "first"), ("099", "last"), ("030", "peak"), ("001", "sample"), ("050", "sample")]
    assert set(got) == {"a", "b"} and [x for x, _ in got["b"]] == ["x"]
    out.explain("simple")
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(who" in x and "_piece" in x]
    assert len([x for x in moved if "ReusedExchange" not in x]) == 1


def _connections(spark):
    """A beacon among places that see one connection each, and a client with long names."""
    rows = [(f"b{i:02}", START + timedelta(seconds=60 * i), "flow", "10.0.0.1", "9.9.9.9", 443, "tls", None) for i in range(30)]
    rows += [(f"o{i:02}", START + timedelta(seconds=7 * i), "flow", "10.0.0.1", f"8.8.8.{i}", 80, None, None) for i in range(40)]
    rows += [
        (f"d{i:02}", START + timedelta(seconds=i), "dns", "10.0.0.2", "10.0.0.3", 53, None, f"{i:044d}.evil.test")
        for i in range(60)
    ]
    layout = (
        "id string, event_time timestamp, event_type string, src_ip string, dest_ip string, dest_port int,"
        " app_proto string, dns_query string"
    )
    missing = {
        "pkts_toclient": "bigint", "bytes_toserver": "bigint", "dns_rcode": "string",
        "sig_signature": "string", "sig_category": "string", "sig_signature_id": "bigint",
    }
    return spark.createDataFrame(rows, layout).select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()])


def test_contributors_carry_only_what_is_read(spark, monkeypatch):
    """Rules that ask for no contributors send none, and only the fields that are looked at travel."""
    kept, timed = {}, []
    write, measure = rules_module.stored, rules_module.interval_stats

    def storing(df, name, by=()):
        kept[name] = write(df, name, by)
        return kept[name]

    def timing(df, *args, **more):
        timed.append(df.select("k1").distinct().collect())
        return measure(df, *args, **more)

    monkeypatch.setattr(rules_module, "stored", storing)
    monkeypatch.setattr(rules_module, "interval_stats", timing)
    events = _connections(spark)
    able = [RULES[r] for r in ("D-001", "D-003", "D-004")]
    found, total = run_rules(events, able, detail=False, every=True)
    assert total == 130
    [beacon] = found["D-004"].collect()
    assert (beacon.entity_value, beacon.event_count, beacon.evidence.app_proto) == ("10.0.0.1", 30, "tls")
    [names] = found["D-003"].collect()
    assert (names.entity_value, names.evidence.top_domain) == ("10.0.0.2", "evil.test")
    assert found["D-001"].count() == 1
    assert set(kept["contributors"].columns) == {"rule_id", "_b", "_entity", "_part", "_us", "id", "k1", "_note"}
    assert kept["contributors"].groupBy("rule_id").count().orderBy("rule_id").collect() == [("D-003", 60), ("D-004", 30)]
    assert kept["contributors"].filter("rule_id = 'D-004' AND k1 IS NOT NULL").count() == 0
    # places with one connection have no intervals to measure
    assert timed == [[("9.9.9.9:443",)]]
    noise = {r.rule_id: (r.events, r.alerts) for r in evaluation.benign_noise(events, able).collect()}
    assert noise == {"D-001": (130, 1), "D-003": (130, 1), "D-004": (130, 1)}


def test_metrics_run_the_rule_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1,), (3,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(i * 7200, 1, i * 7, 3, 10.0 + i, datetime(2026, 1, 1), "N", 5.0) for i in range(200)]
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double,"
        " l_shipdate timestamp, l_returnflag string, l_quantity double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    calls, detect = [], detect_queries.detect_port_scan

    def counting(*args, **more):
        # the tiny table has 8 ports and 6 hosts
        calls.append(args[1])
        return detect(args[0], PortScanParams(distinct_ports=6, distinct_hosts=6), **more)

    monkeypatch.setattr(detect_queries, "detect_port_scan", counting)
    [got] = detect_queries.q_metrics(spark, str(tmp_path)).collect()
    assert (got.rule_id, got.tp, got.fp, got.fn, got.tn, got.alerts_per_10k) == ("D-001", 1, 0, 0, 1, 50.0)
    assert calls == [PortScanParams(distinct_ports=25, distinct_hosts=20)]


def test_contributors_are_ranked_where_they_meet(spark, monkeypatch, capsys):
    """Of rules that look at nothing only samples are stored, the same as those of rows ranked by group; an
    event is dealt out once for all rules that it serves, and tags are compiled."""
    rng = random.Random(5)
    rows = [
        (f"f{i:03}", START + timedelta(seconds=rng.randrange(3600)), "flow", f"10.0.0.{i % 2}", f"9.9.{i % 7}.{i % 23}", 1000 + i % 31, i % 50)
        for i in range(600)
    ]
    rows += rows[:40] + [("none", None, "flow", "10.0.0.1", "9.9.9.9", 5, 7), ("who", START, "flow", None, "9.9.9.9", 5, 7)]
    layout = "id string, event_time timestamp, event_type string, src_ip string, dest_ip string, dest_port int, bytes_toserver long"
    missing = {
        "pkts_toclient": "bigint", "app_proto": "string", "dns_rcode": "string", "dns_query": "string",
        "sig_signature": "string", "sig_category": "string", "sig_signature_id": "bigint",
    }
    events = spark.createDataFrame(rows, layout).select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()])
    kept, write = {}, rules_module.stored

    def storing(df, name, by=()):
        kept[name] = df, write(df, name, by)
        return kept[name][1]

    monkeypatch.setattr(rules_module, "stored", storing)
    history = spark.createDataFrame(
        [(f"10.0.0.{i}", "outbound_bytes_per_hour", 7, 1.0, 1.0, 1.0, 100) for i in range(2)],
        "address string, metric string, window_days int, mean double, stddev double, p95 double, sample_count long",
    )
    volume = replace(RULES["D-005"], params=rules_module.VolumeParams(min_bytes=100))
    found, _ = run_rules(events, [RULES["D-001"], volume], history)
    for rule, seconds in (("D-001", 600), ("D-005", 3600)):
        served = events.filter("src_ip IS NOT NULL AND event_time IS NOT NULL" + (" AND bytes_toserver > 0" if rule == "D-005" else ""))
        at = F.unix_micros("event_time")
        grouped = served.select(
            F.col("src_ip").alias("who"), (F.floor(at / 1_000_000) - F.floor(at / 1_000_000) % seconds).alias("b"),
            at.alias("us"), "id", F.col("bytes_toserver" if rule == "D-005" else "dest_port").alias("w"),
        )
        peak = "w" if rule == "D-005" else None
        want = {(r.who, r.b): r.samples for r in sample_contributors(grouped, ["who", "b"], "us", "id", 60, 20, peak).collect()}
        fired = found[rule].select("entity_value", F.unix_seconds("window_bucket").alias("b"), "samples").collect()
        assert {(r.entity_value, r.b): r.samples for r in fired} == {(r.entity_value, r.b): want[r.entity_value, r.b] for r in fired}
        assert len(fired) == {"D-001": 12, "D-005": 2}[rule]
    assert kept["contributors"][1].filter("role IS NULL").count() == 0
    capsys.readouterr()
    kept["contributors"][0].explain("simple")
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert plan.count("explode(array_distinct(") >= 1 and "D-001" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    rules_module.tagged(events, [RULES["D-001"], volume], every=True).explain("simple")
    assert "lambda" not in capsys.readouterr().out
