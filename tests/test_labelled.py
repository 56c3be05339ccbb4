import json

import pytest
from pyspark.sql import functions as F

from netquarry.operators.evaluation import benign_noise, detector_metrics, judge_cases
from netquarry.operators.rules import RULES
from netquarry.operators.sets import union_all
from netquarry.sources.labelled import read_labelled_cases
from tests.cases import all_cases, write


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("labelled")
    write(root)
    cases, events, baselines, rejects = read_labelled_cases(spark, str(root))
    assert rejects.count() == 0
    stored = str(root / "stored")
    events.write.parquet(stored)
    return cases.cache(), spark.read.parquet(stored), baselines.cache()


@pytest.fixture(scope="module")
def outcomes(corpus):
    cases, events, baselines = corpus
    parts = []
    for rule in RULES.values():
        # every rule sees only the cases written for it, all of them in one job
        mine = events.join(cases.filter(F.col("rule_id") == rule.rule_id).select("case_id"), "case_id", "left_semi")
        found = rule.run(mine, baselines, scope=["case_id"])
        parts.append(found.withColumn("evidence", F.to_json("evidence")).cache())
    return union_all(parts)


def test_every_case_is_read(corpus):
    cases, events, _ = corpus
    assert cases.count() == len(all_cases()) == 34
    assert cases.filter("expected = 'detection'").count() == 15


def test_rules_score_perfectly(corpus, outcomes):
    cases, _, _ = corpus
    verdicts = judge_cases(cases, outcomes).collect()
    assert len(verdicts) == 34
    bad = [(r.case_id, r.verdict, r.reason) for r in verdicts if not r.matched]
    assert not bad
    quiet = outcomes.sparkSession.createDataFrame(
        [(r, 2000, 0) for r in RULES], "rule_id string, events long, alerts long")
    for row in detector_metrics(judge_cases(cases, outcomes), quiet).collect():
        assert (row.precision, row.recall, row.f1, row.alerts_per_10k) == (1.0, 1.0, 1.0, 0.0)


def test_evidence_and_samples(outcomes):
    rows = {r.case_id: r for r in outcomes.collect()}
    scan = rows["D-001/positive/forty-ports"]
    seen = json.loads(scan.evidence)
    assert seen["distinct_dest_ports"] == 40 and seen["unanswered_flows"] == 40
    assert seen["sample_dest_ports"] == list(range(1000, 1020))
    assert scan.confidence == 1.0 and scan.signal_strength == round(min(1, 40 / 20 / 3), 4)
    assert len(scan.samples) == 20 and [s.role for s in scan.samples][:2] == ["first", "last"]
    assert len({s.event_id for s in scan.samples}) == 20
    auth = json.loads(rows["D-002/positive/two-services"].evidence)
    assert auth["failures"] == 24 and auth["signature_ids"] == [11, 12]
    assert auth["sample_targets"] == ["10.10.0.5:22", "10.10.0.5:3389"]
    tunnel = json.loads(rows["D-003/positive/tunnel"].evidence)
    assert tunnel["signals"] == ["long_labels", "tunnel"] or tunnel["signals"] == ["tunnel"]
    assert tunnel["top_domain"] == "exfil.test" and tunnel["top_domain_names"] == 300
    beacon = json.loads(rows["D-004/positive/among-noise"].evidence)
    assert beacon["destination"] == "203.0.113.50:443" and beacon["connections"] == 70
    volume = rows["D-005/positive/many-flows"]
    assert json.loads(volume.evidence)["flows"] == 100 and len(volume.samples) == 20


def test_rows_in_any_order_give_the_same_alerts(corpus):
    cases, events, baselines = corpus
    rule = RULES["D-004"]
    def out(df):
        return sorted(map(str, rule.run(df, scope=["case_id"]).collect()))
    assert out(events) == out(events.orderBy(F.rand(3)).repartition(5))


def test_noise_counts_distinct_keys(spark, corpus):
    _, events, _ = corpus
    quiet = events.filter("case_id LIKE 'D-001/negative/%'")
    rows = {r.rule_id: (r.events, r.alerts) for r in benign_noise(quiet).collect()}
    assert {k: v[1] for k, v in rows.items()} == dict.fromkeys(RULES, 0)
    assert rows["D-001"][0] == quiet.count()
