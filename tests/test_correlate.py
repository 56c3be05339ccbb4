import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netquarry.operators.correlate import GapRules, correlation_summary, gap_groups, propose_cases

T0 = datetime(2026, 9, 1, tzinfo=UTC)


def greedy(rows, gap, span, cap):
    """Brute force: one pass per key."""
    out, state = {}, {}
    for key, s, e, rid in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        cur = state.get(key)
        joins = cur and s - cur["end"] <= gap and max(cur["end"], e) - cur["start"] <= span and cur["n"] < cap
        if not joins:
            cur = state[key] = {"start": s, "end": e, "n": 0, "no": (cur["no"] + 1 if cur else 0)}
        cur["end"], cur["n"] = max(cur["end"], e), cur["n"] + 1
        out[rid] = (key, cur["no"])
    return out


def partition(mapping):
    groups = {}
    for rid, g in mapping.items():
        groups.setdefault(g, set()).add(rid)
    return sorted(map(sorted, groups.values()))


def frame(spark, rows):
    moved = [(k, T0 + timedelta(seconds=s), T0 + timedelta(seconds=e), i) for k, s, e, i in rows]
    return spark.createDataFrame(moved, "k string, s timestamp, e timestamp, id long")


@pytest.mark.parametrize("seed,cap,span,gap,long", [(1, 500, 86400, 3600, 0), (2, 7, 5000, 600, 0), (3, 5, 3000, 200, 900)])
def test_groups_match_brute_force(spark, seed, cap, span, gap, long):
    rng = random.Random(seed)
    rows = []
    for i in range(2500):
        # one key holds most rows
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        s = rng.randrange(0, 400_000 if seed == 1 else 60_000)
        rows.append((key, s, s + rng.choice([0, 1, 30, long]), i))
    rules = GapRules(gap, span, cap, piece_seconds=1000, block_rows=max(cap, 40))
    got = gap_groups(frame(spark, rows), ["k"], "s", "e", "id", rules).collect()
    assert len(got) == len(rows)
    mine = partition({r.id: (r.k, r.island, r.part) for r in got})
    assert mine == partition(greedy(rows, gap, span, cap))


def test_gap_is_inclusive(spark):
    rows = [("a", 0, 10, 1), ("a", 3610, 3610, 2), ("a", 7211, 7211, 3)]
    got = {r.id: (r.island, r.part) for r in gap_groups(frame(spark, rows), ["k"], "s", "e", "id").collect()}
    assert got[1] == got[2] != got[3]


def alerts_frame(spark, rows):
    data = [(i, r, sev, "src_ip", ent, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + 60))
            for i, (r, sev, ent, s) in enumerate(rows)]
    return spark.createDataFrame(
        data, "alert_id long, rule_id string, severity int, entity_type string, entity_value string,"
        " first_seen timestamp, last_seen timestamp")


def test_proposals(spark):
    rows = [("D-001", 3, "10.0.0.1", 0), ("D-002", 3, "10.0.0.1", 600), ("D-004", 4, "10.0.0.1", 1200),
            ("D-001", 2, "10.0.0.2", 0), ("D-001", 3, "10.0.0.1", 20000)]
    proposals, members = propose_cases(alerts_frame(spark, rows))
    got = {(r.entity_value, r.island): r for r in proposals.collect()}
    first = got[("10.0.0.1", 1)]
    assert (first.severity, first.escalated, first.alerts) == (5, True, 3)
    assert first.title == "3 rules on 10.0.0.1: D-001, D-002, D-004"
    assert len(got) == 3 and members.count() == 5
    assert correlation_summary(proposals).first().asDict() == {
        "proposals": 3, "alerts": 5, "escalated": 1, "entities": 2}


def test_no_nested_loops(spark):
    proposals, _ = propose_cases(alerts_frame(spark, [("D-001", 3, "a", 0)]))
    plan = proposals._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
