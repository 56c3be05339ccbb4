import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from netquarry.operators import cases as C
from netquarry.operators.correlate import GapRules

T0 = datetime(2026, 9, 1, tzinfo=UTC)
HOUR = 3600
INCIDENTS = ("incident_id string, case_number string, correlation_key string, title string, severity int, status string,"
             " window_start timestamp, window_end timestamp, distinct_rule_count int, created_at timestamp, updated_at timestamp")
ALERTS = ("alert_id string, rule_id string, severity int, entity_type string, entity_value string, first_seen timestamp,"
          " last_seen timestamp, status string")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def alerts(spark, rows):
    return spark.createDataFrame(
        [(f"a{i:04d}", r, s, "src_ip", e, at(a), at(b), "open") for i, (r, s, e, a, b) in enumerate(rows)], ALERTS)


def incident(i, key, status, start, end, created=0):
    return (f"i{i}", f"CASE-2026-{i:04d}", f"src_ip={key}", "t", 3, status, at(start), at(end), 1, at(created), at(created))


def run(spark, rows, incidents=(), linked=(), **kw):
    return C.file_cases(
        alerts(spark, rows), spark.createDataFrame(list(incidents), INCIDENTS),
        spark.createDataFrame(list(linked), "incident_id string, alert_id string"),
        F.lit(at(10**6)), **kw)


def test_opens_extends_and_stands_beside(spark):
    rows = [("D-001", 3, "x", 0, 60), ("D-002", 3, "x", 600, 700), ("D-004", 4, "x", 1200, 1300),
            ("D-001", 2, "y", 5000, 5100), ("D-003", 3, "z", 9000, 9100)]
    incidents = [incident(7, "y", "investigating", 1000, 2000), incident(8, "z", "closed_benign", 6000, 7000)]
    out = run(spark, rows, incidents, last_ordinal=8)
    got = {r.correlation_key: r for r in out["incidents"].collect()}
    x, y, z = got["src_ip=x"], got["src_ip=y"], got["src_ip=z"]
    assert (x.created, x.severity, x.distinct_rule_count, x.case_number) == (True, 5, 3, "CASE-2026-0009")
    assert (y.created, y.incident_id, y.window_end) == (False, "i7", at(5100).replace(tzinfo=None))
    assert z.created and z.case_number == "CASE-2026-0010" and z.status == "new"
    entries = out["timeline"].collect()
    assert sorted(e.entry_type for e in entries) == ["alert_fired"] * 5 + ["observation"]
    assert [e.summary for e in entries if e.entry_type == "observation"] == [
        "A case of its own: CASE-2026-0008 had ended before"]
    assert out["links"].count() == 5 and out["alert_status"].filter("status = 'correlated'").count() == 5


def test_second_run_adds_nothing(spark):
    rows = [("D-001", 3, "x", 0, 60), ("D-002", 3, "x", 600, 700)]
    first = run(spark, rows)
    links = [(r.incident_id, r.alert_id) for r in first["links"].collect()]
    stored = [tuple(r[c] for c in ("incident_id", "case_number", "correlation_key", "title", "severity", "status",
                                   "window_start", "window_end", "distinct_rule_count", "created_at", "updated_at"))
              for r in first["incidents"].collect()]
    again = run(spark, rows, stored, links)
    assert again["incidents"].count() == again["links"].count() == again["timeline"].count() == 0


def test_severity_does_not_fall_when_a_case_grows(spark):
    rows = [("D-004", 5, "x", 0, 60), ("D-001", 2, "x", 1800, 1900)]
    out = run(spark, rows, [incident(1, "x", "new", 0, 60)], [("i1", "a0000")])
    row = out["incidents"].collect()
    assert [(r.incident_id, r.severity, r.title) for r in row] == [("i1", 5, "D-001 and D-004 on x")]


def brute(groups, seed, gap, span):
    """Filing in order, keeping every open case; groups are (start, end) sorted by start."""
    cases = [] if seed is None else [{"id": "seed", "s": seed[0], "e": seed[1], "c": 0}]
    out = []
    for i, (s, e) in enumerate(groups):
        newest = max(cases, key=lambda c: (c["e"], c["c"]), default=None)
        if newest and s - newest["e"] <= gap and max(newest["e"], e) - newest["s"] <= span:
            newest["s"], newest["e"] = min(newest["s"], s), max(newest["e"], e)
            out.append(newest["id"])
        else:
            cases.append({"id": i, "s": s, "e": e, "c": i + 1})
            out.append(i)
    return out


def test_filing_matches_brute_force(spark):
    rng = random.Random(5)
    proposals, incidents, want = [], [], []
    for k in range(40):
        key = f"src_ip={k}"
        seed = None
        if k % 2:
            s = rng.randrange(0, 200_000)
            seed = (s, s + rng.randrange(0, 20_000))
            incidents.append(incident(k, str(k), "new", *seed))
        spots = sorted((rng.randrange(0, 300_000), rng.randrange(0, 30_000)) for _ in range(rng.randrange(1, 40)))
        groups = [(s, s + d) for s, d in spots]
        for i, (s, e) in enumerate(groups):
            proposals.append((key, i, 1, at(s), at(e)))
        for i, case in enumerate(brute(groups, seed, HOUR, 24 * HOUR)):
            want.append((key, i, f"i{k}" if case == "seed" else case))
    frame = spark.createDataFrame(
        proposals, "correlation_key string, island long, part long, window_start timestamp, window_end timestamp")
    rows = C.assign_cases(frame, spark.createDataFrame(incidents, INCIDENTS), F.lit(at(10**6)), GapRules()).collect()
    openers = {r.incident_id: r.island for r in rows if r.created}
    got = sorted((r.correlation_key, r.island, openers.get(r.incident_id, r.incident_id)) for r in rows)
    assert got == sorted(want)


def test_workflow(spark):
    cases = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "closed_benign")], "incident_id string, status string")
    moves = [("a", 1, "closed_benign", " done\x01 "), ("a", 2, "triaging", None), ("a", 3, "investigating", None),
             ("a", 4, "investigating", None), ("a", 5, "closed_true_positive", "seen"), ("b", 1, "contained_recommended", None),
             ("c", 1, "new", None)]
    rows = spark.createDataFrame([(i, at(t), n, s, r) for n, (i, t, s, r) in enumerate(moves)],
                                 "incident_id string, requested_at timestamp, request_id long, to_status string, reason string")
    outcomes, final = C.replay_workflow(cases, rows)
    assert [r.outcome for r in outcomes.orderBy("request_id").collect()] == [
        "moved", "illegal", "moved", "same", "moved", "illegal", "illegal"]
    got = {r.incident_id: (r.status, r.closure_reason, r.closed_at is not None) for r in final.collect()}
    assert got == {"a": ("closed_true_positive", "seen", True), "b": ("new", None, False), "c": ("closed_benign", None, False)}


def test_a_hot_case_is_replayed_block_by_block(spark):
    rng = random.Random(5)
    states = [*C.LEGAL_MOVES, "unheard_of", None]
    rows = [("hot", at(rng.randrange(2000)), n, rng.choice(states)) for n in range(9000)]
    rows += [(f"c{n % 50}", at(rng.randrange(50)), n, rng.choice(states)) for n in range(9000, 9600)]
    rows += [("lost", at(1), 9999, "triaging"), (None, at(1), 9998, "triaging"), ("odd", at(1), 9997, "triaging")]
    cases = [("hot", "new"), ("idle", "triaging"), ("odd", "strange"), *((f"c{n}", states[n % 7]) for n in range(50))]
    want, state = {}, dict(cases)
    for case, _, n, target in sorted((r for r in rows if r[0] in state), key=lambda r: (r[0], r[1], r[2])):
        now = state[case]
        if now == "strange":
            want[n] = (None, "illegal")
            continue
        verdict = "same" if now == target else "moved" if target in C.LEGAL_MOVES[now] else "illegal"
        want[n] = (now, verdict)
        state[case] = target if verdict == "moved" else now
    requests = spark.createDataFrame([(*r, None) for r in rows], "incident_id string, requested_at timestamp,"
                                     " request_id long, to_status string, reason string")
    outcomes, final = C.replay_workflow(spark.createDataFrame(cases, "incident_id string, status string"), requests)
    assert {r.request_id: (r.from_status, r.outcome) for r in outcomes.collect()} == want
    assert {r.incident_id: r.status for r in final.collect()} == state
    none, _ = C.replay_workflow(spark.createDataFrame(cases, "incident_id string, status string"), requests.limit(0))
    assert none.count() == 0


def test_notes(spark):
    df = spark.createDataFrame([(0, " a\x00b\nc "), (1, "\x01 \n"), (2, "x" * 8001), (3, None)], "i int, body string")
    got = [(r.clean, r.refused) for r in C.clean_notes(df).orderBy("i").collect()]
    assert got == [("ab\nc", None), (None, "empty"), (None, "too_long"), (None, "empty")]
