import ipaddress
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netquarry.operators import prefix as P
from netquarry.operators.inventory import upsert_assets
from netquarry.operators.reads import events_of_asset, events_of_networks, keyset_page

T0 = datetime(2026, 1, 1, tzinfo=UTC)
NETS = [  # asset, cidr, primary, active, age, criticality
    ("wide", "10.0.0.0/8", True, True, 0, 1), ("mid", "10.1.0.0/16", True, True, 1, 2),
    ("near", "10.1.2.0/24", True, True, 2, 3), ("host", "10.1.2.3/32", True, True, 3, 4),
    ("asleep", "10.1.2.4/32", True, False, 0, 5), ("second", "10.2.0.0/16", False, True, 0, 1),
    ("prime", "10.2.0.0/16", True, True, 9, 2), ("old", "10.3.0.0/16", True, True, 1, 3),
    ("new", "10.3.0.0/16", True, True, 2, 4), ("six", "2001:db8::/33", True, True, 0, 5),
    ("six-in", "2001:db8:0:5::/64", True, True, 0, 2),
]


def nets(spark, rows=NETS):
    return spark.createDataFrame(
        [(a, c, p, on, T0 + timedelta(days=d), k) for a, c, p, on, d, k in rows],
        "asset_id string, cidr string, is_primary boolean, is_active boolean, created_at timestamp, criticality int")


def addresses(spark, values):
    return spark.createDataFrame([(v,) for v in values], "ip string")


def test_longest_prefix(spark):
    want = {"10.9.9.9": "wide", "10.1.9.9": "mid", "10.1.2.9": "near", "10.1.2.3": "host", "10.1.2.4": "near",
            "10.2.0.1": "prime", "10.3.0.1": "old", "2001:db8::1": "six", "2001:db8:0:5::9": "six-in",
            "2001:db8:8000::1": None, "192.0.2.1": None, "not-an-ip": None}
    got = P.resolve_assets(addresses(spark, want), "ip", nets(spark))
    assert {r.ip: r.asset_id for r in got.collect()} == want


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"n{i}", str(ipaddress.ip_network((rng.randrange(2**32), rng.randrange(3, 33)), strict=False)), i % 2 == 0,
             True, rng.randrange(9), 1) for i in range(300)]
    probes = [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(500)]
    parsed = [(a, ipaddress.ip_network(c)) for a, c, *_ in rows]
    want = {(p, a) for p in probes for a, n in parsed if ipaddress.ip_address(p) in n}
    got = {(r.address, r.asset_id) for r in P.memberships(addresses(spark, probes), "ip", nets(spark, rows)).collect()}
    assert got == want
    over = {(r.asset_id, r.other_asset_id) for r in P.network_overlaps(nets(spark, rows), nets(spark, rows[:0])).collect()}
    assert over == {(a, b) for a, n in parsed for b, m in parsed if a != b and n.overlaps(m)}


def test_a_witness_for_every_overlap(spark):
    rng = random.Random(8)

    def some(n, name):
        out = [(f"{name}{rng.randrange(n // 3)}", str(ipaddress.ip_network((rng.randrange(2**32), rng.randrange(6, 33)), strict=False)))
               for _ in range(n)]
        return out + [(f"{name}{rng.randrange(n // 3)}", f"2001:db8:{rng.randrange(4)}::/{rng.choice([33, 48, 64])}") for _ in range(6)]

    mine, theirs = some(90, "a"), some(120, "b")
    theirs += [("a1", c) for _, c in mine[:20]] + [("b0", "nonsense"), (mine[0][0], mine[0][1])]
    gone = {"b1", "b2"}

    def table(rows):
        return spark.createDataFrame(rows, "asset_id string, cidr string")

    left = [(a, ipaddress.ip_network(c, strict=False), c) for a, c in theirs if a not in gone and c != "nonsense"]
    left += [(a, ipaddress.ip_network(c, strict=False), c) for a, c in mine]
    want = {}
    for a, c in mine:
        net = ipaddress.ip_network(c, strict=False)
        others = {(b, d) for b, m, d in left if b != a and m.version == net.version and m.overlaps(net)}
        if others:
            want[a, c] = others
    excluded = table([(g, "") for g in gone])
    rows = P.overlap_witnesses(table(mine), table(theirs), excluded).collect()
    assert {(r.asset_id, r.cidr) for r in rows} == set(want) and len(rows) == len(want)
    assert all((r.other_asset_id, r.other_cidr) in want[r.asset_id, r.cidr] for r in rows)
    assert P.overlap_witnesses(table([]), table(theirs)).count() == 0


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_no_nested_loop(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for df in (P.longest_match(addresses(spark, ["10.1.2.3"]), "ip", nets(spark)),
                   P.memberships(addresses(spark, ["10.1.2.3"]), "ip", nets(spark)),
                   P.network_overlaps(nets(spark), nets(spark)),
                   P.overlap_witnesses(nets(spark), nets(spark))):
            rows = df.count()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert rows and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_events_of_asset_both_ways(spark):
    events = spark.createDataFrame(
        [("1", "10.1.2.3", "192.0.2.1"), ("2", "192.0.2.1", "10.1.2.3"), ("3", "10.9.9.9", None), ("4", None, "10.1.2.3"),
         ("5", "10.1.2.3", "10.1.2.3"), ("6", None, None)], "id string, src_ip string, dest_ip string")
    for found in (events_of_asset(events, nets(spark), "host"),
                  events_of_networks(events, nets(spark).filter("asset_id = 'host'"))):
        assert sorted(r.id for r in found.collect()) == ["1", "2", "4", "5"]


def test_keyset_walk(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(50)], "t int, id int")
    seen, after, more = [], None, True
    while more:
        page = keyset_page(rows, ["t", "id"], 7, after).orderBy(F.desc("t"), F.desc("id")).collect()
        seen += [r.id for r in page]
        after, more = [page[-1].t, page[-1].id], page[-1].has_more
    assert seen == list(range(49, -1, -1))


def seeds(spark, rows):
    return spark.createDataFrame(rows, "hostname string, environment string, owner string, criticality int, tags array<string>,"
                                 " description string, networks array<struct<cidr: string, is_primary: boolean>>")


def test_seeding(spark):
    assets = spark.createDataFrame(
        [("a1", "web.test", "lab", "x", 1, ["t"], None, False, T0), ("a2", "db.test", "lab", "x", 1, ["t"], None, True, T0)],
        "asset_id string, hostname string, environment string, owner string, criticality int, tags array<string>,"
        " description string, is_active boolean, created_at timestamp")
    networks = spark.createDataFrame([("a1", "10.0.0.1/32", True), ("a2", "10.0.1.0/24", True)],
                                     "asset_id string, cidr string, is_primary boolean")
    now = F.lit(T0)
    good = seeds(spark, [(" WEB.test", "dev", None, 4, [" A "], None, [("10.0.0.2/32", True)]),
                         ("new.test", "lab", None, None, None, None, [("10.5.0.0/16", True)])])
    after, nets_after, refused = upsert_assets(assets, networks, good, now)
    assert refused.count() == 0
    got = {r.hostname: r for r in after.collect()}
    assert set(got) == {"web.test", "db.test", "new.test"}
    assert (got["web.test"].asset_id, got["web.test"].criticality, got["web.test"].is_active, got["web.test"].tags) == ("a1", 4, True, ["a"])
    assert got["new.test"].criticality == 3
    assert sorted(r.cidr for r in nets_after.collect()) == ["10.0.0.2/32", "10.0.1.0/24", "10.5.0.0/16"]
    bad = seeds(spark, [("in valid", "lab", None, 3, None, None, []), ("dup.test", "lab", None, 3, None, None, []),
                        ("dup.test", "lab", None, 3, None, None, []), ("h.test", "lab", None, 3, None, None, [("10.0.0.1/8", True)]),
                        ("o.test", "lab", None, 3, None, None, [("10.0.1.128/25", True)])])
    same, _, refused = upsert_assets(assets, networks, bad, now)
    assert {(r.hostname, r.problem) for r in refused.collect()} == {
        ("in valid", "hostname"), ("dup.test", "duplicate hostname"), ("h.test", "networks"), ("o.test", "network overlap")}
    assert same.count() == 2
