import ipaddress
import math
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from netquarry.functions import dns, ip, markdown, scoring, secrets, text, timing


def column(spark, values, expr, name="v", kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")
    return [r[1] for r in rows.select("i", expr.alias("out")).orderBy("i").collect()]


ADDRESSES = [
    "10.0.0.1", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4.5",
    "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db8:0:1:0:0:0:1",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:::2", ":1::2",
    "1::2::3", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "::1.2.3.999", "fe80::1", "12345::",
    "1:0:0:2:0:0:0:3", "0:0:1:0:0:1:0:0", "abc", "", ":", "g::1", "1:2:3:4:5:6:1.2.3.4",
    "1:2:3:4:5:6:7:1.2.3.4", "1::8:", "10.0.0.1 ",
]


def _hex(value):
    try:
        parsed = ipaddress.ip_address(value)
    except ValueError:
        return None
    return format(int(parsed), "08x" if parsed.version == 4 else "032x")


def _fold(value):
    """RFC 5952 text without the dotted rendering of mapped addresses."""
    parsed = ipaddress.ip_address(value)
    if parsed.version == 4:
        return str(parsed)
    return ipaddress.IPv6Address._string_from_ip_int(int(parsed))


def test_addresses_parse_like_the_standard_library(spark):
    assert column(spark, ADDRESSES, ip.ip_hex(F.col("v"))) == [_hex(a) for a in ADDRESSES]


def test_canonical_text(spark):
    good = [a for a in ADDRESSES if _hex(a)]
    assert column(spark, good, ip.ip_canonical(F.col("v"))) == [_fold(a) for a in good]
    assert column(spark, good, ip.hex_to_text(ip.ip_hex(F.col("v")))) == [_fold(a) for a in good]


def test_internal_ranges(spark):
    nets = [ipaddress.ip_network(n) for n in ip.INTERNAL_NETWORKS]
    probes = set()
    for net in nets:
        low, high = int(net.network_address), int(net.broadcast_address)
        cls = type(net.network_address)
        for value in (low - 1, low, high, high + 1):
            if 0 <= value <= (2**32 - 1 if net.version == 4 else 2**128 - 1):
                probes.add(_fold(str(cls(value))))
    probes |= {"203.0.113.9", "8.8.8.8", "2001:db8::1"}
    probes = sorted(probes)
    want = [any(ipaddress.ip_address(p) in n for n in nets) for p in probes]
    assert column(spark, probes, ip.is_internal(F.col("v"))) == want
    by_cidr = F.lit(False)
    for net in ip.INTERNAL_NETWORKS:
        by_cidr = by_cidr | ip.ip_in(F.col("v"), net)
    assert column(spark, probes, by_cidr) == want


CIDRS = ["10.0.0.0/8", "10.1.2.3/32", "10.1.2.3/24", "10.1.2.3", "2001:db8::/33", "::/0",
         "10.0.0.0/33", "x/8", "10.0.0.0/a", "172.16.0.0/12", "192.0.2.128/25", "fe80::/10"]


def test_networks(spark):
    got = column(spark, CIDRS, ip.cidr_struct(F.col("v")))
    for cidr, row in zip(CIDRS, got):
        try:
            net = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            assert row is None, cidr
            continue
        assert (row.ip_version, row.masklen) == (net.version, net.prefixlen)
        strict = str(ipaddress.ip_interface(cidr).ip) == str(net.network_address)
        assert row.strict == strict, cidr
        width = 8 if net.version == 4 else 32
        assert row.net_key.ljust(width, "0") == format(int(net.network_address), f"0{width}x")


def test_sensor_time(spark):
    values = ["2026-09-01T10:00:00.123456+0000", "2026-09-01T10:00:00Z", "2026-09-01T12:00:00+02:00",
              "2026-09-01T10:00:00", "nonsense", "2026-13-01T10:00:00Z", None]
    got = column(spark, values, timing.micros(timing.parse_sensor_time(F.col("v"))))
    base = int(datetime(2026, 9, 1, 10, tzinfo=UTC).timestamp()) * 10**6
    assert got == [base + 123456, base, base, None, None, None, None]


def test_iso(spark):
    base = int(datetime(2026, 9, 1, 10, tzinfo=UTC).timestamp()) * 10**6
    got = column(spark, [base, base + 5], timing.iso_utc(timing.from_micros(F.col("v"))), kind="long")
    assert got == ["2026-09-01T10:00:00+00:00", "2026-09-01T10:00:00.000005+00:00"]


def _entropy(value):
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def test_dns(spark):
    names = ["a.b.Example.COM..", "example.com", "com", ".", "x.y", "aaaaaaaaaaaaaaaa.b.c",
             "q1w2e3r4t5y6u7i8.b.c", "short.q1w2e3r4t5y6u7i8.b.c"]
    assert column(spark, names, dns.base_domain(F.col("v"))) == [
        "example.com", "example.com", "com", "", "x.y", "b.c", "b.c", "b.c"]
    assert column(spark, names, dns.subdomain_labels(F.col("v")))[0] == ["a", "b"]
    assert column(spark, names, dns.looks_random(F.col("v"), 3.5)) == [
        False, False, False, False, False, False, True, True]
    words = ["aab", "abcdefgh", "zzzz", ""]
    got = column(spark, words, dns.shannon_entropy(F.col("v")))
    assert got == pytest.approx([_entropy("aab"), 3.0, 0.0, 0.0])
    hosts = ["x.cloudfront.net", "cloudfront.net.", "notcloudfront.net", "1.in-addr.arpa"]
    assert column(spark, hosts, dns.is_allowed(F.col("v"))) == [True, True, False, True]


def _depth(raw):
    depth = deepest = 0
    inside = escaped = False
    for ch in raw:
        if escaped:
            escaped = False
        elif inside:
            escaped, inside = ch == "\\", ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "{[":
            depth += 1
            deepest = max(deepest, depth)
        elif ch in "}]":
            depth = max(0, depth - 1)
    return deepest


def test_depth_and_structure(spark):
    lines = ['{"a":[1,{"b":"}{"}]}', '{"a":"\\"{{{"}', "}}}[", '{"open":"{{', "", '{"a":"\\\\"}',
             '{"a":{"b":{"c":[[]]}}}']
    assert column(spark, lines, text.bracket_depth(F.col("v"))) == [_depth(x) for x in lines]

    wide = "{" + ",".join(f'"k{i}":1' for i in range(201)) + "}"
    exact = "{" + ",".join(f'"k{i}":1' for i in range(200)) + "}"
    long = '{"a":[' + ",".join("1" for _ in range(1001)) + "]}"
    fine = '{"a":[' + ",".join("1" for _ in range(1000)) + "]}"
    nested = '{"a":[' + ",".join("[1,2]" for _ in range(900)) + "]}"
    got = column(spark, [wide, exact, long, fine, nested],
                 text.structure_excess(text.skeleton(F.col("v")), 200, 1000))
    assert got == [True, False, True, False, False]


def test_depth_survives_hostile_lines(spark):
    lines = ['{"a":"' + '\\"' * 30000 + '"}', "[" * 60000, '"' * 60001]
    assert column(spark, lines, text.bracket_depth(F.col("v"))) == [_depth(x) for x in lines]


def test_strict_json(spark):
    skel = text.skeleton(F.col("v"))
    lines = ['{"a":1}', '{"a":1} x', '{"a":1} {"b":2}', '{"a":1}  ', "[1]", "3", '"x"', '{"a":1', "{a:1}",
             '{"a":1,"a":2}', '{"a":NaN}', '{"a":"x}y"}', '{"a":1}}']
    got = column(spark, lines, text.strict_json(F.col("v"), text.bracket_fold(skel), skel).isNotNull())
    assert got == [True, False, False, True, True, True, True, False, False, False, False, True, False]


def test_clean_json_text(spark):
    lines = [r'{"a":"x\u0001y"}', r'{"a":"x\\u0001y"}', r'{"a":"x\ny\tz"}', r'{"a":"\u0001\u0002\\\u0003"}',
             '{"a":"x\x85y"}', r'{"a":"\u0009\u007fA"}']
    assert column(spark, lines, text.clean_json_text(F.col("v"))) == [
        '{"a":"xy"}', r'{"a":"x\\u0001y"}', r'{"a":"xy\tz"}', r'{"a":"\\"}', '{"a":"xy"}',
        r'{"a":"\u0009A"}']


def test_severity(spark):
    rows = [(3, 1.0, None), (3, 0.0, 1), (5, 1.0, 5), (4, 0.5, 3), (3, 0.75, 4), (1, 0.0, 1)]
    df = spark.createDataFrame(rows, "b int, s double, c int")
    score = scoring.severity_score(F.col("b"), F.col("s"), F.col("c"))
    out = df.select(score.alias("x")).select("x.*", scoring.reproduce(F.col("x.rationale")).alias("again"))
    got = [(r.value, r.again, r.rationale.asset_criticality_source) for r in out.collect()]
    want = []
    for base, signal, crit in rows:
        raw = base + 0.5 * ((crit or 3) - 3) + 2 * (signal - 0.5)
        value = max(1, min(5, math.floor(raw + 0.5)))
        want.append((value, value, "asset" if crit else "default"))
    assert got == want


def test_titles_and_numbers(spark):
    df = spark.range(1)
    when = F.lit("2026-01-05 00:00:00").cast("timestamp")
    row = df.select(
        scoring.case_number("CASE", when, F.lit(7)).alias("a"),
        scoring.case_number("CASE", when, F.lit(12345)).alias("b"),
        scoring.case_title(F.array(F.lit("D-001")), F.lit("10.0.0.1")).alias("c"),
        scoring.case_title(F.array(F.lit("D-001"), F.lit("D-002")), F.lit("x"), F.lit("web")).alias("d"),
        scoring.case_title(F.array(*map(F.lit, ["D-001", "D-002", "D-003"])), F.lit("x")).alias("e"),
    ).first()
    assert tuple(row) == ("CASE-2026-0007", "CASE-2026-12345", "D-001 on 10.0.0.1",
                          "D-001 and D-002 on web", "3 rules on x: D-001, D-002, D-003")


def test_markdown(spark):
    values = ["a|b", "`x`", "  two\n lines ", "rtl‮end", "", "a``b", "*bold* [x](y)", "tab\there"]
    assert column(spark, values, markdown.md_cell(F.col("v"))) == [
        r"a\|b", r"\`x\`", "two lines", r"rtl\<U\+202E\>end", "", r"a\`\`b",
        r"\*bold\* \[x\]\(y\)", "tab here"]
    assert column(spark, values, markdown.md_code(F.col("v"))) == [
        "`a|b`", "`` `x` ``", "`two lines`", "`rtl<U+202E>end`", "``", "``` a``b ```",
        "`*bold* [x](y)`", "`tab here`"]
    assert column(spark, ["a\n```\nb"], markdown.md_fence(F.col("v"), "json")) == ["````json\na\n```\nb\n````"]
    assert column(spark, ["    code\n\n  b", "\n \n"], markdown.md_prose(F.col("v"))) == ["code\n\nb", "_(empty)_"]


def test_thresholds_must_be_positive():
    import pytest

    from netquarry.operators.rules import AuthBurstParams, BeaconParams, PortScanParams

    for make in (
        lambda: PortScanParams(distinct_ports=0),
        lambda: AuthBurstParams(burst=-1),
        lambda: BeaconParams(max_jitter=0),
    ):
        with pytest.raises(ValueError):
            make()


def test_whole_text_unless_a_length_is_given(spark):
    from netquarry.functions.secrets import bounded_detail
    from netquarry.functions.text import excerpt

    rules = F.array(*[F.lit(f"D-{i:03}") for i in range(90)])
    detail = F.map_from_entries(
        F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.struct(
            F.concat(F.repeat(F.lit("k"), F.lit(80)), i.cast("string")), F.repeat(F.lit("v"), F.lit(700)))))
    row = spark.range(1).select(
        F.length(scoring.case_title(rules, F.lit("x"))).alias("title"),
        F.length(scoring.case_title(rules, F.lit("x"), max_chars=200)).alias("short_title"),
        F.length(excerpt(F.repeat(F.lit("r"), F.lit(900)))).alias("raw"),
        F.length(excerpt(F.repeat(F.lit("r"), F.lit(900)), 256)).alias("short_raw"),
        F.size(bounded_detail(detail)).alias("keys"),
        F.length(F.map_values(bounded_detail(detail))[0]).alias("value"),
        F.size(bounded_detail(detail, 32)).alias("some_keys"),
        F.size(bounded_detail(detail, key_chars=64, value_chars=512)).alias("equal_keys"),
    ).first()
    assert row.title > 400 and row.short_title == 200
    assert (row.raw, row.short_raw) == (900, 256)
    assert (row["keys"], row.value, row.some_keys, row.equal_keys) == (50, 700, 32, 1)


def test_invisible_text_is_written_out(spark):
    odd = [p for low, high in markdown._INVISIBLE_RANGES for p in range(low, high + 1)]
    values = [f"a{chr(p)}b{chr(p)}" for p in odd] + ["plain", "é", "a\x07b\x7f", "\x0b", "\ta\nb\rc", "", None]
    want = [f"a<U+{p:04X}>b<U+{p:04X}>" for p in odd] + ["plain", "é", "ab", "", "\ta\nb\rc", "", None]
    assert column(spark, values, markdown.md_visible(F.col("v"))) == want
    spaced = ["a  b", " a ", "a\u00a0b", "a\t b", "a\u2028b", "a\x1cb", "a b", "\u200b a", "", None]
    assert column(spark, spaced, markdown.md_one_line(F.col("v"))) == [
        "a b", "a", "a b", "a b", "a b", "ab", "a b", "<U+200B> a", "", None]
    # plain text is looked through once, not once for each of the code points
    plan = spark.range(1).select(markdown.md_visible(F.col("id").cast("string")).alias("t"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("replace(") <= 2


def test_shortest_secrets_pass_the_first_look(spark):
    found = {
        "email": ["a@b.cc", "a@b.c"],
        "aws_access_key_id": [k + "A" * 12 for k in ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ANVA")] + ["AKIA"],
        "private_key_block": ["--BEGINPRIVATE KEY--", "--begin rsa private key--", "-BEGIN PRIVATE KEY-"],
        "jwt": ["eyJ" + ".".join(["a" * 8] * 3), "eyJ"],
        "bearer_token": ["token " + "a" * 16, "BEARER\t" + "a" * 16, "token " + "a" * 15],
        "credential_assignment": ["auth:abcd", "Secret = abcd", "auth abcd"],
        "slack_or_github_token": [k + "a" * 8 for k in ("xoxa-", "xoxs-", "ghp_", "gho_", "ghs_", "github_pat_")] + ["ghx_" + "a" * 8],
        "private_key_body": ["MII" + "a" * 40, "MII" + "a" * 39],
        "base64_blob": ["aA1" * 20, "aA1" * 19 + "aA", "a" * 60],
    }
    assert list(found) == [n for n, _ in secrets.SECRET_PATTERNS]
    for name, values in found.items():
        pattern = dict(secrets.SECRET_PATTERNS)[name]
        misses = 2 if name == "base64_blob" else 1
        hits = column(spark, values, F.array_contains(secrets.secret_names(F.col("v")), name))
        assert hits == [True] * (len(values) - misses) + [False] * misses
        if name != "base64_blob":
            assert hits == column(spark, values, F.col("v").rlike(pattern))
    assert column(spark, [None], secrets.free_text(F.col("v"))) == [None]
    # a text that holds none of a pattern's literals is not searched for it
    plan = spark.range(1).select(secrets.secret_names(F.col("id").cast("string")).alias("t"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in text and "length(" in text
