"""Our own inputs for the 34 labelled cases, generated from their descriptions."""

import hashlib
import json
import random
from datetime import UTC, datetime, timedelta

START = datetime(2026, 9, 1, 10, tzinfo=UTC)
MIB = 1024 * 1024


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f+0000")


class Case:
    def __init__(self, rule, kind, name, entity=None, baselines=()):
        self.rule, self.kind, self.name = rule, kind, name
        self.entity, self.baselines = entity, baselines
        self.lines = []
        self.rng = random.Random(name)

    def add(self, seconds, kind, src, dest, port, sport=40000, **objects):
        record = {
            "timestamp": stamp(seconds), "flow_id": len(self.lines) + 1, "event_type": kind,
            "src_ip": src, "src_port": sport, "dest_ip": dest, "dest_port": port, "proto": "TCP", **objects}
        self.lines.append(json.dumps(record))

    def flow(self, seconds, src, dest, port, out=600, answered=True, app=None):
        body = {"start": stamp(seconds), "bytes_toserver": out, "bytes_toclient": 400,
                "pkts_toserver": 3, "pkts_toclient": 4 if answered else 0}
        extra = {} if app is None else {"app_proto": app}
        self.add(seconds, "flow", src, dest, port, flow=body, **extra)

    def auth(self, seconds, src, dest, port, signature, sid, category="Attempted Administrator Privilege Gain"):
        self.add(seconds, "alert", src, dest, port,
                 alert={"signature": signature, "signature_id": sid, "category": category, "severity": 2})

    def dns(self, seconds, client, name, rrtype="A", rcode=None, resolver="10.10.0.53"):
        if rcode is None:
            self.add(seconds, "dns", client, resolver, 53, dns={"type": "query", "rrname": name, "rrtype": rrtype})
        else:
            self.add(seconds, "dns", resolver, client, 40000, sport=53,
                     dns={"type": "answer", "rrname": name, "rrtype": rrtype, "rcode": rcode})

    def labels(self):
        positive = self.kind == "positive"
        seconds = 600 if self.rule in ("D-001", "D-002", "D-003") else 3600
        lines = [f"case_id: {self.rule}-{self.name}", f"rule_id: {self.rule}",
                 f"expected: {'detection' if positive else 'no_detection'}"]
        if positive:
            lines += [f'expected_entity: {{ type: src_ip, value: "{self.entity}" }}', "expected_min_severity: 3"]
        end = START + timedelta(seconds=seconds)
        lines.append(f'window: {{ start: "{START:%Y-%m-%dT%H:%M:%SZ}", end: "{end:%Y-%m-%dT%H:%M:%SZ}" }}')
        if self.baselines:
            lines.append("baselines:")
            for b in self.baselines:
                lines.append("  - " + json.dumps(b))
        return "\n".join(lines) + "\n"


def baseline(address, mean, stddev, p95, n):
    return {"address": address, "metric": "outbound_bytes_per_hour", "window_days": 7, "mean": mean * MIB,
            "stddev": stddev * MIB, "p95": p95 * MIB, "sample_count": n}


def random_label(rng, n, alphabet="abcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def distinct_label(rng, n):
    """n different characters: entropy log2(n)."""
    return "".join(rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", n))


def all_cases():
    out = []

    def case(*args, **kw):
        made = Case(*args, **kw)
        out.append(made)
        return made

    a, host = "10.10.0.21", "10.10.0.5"
    c = case("D-001", "positive", "forty-ports", a)
    for i in range(40):
        c.flow(i * 3, a, host, 1000 + i, answered=False)
    c = case("D-001", "positive", "one-port-thirty-hosts", a)
    for i in range(30):
        c.flow(i * 3, a, f"10.10.1.{i + 1}", 445, answered=i % 3 == 0)
    c = case("D-001", "positive", "slow-mixed", a)
    for i in range(50):
        c.flow(i * 9.6, a, f"10.10.2.{i // 2 + 1}", 22 if i % 2 else 3389, answered=False)
    for i in range(60):
        c.flow(i * 8, "10.10.0.22", "10.10.0.80", 443)
    c = case("D-001", "negative", "one-service")
    for i in range(200):
        c.flow(i * 2, a, host, 22)
    c = case("D-001", "negative", "one-resolver")
    for i in range(300):
        c.dns(i * 1.5, a, f"www{i % 9}.example.com")
        c.flow(i * 1.5, a, "10.10.0.53", 53)
    c = case("D-001", "negative", "health-checks")
    for i in range(60):
        c.flow(i * 9, a, f"10.10.3.{i % 4 + 1}", (80, 443, 9100)[i // 4 % 3])
    c = case("D-001", "negative", "below-threshold")
    for i in range(32):
        c.flow(i * 5, a, f"10.10.4.{i % 8 + 1}", 80 if i // 8 % 2 else 443, answered=False)

    b = "10.10.0.66"
    c = case("D-002", "positive", "ssh", b)
    for i in range(200):
        c.auth(i * 0.45, b, host, 22, "SSH Brute Force attempt", 2001219)
    c = case("D-002", "positive", "web-login", b)
    for i in range(60):
        c.auth(i * 1.6, b, "10.10.0.80", 443, "WEB login failed for account", 3000001, "Misc")
    c = case("D-002", "positive", "two-services", b)
    for i in range(12):
        c.auth(i * 5, b, host, 22, "SSH invalid user", 11)
        c.auth(i * 5 + 1, b, host, 3389, "RDP failed password", 12)
        c.flow(i * 5, "10.10.0.9", host, 443)
        c.auth(i * 50, "10.10.0.10", host, 80, "ordinary scan of headers", 13, "Misc activity")
    c = case("D-002", "negative", "eight")
    for i in range(8):
        c.auth(i * 3.5, b, host, 22, "SSH brute force", 1)
    c = case("D-002", "negative", "typo-then-success")
    for i in range(3):
        c.auth(i * 4, b, host, 22, "SSH auth fail", 1)
    c.flow(20, b, host, 22)
    c = case("D-002", "negative", "steady-probe")
    for i in range(10):
        c.auth(i * 60, b, host, 22, "SSH login fail", 1)
    c = case("D-002", "negative", "unrelated")
    for i in range(100):
        c.auth(i * 1, b, host, 80, "HTTP suspicious header", 1, "Potentially Bad Traffic")

    d = "10.10.0.40"
    c = case("D-003", "positive", "tunnel", d)
    for i in range(300):
        c.dns(i * 1.9, d, hashlib.sha1(str(i).encode()).hexdigest() + ".t.exfil.test", "TXT")
    c = case("D-003", "positive", "generated-domains", d)
    for i in range(120):
        name = random_label(c.rng, 14) + ".test"
        c.dns(i * 4, d, name)
        c.dns(i * 4 + 0.5, d, name, rcode="NXDOMAIN" if i < 110 else "NOERROR")
    c = case("D-003", "positive", "long-labels", d)
    for i in range(40):
        c.dns(i * 10, d, ("chunk%02d" % i + "a" * 48)[:48] + ".up.example.test")
    c = case("D-003", "negative", "cdn")
    for i in range(120):
        c.dns(i * 4, d, f"d{i % 8}x9k2m4q7w8e1r5t.cloudfront.net")
    c = case("D-003", "negative", "dnssec")
    for i in range(100):
        c.dns(i * 5, d, ("_dmarc." if i % 2 else "") + f"site{i % 30}.example", "TXT" if i % 2 else "DNSKEY")
    c = case("D-003", "negative", "resolver-volume")
    for i in range(400):
        c.dns(i * 1.4, d, f"host-{i % 150:03d}.corp.example.test")
        c.dns(i * 1.4 + 0.2, d, f"host-{i % 150:03d}.corp.example.test", rcode="NXDOMAIN" if i % 20 == 0 else "NOERROR")

    e, ext = "10.10.0.30", "203.0.113.50"
    c = case("D-004", "positive", "minute", e)
    for i in range(58):
        c.flow(30 + i * 60 + c.rng.uniform(-1.2, 1.2), e, ext, 443, app="tls")
    c = case("D-004", "positive", "five-minutes", e)
    for i in range(11):
        c.flow(60 + i * 300 + c.rng.uniform(-9, 9), e, ext, 8443)
    c = case("D-004", "positive", "among-noise", e)
    for i in range(70):
        c.flow(20 + i * 45 + c.rng.uniform(-0.9, 0.9), e, ext, 443)
    for i in range(100):
        c.flow(c.rng.uniform(0, 3599), e, f"198.51.100.{i % 40 + 1}", 443)
    c = case("D-004", "negative", "irregular")
    t = 0.0
    for i in range(40):
        t += c.rng.choice([5, 20, 60, 180, 240])
        c.flow(t % 3599, e, ext, 443)
    c = case("D-004", "negative", "internal-heartbeat")
    for i in range(110):
        c.flow(i * 30, e, "10.10.0.200", 9200)
    c = case("D-004", "negative", "ntp")
    for i in range(58):
        c.flow(i * 60, e, ext, 123, app="ntp")
    c = case("D-004", "negative", "alternating")
    t = 0
    for i in range(12):
        t += 180 if i % 2 else 420
        c.flow(t % 3600, e, ext, 443)

    v = "10.10.0.31"
    for name, total, flows, stats in (
        ("ten-times", 400, 1, (20, 5, 30, 168)),
        ("quiet-host", 120, 1, (1, 0.5, 2, 168)),
        ("many-flows", 250, 100, (50, 10, 80, 168)),
    ):
        c = case("D-005", "positive", name, v, [baseline(v, *stats)])
        for i in range(flows):
            c.flow(60 + i * 30, v, ext, 443, out=total * MIB // flows + 1)
    c = case("D-005", "negative", "few-samples", None, [baseline(v, 20, 5, 30, 5)])
    c.flow(60, v, ext, 443, out=300 * MIB)
    c = case("D-005", "negative", "no-baseline")
    c.flow(60, v, ext, 443, out=300 * MIB)
    c = case("D-005", "negative", "inbound", None, [baseline(v, 20, 5, 30, 168)])
    c.flow(60, ext, v, 443, out=500 * MIB)
    c = case("D-005", "negative", "busy-server", None, [baseline(v, 500, 100, 700, 168)])
    c.flow(60, v, ext, 443, out=650 * MIB)
    return out


def write(root):
    for case in all_cases():
        folder = root / case.rule / case.kind / case.name
        folder.mkdir(parents=True)
        (folder / "labels.yml").write_text(case.labels())
        (folder / "events.ndjson").write_text("\n".join(case.lines) + "\n")
