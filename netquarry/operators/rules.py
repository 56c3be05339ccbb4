"""The five detection rules, their shared scan, and their registry.

A rule says which events serve it and on which fine keys they are tallied (host and port, name,
instant, …), and folds stored tallies into firing ``(window, entity)`` groups. All rules of a run
share two reads of the events:

1. one expansion tags each event with the rules it serves, and one exchange tallies them all, so the
   rows of one busy source are combined in their own tasks before they meet;
2. the groups that fired, few beside the events, pick their contributors for samples.

Lists, bursts and intervals come from the stored tallies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.dns import (
    ALLOWED_SUFFIXES,
    base_domain,
    canonical_name,
    has_long_label,
    is_allowed,
    looks_random,
)
from netquarry.functions.ip import ip_in, is_internal
from netquarry.functions.scoring import AUTH_PATTERNS, is_auth_failure
from netquarry.functions.timing import bucket_seconds, iso_utc
from netquarry.operators.pieces import (
    densest_span,
    gathered_samples,
    interval_stats,
    sampled_in_place,
    smallest_k,
)
from netquarry.session import materialize, stored

# fixed values
SATURATION = 3.0
MIB = 1024 * 1024
METRIC = "outbound_bytes_per_hour"
KEYS = ["_b", "_entity"]
PIECES_PER_WINDOW = 30


class Checked:
    """Refuses thresholds that would fire on nothing or divide by zero."""

    positive: ClassVar[tuple[str, ...]] = ()

    def __post_init__(self) -> None:
        for name in self.positive:
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{type(self).__name__}.{name} must be above zero, not {value}")


# fixed values: the defaults of the parameters below
@dataclass(frozen=True)
class PortScanParams(Checked):
    positive = ("distinct_ports", "distinct_hosts", "min_flows")
    distinct_ports: int = 20
    distinct_hosts: int = 15
    min_flows: int = 20


@dataclass(frozen=True)
class AuthBurstParams(Checked):
    positive = ("failures", "burst_seconds", "burst")
    failures: int = 10
    burst_seconds: int = 120
    burst: int | None = None
    """how many failures the densest span must hold; ``failures`` when not given"""
    signature_patterns: tuple[str, ...] = AUTH_PATTERNS


@dataclass(frozen=True)
class DnsParams(Checked):
    positive = (
        "unique_subdomains", "entropy_threshold", "long_label_chars", "long_queries",
        "nxdomain_failures", "nxdomain_ratio",
    )
    unique_subdomains: int = 50
    entropy_threshold: float = 3.5
    long_label_chars: int = 40
    long_queries: int = 20
    nxdomain_failures: int = 50
    nxdomain_ratio: float = 0.5
    allowed_suffixes: tuple[str, ...] = ALLOWED_SUFFIXES


@dataclass(frozen=True)
class BeaconParams(Checked):
    positive = ("min_connections", "min_interval_seconds", "max_jitter")
    min_connections: int = 10
    min_interval_seconds: float = 5.0
    max_jitter: float = 0.15
    allowed_ports: tuple[int, ...] = (53, 67, 68, 123, 1900, 5353)
    allowed_app_protos: tuple[str, ...] = ("dns", "dhcp", "ntp", "mdns")
    allowed_destinations: tuple[str, ...] = ()
    include_internal: bool = False


@dataclass(frozen=True)
class VolumeParams(Checked):
    positive = ("min_bytes", "min_samples", "full_confidence_samples")
    stddev_multiplier: float = 3.0
    p95_multiplier: float = 2.0
    min_bytes: int = 50 * MIB
    min_samples: int = 24
    full_confidence_samples: int = 168


@dataclass(frozen=True)
class Feed:
    """Which events serve a rule, whom they count for, and what is tallied."""

    kept: Column
    entity: Column
    #: up to three keys of the finest tallies, and whether each instant is a key too
    keys: tuple[Column, ...]
    instants: bool = False
    #: up to two sums
    amounts: tuple[Column, ...] = ()
    #: contributors are told apart by this too (as well as by window and entity)
    part: Column | None = None
    peak: Column | None = None
    note: Column | None = None


@dataclass(frozen=True)
class Plan:
    """``feed(params)`` names the events, ``fire`` folds tallies into firing groups, ``look`` adds
    what only the contributors of firing groups tell, ``evidence`` names the fields. ``looks`` names
    the fields that ``look`` reads beside keys, instant and id; without it they all travel."""

    feed: Callable[[Any], Feed]
    fire: Callable[..., DataFrame]
    evidence: Callable[[Any], list[Column]]
    look: Callable[..., DataFrame] | None = None
    looks: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    base_severity: int
    window_seconds: int
    detect: Callable[..., DataFrame]
    params: Any
    version: int = 1
    needs_baselines: bool = False
    mitre_hint: str = ""
    #: how the rule takes part in a shared scan; a rule without one is run by ``detect`` alone
    plan: Plan | None = None

    def spec(self) -> dict[str, Any]:
        return {
            "rule_id": self.rule_id,
            "name": self.name,
            "version": self.version,
            "base_severity": self.base_severity,
            "window_seconds": self.window_seconds,
            "params": asdict(self.params),
        }

    def run(
        self,
        events: DataFrame,
        baselines: DataFrame | None = None,
        detail: bool = True,
        scope: Sequence[str] = (),
    ) -> DataFrame:
        """Firing windows. ``detail`` adds the sampled contributors; ``scope`` names columns
        that separate independent corpora held in one table."""
        if self.needs_baselines:
            if baselines is None:
                raise ValueError(f"{self.rule_id} needs baselines")
            return self.detect(
                events, baselines, self.params, rule=self, detail=detail, scope=scope
            )
        return self.detect(events, self.params, rule=self, detail=detail, scope=scope)


def _signal(ratio: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), ratio / SATURATION), 4)


def _share(part: Column, whole: Column) -> Column:
    return F.bround(F.lit(0.5) + F.lit(0.5) * part / whole, 4)


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.expr("CAST(array() AS ARRAY<STRING>)"))


def _firing(rows: DataFrame, fired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the groups that fired, which are stored and few."""
    return rows.join(fired.select(*keys), list(keys), "left_semi")


def _text(value: Column | None) -> Column:
    return F.lit(None).cast("string") if value is None else value.cast("string")


def _number(value: Column | None) -> Column:
    return F.lit(None).cast("bigint") if value is None else value.cast("bigint")


def _tag(rule: Rule) -> tuple[Column, Column]:
    """Whether an event serves a rule, and its fields for that rule."""
    feed = rule.plan.feed(rule.params)
    key = dict(enumerate(feed.keys))
    amount = dict(enumerate(feed.amounts))
    fields = F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        feed.entity.cast("string").alias("_entity"),
        bucket_seconds(F.col("event_time"), rule.window_seconds).cast("bigint").alias("_b"),
        *[_text(key.get(i)).alias(f"k{i + 1}") for i in range(3)],
        _number(F.unix_micros("event_time") if feed.instants else None).alias("_at"),
        *[_number(amount.get(i)).alias(f"s{i + 1}") for i in range(2)],
        F.coalesce(_text(feed.part), F.lit("")).alias("_part"),
        _number(feed.peak).alias("_weight"),
        _text(feed.note).alias("_note"),
    )
    return feed.kept & feed.entity.isNotNull(), fields


def tagged(
    events: DataFrame, rules: Sequence[Rule], scope: Sequence[str] = (), every: bool = False
) -> DataFrame:
    """One row for each event and rule that it serves, in one layout. ``every`` adds a row with
    the rule ``*`` for each event, so that the tallies count them all."""
    tags = [_tag(rule) for rule in rules]
    at = F.unix_micros("event_time").alias("_us")
    if len(tags) == 1 and not every:
        kept, fields = tags[0]
        rows = events.filter(kept).select(*scope, "id", at, fields.alias("_t"))
        return rows.select(*scope, "id", "_us", "_t.*")
    served = [F.when(kept, fields) for kept, fields in tags]
    if every:
        shape = tags[0][1]
        nothing = F.struct(
            F.lit("*").alias("rule_id"),
            *[
                F.lit(None).cast(kind).alias(name)
                for name, kind in events.select(shape.alias("t")).select("t.*").dtypes
                if name != "rule_id"
            ],
        )
        served.append(nothing)
    # the tags are columns first and the empty ones go after the expansion: a function over the
    # array would have Spark interpret every expression in it, row by row
    names = [f"_t{i}" for i in range(len(served))]
    laid = events.select(*scope, "id", at, *[tag.alias(n) for tag, n in zip(served, names, strict=True)])
    expanded = laid.select(*scope, "id", "_us", F.explode(F.array(*names)).alias("_t"))
    return expanded.filter(F.col("_t").isNotNull()).select(*scope, "id", "_us", "_t.*")


def tallied(tags: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The finest tallies of all rules. Sums, counts and ends only: they combine map-side."""
    return tags.groupBy("rule_id", *scope, *KEYS, "k1", "k2", "k3", "_at").agg(
        F.count("*").alias("n"),
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
        F.min("_us").alias("lo"),
        F.max("_us").alias("hi"),
    )


def _looks(rule: Rule, fields: Sequence[str]) -> list[str]:
    """Those of the fields that the rule's ``look`` reads."""
    if rule.plan.look is None:
        return []
    return [c for c in fields if rule.plan.looks is None or c in rule.plan.looks]


def contributors(
    events: DataFrame,
    rules: Sequence[Rule],
    asked: DataFrame,
    detail: bool,
    scope: Sequence[str] = (),
) -> DataFrame:
    """The events behind the groups ``asked`` for (rule_id, scope, keys, _part): one row for each
    group and event, with its ``_piece`` of time, the fields that a rule looks at, and ``_weight``
    with ``detail``.

    An event moves once for each entity, not once for each rule: rows are dealt by entity and piece
    of time, where they meet all that is asked there. What is asked is stored as files, which tell
    Spark its size: a short list goes to the events, and only beside a long one do they move."""
    tags = [_tag(rule) for rule in rules]
    place = [*scope, "_entity", "_piece"]
    width = max(1, max(r.window_seconds for r in rules) // PIECES_PER_WINDOW)
    base = ("rule_id", "_entity", "_b", "_part", "_weight")
    fields = [c for c in tagged(events, rules[:1], scope).columns if c not in (*base, *scope, "id", "_us")]
    laid = events.select(
        *scope,
        "id",
        F.unix_micros("event_time").alias("_us"),
        *[F.when(kept, tag).alias(f"_t{i}") for i, (kept, tag) in enumerate(tags)],
    )
    held: list[Column] = []
    for i, rule in enumerate(rules):
        feed = rule.plan.feed(rule.params)
        own = [
            *(["_part"] if feed.part is not None else []),
            *(["_weight"] if detail and feed.peak is not None else []),
            *_looks(rule, fields),
        ]
        held += [F.col(f"_t{i}.{c}").alias(f"_{i}{c}") for c in own]
    whom = [F.col(f"_t{i}._entity").alias(f"_e{i}") for i in range(len(rules))]
    listed = laid.select(*scope, "id", "_us", *held, *whom)
    names = [c for c in listed.columns if c not in (*scope, *[f"_e{i}" for i in range(len(rules))])]
    whoever = F.explode(F.array_distinct(F.array(*[f"_e{i}" for i in range(len(rules))])))
    served = [F.when(F.col(f"_e{i}") == F.col("_entity"), 1 << i).otherwise(0) for i in range(len(rules))]
    dealt = (
        listed.select("*", whoever.alias("_entity"))
        .filter(F.col("_entity").isNotNull())
        .select(
            *scope,
            "_entity",
            F.floor(F.col("_us") / F.lit(width * 1_000_000)).cast("bigint").alias("_piece"),
            *names,
            F.coalesce(reduce(Column.__add__, served), F.lit(0)).alias("_serves"),
        )
    )

    number = F.lit(None).cast("int")
    seconds = F.lit(None).cast("int")
    for i, rule in enumerate(rules):
        number = F.when(F.col("rule_id") == rule.rule_id, i).otherwise(number)
        seconds = F.when(F.col("rule_id") == rule.rule_id, rule.window_seconds).otherwise(seconds)
    last = F.floor((F.col("_b") + seconds - 1) / width)
    pieces = F.explode(F.sequence(F.floor(F.col("_b") / width), last))
    asks = (
        asked.select("*", number.alias("_i"), seconds.alias("_s"), pieces.alias("_piece"))
        .groupBy(*place)
        .agg(F.collect_list(F.struct("rule_id", "_i", "_s", "_b", "_part")).alias("_asks"))
    )
    asks = stored(asks, "asked")

    def of_rule(field: str) -> Column:
        found = [F.when(F.col("_a._i") == i, F.col(c)) for i in range(len(rules)) if (c := f"_{i}{field}") in names]
        return F.coalesce(*found) if found else F.lit(None)

    second = F.floor(F.col("_us") / F.lit(1_000_000)).cast("bigint")
    met = (
        dealt.join(asks, place)
        .select(*place, *names, "_serves", F.explode("_asks").alias("_a"))
        .filter(
            (F.col("_serves").bitwiseAND(F.expr("shiftleft(1, _a._i)")) != 0)
            & (second - F.pmod(second, F.col("_a._s")) == F.col("_a._b"))
            & (F.coalesce(of_rule("_part"), F.lit("")) == F.col("_a._part"))
        )
    )
    read = {c for rule in rules for c in _looks(rule, fields)}
    return met.select(
        F.col("_a.rule_id").alias("rule_id"),
        *place,
        F.col("_a._b").alias("_b"),
        F.col("_a._part").alias("_part"),
        "_us",
        "id",
        *([of_rule("_weight").cast("bigint").alias("_weight")] if detail else []),
        *[of_rule(c).alias(c) for c in fields if c in read],
    )


def run_rules(
    events: DataFrame,
    rules: Sequence[Rule],
    baselines: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    detail: bool = True,
    scope: Sequence[str] = (),
    every: bool = False,
    failed: Callable[[Rule, Exception], None] | None = None,
) -> tuple[dict[str, DataFrame], int | None]:
    """Firing groups by rule, from two reads of ``events``; with ``every`` also how many events
    there were.

    ``baselines`` is keyed by address, or makes such a table from the rule's tallies. A rule whose
    groups cannot be formed is handed to ``failed`` while the others go on."""
    keys = [*scope, *KEYS]
    tags = tagged(events, rules, scope, every)
    tallies = stored(tallied(tags, scope), "tallies", by=["rule_id"])
    total = None
    if every:
        total = tallies.filter(F.col("rule_id") == "*").agg(F.sum("n")).first()[0] or 0

    own: dict[str, DataFrame] = {}
    fired: dict[str, DataFrame] = {}
    for rule in rules:
        try:
            own[rule.rule_id] = tallies.filter(F.col("rule_id") == rule.rule_id).drop("rule_id")
            history = baselines
            if rule.needs_baselines and callable(baselines):
                history = baselines(own[rule.rule_id])
            extra = [history] if rule.needs_baselines else []
            groups = rule.plan.fire(own[rule.rule_id], *extra, rule.params, keys)
            if "_part" not in groups.columns:
                groups = groups.withColumn("_part", F.lit(""))
            fired[rule.rule_id] = materialize(groups)
        except Exception as error:
            if failed is None:
                raise
            failed(rule, error)
    going = [rule for rule in rules if rule.rule_id in fired]
    if not going:
        return {}, total

    asking = [rule for rule in going if detail or rule.plan.look is not None]
    rows = samples = None
    if asking:
        asked = reduce(
            DataFrame.unionByName,
            [
                fired[r.rule_id].select(F.lit(r.rule_id).alias("rule_id"), *keys, "_part")
                for r in asking
            ],
        )
        rows = contributors(events, asking, asked, detail, scope)
        looking = [r.rule_id for r in asking if r.plan.look is not None]
        if detail:
            # the look columns only break ties: both reads of the dealt rows then read the same
            looks = [c for c in rows.columns if c not in ("rule_id", *keys, "_part", "_piece", "_us", "id", "_weight")]
            rows = sampled_in_place(
                rows, ["rule_id", *keys], [*scope, "_entity", "_piece"], ["_us", "id", *looks], "_weight"
            )
            rows = rows.filter(F.col("role").isNotNull() | F.col("rule_id").isin(looking))
        rows = stored(rows.drop("_piece", "_weight"), "contributors", by=["rule_id"])
    if detail:
        picked = rows.filter(F.col("role").isNotNull())
        samples = materialize(gathered_samples(picked, ["rule_id", *keys], "id"))
    found = {}
    for rule in going:
        groups = fired[rule.rule_id]
        if rule.plan.look is not None:
            theirs = rows.filter(F.col("rule_id") == rule.rule_id)
            groups = rule.plan.look(groups, own[rule.rule_id], theirs, rule.params, keys)
        picked = None
        if samples is not None:
            picked = samples.filter(F.col("rule_id") == rule.rule_id).drop("rule_id")
        found[rule.rule_id] = _finish(rule, groups, picked, scope)
    return found, total


def _finish(
    rule: Rule, fired: DataFrame, samples: DataFrame | None, scope: Sequence[str]
) -> DataFrame:
    """The common output shape. ``fired`` carries ``_b, _entity, first_us, last_us, signal,
    confidence, event_count`` and what the evidence names."""
    start = F.timestamp_seconds(F.col("_b"))
    end = F.timestamp_seconds(F.col("_b") + rule.window_seconds)
    full = F.struct(
        *rule.plan.evidence(rule.params),
        iso_utc(start).alias("window_start"),
        iso_utc(end).alias("window_end"),
    )
    shown = F.expr("CAST(array() AS ARRAY<STRUCT<event_id: STRING, role: STRING>>)")
    if samples is not None:
        fired = fired.join(samples, [*scope, *KEYS], "left")
        shown = F.coalesce(F.col("samples"), shown)
    return fired.select(
        *scope,
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.version).alias("rule_version"),
        F.lit("src_ip").alias("entity_type"),
        F.col("_entity").alias("entity_value"),
        start.alias("window_bucket"),
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        F.col("signal").alias("signal_strength"),
        F.col("confidence"),
        F.col("event_count").cast("bigint").alias("event_count"),
        full.alias("evidence"),
        shown.alias("samples"),
    )


def _alone(
    rule_id: str,
    events: DataFrame,
    params: Any,
    rule: Rule | None,
    detail: bool,
    scope: Sequence[str],
    baselines: DataFrame | None = None,
) -> DataFrame:
    """One rule as a run of its own."""
    chosen = replace(rule or RULES[rule_id], params=params, plan=RULES[rule_id].plan)
    found, _ = run_rules(events, [chosen], baselines, detail, scope)
    return found[chosen.rule_id]


# ------------------------------------------------------------------ D-001


def detect_port_scan(
    events: DataFrame,
    params: PortScanParams = PortScanParams(),
    *,
    rule: Rule | None = None,
    detail: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """One source touching many distinct ports or hosts in a window."""
    return _alone("D-001", events, params, rule, detail, scope)


def _scan_feed(params: PortScanParams) -> Feed:
    silent = F.coalesce(F.col("pkts_toclient"), F.lit(0)) == 0
    return Feed(
        kept=(F.col("event_type") == "flow")
        & F.col("dest_ip").isNotNull()
        & F.col("dest_port").isNotNull(),
        entity=F.col("src_ip"),
        keys=(F.col("dest_ip"), F.col("dest_port")),
        amounts=(silent.cast("int"),),
    )


def _scan_fire(tallies: DataFrame, params: PortScanParams, keys: Sequence[str]) -> DataFrame:
    targets = tallies.withColumn("k2", F.col("k2").cast("int"))
    counted = targets.groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        F.sum("s1").alias("unanswered"),
        F.count("*").alias("targets"),
        F.count_distinct("k2").alias("ports"),
        F.count_distinct("k1").alias("hosts"),
        F.min("lo").alias("first_us"),
        F.max("hi").alias("last_us"),
    )
    ratio = F.greatest(
        F.col("ports") / params.distinct_ports, F.col("hosts") / params.distinct_hosts
    )
    fired = materialize(
        counted.filter(
            (F.col("event_count") >= params.min_flows)
            & (
                (F.col("ports") >= params.distinct_ports)
                | (F.col("hosts") >= params.distinct_hosts)
            )
        )
        .withColumn("signal", _signal(ratio))
        .withColumn("confidence", _share(F.col("unanswered"), F.col("event_count")))
    )
    touched = _firing(targets, fired, keys)
    return fired.join(smallest_k(touched, keys, "k2", 20, "sample_ports"), keys, "left").join(
        smallest_k(touched, keys, "k1", 10, "sample_hosts"), keys, "left"
    )


def _scan_evidence(params: PortScanParams) -> list[Column]:
    return [
        F.col("ports").alias("distinct_dest_ports"),
        F.col("hosts").alias("distinct_dest_hosts"),
        F.col("targets").alias("distinct_targets"),
        F.col("event_count").alias("flows"),
        F.col("unanswered").alias("unanswered_flows"),
        F.lit(params.distinct_ports).alias("threshold_ports"),
        F.lit(params.distinct_hosts).alias("threshold_hosts"),
        F.col("sample_ports").alias("sample_dest_ports"),
        F.col("sample_hosts").alias("sample_dest_hosts"),
    ]


# ------------------------------------------------------------------ D-002


def detect_auth_burst(
    events: DataFrame,
    params: AuthBurstParams = AuthBurstParams(),
    *,
    rule: Rule | None = None,
    detail: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Authentication-failure signatures bursting inside a short span."""
    return _alone("D-002", events, params, rule, detail, scope)


def _burst_feed(params: AuthBurstParams) -> Feed:
    target = F.when(
        F.col("dest_ip").isNotNull(),
        F.concat(
            F.col("dest_ip"),
            F.coalesce(F.concat(F.lit(":"), F.col("dest_port").cast("string")), F.lit("")),
        ),
    )
    return Feed(
        kept=(F.col("event_type") == "alert")
        & is_auth_failure(
            F.col("sig_signature"), F.col("sig_category"), params.signature_patterns
        ),
        entity=F.col("src_ip"),
        keys=(
            target,
            F.col("sig_signature_id"),
            F.when(F.col("sig_category") != "", F.col("sig_category")),
        ),
        instants=True,
    )


def _burst_fire(tallies: DataFrame, params: AuthBurstParams, keys: Sequence[str]) -> DataFrame:
    need = params.failures if params.burst is None else params.burst
    parts = tallies.withColumn("k2", F.col("k2").cast("bigint"))
    counted = parts.groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        F.count_distinct("k1").alias("targets"),
        F.min("lo").alias("first_us"),
        F.max("hi").alias("last_us"),
    )
    enough = materialize(counted.filter(F.col("event_count") >= params.failures))
    touched = _firing(parts, enough, keys)
    spans = densest_span(touched, keys, "_at", params.burst_seconds, weight="n")
    fired = (
        enough.join(spans, keys)
        .filter(F.col("max_burst") >= need)
        .withColumn("signal", _signal(F.col("max_burst") / need))
        .withColumn("confidence", _share(F.col("max_burst"), F.col("event_count")))
    )
    fired = materialize(fired)
    touched = _firing(parts, fired, keys)
    for value, k, name in (
        ("k1", 10, "sample_targets"),
        ("k2", 10, "signature_ids"),
        ("k3", 5, "sample_categories"),
    ):
        fired = fired.join(smallest_k(touched, keys, value, k, name), keys, "left")
    return fired


def _burst_evidence(params: AuthBurstParams) -> list[Column]:
    need = params.failures if params.burst is None else params.burst
    return [
        F.col("event_count").alias("failures"),
        F.col("max_burst"),
        F.lit(params.burst_seconds).alias("burst_seconds"),
        F.lit(need).alias("threshold"),
        F.col("targets").alias("distinct_targets"),
        _strings(F.col("sample_targets")).alias("sample_targets"),
        F.coalesce(
            F.col("signature_ids"), F.expr("CAST(array() AS ARRAY<BIGINT>)")
        ).alias("signature_ids"),
        _strings(F.col("sample_categories")).alias("sample_categories"),
    ]


# ------------------------------------------------------------------ D-003


def detect_dns_anomaly(
    events: DataFrame,
    params: DnsParams = DnsParams(),
    *,
    rule: Rule | None = None,
    detail: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Random names under one domain, NXDOMAIN storms, over-long labels, per client."""
    return _alone("D-003", events, params, rule, detail, scope)


def _dns_feed(params: DnsParams) -> Feed:
    answer = F.col("dns_rcode").isNotNull()
    asked = (~answer) & (F.coalesce(F.col("dns_query"), F.lit("")) != "")
    return Feed(
        kept=F.col("event_type") == "dns",
        entity=F.when(answer, F.col("dest_ip")).otherwise(F.col("src_ip")),
        keys=(F.when(asked, canonical_name(F.col("dns_query"))),),
        amounts=(
            answer.cast("int"),
            F.coalesce(F.upper("dns_rcode") == "NXDOMAIN", F.lit(False)).cast("int"),
        ),
    )


def _domains(names: DataFrame, params: DnsParams, keys: Sequence[str]) -> DataFrame:
    """Tallies of each client's domains, with ``judged``: whether the domain counts."""
    name = F.col("k1")
    domain = F.when(name.isNotNull(), base_domain(name))
    long_name = has_long_label(name, params.long_label_chars) & ~is_allowed(
        name, params.allowed_suffixes
    )
    return (
        names.groupBy(*keys, domain.alias("domain"))
        .agg(
            F.count("k1").alias("names"),
            F.count_if(looks_random(name, params.entropy_threshold)).alias("random"),
            F.count_if(F.coalesce(long_name, F.lit(False))).alias("long"),
            F.sum("n").alias("n"),
            F.sum("s1").alias("answers"),
            F.sum("s2").alias("nx"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        .withColumn(
            "judged",
            F.col("domain").isNotNull() & ~is_allowed(F.col("domain"), params.allowed_suffixes),
        )
    )


def _dns_fire(tallies: DataFrame, params: DnsParams, keys: Sequence[str]) -> DataFrame:
    """Three levels of grouping, each on a prefix of the keys before: name, domain, client."""
    tunnelled = (
        F.col("judged")
        & (F.col("names") >= params.unique_subdomains)
        & (F.col("random") * 2 >= F.col("names"))
    )
    clients = _domains(tallies, params, keys).groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        F.sum("answers").alias("answers"),
        F.sum("nx").alias("nx"),
        F.sum("names").alias("distinct_names"),
        F.sum("long").alias("long_names"),
        F.max(F.when(tunnelled, F.col("names"))).alias("tunnel_names"),
        F.min("lo").alias("first_us"),
        F.max("hi").alias("last_us"),
    )
    tunnel = F.col("tunnel_names") / params.unique_subdomains
    storm = F.when(
        (F.col("nx") >= params.nxdomain_failures)
        & (F.col("nx") / F.nullif(F.col("answers"), F.lit(0)) >= params.nxdomain_ratio),
        F.col("nx") / params.nxdomain_failures,
    )
    labels = F.when(
        F.col("long_names") >= params.long_queries, F.col("long_names") / params.long_queries
    )
    signals = F.array_compact(
        F.array(
            F.when(labels.isNotNull(), F.lit("long_labels")),
            F.when(storm.isNotNull(), F.lit("nxdomain")),
            F.when(tunnel.isNotNull(), F.lit("tunnel")),
        )
    )
    return (
        clients.withColumn("signals", signals)
        .filter(F.size("signals") > 0)
        .withColumn("signal", _signal(F.greatest(tunnel, storm, labels)))
        .withColumn(
            "confidence",
            F.bround(
                F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.2) * (F.size("signals") - 1)), 4
            ),
        )
    )


def _dns_look(
    fired: DataFrame, tallies: DataFrame, rows: DataFrame, params: DnsParams, keys: Sequence[str]
) -> DataFrame:
    """The domain with most names; of equals the one whose first query comes first."""
    domains = _domains(_firing(tallies, fired, keys), params, keys).filter("judged")
    seen = (
        rows.filter(F.col("k1").isNotNull())
        .groupBy(*keys, base_domain(F.col("k1")).alias("domain"))
        .agg(F.min(F.struct("_us", "id")).alias("seen"))
    )
    top = F.min_by(
        F.struct("domain", "names", "random"),
        F.struct((-F.col("names")).alias("a"), F.col("seen").alias("b")),
    )
    best = domains.join(seen, [*keys, "domain"]).groupBy(*keys).agg(top.alias("top"))
    return fired.join(best, keys, "left")


def _dns_evidence(params: DnsParams) -> list[Column]:
    return [
        F.col("signals"),
        F.col("distinct_names"),
        (F.col("event_count") - F.col("answers")).alias("query_records"),
        F.col("answers"),
        F.col("nx").alias("nxdomain_answers"),
        F.coalesce(
            F.bround(F.try_divide(F.col("nx"), F.col("answers")), 4), F.lit(0.0)
        ).alias("nxdomain_ratio"),
        F.coalesce(F.col("top.domain"), F.lit("")).alias("top_domain"),
        F.coalesce(F.col("top.names"), F.lit(0)).alias("top_domain_names"),
        F.coalesce(F.col("top.random"), F.lit(0)).alias("top_domain_suspicious"),
        F.col("long_names"),
        F.lit(params.unique_subdomains).alias("threshold_unique_subdomains"),
        F.lit(params.nxdomain_failures).alias("threshold_nxdomain"),
        F.lit(params.long_queries).alias("threshold_long_queries"),
    ]


# ------------------------------------------------------------------ D-004


def detect_beaconing(
    events: DataFrame,
    params: BeaconParams = BeaconParams(),
    *,
    rule: Rule | None = None,
    detail: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Regular, low-jitter outbound connections to one destination."""
    return _alone("D-004", events, params, rule, detail, scope)


def _beacon_feed(params: BeaconParams) -> Feed:
    dest = F.col("dest_ip")
    protos = [p.strip().lower() for p in params.allowed_app_protos]
    kept = (
        (F.col("event_type") == "flow")
        & dest.isNotNull()
        & F.col("dest_port").isNotNull()
        & ~F.col("dest_port").isin(*params.allowed_ports)
        & ~F.coalesce(F.lower("app_proto"), F.lit("")).isin(*protos)
    )
    if not params.include_internal:
        kept = kept & ~is_internal(dest)
    for cidr in params.allowed_destinations:
        kept = kept & ~ip_in(dest, cidr)
    place = F.concat_ws(":", "dest_ip", F.col("dest_port").cast("string"))
    return Feed(
        kept=kept,
        entity=F.col("src_ip"),
        keys=(place,),
        instants=True,
        amounts=(F.coalesce("bytes_toserver", F.lit(0)),),
        part=place,
        note=F.col("app_proto"),
    )


def _beacon_fire(tallies: DataFrame, params: BeaconParams, keys: Sequence[str]) -> DataFrame:
    window = RULES["D-004"].window_seconds
    fine = [*keys, "k1"]
    # most places see too few connections, and those need no order: only the others' instants move
    busy = tallies.groupBy(*fine).agg(F.sum("n").alias("_n"))
    busy = stored(busy.filter(F.col("_n") >= params.min_connections).select(*fine), "busy-places")
    tallies = _firing(tallies, busy, fine)
    stats = interval_stats(tallies, fine, "_at", max(1, window // PIECES_PER_WINDOW), weight="n")
    beacons = materialize(
        stats.filter(
            (F.col("connections") >= params.min_connections)
            & (F.col("mean_interval") >= params.min_interval_seconds)
            & (F.col("jitter") <= params.max_jitter)
        ).withColumn("jitter", F.bround("jitter", 4))
    )
    rank = F.struct("jitter", (-F.col("connections")).alias("c"), F.col("k1").alias("_dest"))
    sources = (
        beacons.groupBy(*keys)
        .agg(
            F.min_by(F.struct("k1", "connections", "mean_interval", "jitter"), rank).alias("best"),
            F.sum("connections").alias("event_count"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
        )
        .select(*keys, "best.*", "event_count", "first_us", "last_us")
    )
    sent = (
        tallies.join(sources.select(*fine), fine, "left_semi")
        .groupBy(*keys)
        .agg(F.sum("s1").alias("bytes_out"))
    )
    leaders = smallest_k(beacons.select(*keys, rank.alias("_place")), keys, "_place", 3, "_leaders")
    confidence = F.least(
        F.lit(1.0),
        F.greatest(F.lit(0.5), F.lit(1.0) - F.col("jitter") / params.max_jitter * 0.5),
    )
    return (
        sources.join(sent, keys)
        .join(leaders, keys)
        .withColumnRenamed("k1", "_part")
        .withColumn("signal", _signal(F.col("connections") / params.min_connections))
        .withColumn("confidence", F.bround(confidence, 4))
    )


def _beacon_look(
    fired: DataFrame, tallies: DataFrame, rows: DataFrame, params: BeaconParams, keys: Sequence[str]
) -> DataFrame:
    """The protocol of the first connection."""
    first = F.min_by(F.struct("_note"), F.struct("_us", "id"))
    return fired.join(rows.groupBy(*keys).agg(first.alias("head")), keys, "left")


def _beacon_evidence(params: BeaconParams) -> list[Column]:
    return [
        F.col("_part").alias("destination"),
        F.col("connections"),
        F.bround("mean_interval", 2).alias("mean_interval_seconds"),
        F.col("jitter"),
        F.col("bytes_out"),
        F.coalesce(F.col("head._note"), F.lit("")).alias("app_proto"),
        F.transform("_leaders", lambda x: x["_dest"]).alias("beaconing_destinations"),
        F.lit(params.min_connections).alias("threshold_connections"),
        F.lit(params.max_jitter).alias("max_jitter"),
    ]


# ------------------------------------------------------------------ D-005


def detect_volume_anomaly(
    events: DataFrame,
    baselines: DataFrame,
    params: VolumeParams = VolumeParams(),
    *,
    rule: Rule | None = None,
    detail: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Hourly outbound bytes above the source's own baseline. ``baselines`` is keyed by
    address, one row each; sources without enough history are left alone."""
    return _alone("D-005", events, params, rule, detail, scope, baselines)


def _volume_feed(params: VolumeParams) -> Feed:
    return Feed(
        kept=(F.col("event_type") == "flow")
        & F.col("dest_ip").isNotNull()
        & (F.col("bytes_toserver") > 0)
        & ~is_internal(F.col("dest_ip")),
        entity=F.col("src_ip"),
        keys=(F.col("dest_ip"),),
        amounts=(F.col("bytes_toserver"),),
        peak=F.col("bytes_toserver"),
    )


def _volume_fire(
    tallies: DataFrame, baselines: DataFrame, params: VolumeParams, keys: Sequence[str]
) -> DataFrame:
    scope = [k for k in keys if k not in KEYS]
    known = baselines.filter(
        (F.col("metric") == METRIC) & (F.col("sample_count") >= params.min_samples)
    ).select(
        *scope,
        F.col("address").alias("_entity"),
        "window_days",
        "mean",
        "stddev",
        "p95",
        "sample_count",
    )
    counted = tallies.groupBy(*keys).agg(
        F.sum("s1").alias("bytes_out"),
        F.sum("n").alias("event_count"),
        F.count("*").alias("destinations"),
        F.min("lo").alias("first_us"),
        F.max("hi").alias("last_us"),
    )
    limit = F.floor(
        F.greatest(
            F.col("mean") + params.stddev_multiplier * F.col("stddev"),
            params.p95_multiplier * F.col("p95"),
            F.lit(float(params.min_bytes)),
        )
    ).cast("bigint")
    fired = (
        counted.join(known, [*scope, "_entity"])
        .withColumn("limit_bytes", limit)
        .filter(F.col("bytes_out") >= F.col("limit_bytes"))
        .withColumn("ratio", F.col("bytes_out") / F.col("limit_bytes"))
        .withColumn("signal", _signal(F.col("ratio")))
        .withColumn(
            "confidence",
            F.bround(
                F.lit(0.5)
                + F.lit(0.5)
                * F.least(
                    F.lit(1.0), F.col("sample_count") / float(params.full_confidence_samples)
                ),
                4,
            ),
        )
    )
    fired = materialize(fired)
    touched = _firing(tallies, fired, keys)
    return fired.join(smallest_k(touched, keys, "k1", 10, "sample_dests"), keys, "left")


def _volume_evidence(params: VolumeParams) -> list[Column]:
    return [
        F.col("bytes_out"),
        F.col("limit_bytes").alias("threshold_bytes"),
        F.bround("ratio", 3).alias("ratio"),
        F.bround("mean", 1).alias("baseline_mean"),
        F.bround("stddev", 1).alias("baseline_stddev"),
        F.bround("p95", 1).alias("baseline_p95"),
        F.col("sample_count").alias("baseline_samples"),
        F.col("window_days").alias("baseline_window_days"),
        F.col("event_count").alias("flows"),
        F.col("destinations").alias("distinct_destinations"),
        _strings(F.col("sample_dests")).alias("sample_destinations"),
    ]


RULES: dict[str, Rule] = {
    r.rule_id: r
    for r in (
        Rule(
            "D-001", "Port scan", 3, 600, detect_port_scan, PortScanParams(), mitre_hint="T1046",
            plan=Plan(_scan_feed, _scan_fire, _scan_evidence),
        ),
        Rule(
            "D-002", "Auth-failure burst", 3, 600, detect_auth_burst, AuthBurstParams(),
            mitre_hint="T1110", plan=Plan(_burst_feed, _burst_fire, _burst_evidence),
        ),
        Rule(
            "D-003", "DNS anomaly", 3, 600, detect_dns_anomaly, DnsParams(), mitre_hint="T1071.004",
            plan=Plan(_dns_feed, _dns_fire, _dns_evidence, _dns_look, ("k1",)),
        ),
        Rule(
            "D-004", "Periodic beaconing", 4, 3600, detect_beaconing, BeaconParams(),
            mitre_hint="T1071",
            plan=Plan(_beacon_feed, _beacon_fire, _beacon_evidence, _beacon_look, ("_note",)),
        ),
        Rule(
            "D-005", "Outbound volume anomaly", 3, 3600, detect_volume_anomaly, VolumeParams(),
            needs_baselines=True, mitre_hint="T1041",
            plan=Plan(_volume_feed, _volume_fire, _volume_evidence),
        ),
    )
}
