"""Filing proposals into cases, and what is read from cases afterwards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.scoring import (
    CASE_FORMULA,
    ESCALATION_RULES,
    case_number,
    case_severity,
    case_title,
)
from netquarry.functions.text import clean_keep_newline, strip_python
from netquarry.operators.correlate import GapRules, islands, propose_cases
from netquarry.operators.pieces import MICRO, ranked
from netquarry.operators.prefix import longest_match
from netquarry.operators.replay import Machine, states_before
from netquarry.operators.sets import drop_known, union_all
from netquarry.schemas import CLOSED_STATUSES
from netquarry.session import materialize
from netquarry.sources.normalize import event_uuid

GROUP = ["correlation_key", "island", "part"]


def latest_case(incidents: DataFrame, open_cases: bool) -> DataFrame:
    """The newest open (or closed) case of each key, by end and then by creation."""
    closed = F.col("status").isin(*CLOSED_STATUSES)
    others = [c for c in incidents.columns if c != "correlation_key"]
    return (
        incidents.filter(~closed if open_cases else closed)
        .groupBy("correlation_key")
        .agg(F.max_by(F.struct(*others), F.struct("window_end", "created_at", "incident_id")).alias("c"))
        .select("correlation_key", "c.*")
    )


def latest_case_asof(
    proposals: DataFrame, incidents: DataFrame, open_cases: bool, rules: GapRules = GapRules()
) -> DataFrame:
    """Proposals with ``previous_case`` (the newest open or closed case of the key, if its end
    is no more than the gap before the proposal) and ``continues`` (the span allows joining)."""
    newest = latest_case(incidents, open_cases).select(
        "correlation_key",
        F.col("case_number").alias("previous_case"),
        F.col("status").alias("previous_status"),
        F.unix_micros("window_start").alias("_ps"),
        F.unix_micros("window_end").alias("_pe"),
    )
    joined = proposals.join(newest, "correlation_key", "left")
    near = F.unix_micros("window_start") - F.col("_pe") <= rules.gap_seconds * MICRO
    span = F.greatest(F.col("_pe"), F.unix_micros("window_end")) - F.col("_ps")
    return joined.select(
        *proposals.columns,
        F.when(near, F.col("previous_case")).alias("previous_case"),
        F.when(near, F.col("previous_status")).alias("previous_status"),
        F.coalesce(near & (span <= rules.max_span_seconds * MICRO), F.lit(False)).alias("continues"),
    )


def _file_in_order(rows: DataFrame, rules: GapRules) -> DataFrame:
    """``(correlation_key, island, part, _case, _first)`` for proposals and seed rows cut into
    chains. Within a chain each proposal either extends the newest open case or opens one, which
    depends on the one before. A chain streams through sorted batches with one case as state;
    chains are short, because proposals of a key lie more than a gap apart unless a cap cut
    them."""
    gap, span = rules.gap_seconds * MICRO, rules.max_span_seconds * MICRO

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, case, start, end = None, None, 0, 0
        for pdf in batches:
            out = []
            columns = (
                "correlation_key", "_island", "_seed", "_case_start", "_s", "_e", "island", "part",
                "_own_case",
            )
            for key, number, seed, opened, s, e, island, part, own in zip(
                *(pdf[c] for c in columns)
            ):
                if (key, number) != chain:
                    chain, case = (key, number), None
                if seed:
                    case, start, end = own, opened, e
                    continue
                first = not (
                    case is not None and s - end <= gap and max(end, e) - start <= span
                )
                if not first:
                    start, end = min(start, s), max(end, e)
                    out.append((key, island, part, case, False))
                    continue
                out.append((key, island, part, own, True))
                if case is None or e >= end:
                    case, start, end = own, s, e
            yield pd.DataFrame(
                out, columns=["correlation_key", "island", "part", "_case", "_first"]
            )

    return (
        rows.repartition("correlation_key", "_island")
        .sortWithinPartitions("correlation_key", "_island", "_s", "island", "part")
        .mapInPandas(
            walk,
            "correlation_key string, island bigint, part bigint, _case string, _first boolean",
        )
    )


def assign_cases(
    proposals: DataFrame, incidents: DataFrame, now: Column, rules: GapRules = GapRules()
) -> DataFrame:
    """``(correlation_key, island, part, incident_id, created)``: the case each proposal goes
    to and whether it opens it."""
    own = event_uuid(
        F.sha2(
            F.concat_ws(
                "|",
                "correlation_key",
                F.unix_micros("window_start").cast("string"),
                F.col("island").cast("string"),
                F.col("part").cast("string"),
                F.unix_micros(now).cast("string"),
            ),
            256,
        )
    )
    seeds = latest_case(incidents, True).select(
        "correlation_key",
        F.col("incident_id").alias("_seed_case"),
        F.unix_micros("window_start").alias("_ss"),
        F.unix_micros("window_end").alias("_se"),
    )
    rows = proposals.select(
        *GROUP,
        F.unix_micros("window_start").alias("_s"),
        F.unix_micros("window_end").alias("_e"),
        own.alias("_own_case"),
    ).join(seeds, "correlation_key", "left")
    # Proposals far before the newest open case are late arrivals. The first of a key may still
    # join it, and moves its start so far back that none of the others can, nor can they take
    # its place: they open cases of their own, in any order.
    heads = rows.groupBy("correlation_key").agg(
        F.min(F.struct("_s", "island", "part")).alias("_head")
    )
    rows = rows.join(heads, "correlation_key")
    settled = F.coalesce(
        (F.col("_s") < F.col("_se") - rules.max_span_seconds * MICRO)
        & (F.col("_e") < F.col("_se"))
        & (F.struct("_s", "island", "part") != F.col("_head")),
        F.lit(False),
    )
    alone = rows.filter(settled).select(
        *GROUP, F.col("_own_case").alias("_case"), F.lit(True).alias("_first")
    )
    moving = rows.filter(~settled)
    beginning = F.lit(-(2**60)).cast("bigint")
    seed_rows = (
        moving.filter(F.col("_seed_case").isNotNull())
        .select("correlation_key", "_seed_case", "_ss", "_se")
        .distinct()
        .select(
            "correlation_key",
            F.lit(-1).cast("bigint").alias("island"),
            F.lit(-1).cast("bigint").alias("part"),
            beginning.alias("_s"),
            F.col("_se").alias("_e"),
            F.col("_seed_case").alias("_own_case"),
            F.col("_ss").alias("_case_start"),
            F.lit(True).alias("_seed"),
        )
    )
    walked = seed_rows.unionByName(
        moving.select(
            *GROUP, "_s", "_e", "_own_case", F.col("_s").alias("_case_start"), F.lit(False).alias("_seed")
        )
    ).withColumn("_id", F.struct("island", "part"))
    chains = islands(walked, ["correlation_key"], rules)
    filed = _file_in_order(chains.drop("_id"), rules)
    return alone.unionByName(filed).select(
        *GROUP, F.col("_case").alias("incident_id"), F.col("_first").alias("created")
    )


def assign_ordinals(
    rows: DataFrame, order_us: str, order: Sequence[str], last: int = 0
) -> DataFrame:
    """``ordinal`` = ``last`` + place in the order. Rows are range-partitioned by the order and
    numbered inside their partition; the sizes of the partitions before give the rest. However
    many rows share an instant, they are dealt by the other order columns."""
    keys = [order_us, *order]
    place = F.monotonically_increasing_id()
    numbered = materialize(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.shiftright(place, 33))
        .withColumn("_local", place.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        numbered.join(before, "_part")
        .withColumn("ordinal", F.col("_before") + F.col("_local") + last + 1)
        .drop("_part", "_local", "_before")
    )


def file_cases(
    alerts: DataFrame,
    incidents: DataFrame,
    incident_alerts: DataFrame,
    now: Column,
    prefix: str = "CASE",
    last_ordinal: int = 0,
    rules: GapRules = GapRules(),
    candidates: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One correlation run: ``incidents`` (rows opened or changed), ``links``, ``timeline``,
    ``alert_status``.

    ``candidates`` are the alerts to correlate (open ones of ``alerts`` when not given).
    Members already linked are left out; a proposal without new members does nothing.
    Severity, title and rule count are taken over **all** members of a case and the window
    grows at both ends, so a late quiet proposal can neither lower a case nor be left outside
    its window."""
    if candidates is None:
        candidates = alerts.filter(F.col("status") == "open") if "status" in alerts.columns else alerts
    proposals, members = propose_cases(candidates, rules)
    proposals = materialize(proposals)
    fresh = members.join(incident_alerts.select("alert_id").distinct(), "alert_id", "left_anti")
    live = proposals.join(fresh.select(*GROUP).distinct(), GROUP, "left_semi")
    homes = materialize(assign_cases(live, incidents, now, rules))
    links = materialize(
        fresh.join(homes, GROUP).select("incident_id", "alert_id", "correlation_key", "created")
    )

    touched = homes.groupBy("incident_id", "correlation_key").agg(
        F.max("created").alias("created")
    )
    before = incidents.join(touched.filter(~F.col("created")).select("incident_id"), "incident_id", "left_semi")
    every_link = (
        links.select("incident_id", "alert_id")
        .unionByName(
            incident_alerts.select("incident_id", "alert_id").join(
                before.select("incident_id"), "incident_id", "left_semi"
            )
        )
        .distinct()
    )
    facts = alerts.select(
        "alert_id", "rule_id", "severity", "entity_value", "first_seen", "last_seen"
    )
    rolled = (
        every_link.join(facts, "alert_id")
        .groupBy("incident_id")
        .agg(
            F.max("severity").alias("member_max"),
            F.array_sort(F.collect_set("rule_id")).alias("rules"),
            F.min("first_seen").alias("_start"),
            F.max("last_seen").alias("_end"),
            F.min("entity_value").alias("entity_value"),
        )
    )
    count = F.size("rules")
    described = rolled.select(
        "incident_id",
        "member_max",
        count.alias("distinct_rule_count"),
        case_severity(F.col("member_max"), count).alias("severity"),
        case_title(F.col("rules"), F.col("entity_value")).alias("title"),
        F.to_json(
            F.struct(
                F.lit(CASE_FORMULA).alias("formula"),
                "member_max",
                count.alias("distinct_rules"),
                (count >= ESCALATION_RULES).alias("escalated"),
                case_severity(F.col("member_max"), count).alias("result"),
            )
        ).alias("severity_rationale"),
        "_start",
        "_end",
    )
    created = touched.filter("created").join(described, "incident_id")
    numbered = assign_ordinals(
        materialize(created).withColumn("_us", F.unix_micros("_start")), "_us", ["correlation_key", "incident_id"], last_ordinal
    )
    opened = numbered.select(
        "incident_id",
        case_number(prefix, now, F.col("ordinal")).alias("case_number"),
        "correlation_key",
        "title",
        "severity",
        "severity_rationale",
        F.lit("new").alias("status"),
        F.col("_start").alias("window_start"),
        F.col("_end").alias("window_end"),
        "distinct_rule_count",
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(True).alias("created"),
    )
    grown = before.select(
        "incident_id", "case_number", "correlation_key", "status", "window_start", "window_end", "created_at"
    ).join(described, "incident_id").select(
        "incident_id",
        "case_number",
        "correlation_key",
        "title",
        "severity",
        "severity_rationale",
        "status",
        F.least("window_start", "_start").alias("window_start"),
        F.greatest("window_end", "_end").alias("window_end"),
        "distinct_rule_count",
        "created_at",
        now.alias("updated_at"),
        F.lit(False).alias("created"),
    )

    openers = live.join(homes.filter("created"), GROUP)
    beside = latest_case_asof(
        openers.select("incident_id", "correlation_key", "window_start", "window_end"),
        incidents,
        False,
        rules,
    ).filter(F.col("previous_case").isNotNull())
    timeline = timeline_entries(links.join(alerts.drop("correlation_key"), "alert_id"), beside)
    status = links.select("alert_id", F.lit("correlated").alias("status"))
    return {
        "incidents": opened.unionByName(grown),
        "links": links.select("incident_id", "alert_id"),
        "timeline": timeline,
        "alert_status": status,
    }


def timeline_entries(
    linked: DataFrame,
    superseded: DataFrame | None = None,
    transitions: DataFrame | None = None,
    notes: DataFrame | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """``(incident_id, occurred_at, entry_type, summary, alert_id)`` from the four sources that
    write into a case's story. One entry per (case, type, alert); entries without an alert never
    conflict."""
    none = F.lit(None)

    def entry(df: DataFrame, at: str, kind: str, summary: Column, alert: Column) -> DataFrame:
        return df.select(
            "incident_id",
            F.col(at).alias("occurred_at"),
            F.lit(kind).alias("entry_type"),
            summary.alias("summary"),
            alert.cast("string").alias("alert_id"),
        )

    out = entry(
        linked,
        "first_seen",
        "alert_fired",
        F.concat(
            F.col("rule_id"), F.lit(" fired on "), F.col("entity_type"), F.lit(" "), F.col("entity_value")
        ),
        F.col("alert_id"),
    )
    if superseded is not None:
        text = F.concat(
            F.lit("A case of its own: "), F.col("previous_case"), F.lit(" had ended before")
        )
        out = out.unionByName(entry(superseded, "window_start", "observation", text, none))
    if transitions is not None:
        moved = F.concat(F.lit("Status: "), F.col("from_status"), F.lit(" to "), F.col("to_status"))
        out = out.unionByName(entry(transitions, "requested_at", "status_change", moved, none))
    if notes is not None:
        out = out.unionByName(
            entry(notes, "created_at", "note_added", F.lit("A note was added"), none)
        )
    if existing is None:
        existing = out.limit(0)
    return drop_known(out, existing, ["incident_id", "entry_type", "alert_id"])


def case_detail(
    incidents: DataFrame, incident_alerts: DataFrame, alerts: DataFrame, rules: DataFrame
) -> DataFrame:
    """Member alerts of each case as rows in reading order: ``position`` counts from 1 by
    ``(first_seen, alert_id)``. Kept as rows because a case may have any number of members."""
    # rules hold one row per rule id
    members = (
        incident_alerts.join(incidents.select("incident_id", "case_number"), "incident_id")
        .join(alerts, "alert_id")
        .join(rules.select("rule_id", F.col("name").alias("rule_name")), "rule_id", "left")
        .withColumn("_us", F.unix_micros("first_seen"))
    )
    return (
        ranked(members, ["incident_id"], ["_us", "alert_id"], "_us", 6 * 3600)
        .withColumn("position", F.col("_rank") + 1)
        .drop("_us", "_rank", "_size")
    )


def trace_provenance(
    incident_alerts: DataFrame,
    alerts: DataFrame,
    alert_events: DataFrame,
    events: DataFrame,
    batches: DataFrame,
    max_alerts: int | None = None,
    max_events: int | None = None,
) -> DataFrame:
    """``(incident_id, batch_id, …batch columns, complete)``: the batches behind the sampled events
    of each case's alerts. With limits only the first ``max_events`` events of the first
    ``max_alerts`` alerts are followed, and ``complete`` tells whether that was all there is."""
    links = incident_alerts.join(alerts.select("alert_id", "first_seen"), "alert_id")
    sampled = alert_events.select("alert_id", "event_id")
    cut = []
    if max_alerts is not None:
        by_case = Window.partitionBy("incident_id").orderBy("first_seen", "alert_id")
        near = links.withColumn("_r", F.row_number().over(by_case))
        near = near.filter(F.col("_r") <= max_alerts + 1)
        cut.append(near.filter(F.col("_r") > max_alerts).select("incident_id"))
        links = near.filter(F.col("_r") <= max_alerts)
    if max_events is not None:
        by_alert = Window.partitionBy("alert_id").orderBy("event_id")
        some = sampled.withColumn("_k", F.row_number().over(by_alert))
        some = some.filter(F.col("_k") <= max_events + 1)
        more = some.filter(F.col("_k") > max_events).select("alert_id")
        cut.append(links.join(more, "alert_id").select("incident_id"))
        sampled = some.filter(F.col("_k") <= max_events).select("alert_id", "event_id")
    used = links.join(sampled, "alert_id").select("incident_id", "event_id").distinct()
    found = (
        used.join(events.select(F.col("id").alias("event_id"), "batch_id"), "event_id")
        .select("incident_id", "batch_id")
        .distinct()
        .join(batches, "batch_id")
    )
    if not cut:
        return found.withColumn("complete", F.lit(True))
    partial = union_all(cut).distinct().withColumn("_partial", F.lit(True))
    return (
        found.join(partial, "incident_id", "left")
        .withColumn("complete", F.col("_partial").isNull())
        .drop("_partial")
    )


def case_assets(
    incident_alerts: DataFrame, alerts: DataFrame, networks: DataFrame, incidents: DataFrame | None = None
) -> DataFrame:
    """``(incident_id, asset_id)``: inventory assets behind the addresses of a case's alerts,
    and its primary asset when it has one."""
    named = incident_alerts.join(alerts.select("alert_id", "entity_value"), "alert_id").select(
        "incident_id", F.col("entity_value").alias("address")
    ).distinct()
    owners = longest_match(named, "address", networks).select("address", "asset_id")
    out = named.join(owners, "address").select("incident_id", "asset_id")
    if incidents is not None and "primary_asset_id" in incidents.columns:
        primary = incidents.filter(F.col("primary_asset_id").isNotNull()).select(
            "incident_id", F.col("primary_asset_id").alias("asset_id")
        )
        out = out.unionByName(primary)
    return out.distinct()


# ------------------------------------------------------------------ workflow and notes

# fixed values: the legal moves between case states
_CLOSED = list(CLOSED_STATUSES)
LEGAL_MOVES = {
    "new": ["triaging", "investigating", *_CLOSED],
    "triaging": ["investigating", "contained_recommended", *_CLOSED],
    "investigating": ["triaging", "contained_recommended", *_CLOSED],
    "contained_recommended": ["investigating", *_CLOSED],
    "closed_true_positive": ["investigating"],
    "closed_false_positive": ["investigating"],
    "closed_benign": ["investigating"],
}

MACHINE = Machine(LEGAL_MOVES)


def apply_move(status: str, target: str) -> str:
    """``moved``, ``same`` or ``illegal``."""
    if status == target:
        return "same"
    return "moved" if target in LEGAL_MOVES[status] else "illegal"


def replay_workflow(cases: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, final)``. ``transitions`` is ``(incident_id, requested_at, request_id,
    to_status, reason)`` applied per case in time order; a refused move changes nothing.
    Closing stamps ``closed_at`` and the reason, reopening clears them. Requests of unknown cases
    are left out; from a status that does not exist every move is illegal.

    Requests are composed block by block (``operators.replay``), so a case's requests are walked
    by as many tasks as it has blocks."""
    rows = transitions.select("incident_id", "requested_at", "request_id", "to_status", "reason")
    starts = cases.select("incident_id", MACHINE.letter(F.col("status")).alias("_before"))
    met = states_before(
        rows, starts, "incident_id", ["requested_at", "request_id"], "to_status", MACHINE
    )
    target = MACHINE.letter(F.col("to_status"))
    same = (F.col("_before") == target) & (target != "-")
    moved = MACHINE.apply(F.col("_before"), MACHINE.move(F.col("to_status"))) != F.col("_before")
    outcomes = met.select(
        "incident_id",
        "requested_at",
        "request_id",
        MACHINE.status(F.col("_before")).alias("from_status"),
        "to_status",
        "reason",
        F.when(same, F.lit("same")).when(moved, F.lit("moved")).otherwise(F.lit("illegal")).alias("outcome"),
    )
    last = (
        outcomes.filter("outcome = 'moved'")
        .groupBy("incident_id")
        .agg(
            F.max_by(
                F.struct("to_status", "requested_at", "reason"), F.struct("requested_at", "request_id")
            ).alias("l")
        )
    )
    closed = F.col("_status").isin(*CLOSED_STATUSES)
    final = (
        cases.join(last, "incident_id", "left")
        .withColumn("_status", F.coalesce("l.to_status", "status"))
        .select(
            "incident_id",
            F.col("_status").alias("status"),
            F.when(closed, F.col("l.requested_at")).alias("closed_at"),
            F.when(closed, clean_reason(F.col("l.reason"))).alias("closure_reason"),
        )
    )
    return outcomes, final


def clean_reason(reason: Column, limit: int = 500) -> Column:
    """A closure reason without control characters; blank means none was given. Longer than
    ``limit`` is refused upstream by :func:`clean_notes` with that limit."""
    cleaned = strip_python(clean_keep_newline(reason))
    return F.when(cleaned != "", cleaned)


def clean_notes(notes: DataFrame, column: str = "body", limit: int = 8000) -> DataFrame:
    """``notes`` with ``clean`` and ``refused`` (``empty``, ``too_long`` or NULL). A note that
    is too long is refused, never cut."""
    cleaned = strip_python(clean_keep_newline(F.coalesce(F.col(column), F.lit(""))))
    size = F.length("clean")
    return (
        notes.withColumn("clean", cleaned)
        .withColumn(
            "refused",
            F.when(size == 0, F.lit("empty")).when(size > limit, F.lit("too_long")),
        )
        .withColumn("clean", F.when(F.col("refused").isNull(), F.col("clean")))
    )


__all__ = [
    "apply_move", "assign_cases", "assign_ordinals", "case_assets", "case_detail", "clean_notes",
    "clean_reason", "file_cases", "latest_case", "latest_case_asof",
    "replay_workflow", "timeline_entries", "trace_provenance",
]
