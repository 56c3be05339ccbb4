"""Redacted evidence packets: what may leave, per case, as one canonical JSON text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.secrets import free_text, name_class, names_in_text, replace_names
from netquarry.functions.timing import iso_utc
from netquarry.operators.pieces import numbered, running_total
from netquarry.operators.redact import SUBJECT_LABEL, token_numbers
from netquarry.session import materialize, stored

# fixed values: what may happen to an evidence key
NUMERIC_KEYS = frozenset(
    {
        "failures", "max_burst", "burst_seconds", "threshold", "distinct_targets", "signature_ids",
        "connections", "mean_interval_seconds", "jitter", "bytes_out", "threshold_connections",
        "max_jitter", "distinct_names", "query_records", "answers", "nxdomain_answers",
        "nxdomain_ratio", "long_names", "threshold_unique_subdomains", "threshold_nxdomain",
        "threshold_long_queries", "distinct_dest_ports", "distinct_dest_hosts", "flows",
        "unanswered_flows", "threshold_ports", "threshold_hosts", "sample_dest_ports",
        "threshold_bytes", "ratio", "baseline_mean", "baseline_stddev", "baseline_p95",
        "baseline_samples", "baseline_window_days", "distinct_destinations",
        "top_domain_suspicious", "top_domain_names",
    }
)
ADDRESS_KEYS = frozenset(
    {
        "destination", "beaconing_destinations", "sample_targets", "sample_dest_hosts",
        "sample_destinations", "top_domain",
    }
)
VOCABULARY_KEYS = frozenset({"app_proto", "signals"})
TIME_KEYS = frozenset({"window_start", "window_end"})
DROP_KEYS = frozenset({"sample_categories"})


@dataclass(frozen=True)
class PacketLimits:
    """Bounds of a packet; none is set unless asked for, and then the packet lists what was left
    out."""

    max_bytes: int | None = None
    max_alerts: int | None = None
    max_keys: int | None = None
    max_items: int | None = None
    max_timeline: int | None = None
    line_chars: int | None = None
    word_chars: int | None = None


def _head(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _json(value: Column) -> Column:
    """One value as JSON text."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def _in(key: Column, names: frozenset[str]) -> Column:
    return key.isin(*sorted(names))


def _strings(v: Column) -> Column:
    """Items of an array value, or the value itself, as text."""
    kind = F.schema_of_variant(v)
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return (
        F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "ARRAY<STRING>"), none))
        .when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string")))
        .otherwise(none)
    )


def _is_number(kind: Column) -> Column:
    return kind.rlike(r"^(?:BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\([0-9, ]+\))$")


def _words(v: Column, limits: PacketLimits) -> Column:
    items = F.coalesce(
        F.try_variant_get(v, "$", "ARRAY<VARIANT>"), F.expr("CAST(array() AS ARRAY<VARIANT>)")
    )
    return F.array_compact(
        F.transform(
            _head(items, limits.max_items),
            lambda i: F.when(
                F.schema_of_variant(i) == "STRING",
                free_text(F.try_variant_get(i, "$", "string"), limits.word_chars),
            ),
        )
    )


def _refusal(key: Column, v: Column) -> Column:
    """Why a key is left out; NULL when it is sent."""
    kind = F.schema_of_variant(v)
    numeric = _is_number(kind) | kind.rlike(
        r"^ARRAY<(?:BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\([0-9, ]+\))>$"
    )
    word = F.when(kind == "STRING", free_text(F.try_variant_get(v, "$", "string")).isNotNull())
    wordy = F.coalesce(word, kind.startswith("ARRAY"))
    return (
        F.when(_in(key, DROP_KEYS), F.lit("always withheld"))
        .when(_in(key, NUMERIC_KEYS), F.when(~F.coalesce(numeric, F.lit(False)), F.lit("value is not numeric")))
        .when(
            _in(key, VOCABULARY_KEYS),
            F.when(~F.coalesce(wordy, F.lit(False)), F.lit("text looks secret")),
        )
        .when(~_in(key, ADDRESS_KEYS | TIME_KEYS), F.lit("key is not listed"))
    )


def _rendered(key: Column, v: Column, tokens: Column, limits: PacketLimits) -> Column:
    kind = F.schema_of_variant(v)
    items = F.coalesce(
        F.try_variant_get(v, "$", "ARRAY<VARIANT>"), F.expr("CAST(array() AS ARRAY<VARIANT>)")
    )

    def named(x: Column) -> Column:
        return F.coalesce(F.try_element_at(tokens, x), F.lit("other"))

    one = _json(named(F.try_variant_get(v, "$", "string")))
    many = F.to_json(_head(F.transform(_strings(v), named), limits.max_items))
    return (
        F.when(
            _in(key, NUMERIC_KEYS),
            F.when(_is_number(kind), F.to_json(v)).otherwise(
                F.to_json(_head(items, limits.max_items))
            ),
        )
        .when(_in(key, ADDRESS_KEYS), F.when(kind == "STRING", one).otherwise(many))
        .when(
            _in(key, TIME_KEYS),
            F.when(kind == "STRING", F.to_json(v)).otherwise(F.lit("null")),
        )
        .otherwise(
            F.when(
                kind == "STRING", _json(free_text(F.try_variant_get(v, "$", "string"), limits.word_chars))
            ).otherwise(F.to_json(_words(v, limits)))
        )
    )


@dataclass(frozen=True)
class _Items:
    """What is sent of all cases: ``alerts`` ``(incident_id, _a, _j, _w)``, the JSON text of each
    alert and what it withholds; ``lines`` ``(incident_id, _at, _l)``, NULL where a line is
    withheld; ``over``, the cases with more alerts than allowed; ``tokens``."""

    alerts: DataFrame
    lines: DataFrame
    over: DataFrame
    tokens: DataFrame


def _items(cases: DataFrame, alerts: DataFrame, timeline: DataFrame, limits: PacketLimits) -> _Items:
    last = limits.max_alerts
    by_time = Window.partitionBy("incident_id").orderBy("first_seen", "alert_id")
    near = (
        alerts.withColumn("_r", F.row_number().over(by_time))
        .filter(F.lit(True) if last is None else F.col("_r") <= last + 1)
        .withColumn("_a", (F.col("_r") - 1).cast("int"))
    )
    past = F.lit(False) if last is None else F.col("_r") > last
    over = near.filter(past).select("incident_id", F.lit(True).alias("_over"))
    values = F.try_variant_get(F.try_parse_json("evidence"), "$", "MAP<STRING, VARIANT>")
    entries = F.transform(
        F.array_sort(F.map_keys("_map")),
        lambda k: F.struct(k.alias("k"), F.element_at("_map", k).alias("v")),
    )
    judged = F.transform(
        "_entries",
        lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), _refusal(e["k"], e["v"]).alias("why")),
    )
    kept = (
        near.filter(~past)
        .withColumn("_map", values)
        .withColumn("_entries", F.coalesce(entries, F.expr("CAST(array() AS ARRAY<STRUCT<k: STRING, v: VARIANT>>)")))
        .withColumn("_judged", judged)
        .withColumn("_fit", F.filter("_judged", lambda e: e["why"].isNull()))
        .withColumn("_sent", _head(F.col("_fit"), limits.max_keys))
        .withColumn(
            "_late", F.filter("_fit", lambda e, i: i >= F.size("_sent"))
        )
        .join(cases.select("incident_id", "subject"), "incident_id")
    )
    where = F.concat(F.lit("alerts["), F.col("_a").cast("string"), F.lit("]."))
    withheld = F.concat(
        F.transform(
            F.filter("_judged", lambda e: e["why"].isNotNull()),
            lambda e: F.concat(where, e["k"], F.lit(": "), e["why"]),
        ),
        F.transform("_late", lambda e: F.concat(where, e["k"], F.lit(": beyond the keys allowed"))),
    )
    # judged once; the names, the tokens and the texts all read this
    kept = materialize(
        kept.select(
            "incident_id", "subject", "_a", "entity_value", "confidence", "event_count", "first_seen",
            "last_seen", "rule_id", "severity",
            F.transform("_sent", lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))).alias("_sent"),
            withheld.alias("_w"),
        )
    )

    # timeline: all lines, or those up to the last one that fits
    numbered = timeline.withColumn(
        "_ok",
        free_text(replace_names(F.col("summary"), lambda v: F.lit("domain-1")), limits.line_chars).isNotNull(),
    ).withColumn("_at", F.struct("occurred_at", "entry_id"))
    read = numbered
    if limits.max_timeline is not None:
        by_entry = Window.partitionBy("incident_id").orderBy("_at")
        good = (
            numbered.filter("_ok")
            .select("incident_id", "_at")
            .withColumn("_t", F.row_number().over(by_entry))
            .filter(F.col("_t") <= limits.max_timeline)
        )
        ends = good.groupBy("incident_id").agg(F.max("_at").alias("_end"), F.count("*").alias("_n"))
        read = numbered.join(ends, "incident_id", "left").filter(
            F.col("_end").isNull()
            | (F.col("_n") < limits.max_timeline)
            | (F.col("_at") <= F.col("_end"))
        )
    read = materialize(
        read.join(cases.select("incident_id", "subject"), "incident_id").select(
            "incident_id", "subject", "_at", "summary", names_in_text(F.col("summary")).alias("_names")
        )
    )

    # every value that gets a token, with its place
    def place(df: DataFrame, part: int, a: Column, b: Column, c: Column, value: Column) -> DataFrame:
        return df.select(
            "incident_id",
            "subject",
            F.lit(part).alias("_p0"),
            a.cast("string").alias("_p1"),
            b.cast("int").alias("_p2"),
            c.cast("int").alias("_p3"),
            value.alias("_value"),
        )

    padded = F.lpad(F.col("_a").cast("string"), 10, "0")
    entity = place(
        kept.filter(F.coalesce("entity_value", F.lit("")) != ""), 0, padded, F.lit(-1), F.lit(0), F.col("entity_value")
    )
    listed = kept.select(
        "incident_id", "subject", "_a", F.posexplode("_sent").alias("_k", "_e")
    ).filter(_in(F.col("_e.k"), ADDRESS_KEYS))
    inside = place(
        listed.select("incident_id", "subject", "_a", "_k", F.posexplode(_strings(F.col("_e.v"))).alias("_i", "_s")),
        0, padded, F.col("_k"), F.col("_i"), F.col("_s"),
    )
    told = place(
        read.select(
            "incident_id", "subject", "_at", F.posexplode("_names").alias("_i", "_s")
        ),
        1,
        F.concat(
            F.lpad(F.unix_micros("_at.occurred_at").cast("string"), 20, "0"),
            F.lit("|"),
            F.col("_at.entry_id").cast("string"),
        ),
        F.lit(0),
        F.col("_i"),
        F.col("_s"),
    )
    tokens = materialize(
        token_numbers(
            entity.unionByName(inside).unionByName(told),
            "incident_id",
            "_value",
            ["_p0", "_p1", "_p2", "_p3"],
            subject="subject",
        )
    )
    no_tokens = F.expr("CAST(map() AS MAP<STRING, STRING>)")

    def with_tokens(df: DataFrame, names: DataFrame, place: str) -> DataFrame:
        """Each row with the tokens of its own names, however many its case has."""
        maps = (
            names.distinct()
            .join(tokens.select("incident_id", "_value", "token"), ["incident_id", "_value"])
            .groupBy("incident_id", place)
            .agg(F.map_from_entries(F.collect_list(F.struct("_value", "token"))).alias("_tokens"))
        )
        return df.join(maps, ["incident_id", place], "left").withColumn(
            "_tokens", F.coalesce("_tokens", no_tokens)
        )

    body = F.array_join(
        F.transform(
            "_sent",
            lambda e: F.concat(
                _json(e["k"]), F.lit(":"), _rendered(e["k"], e["v"], F.col("_tokens"), limits)
            ),
        ),
        ",",
    )
    label = F.when(
        F.coalesce("entity_value", F.lit("")) == "", F.lit(SUBJECT_LABEL)
    ).otherwise(F.coalesce(F.try_element_at("_tokens", F.col("entity_value")), F.lit("other")))
    alert_json = F.concat(
        F.lit('{"confidence":'), F.col("confidence").cast("double").cast("string"),
        F.lit(',"entity":'), _json(label),
        F.lit(',"event_count":'), F.col("event_count").cast("string"),
        F.lit(',"evidence":{'), body,
        F.lit('},"first_seen":'), _json(iso_utc(F.col("first_seen"))),
        F.lit(',"last_seen":'), _json(iso_utc(F.col("last_seen"))),
        F.lit(',"rule_id":'), _json(F.col("rule_id")),
        F.lit(',"severity":'), F.col("severity").cast("string"), F.lit("}"),
    )
    named = entity.unionByName(inside).select(
        "incident_id", F.col("_p1").cast("int").alias("_a"), "_value"
    )
    rendered = with_tokens(kept, named, "_a").select(
        "incident_id", "_a", alert_json.alias("_j"), "_w"
    )
    line = free_text(
        replace_names(
            F.col("summary"), lambda v: F.coalesce(F.try_element_at("_tokens", v), F.lit("other"))
        ),
        limits.line_chars,
    )
    mentioned = read.select("incident_id", "_at", F.explode("_names").alias("_value"))
    told_lines = with_tokens(read, mentioned, "_at").select("incident_id", "_at", line.alias("_l"))
    return _Items(rendered, told_lines, over, tokens.select("incident_id", "token", F.col("_value").alias("value")))


def _frame() -> tuple[Column, Column]:
    """What stands between the alerts and the flag, and between the flag and the timeline."""
    kind = name_class(F.col("subject"))
    subject_class = (
        F.when(kind == "int", F.lit("private")).when(kind == "ext", F.lit("public")).otherwise(F.lit("domain"))
    )
    head = F.concat(
        F.lit('],"case_number":'), _json(F.col("case_number")),
        F.lit(',"distinct_rule_count":'), F.col("distinct_rule_count").cast("string"),
        F.lit(',"packet_truncated":'),
    )
    tail = F.concat(
        F.lit(',"severity":'), F.col("severity").cast("string"),
        F.lit(',"status":'), _json(F.col("status")),
        F.lit(f',"subject":"{SUBJECT_LABEL}","subject_class":'), _json(subject_class),
        F.lit(',"timeline":'), F.to_json("_l"),
        F.lit(',"window_end":'), _json(iso_utc(F.col("window_end"))),
        F.lit(',"window_start":'), _json(iso_utc(F.col("window_start"))), F.lit("}"),
    )
    return head, tail

def evidence_packets(
    cases: DataFrame, alerts: DataFrame, timeline: DataFrame, limits: PacketLimits = PacketLimits()
) -> tuple[DataFrame, DataFrame]:
    """``(packets, mapping)``. ``packets`` is ``(incident_id, packet_json, packet_hash,
    truncated, dropped)``; ``mapping`` resolves the tokens and is kept apart.

    ``alerts`` carries ``incident_id`` and evidence as JSON text; ``timeline`` is
    ``(incident_id, occurred_at, entry_id, summary)``. Tokens are numbered by alert, then by
    evidence key in order, then along the timeline. A packet has all of its case; ``dropped`` names
    every key and timeline line that was withheld. Limits, where given, are applied below the
    shuffle."""
    items = _items(cases, alerts, timeline, limits)
    over = items.over
    per_case = items.alerts.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("_a", "_j", "_w"))).alias("_alerts")
    )
    # judged on the text that would be sent
    lines = items.lines.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_l"))).alias("_lines")
    )
    refused_lines = F.transform(
        F.filter("_lines", lambda x: x["_l"].isNull()),
        lambda x: F.concat(
            F.lit("timeline["), x["_at"]["entry_id"].cast("string"), F.lit("]: text looks secret")
        ),
    )

    joined = (
        cases.join(per_case, "incident_id", "left")
        .join(lines, "incident_id", "left")
        .join(over, "incident_id", "left")
        .withColumns(
            {
                "_j": F.coalesce(
                    F.transform("_alerts", lambda a: a["_j"]), F.expr("CAST(array() AS ARRAY<STRING>)")
                ),
                "_w": F.concat(
                    F.coalesce(
                        F.flatten(F.transform("_alerts", lambda a: a["_w"])),
                        F.expr("CAST(array() AS ARRAY<STRING>)"),
                    ),
                    F.coalesce(refused_lines, F.expr("CAST(array() AS ARRAY<STRING>)")),
                ),
                "_l": F.coalesce(
                    F.filter(F.transform("_lines", lambda x: x["_l"]), lambda x: x.isNotNull()),
                    F.expr("CAST(array() AS ARRAY<STRING>)"),
                ),
                "_over": F.coalesce("_over", F.lit(False)),
            }
        )
    )
    head, tail = _frame()
    framed = joined.withColumns({"_head": head, "_tail": tail})

    def packet(n: Column, cut: Column) -> Column:
        return F.concat(
            F.lit('{"alerts":['),
            F.array_join(F.slice("_j", F.lit(1), n), ","),
            F.col("_head"),
            F.when(cut, F.lit("true")).otherwise(F.lit("false")),
            F.col("_tail"),
        )

    count = F.size("_j")
    # whole alerts leave from the end
    fitting = count if limits.max_bytes is None else F.array_max(
        F.filter(
            F.sequence(F.lit(0), count),
            lambda n: (n == 0)
            | (F.octet_length(packet(n, (n < count) | F.col("_over"))) <= limits.max_bytes),
        )
    )
    sized = framed.withColumn("_n", fitting).withColumn("_cut", (F.col("_n") < count) | F.col("_over"))
    done = sized.withColumn("packet_json", packet(F.col("_n"), F.col("_cut")))
    squeezed = F.when(
        F.col("_n") < count,
        F.transform(
            F.sequence(F.col("_n"), count - 1),
            lambda i: F.concat(
                F.lit("alerts["), i.cast("string"), F.lit(f"]: packet would pass {limits.max_bytes} bytes")
            ),
        ),
    ).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    capped = F.when(
        F.col("_over"), F.array(F.lit(f"alerts: only {limits.max_alerts} allowed"))
    ).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    packets = done.select(
        "incident_id",
        "packet_json",
        F.sha2("packet_json", 256).alias("packet_hash"),
        F.col("_cut").alias("truncated"),
        F.concat("_w", capped, squeezed).alias("dropped"),
    )
    return packets, items.tokens


def packet_parts(
    cases: DataFrame,
    alerts: DataFrame,
    timeline: DataFrame,
    max_bytes: int,
    limits: PacketLimits = PacketLimits(),
    room: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(parts, withheld, mapping)``. The evidence of each case in as many packets as it takes:
    ``parts`` is ``(incident_id, packet_no, alerts, lines, packet_json, packet_hash, oversize)``,
    packets numbered from 1 and each with the facts of its case. Nothing is left out: alerts in
    order, then the lines of the timeline. ``withheld`` is ``(incident_id, what)``, one row for
    each key or line that may not leave.

    The items of a case are laid end to end and cut at multiples of the bytes a packet has for
    them (``room`` bytes if that is less); an item that lies across a cut makes a packet of its
    own. That takes no walk along the case, and at most twice the packets of the tightest cutting. Only an item that alone passes
    ``max_bytes`` makes a packet above it, which is marked ``oversize``. A case without items has
    one packet."""
    items = _items(cases, alerts, timeline, limits)
    good = items.lines.filter(F.col("_l").isNotNull())
    item = "struct<_p: int, _a: int, _at: struct<t: timestamp, e: string>>"
    place = F.struct(F.lit(0), F.col("_a"), F.lit(None)).cast(item).alias("_place")
    entry = F.struct("_at.occurred_at", F.col("_at.entry_id").cast("string"))
    later = F.struct(F.lit(1), F.lit(None), entry).cast(item).alias("_place")
    every = items.alerts.select("incident_id", place, F.col("_j").alias("_text")).unionByName(
        good.select("incident_id", later, _json(F.col("_l")).alias("_text"))
    )
    head, tail = _frame()
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    number, flag = ',"packet_no":', ',"packet_truncated":false'

    def whole(alert_list: Column, line_list: Column) -> Column:
        return F.concat(
            F.lit('{"alerts":['), F.array_join(alert_list, ","), F.col("_head"),
            F.lit(number), F.col("packet_no").cast("string"), F.lit(flag), F.col("_front"), F.lit("["), F.array_join(line_list, ","), F.lit("]"), F.col("_back"),
        )

    # a case without its items; twenty bytes are more than any number of a packet takes
    ends = F.split(tail, r'(?<="timeline":)\[\]')
    facts = F.octet_length(F.concat("_head", "_front", "_back"))
    fixed = len('{"alerts":[' + number + flag + "[]") + 20
    frames = stored(
        cases.withColumn("_l", none)
        .select(
            "incident_id",
            F.regexp_replace(head, ',"packet_truncated":$', "").alias("_head"),
            F.get(ends, F.lit(0)).alias("_front"),
            F.get(ends, F.lit(1)).alias("_back"),
        )
        .withColumn("_room", F.greatest(max_bytes - fixed - facts, F.lit(1)))
        .withColumn("_room", F.least("_room", F.lit(room))),
        "packet-frames",
    )
    # the comma before it is part of an item
    sized = every.withColumn("_size", F.octet_length("_text") + 1)
    laid = running_total(sized, ["incident_id"], ["_place"], "_size", "_start").join(
        frames.select("incident_id", "_room"), "incident_id"
    )
    stretch = F.floor(F.col("_start") / F.col("_room"))
    across = F.col("_start") + F.col("_size") > (stretch + 1) * F.col("_room")
    groups = (
        laid.withColumn("_cut", F.struct(stretch.alias("s"), across.alias("x")))
        .groupBy("incident_id", "_cut")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_text"))).alias("_items"))
    )
    ranked = numbered(groups, ["incident_id"], ["_cut"], "packet_no")
    filled = frames.join(ranked, "incident_id", "left")

    def texts(part: int) -> Column:
        chosen = F.filter("_items", lambda x: x["_place"]["_p"] == part)
        return F.coalesce(F.transform(chosen, lambda x: x["_text"]), none)

    parts = (
        filled.withColumn("packet_no", F.coalesce("packet_no", F.lit(1)).cast("bigint"))
        .withColumns({"alerts": texts(0), "lines": texts(1)})
        .withColumn("packet_json", whole(F.col("alerts"), F.col("lines")))
        .select(
            "incident_id", "packet_no", "alerts", "lines", "packet_json",
            F.sha2("packet_json", 256).alias("packet_hash"),
            (F.octet_length("packet_json") > max_bytes).alias("oversize"),
        )
    )
    refused = items.lines.filter(F.col("_l").isNull()).select(
        "incident_id",
        F.concat(F.lit("timeline["), F.col("_at.entry_id").cast("string"), F.lit("]: text looks secret")).alias("what"),
    )
    withheld = items.alerts.select("incident_id", F.explode("_w").alias("what")).unionByName(refused)
    return parts, withheld, items.tokens


__all__ = ["PacketLimits", "evidence_packets", "packet_parts"]
