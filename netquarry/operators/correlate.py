"""Grouping alerts into proposals: capped gap sessions per entity.

An alert joins the group before it when it begins no later than ``gap`` after the group's end
so far, keeps the group within ``max_span``, and finds fewer than ``max_n`` members. Read as a
loop that is one long chain per entity. It is done here in three layers:

1. *Islands.* Where an alert begins more than ``gap`` after everything before it ended, a group
   ends whatever the caps say. Running maxima carried over pieces find these places natively.
2. An island within both caps is one group. Nothing more is needed for it.
3. Only islands that break a cap are cut further. Where the next group starts depends on the
   start of this one and at most ``max_n`` alerts after it, so each block of alerts can work
   out, for every possible entry, where the chain leaves it. The blocks' answers are small and
   are chained; then every block marks its own starts. No task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.scoring import ESCALATION_RULES, case_severity, case_title, entity_key
from netquarry.operators.pieces import MICRO, carry_in, ranked, with_piece
from netquarry.session import materialize

HOUR = 3600


@dataclass(frozen=True)
class GapRules:
    gap_seconds: int = HOUR
    max_span_seconds: int = 24 * HOUR
    max_n: int = 500
    piece_seconds: int = 6 * HOUR
    block_rows: int = 20_000


def islands(
    df: DataFrame, keys: Sequence[str], rules: GapRules, start: str = "_s", end: str = "_e",
    row_id: str = "_id",
) -> DataFrame:
    """``df`` plus ``_island``: the number of the gap-separated stretch of its group."""
    keys = list(keys)
    cut = with_piece(df, start, rules.piece_seconds)
    reach = carry_in(cut, keys, F.max(end), "max", "_reach")
    before = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(start, end, row_id)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.greatest(F.col("_reach"), F.max(end).over(before))
    opens = ended.isNull() | (F.col(start) - ended > rules.gap_seconds * MICRO)
    flagged = cut.join(reach, [*keys, "_piece"]).withColumn("_opens", opens.cast("int"))
    earlier = carry_in(flagged, keys, F.sum("_opens"), "sum", "_opened")
    return (
        flagged.withColumn("_local", F.sum("_opens").over(upto))
        .join(earlier, [*keys, "_piece"])
        .withColumn("_island", F.col("_opened") + F.col("_local"))
        .drop("_piece", "_reach", "_opens", "_opened", "_local")
    )


def _next_starts(
    start: np.ndarray, end: np.ndarray, own: int, max_n: int, gap: int, span: int
) -> np.ndarray:
    """For each of the first ``own`` rows, how many rows on the next group starts if a group
    starts here. All rows advance together, one member at a time."""
    n = len(start)
    here = np.arange(own)
    alive = np.ones(own, dtype=bool)
    result = np.full(own, max_n, dtype=np.int64)
    running = end[:own].copy()
    for k in range(1, max_n):
        at = here + k
        inside = alive & (at < n)
        result[alive & (at >= n)] = k
        idx = np.flatnonzero(inside)
        if len(idx) == 0:
            break
        alive = inside
        s, e = start[idx + k], end[idx + k]
        grown = np.maximum(running[idx], e)
        joins = (s - running[idx] <= gap) & (grown - start[idx] <= span)
        stopped = idx[~joins]
        result[stopped] = k
        alive[stopped] = False
        running[idx[joins]] = grown[joins]
    return result


def _blocks(rows: DataFrame, keys: list[str], rules: GapRules) -> DataFrame:
    """Rows with ``_block``; the first rows of a block are also sent to the block before it,
    which looks that far ahead."""
    size = rules.block_rows
    own = F.floor(F.col("_rank") / size).cast("bigint")
    ahead = (F.col("_rank") >= size) & (F.pmod(F.col("_rank"), F.lit(size)) < rules.max_n)
    homes = F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))
    return rows.withColumn("_block", F.explode(homes))


def _split_islands(rows: DataFrame, keys: Sequence[str], rules: GapRules) -> DataFrame:
    """``(keys, _island, _id, _part)`` for rows of islands that break a cap."""
    if rules.block_rows < rules.max_n:
        raise ValueError("a block must hold at least max_n rows")
    keys = list(keys)
    group = [*keys, "_island"]
    placed = ranked(rows, group, ["_s", "_e", "_id"], "_s", rules.piece_seconds)
    # read twice: once for the blocks' answers, once to mark the starts
    blocks = materialize(_blocks(placed.select(*group, "_s", "_e", "_id", "_rank"), group, rules))
    size, max_n = rules.block_rows, rules.max_n
    gap, span = rules.gap_seconds * MICRO, rules.max_span_seconds * MICRO
    key_ddl = ", ".join(f"{c} {t}" for c, t in rows.select(*group).dtypes)
    id_type = dict(rows.dtypes)["_id"]

    def jumps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        pdf = pdf.sort_values("_rank", kind="stable").reset_index(drop=True)
        block = int(pdf["_block"].iloc[0])
        own = int((pdf["_rank"] < (block + 1) * size).sum())
        steps = _next_starts(
            pdf["_s"].to_numpy(), pdf["_e"].to_numpy(), own, max_n, gap, span
        )
        return pdf, own, steps

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        """For every entry offset: the entry into the next block, and the starts passed."""
        head = pdf.iloc[0]
        _, own, steps = jumps(pdf)
        leave = np.zeros(own, dtype=np.int64)
        passed = np.zeros(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            j = i + steps[i]
            if j >= own:
                leave[i], passed[i] = j - own, 1
            else:
                leave[i], passed[i] = leave[j], passed[j] + 1
        entries = min(own, max_n)
        row = {c: head[c] for c in group}
        row |= {
            "_block": head["_block"],
            "_leave": leave[:entries].tolist(),
            "_passed": passed[:entries].tolist(),
        }
        return pd.DataFrame([row])

    maps = blocks.groupBy(*group, "_block").applyInPandas(
        exits, f"{key_ddl}, _block bigint, _leave array<bigint>, _passed array<bigint>"
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk the blocks of each island in order; the state is one entry and one count."""
        current, entry, parts = None, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                values = dict(zip(pdf.columns, row))
                identity = tuple(values[c] for c in group)
                if identity != current:
                    current, entry, parts = identity, 0, 0
                out.append((*identity, values["_block"], entry, parts))
                if entry < len(values["_leave"]):
                    parts += int(values["_passed"][entry])
                    entry = int(values["_leave"][entry])
            yield pd.DataFrame(out, columns=[*group, "_block", "_entry", "_parts"])

    entries = (
        maps.repartition(*group)
        .sortWithinPartitions(*group, "_block")
        .mapInPandas(chain, f"{key_ddl}, _block bigint, _entry bigint, _parts bigint")
    )

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, parts = int(pdf["_entry"].iloc[0]), int(pdf["_parts"].iloc[0])
        pdf, own, steps = jumps(pdf)
        starts = np.zeros(own, dtype=np.int64)
        i = entry
        while i < own:
            starts[i] = 1
            i += steps[i]
        out = pdf.iloc[:own][[*group, "_id"]].copy()
        out["_part"] = parts + np.cumsum(starts)
        return out

    return (
        blocks.join(entries, [*group, "_block"])
        .groupBy(*group, "_block")
        .applyInPandas(mark, f"{key_ddl}, _id {id_type}, _part bigint")
    )


def gap_groups(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    row_id: str,
    rules: GapRules = GapRules(),
) -> DataFrame:
    """``(keys, row_id, island, part)``: the group of every row. ``start`` and ``end`` are
    timestamps. Rows tie-break by ``(start, end, row_id)``."""
    keys = list(keys)
    rows = df.select(
        *keys,
        F.unix_micros(start).alias("_s"),
        F.unix_micros(end).alias("_e"),
        F.col(row_id).alias("_id"),
    )
    numbered = materialize(islands(rows, keys, rules))
    group = [*keys, "_island"]
    over = (
        numbered.groupBy(*group)
        .agg(
            F.count("*").alias("_n"),
            (F.max("_e") - F.min("_s")).alias("_span"),
        )
        .filter(
            (F.col("_n") > rules.max_n) | (F.col("_span") > rules.max_span_seconds * MICRO)
        )
        .select(*group)
    )
    over = materialize(over)
    whole = numbered.join(over, group, "left_anti").select(
        *group, "_id", F.lit(1).cast("bigint").alias("_part")
    )
    if not over.isEmpty():
        cut = _split_islands(numbered.join(over, group, "left_semi"), keys, rules)
        whole = whole.unionByName(cut.select(*group, "_id", "_part"))
    return whole.select(
        *keys,
        F.col("_id").alias(row_id),
        F.col("_island").alias("island"),
        F.col("_part").alias("part"),
    )


def propose_cases(
    alerts: DataFrame, rules: GapRules = GapRules()
) -> tuple[DataFrame, DataFrame]:
    """``(proposals, members)``. ``members`` is ``(alert_id, correlation_key, island, part)``
    and ``proposals`` one row per group with its window, severity, rules and title. Members
    stay rows: a group is never gathered into an array."""
    keyed = alerts.withColumn(
        "correlation_key", entity_key(F.col("entity_type"), F.col("entity_value"))
    )
    members = materialize(
        gap_groups(keyed, ["correlation_key"], "first_seen", "last_seen", "alert_id", rules)
    )
    proposals = severity_rollup(
        members.join(keyed.drop("correlation_key"), "alert_id"),
        ["correlation_key", "island", "part"],
    )
    return proposals, members


def severity_rollup(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: worst severity, one step up from three distinct rules on, the rules, the
    window, the title. The set of rules is as small as the rule registry."""
    rolled = members.groupBy(*keys).agg(
        F.count("*").alias("alerts"),
        F.max("severity").alias("member_max"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.min("first_seen").alias("window_start"),
        F.max("last_seen").alias("window_end"),
        F.min("entity_type").alias("entity_type"),
        F.min("entity_value").alias("entity_value"),
    )
    count = F.size("rules")
    return rolled.select(
        *keys,
        "entity_type",
        "entity_value",
        "alerts",
        "rules",
        count.alias("distinct_rule_count"),
        "member_max",
        case_severity(F.col("member_max"), count).alias("severity"),
        (count >= ESCALATION_RULES).alias("escalated"),
        case_title(F.col("rules"), F.col("entity_value")).alias("title"),
        "window_start",
        "window_end",
    )


def correlation_summary(proposals: DataFrame) -> DataFrame:
    return proposals.agg(
        F.count("*").alias("proposals"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
        F.count_if("escalated").alias("escalated"),
        F.count_distinct("correlation_key").alias("entities"),
    )
