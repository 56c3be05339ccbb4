"""Order-dependent work over groups that may be very large.

A window function puts a whole group into one task. Where one group may hold a third of all
rows that is a straggler, so the operators here cut every group along its order into *pieces*
(a fixed stretch of time), do the ordered work inside ``(group, piece)``, and carry only one
summary row per piece across the group. A group is never gathered: its rows are spread over as
many tasks as it has pieces. Results are exact and do not depend on the piece length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.session import stored

MICRO = 1_000_000


def with_piece(
    df: DataFrame, at_us: str, seconds: int | Column, name: str = "_piece"
) -> DataFrame:
    """``seconds`` may differ from group to group."""
    return df.withColumn(name, F.floor(F.col(at_us) / F.lit(seconds * MICRO)).cast("bigint"))


def carry_in(
    df: DataFrame, keys: Sequence[str], summary: Column, running: str, name: str
) -> DataFrame:
    """One row per ``(keys, _piece)`` with ``running`` (max or sum) of the summaries of all
    earlier pieces of the group. ``summary`` is an aggregate, so it is combined map-side."""
    per_piece = df.groupBy(*keys, "_piece").agg(summary.alias("_own"))
    before = (
        Window.partitionBy(*keys)
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if running == "max":
        carried = F.max("_own").over(before)
    else:
        carried = F.coalesce(F.sum("_own").over(before), F.lit(0))
    return per_piece.select(*keys, "_piece", carried.alias(name))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    at_us: str,
    piece_seconds: int | Column,
) -> DataFrame:
    """``_rank`` (0-based) and ``_size`` of every row in its group ordered by ``order``, whose
    first column must be ``at_us``."""
    cut = with_piece(df, at_us, piece_seconds)
    per_piece = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_own"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        *keys,
        "_piece",
        F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_offset"),
        F.sum("_own").over(whole).alias("_size"),
    )
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        cut.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_piece"])
        .withColumn("_rank", F.col("_offset") + F.col("_local") - 1)
        .drop("_piece", "_local", "_offset")
    )


def _counted(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``name``: the place (from 1) of every row in its group, whatever the order columns hold.

    Rows are range-partitioned by group and order, so a large group is spread over many tasks; they
    are numbered inside a partition, and the sizes of the group's earlier partitions give the
    rest. Null keys form a group."""
    at = F.monotonically_increasing_id()
    rows = stored(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.struct(*keys, F.shiftright(at, 33).alias("_part")))
        .withColumn("_local", at.bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    shares = rows.groupBy("_id").agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    before = (
        Window.partitionBy(*[f"_id.{k}" for k in keys])
        .orderBy("_id._part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    return (
        rows.join(shares.select("_id", shift.alias("_shift")), "_id")
        .withColumn(name, F.col("_shift") + F.col("_local"))
        .drop("_id", "_local", "_shift")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, name: str
) -> DataFrame:
    """``name``: the weights of all rows before each in its group, which is cut like in
    :func:`numbered`. The order must tell the rows of a group apart."""
    at = F.monotonically_increasing_id()
    rows = stored(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.shiftright(at, 33)),
        "running",
    )
    shares = rows.groupBy(*keys, "_part").agg(F.sum(weight).alias("_share"))
    parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = shares.select(*keys, "_part", F.coalesce(F.sum("_share").over(parts), F.lit(0)).alias("_ahead"))
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    own = rows.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        own.join(ahead, [*keys, "_part"])
        .withColumn(name, F.col("_ahead") + F.col("_own"))
        .drop("_part", "_ahead", "_own")
    )


def densest_span(
    df: DataFrame, keys: Sequence[str], at_us: str, seconds: int, weight: str | None = None
) -> DataFrame:
    """``(keys, max_burst)``: the most rows any span of ``seconds``, both ends included, holds.
    With ``weight`` a row counts that many times.

    Rows of one instant are counted together first. Pieces are as long as the span, so the span
    ending at a row reaches into the piece before and no further: each instant is also sent,
    marked, to the piece after its own.
    """
    span_us = seconds * MICRO
    counts = with_piece(df.groupBy(*keys, at_us).agg(_counted(weight).alias("_n")), at_us, seconds)
    both = F.explode(
        F.array(
            F.struct(F.col("_piece").alias("p"), F.lit(True).alias("own")),
            F.struct((F.col("_piece") + 1).alias("p"), F.lit(False).alias("own")),
        )
    )
    spread = counts.withColumn("_t", both).select(
        *keys, at_us, "_n", F.col("_t.p").alias("_piece"), F.col("_t.own").alias("_own")
    )
    reach = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(at_us)
        .rangeBetween(-span_us, Window.currentRow)
    )
    return (
        spread.withColumn("_burst", F.sum("_n").over(reach))
        .filter("_own")
        .groupBy(*keys)
        .agg(F.max("_burst").alias("max_burst"))
    )


def interval_stats(
    df: DataFrame,
    keys: Sequence[str],
    at_us: str,
    piece_seconds: int,
    weight: str | None = None,
) -> DataFrame:
    """``(keys, connections, first_us, last_us, mean_interval, stddev_interval, jitter)``.

    The mean needs only the ends. The spread needs the squares of adjacent differences: inside
    a piece by ``lag``, across pieces from each piece's ends. Sums are exact integers, so the
    result does not depend on order of arithmetic. One row alone has no interval (NULLs). With
    ``weight`` a row stands for that many at its instant, which are no time apart.
    """
    wanted = [*keys, at_us] if weight is None else [*keys, at_us, weight]
    cut = with_piece(df.select(*wanted), at_us, piece_seconds)
    local = Window.partitionBy(*keys, "_piece").orderBy(at_us)
    step = (F.col(at_us) - F.lag(at_us).over(local)).cast("decimal(18,0)")
    per_piece = (
        cut.withColumn("_d", step)
        .groupBy(*keys, "_piece")
        .agg(
            _counted(weight).alias("_n"),
            F.min(at_us).alias("_lo"),
            F.max(at_us).alias("_hi"),
            F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0)).alias("_sq"),
        )
    )
    across = Window.partitionBy(*keys).orderBy("_piece")
    jump = (F.col("_lo") - F.lag("_hi").over(across)).cast("decimal(18,0)")
    totals = (
        per_piece.withColumn("_j", F.coalesce(jump, F.lit(0).cast("decimal(18,0)")))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("connections"),
            F.min("_lo").alias("first_us"),
            F.max("_hi").alias("last_us"),
            F.sum(F.col("_sq").cast("decimal(38,0)") + F.col("_j") * F.col("_j")).alias("_s"),
        )
    )
    gaps = (F.col("connections") - 1).cast("decimal(12,0)")
    total = (F.col("last_us") - F.col("first_us")).cast("decimal(18,0)")
    # beyond 26 digits the product could overflow; the spread is then far from zero, so doubles do
    exact = (gaps * F.col("_s").try_cast("decimal(26,0)") - total * total).cast("double")
    wide = gaps.cast("double") * F.col("_s").cast("double") - F.pow(total.cast("double"), F.lit(2))
    exact = F.coalesce(exact, F.greatest(wide, F.lit(0.0)))
    mean_us = F.try_divide(total.cast("double"), gaps.cast("double"))
    stddev_us = F.try_divide(F.sqrt(exact), gaps.cast("double"))
    return totals.select(
        *keys,
        "connections",
        "first_us",
        "last_us",
        (mean_us / MICRO).alias("mean_interval"),
        (stddev_us / MICRO).alias("stddev_interval"),
        F.try_divide(stddev_us, mean_us).alias("jitter"),
    )


def smallest_k(
    df: DataFrame, keys: Sequence[str], value: str, k: int, name: str
) -> DataFrame:
    """``(keys, name)``: the first ``k`` distinct values in order, as an array. The limit on the
    row number is pushed below the shuffle, so no more than ``k`` rows of a group leave a task."""
    order = Window.partitionBy(*keys).orderBy(value)
    return (
        df.filter(F.col(value).isNotNull())
        .select(*keys, value)
        .distinct()
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(value)).alias(name))
    )


def _piece_summaries(rows: DataFrame, keys: Sequence[str], peak: str) -> DataFrame:
    """``(keys, _piece, _offset, _size, _peak, _most)`` of rows with a ``_local`` number in their piece:
    the rows before the piece, and of the whole group the size, the rank of the first row with the
    largest ``peak``, and that."""
    weight = F.coalesce(F.col(peak), F.lit(0)).cast("bigint")
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_offset") + F.col("_best.at") - 1
    best = F.struct((-weight).alias("w"), F.col("_local").alias("at"))
    return (
        rows.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_own"), F.min(best).alias("_best"))
        .withColumn("_offset", F.coalesce(F.sum("_own").over(before), F.lit(0)))
        .withColumn("_size", F.sum("_own").over(whole))
        .withColumn(
            "_top",
            F.min(F.when(F.col("_piece").isNotNull(), F.struct("_best.w", at.alias("r")))).over(whole),
        )
        .select(
            *keys, "_piece", "_offset", "_size",
            F.col("_top.r").alias("_peak"), (-F.col("_top.w")).alias("_most"),
        )
    )


def _ranked_with_peak(
    df: DataFrame,
    keys: Sequence[str],
    at_us: str,
    row_id: str,
    piece_seconds: int | Column,
    peak: str,
) -> DataFrame:
    """:func:`ranked`, and the group's largest ``peak`` (``_most``) with the rank of the first row that
    has it (``_peak``). Pieces are summed up where their rows are numbered, and only the summaries
    meet by group: the rows are shuffled once, for both reads, as long as both read ``peak``."""
    inside = Window.partitionBy(*keys, "_piece").orderBy(at_us, row_id)
    named = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    rows = with_piece(
        df.filter(named).select(*keys, at_us, row_id, peak), at_us, piece_seconds
    ).withColumn("_local", F.row_number().over(inside).cast("bigint"))
    pieces = _piece_summaries(rows, keys, peak)
    # a left join asks nothing of its rows, so that both reads of them are the same; those without
    # a place find no piece and have no rank
    return rows.join(pieces, [*keys, "_piece"], "left").withColumn(
        "_rank", F.col("_offset") + F.col("_local") - 1
    )


def sample_contributors(
    df: DataFrame,
    keys: Sequence[str],
    at_us: str,
    row_id: str,
    piece_seconds: int | Column,
    k: int = 20,
    peak: str | None = None,
) -> DataFrame:
    """``(keys, samples ARRAY<STRUCT<event_id, role>>)``, at most ``k`` per group: the first
    row, the last, optionally the one with the largest ``peak`` (earliest of equals), then rows
    spread evenly over what remains."""
    if peak is None:
        rows = ranked(df, keys, [at_us, row_id], at_us, piece_seconds)
        rows = rows.withColumn("_peak", F.lit(0).cast("bigint"))
        at_peak = F.lit(True)
    else:
        rows = _ranked_with_peak(df, keys, at_us, row_id, piece_seconds, peak)
        at_peak = F.coalesce(F.col(peak), F.lit(0)) == F.col("_most")
    picked = rows.withColumns(_choice(k)).withColumn("role", _role(at_peak)).filter(F.col("role").isNotNull())
    return gathered_samples(picked, keys, row_id)


def sampled_in_place(
    rows: DataFrame,
    keys: Sequence[str],
    dealt: Sequence[str],
    order: Sequence[str],
    peak: str,
    k: int = 20,
) -> DataFrame:
    """``rows`` with the ``role`` and ``_rank`` that :func:`sample_contributors` gives them, for rows
    that are dealt out by the columns ``dealt``, among them ``_piece``: they are ranked where they
    are, and what is known of a group's pieces comes to them. No key is null."""
    rest = [c for c in keys if c not in dealt]
    inside = Window.partitionBy(*dealt, *rest).orderBy(*order)
    ranks = rows.withColumn("_local", F.row_number().over(inside).cast("bigint"))
    # all that is one value for a group is worked out there, which keeps the work on rows small
    pieces = _piece_summaries(ranks, keys, peak).withColumns(_choice(k))
    told = ("_size", "_most", "_top", "_room", "_step")
    known = F.struct(*rest, "_offset", *told)
    packed = pieces.groupBy(*dealt).agg(F.collect_list(known).alias("_known"))
    # spread rather than looked up: a look-up would be repeated wherever a field of it is read
    spread = ranks.join(packed, list(dealt)).withColumn("_own", F.explode("_known"))
    own = reduce(Column.__and__, [F.col(f"_own.{c}") == F.col(c) for c in rest])
    placed = spread.filter(own).select(
        *rows.columns,
        (F.col("_own._offset") + F.col("_local") - 1).alias("_rank"),
        *[F.col(f"_own.{c}").alias(c) for c in told],
    )
    at_peak = F.coalesce(F.col(peak), F.lit(0)) == F.col("_most")
    return placed.select(*rows.columns, "_rank", _role(at_peak).alias("role"))


def _choice(k: int) -> dict[str, Column]:
    """What the choice of samples needs to know of a group, from its ``_size`` and ``_peak``: ``_top`` is the
    peak's rank if it is neither first nor last."""
    top = F.when((F.col("_peak") > 0) & (F.col("_peak") < F.col("_size") - 1), F.col("_peak"))
    taken = F.least(F.col("_size"), F.lit(2)) + F.when(top.isNotNull(), 1).otherwise(0)
    room = F.lit(k) - taken
    step = F.greatest(F.floor((F.col("_size") - taken) / room), F.lit(1))
    return {"_top": top, "_room": room, "_step": step}


def _role(at_peak: Column) -> Column:
    """The role of a row, from its ``_rank`` and what :func:`_choice` says; null for rows not chosen."""
    position = F.col("_rank")
    at = position - 1 - F.when(position > F.col("_top"), 1).otherwise(0)
    return (
        F.when(position == 0, F.lit("first"))
        .when(position == F.col("_size") - 1, F.lit("last"))
        .when((position == F.col("_top")) & at_peak, F.lit("peak"))
        .when((at % F.col("_step") == 0) & (F.floor(at / F.col("_step")) < F.col("_room")), F.lit("sample"))
    )


def gathered_samples(picked: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """``(keys, samples)`` from the rows that have a role."""
    rank_of = F.when(F.col("role") == "first", 0).when(F.col("role") == "last", 1).when(
        F.col("role") == "peak", 2
    ).otherwise(3)
    packed = F.array_sort(
        F.collect_list(F.struct(rank_of.alias("o"), "_rank", F.col(row_id).alias("id"), "role"))
    )
    return picked.groupBy(*keys).agg(
        F.transform(
            packed, lambda s: F.struct(s["id"].alias("event_id"), s["role"].alias("role"))
        ).alias("samples")
    )
