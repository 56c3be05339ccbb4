"""Age-based removal with protected rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators.sets import union_all
from netquarry.session import stored


@dataclass(frozen=True)
class RetentionRule:
    table: str
    column: str
    days: int
    protects_evidence: bool = False


def policy(events: int, rejects: int, runs: int, audit: int) -> tuple[RetentionRule, ...]:
    return (
        RetentionRule("events", "event_time", events, True),
        RetentionRule("ingest_rejects", "created_at", rejects),
        RetentionRule("detector_runs", "created_at", runs),
        RetentionRule("audit_log", "occurred_at", audit),
    )


def cutoff(now: Column, days: int) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86_400_000_000))


def _old(df: DataFrame, column: str, before: Column, protected: DataFrame | None, key: str) -> DataFrame:
    old = df.filter(F.col(column) < before)
    if protected is None:
        return old
    return old.join(protected.select(key).distinct(), key, "left_anti")


def retention_plan(
    tables: Mapping[str, DataFrame],
    rules: tuple[RetentionRule, ...],
    now: Column,
    protected: DataFrame | None = None,
    key: str = "id",
) -> DataFrame:
    """``(table, before, rows)``: the cutoff of every rule from one clock reading and how many
    rows it would remove. Rows an alert cites (``protected``) are never counted."""
    parts = []
    for rule in rules:
        if rule.table not in tables:
            continue
        before = cutoff(now, rule.days)
        old = _old(
            tables[rule.table], rule.column, before, protected if rule.protects_evidence else None, key
        )
        parts.append(
            old.agg(F.count("*").alias("rows")).select(
                F.lit(rule.table).alias("table"), before.alias("before"), "rows"
            )
        )
    return union_all(parts)


def prune(
    df: DataFrame, column: str, before: Column, protected: DataFrame | None = None, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """``(kept, counts)``: rows that stay, and one row ``(removed, remaining)`` where
    ``remaining`` are old rows kept as evidence. Only old rows meet the protected ids; recent
    ones pass straight through. Write ``kept`` beside the table and swap."""
    recent = df.filter((F.col(column) >= before) | F.col(column).isNull())
    old = df.filter(F.col(column) < before)
    if protected is None:
        counts = old.agg(F.count("*").alias("removed"), F.lit(0).cast("bigint").alias("remaining"))
        return recent, counts
    cited = protected.select(key).distinct().withColumn("_cited", F.lit(True))
    marked = old.join(cited, key, "left")
    kept = recent.unionByName(marked.filter("_cited").select(*df.columns))
    counts = marked.agg(
        F.count_if(F.col("_cited").isNull()).alias("removed"),
        F.count_if(F.col("_cited")).alias("remaining"),
    )
    return kept, counts


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def prune_days(
    spark: SparkSession,
    path: str,
    column: str,
    before: Column,
    protected: DataFrame | None = None,
    key: str = "id",
) -> DataFrame:
    """Prune the day-partitioned table at ``path`` in place and return the manifest
    ``(event_date, action, removed, remaining, stays)`` of its old days.

    A day of which nothing stays is ``dropped`` as a folder, one of which all stays is ``kept``, any
    other is ``rewritten``; days after the cutoff are not touched. ``remaining`` are old rows kept
    as evidence. Only the key of old days is read to find those, and of no other days than theirs
    if ``protected`` names them in ``event_date``. The rows that stay and the manifest are stored
    before the table changes, and every change can be repeated: after a failure run it again.
    Rows without a time lie in no old day and stay."""
    table = spark.read.parquet(path)
    old = table.filter(F.col("event_date") <= F.to_date(before))
    expired = F.col(column) < before
    # the footers have the sizes
    sizes = old.groupBy("event_date").agg(F.count("*").alias("_n"))
    # only the day of the cutoff holds rows of both kinds
    stay = old.filter((F.col("event_date") == F.to_date(before)) & ~expired)
    if protected is not None:
        on = ["event_date", key] if "event_date" in protected.columns else [key]
        stay = stay.unionByName(
            old.filter(expired).join(protected.select(*on).distinct(), on, "left_semi").select(*old.columns)
        )
    stay = stored(stay, "pruned-rows", by=["event_date"])
    left = stay.groupBy("event_date").agg(
        F.count("*").alias("_stays"), F.count_if(expired).alias("_remaining")
    )
    stays = F.coalesce("_stays", F.lit(0))
    action = (
        F.when(stays == 0, "dropped").when(stays == F.col("_n"), "kept").otherwise("rewritten")
    )
    manifest = stored(
        sizes.join(left, "event_date", "left").select(
            "event_date",
            action.alias("action"),
            (F.col("_n") - stays).alias("removed"),
            F.coalesce("_remaining", F.lit(0)).alias("remaining"),
            stays.alias("stays"),
        ),
        "prune-manifest",
    )
    rewritten = manifest.filter("action = 'rewritten'").select("event_date")
    (
        stay.join(F.broadcast(rewritten), "event_date", "left_semi")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )
    # as many names as there are days
    for day in manifest.filter("action = 'dropped'").select("event_date").collect():
        _remove(spark, f"{path.rstrip('/')}/event_date={day[0].isoformat()}")
    return manifest


def prune_table(
    spark: SparkSession,
    path: str,
    target: str,
    column: str,
    before: Column,
    protected: DataFrame | None = None,
    key: str = "id",
) -> DataFrame:
    """Write what stays of the day-partitioned table at ``path`` to ``target``, a fresh folder that
    the caller swaps in, and return the counts. Days after the cutoff are copied as they are;
    only old days meet the protected ids. Run it again after a failure: a half-written target is
    overwritten."""
    table = spark.read.parquet(path)
    edge = F.to_date(before)
    recent = table.filter(F.col("event_date") > edge)
    kept, counts = prune(table.filter(F.col("event_date") <= edge), column, before, protected, key)
    both = recent.unionByName(kept)
    both.write.mode("overwrite").partitionBy("event_date").parquet(target)
    return counts
