"""Registered files and whole-corpus summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def verify_datasets(spark: SparkSession, registry: DataFrame, root: str) -> DataFrame:
    """``(id, ok, sha256)`` for each registered file, ``registry`` being ``(id, path, sha256)``
    with paths relative to ``root``. A missing file is not ok and has no digest."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            F.regexp_replace("path", r"^[a-z0-9]+:/*", "/").alias("_path"),
            F.sha2("content", 256).alias("_actual"),
        )
    )
    wanted = registry.withColumn("_path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))
    return wanted.join(found, "_path", "left").select(
        "id",
        F.coalesce(F.lower("sha256") == F.col("_actual"), F.lit(False)).alias("ok"),
        F.col("_actual").alias("sha256"),
    )


def corpus_profile(events: DataFrame) -> DataFrame:
    """One row: events, a count per type, first and last instant, and the hour-aligned interval
    a sweep should cover."""
    per_type = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi")
    )
    return per_type.agg(
        F.sum("n").alias("events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias(
            "counts_by_type"
        ),
        F.min("lo").alias("first_event"),
        F.max("hi").alias("last_event"),
        F.date_trunc("hour", F.min("lo")).alias("sweep_from"),
        F.timestamp_seconds(
            F.unix_timestamp(F.date_trunc("hour", F.max("hi"))) + F.lit(3600)
        ).alias("sweep_to"),
    )
