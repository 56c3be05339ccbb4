"""Labelled cases: ``<rule>/<positive|negative>/<case>/{labels.yml, events.ndjson}``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.sources.lines import read_lines
from netquarry.sources.normalize import Limits, normalize

_LABELS = """
    case_id STRING, rule_id STRING, expected STRING, entity_type STRING, entity_value STRING,
    min_severity INT, window_start STRING, window_end STRING,
    baselines ARRAY<STRUCT<address: STRING, metric: STRING, window_days: INT, mean: DOUBLE,
                           stddev: DOUBLE, p95: DOUBLE, sample_count: BIGINT>>
"""
_CASE_PATH = r"/([^/]+)/(positive|negative)/([^/]+)/[^/]+$"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    def row(path_case: str, text: str) -> dict:
        doc = yaml.safe_load(text)
        entity = doc.get("expected_entity") or {}
        window = doc.get("window") or {}
        return {
            "case_id": path_case,
            "rule_id": doc["rule_id"],
            "expected": doc["expected"],
            "entity_type": entity.get("type"),
            "entity_value": entity.get("value"),
            "min_severity": doc.get("expected_min_severity"),
            "window_start": window.get("start"),
            "window_end": window.get("end"),
            "baselines": [
                {
                    "address": str(b["address"]),
                    "metric": str(b["metric"]),
                    "window_days": int(b["window_days"]),
                    "mean": float(b["mean"]),
                    "stddev": float(b["stddev"]),
                    "p95": float(b["p95"]),
                    "sample_count": int(b["sample_count"]),
                }
                for b in doc.get("baselines") or []
            ],
        }

    for pdf in batches:
        rows = [row(c, t) for c, t in zip(pdf["case_id"], pdf["value"])]
        yield pd.DataFrame(
            rows,
            columns=[
                "case_id", "rule_id", "expected", "entity_type", "entity_value", "min_severity",
                "window_start", "window_end", "baselines",
            ],
        )


def read_labelled_cases(
    spark: SparkSession, root: str, as_of: str = "2026-09-05 12:00:00"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(cases, events, baselines, rejects)`` of every case under ``root``, keyed by
    ``case_id`` (the path ``rule/kind/case``). Only events inside the case's window count.
    ``rejects`` should be empty: a case must be clean input."""
    case_of = F.concat_ws(
        "/", *[F.regexp_extract("path", _CASE_PATH, i) for i in (1, 2, 3)]
    )
    texts = (
        spark.read.text(
            root, wholetext=True, pathGlobFilter="labels.yml", recursiveFileLookup=True
        )
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .select(case_of.alias("case_id"), "value")
    )
    labels = texts.mapInPandas(_parse, _LABELS)
    cases = labels.select(
        "case_id",
        "rule_id",
        "expected",
        "entity_type",
        "entity_value",
        "min_severity",
        F.to_timestamp("window_start").alias("window_start"),
        F.to_timestamp("window_end").alias("window_end"),
    )
    lines = read_lines(spark, root).filter(F.col("file").endswith("/events.ndjson"))
    keyed = lines.withColumnRenamed("file", "path").withColumn("case_id", case_of).drop("path")
    events, rejects = normalize(keyed, F.lit(as_of).cast("timestamp"), Limits())
    inside = (
        events.join(cases.select("case_id", "window_start", "window_end"), "case_id")
        .filter("event_time >= window_start AND event_time < window_end")
        .drop("window_start", "window_end")
    )
    baselines = labels.select("case_id", F.explode("baselines").alias("b")).select(
        "case_id", "b.*"
    )
    return cases, inside, baselines, rejects
