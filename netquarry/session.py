"""Session settings the library assumes. Nothing here is needed on a cluster that sets them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "netquarry", master: str | None = None, **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every instant in the data is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables. The cluster names it in
    ``spark.checkpoint.dir``. Only a session in one process (``local``) may leave it unset; it
    then gets a folder of its own. Anywhere else that folder would be seen by one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        current = os.path.join(tempfile.mkdtemp(prefix="netquarry-"), "checkpoints")
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and go on from there. For
    results that several later steps read: they are computed once, and a lost executor costs a
    re-read instead of the whole lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Like :func:`materialize`, for wide results: Parquet in the same folder, so that later reads
    keep column pruning and statistics. A read that asks for one value of ``by`` opens only its
    files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
