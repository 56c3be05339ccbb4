"""Reading newline-delimited records with their line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.session import stored

LINES = "file STRING, line_number BIGINT, raw STRING"


def _text(reader, path):
    return reader.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line_number, raw)``. Lines are numbered from 1 in each file; blank lines count
    but are left out. A file is read in as many blocks as Spark likes: rows keep their order
    inside a block, so a line's number is its place in the block plus the lines of the blocks
    before, which is one small row per block. The files are scanned once, into the shared folder:
    places and texts then come from one reading, whatever is computed again."""
    rows = stored(
        _text(spark.read, path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
            F.make_valid_utf8(F.regexp_replace("value", r"\r+$", "")).alias("raw"),
        ),
        "scanned-lines",
    )
    blocks = rows.groupBy("file", "_block").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_start")
    )
    before = (
        Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "file", "_block", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        rows.join(offsets, ["file", "_block"])
        .filter(F.col("raw").rlike(r"\S"))
        .select(
            "file",
            (F.col("_at") - F.col("_start") + F.col("_before") + 1).alias("line_number"),
            "raw",
        )
    )


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The streaming form: no line number, since a file may still be arriving."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return _text(reader, path).select(
        F.col("_metadata.file_path").alias("file"),
        F.lit(None).cast("bigint").alias("line_number"),
        F.make_valid_utf8(F.regexp_replace("value", r"\r+$", "")).alias("raw"),
    ).filter(F.col("raw").rlike(r"\S"))
