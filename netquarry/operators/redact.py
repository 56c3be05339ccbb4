"""Scanning and pseudonymising text per case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.secrets import (
    free_text,
    name_class,
    names_in_text,
    replace_names,
    secret_names,
)
from netquarry.operators.pieces import numbered
from netquarry.session import stored

# fixed value: the label of a case's subject
SUBJECT_LABEL = "asset-A"


def scan_secrets(df: DataFrame, column: str) -> DataFrame:
    """``df`` plus ``patterns``: names of the secret patterns found in the whole text."""
    return df.withColumn("patterns", secret_names(F.col(column)))


def clean_free_text(
    df: DataFrame, column: str, limit: int | None = None, name: str = "clean"
) -> DataFrame:
    return df.withColumn(name, free_text(F.col(column), limit))


def token_numbers(
    values: DataFrame, case: str, value: str, order: Sequence[str], subject: str | None = None
) -> DataFrame:
    """``(case, value, token)``: ``int-1``, ``ext-1``, ``domain-1``, … numbered per case and
    class by first appearance. The case's subject has a fixed label and takes no number.

    Values are reduced to their first appearance before anything is ranked."""
    keep = [case, value] + ([subject] if subject else [])
    first = values.groupBy(*keep).agg(F.min(F.struct(*order)).alias("_first"))
    own = F.col(value) == F.col(subject) if subject else F.lit(False)
    own = F.coalesce(own, F.lit(False))
    others = first.filter(~own)
    kinds = others.withColumn("_kind", name_class(F.col(value)))
    tokens = numbered(kinds, [case, "_kind"], ["_first", value], "_number").select(
        case, value, F.concat_ws("-", "_kind", F.col("_number").cast("string")).alias("token")
    )
    if subject is None:
        return tokens
    return tokens.unionByName(
        first.filter(own).select(case, value, F.lit(SUBJECT_LABEL).alias("token"))
    )


def pseudonymize(
    df: DataFrame, case: str, column: str, order: Sequence[str], subject: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(scrubbed, mapping)``. Every address and host name in ``column`` becomes its token,
    stable within a case; ``mapping`` is ``(case, token, value)``, to be kept apart.

    Tokens travel by name, not as one map per case: a text gets the tokens of its own names, and
    the case may have any number of them. Texts of a case with the same names in the same order
    share one map, so each such list is handled once, with the first place it has."""
    owner = [case] + ([subject] if subject else [])
    # a name repeated in one text keeps its first place
    names = F.array_distinct(names_in_text(F.col(column)))
    named = [*owner, "_names"]
    list_key = F.struct(F.xxhash64(*named), F.xxhash64(F.lit(case), *named))
    # texts without a name have no map; their keys only spread them over the tasks
    row_key = F.struct(F.xxhash64(*df.columns), F.xxhash64(F.lit(case), *df.columns))
    some = F.size("_names") > 0
    listed = df.select(*owner, F.struct(*order).alias("_order"), names.alias("_names"))
    lists = stored(
        listed.withColumn("_row", list_key)
        .groupBy("_row", *owner)
        .agg(F.min("_order").alias("_order"), F.first("_names").alias("_names")),
        "name-lists",
    )
    places = lists.select(*owner, "_order", F.posexplode("_names").alias("_pos", "_value"))
    tokens = stored(
        token_numbers(places, case, "_value", ["_order", "_pos"], subject), "tokens"
    )
    maps = (
        lists.select("_row", case, F.explode("_names").alias("_value"))
        .join(tokens, [case, "_value"])
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("_value", "token"))).alias("_map"))
    )
    keyed = df.withColumn("_names", names).withColumn(
        "_row", F.when(some, list_key).otherwise(row_key)
    )
    joined = keyed.drop("_names").join(maps, "_row", "left")
    scrubbed = joined.withColumn(
        column,
        F.when(F.col("_map").isNull(), F.col(column)).otherwise(
            replace_names(
                F.col(column), lambda v: F.coalesce(F.try_element_at("_map", v), F.lit("other"))
            )
        ),
    ).select(*df.columns)
    return scrubbed, tokens.select(case, "token", F.col("_value").alias("value"))
