"""Connected components of a graph of links, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.staging import stage

ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reachable) for every id that has a link.

    Two steps alternate until no link changes. In the first each node hands its larger neighbours
    to its smallest one, in the second its smaller ones; the links end as stars around the
    smallest ids. A node's smallest neighbour comes from an aggregation that combines before the
    shuffle, and the join back is one that Spark splits where a node is hot. Self-links and null
    ends are ignored; an empty table gives no rows."""
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stage(edges.distinct(), "edges")
    state = fingerprint(edges)
    for _ in range(ROUNDS):
        if state[0] == 0:
            break
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = stage(small, "edges")
        after = fingerprint(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v"), F.col("v")).distinct()
    )


def fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row["n"], row["x"]
