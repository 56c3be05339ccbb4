"""A Merkle manifest of a table: one tree of fan-out 8 per language, and one over their roots.

Every row is a leaf, a digest of its fields. A level holds (tree, place, digest). Each node offers
its digest to the places of its run of eight, which are computed from its own place by slot
offsets, and an equijoin on (tree, place) hands every node its siblings; the rows in slot zero then
emit the parents. The roots of the trees, in the order of the languages, are the leaves of a last
tree that is built in the same way.

On the way back each parent hands its path to its at most eight children, so a path moves once per
parent and not once per document until the last step. Only digests are shuffled, as 32 bytes; the
texts are read once, where they lie.

Defined cases: a null field counts as ``-``; rows without an id come first in their tree and are
not tampered with; rows with equal ids are ordered by their digests, and repeated rows are leaves
of their own; an empty text is ``0:``; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.staging import stage

FAN_OUT = 8
#: Fixed value: the fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(content: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    parts = [field(text if name == "text" else F.col(name)) for name in FIELDS]
    return digest(F.concat(*parts))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest, tampered (null: the row is left as it is). The texts end here."""
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        # a key that orders languages by bytes with null before all, and joins without nulls
        F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).alias("digest"),
        F.when(chosen, leaf(lowered)).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, the position (from 0) in the order inside each tree, and ``n``, the
    rows of the tree. Rows are range-partitioned by the whole order, so one large tree is spread
    over many tasks; they are numbered inside a partition, and the sizes of what lies before give
    the rest."""
    at = F.monotonically_increasing_id()
    numbered = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.shiftright(at, 33))
        .withColumn("local", at.bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    # one row for each tree in each partition: at most partitions + trees rows
    share = numbered.groupBy("tree", "part").agg(
        F.count("*").alias("rows"), F.min("local").alias("first")
    )
    whole = Window.partitionBy("tree").orderBy("part")
    starts = share.select(
        "tree",
        "part",
        (
            F.coalesce(F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            - F.col("first")
        ).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    return (
        numbered.join(starts, ["tree", "part"])
        .withColumn("place", F.col("shift") + F.col("local"))
        .drop("part", "local", "shift")
    )


def run_of(place: Column) -> Column:
    return F.floor(place / F.lit(FAN_OUT)).cast("long")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """tree, n, place, digest, before, after: the digests of the run's others on either side, joined.

    Each node goes to its eight slots' places; the equijoin drops the places that do not exist. The
    join deals rows by (tree, place), so the aggregation of at most eight rows needs no shuffle."""
    base = F.col("place") - F.col("place") % FAN_OUT
    offers = nodes.select(
        "tree",
        F.explode(F.sequence(base, base + (FAN_OUT - 1))).alias("place"),
        F.col("place").alias("from"),
        F.col("digest").alias("theirs"),
    )
    met = (
        nodes.select("tree", "place", "n")
        .join(offers.hint("merge"), ["tree", "place"])
        .groupBy("tree", "place")
        .agg(
            F.first("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("from", "theirs"))).alias("run"),
        )
    )

    def side(test) -> Column:
        return F.aggregate(
            F.filter("run", test),
            F.lit(b""),
            lambda joined, node: F.concat(joined, node["theirs"]),
        )

    return met.select(
        "tree",
        "n",
        "place",
        F.filter("run", lambda node: node["from"] == F.col("place"))[0]["theirs"].alias("digest"),
        side(lambda node: node["from"] < F.col("place")).alias("before"),
        side(lambda node: node["from"] > F.col("place")).alias("after"),
    )


def parents(level: DataFrame) -> DataFrame:
    """The rows in slot zero have their whole run beside them."""
    return level.filter(F.col("place") % FAN_OUT == 0).select(
        "tree",
        (run_of(F.col("n") - 1) + 1).alias("n"),
        run_of(F.col("place")).alias("place"),
        digest(hexed(F.concat("digest", "after"))).alias("digest"),
    )


def grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels that have siblings, from the leaves up, and (tree, digest) of the roots. A tree
    that is down to one node is done; the others go on."""
    nodes = nodes.select("tree", "n", "place", "digest")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    roots = nodes.filter("n = 1").select("tree", "digest")
    while largest > 1:
        level = stage(with_siblings(nodes.filter("n > 1")), f"{name}-level")
        levels.append(level)
        nodes = parents(level)
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "digest"))
        largest = (largest + FAN_OUT - 1) // FAN_OUT
    return levels, roots


def paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """tree, place, path of every leaf that has a sibling: ``path`` lists (before, after) from the
    leaf up and ends with what ``top`` (tree, path) gives for the whole tree. A parent's path is
    joined to its children, level by level."""
    above: DataFrame | None = None
    for level in reversed(levels):
        own = level.select(
            "tree",
            "place",
            F.array(F.struct("before", "after")).alias("own"),
            run_of(F.col("place")).alias("up"),
        )
        # a node whose parent is its tree's root goes on with the path of the tree
        ends = own.join(top, "tree").withColumnRenamed("path", "last")
        if above is None:
            joined = ends.select("tree", "place", F.concat("own", "last").alias("path"))
        else:
            higher = above.select("tree", F.col("place").alias("up"), "path")
            joined = ends.join(higher, ["tree", "up"], "left").select(
                "tree",
                "place",
                F.concat("own", F.coalesce("path", "last")).alias("path"),
            )
        above = joined
    assert above is not None
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(
        path,
        start,
        lambda own, step: digest(hexed(F.concat(step["before"], own, step["after"]))),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row."""
    base = placed(leaves(docs), ["tree", "doc_id", "digest"], "merkle-leaves")
    levels, subroots = grown(base, "merkle")
    # the last tree, over the languages; its nodes carry the language as a name
    crown = placed(
        subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest"),
        ["tree", "name"],
        "merkle-crown",
    )
    crown_levels, root = grown(crown, "merkle-top")
    root = stage(root, "merkle-root")
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    every = root.select("tree", nothing.alias("path"))
    # a lone language is the root itself and has no path above it
    tops = crown.select("tree", "name", "place", F.col("digest").alias("subroot"))
    if crown_levels:
        tops = tops.join(paths(crown_levels, every), ["tree", "place"])
    else:
        tops = tops.withColumn("path", nothing)
    tops = tops.join(root.withColumnRenamed("digest", "root"), "tree")
    tops = stage(tops.select(F.col("name").alias("tree"), "subroot", "root", "path"), "merkle-tops")
    found = base.join(tops.withColumnRenamed("path", "whole"), "tree")
    if levels:
        below = paths(levels, tops.select("tree", "path"))
        found = found.join(below, ["tree", "place"], "left").withColumn(
            "path", F.coalesce("path", "whole")
        )
    else:
        found = found.withColumnRenamed("whole", "path")
    proof = F.aggregate(
        "path",
        F.lit(b""),
        lambda joined, step: F.concat(joined, step["before"], step["after"]),
    )
    result = found.select(
        "doc_id",
        hexed(F.col("digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(hexed(proof), 256).alias("proof_sha256"),
        hexed(folded(F.coalesce("tampered", "digest"), F.col("path"))).alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
