"""Seeding the asset inventory by host name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.ip import cidr_struct
from netquarry.operators.prefix import overlap_witnesses
from netquarry.session import materialize

# fixed values
HOSTNAME = (
    r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    r"(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"
)
TAG = r"^[a-z0-9-]{1,32}$"
ENVIRONMENTS = ("lab", "dev", "staging", "prod_sim")
MAX_TAGS, MAX_NETWORKS, MAX_OWNER, MAX_DESCRIPTION = 20, 32, 128, 1000

_FIELDS = ["environment", "owner", "criticality", "tags", "description"]


def _cleaned(seed: DataFrame) -> DataFrame:
    return seed.withColumns(
        {
            "hostname": F.lower(F.trim("hostname")),
            "tags": F.transform(
                F.coalesce("tags", F.expr("CAST(array() AS ARRAY<STRING>)")),
                lambda t: F.lower(F.trim(t)),
            ),
            "criticality": F.coalesce("criticality", F.lit(3)),
            "networks": F.coalesce(
                "networks",
                F.expr("CAST(array() AS ARRAY<STRUCT<cidr: STRING, is_primary: BOOLEAN>>)"),
            ),
        }
    )


def _row_problem() -> Column:
    """The first rule a seed row breaks on its own."""
    nets = F.col("networks")
    cidrs = F.transform(nets, lambda n: n["cidr"])
    bad_network = F.exists(
        cidrs, lambda c: ~F.coalesce(cidr_struct(c)["strict"], F.lit(False))
    )
    primaries = F.size(F.filter(nets, lambda n: n["is_primary"]))
    tags = F.col("tags")
    return (
        F.when(~F.coalesce(F.col("hostname").rlike(HOSTNAME), F.lit(False)), F.lit("hostname"))
        .when(~F.coalesce(F.col("environment").isin(*ENVIRONMENTS), F.lit(False)), F.lit("environment"))
        .when(~F.col("criticality").between(1, 5), F.lit("criticality"))
        .when(F.length("owner") > MAX_OWNER, F.lit("owner"))
        .when(F.length("description") > MAX_DESCRIPTION, F.lit("description"))
        .when(
            (F.size(tags) > MAX_TAGS)
            | F.exists(tags, lambda t: ~t.rlike(TAG))
            | (F.size(F.array_distinct(tags)) != F.size(tags)),
            F.lit("tags"),
        )
        .when(
            (F.size(nets) > MAX_NETWORKS)
            | bad_network
            | (primaries > 1)
            | (F.size(F.array_distinct(cidrs)) != F.size(cidrs)),
            F.lit("networks"),
        )
    )


def upsert_assets(
    assets: DataFrame, networks: DataFrame, seed: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(assets, networks, refused)`` after seeding. A host name that exists is overwritten and
    reactivated and its networks are replaced as a whole; a new one is added. ``refused`` is
    ``(hostname, problem)``; when it is not empty the seed is refused as a whole and the tables
    come back unchanged.

    ``seed`` is ``(hostname, environment, owner, criticality, tags, description, networks
    ARRAY<STRUCT<cidr, is_primary>>)``."""
    clean = materialize(_cleaned(seed))
    alone = clean.select("hostname", _row_problem().alias("problem")).filter(
        F.col("problem").isNotNull()
    )
    twice = (
        clean.groupBy("hostname")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("hostname", F.lit("duplicate hostname").alias("problem"))
    )
    known = assets.select("asset_id", "hostname", F.col("created_at").alias("_born"))
    identified = clean.join(known, "hostname", "left").withColumn(
        "asset_id", F.coalesce("asset_id", F.concat(F.lit("asset-"), F.substring(F.sha2("hostname", 256), 1, 32)))
    )
    fresh_nets = identified.select("asset_id", "hostname", F.explode("networks").alias("n")).select(
        "asset_id", "hostname", "n.cidr", F.coalesce("n.is_primary", F.lit(False)).alias("is_primary")
    )
    active = networks.join(
        assets.filter("is_active").select("asset_id"), "asset_id", "left_semi"
    )
    sound = fresh_nets.join(alone.select("hostname").distinct(), "hostname", "left_anti")
    clashes = overlap_witnesses(sound, active, exclude=identified.select("asset_id"))
    overlapping = (
        clashes.join(identified.select("asset_id", "hostname"), "asset_id")
        .select("hostname", F.lit("network overlap").alias("problem"))
        .distinct()
    )
    refused = materialize(alone.unionByName(twice).unionByName(overlapping))
    if not refused.isEmpty():
        return assets, networks, refused
    written = identified.select(
        "asset_id",
        "hostname",
        *_FIELDS,
        F.lit(True).alias("is_active"),
        F.coalesce("_born", now).alias("created_at"),
    )
    kept = assets.join(written.select("asset_id"), "asset_id", "left_anti")
    kept_nets = networks.join(identified.select("asset_id"), "asset_id", "left_anti")
    return (
        kept.select(*written.columns).unionByName(written),
        kept_nets.select("asset_id", "cidr", "is_primary").unionByName(
            fresh_nets.drop("hostname")
        ),
        refused,
    )
