"""Longest-prefix match and network membership as equi-joins.

A range or containment predicate would run as a nested loop. Each network is one key
``(version, mask length, leading bits)``; each address is probed once per mask length in use.
The mask lengths are one row per IP version (at most two rows, at most 129 numbers each), which
is the only thing broadcast by hint. Whether the networks themselves are broadcast is left to
Spark's size check; beyond it the join shuffles, and there the keys of short prefixes, which
can attract any number of addresses, are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.ip import cidr_struct, hex_version, ip_hex, prefix_key

SALTS = 16
_TRIPLE = ["ip_version", "masklen", "net_key"]


def network_keys(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``networks`` with ``ip_version, masklen, net_key``; unreadable networks drop out."""
    # generated rather than filtered, so the text is parsed once per network
    return (
        networks.withColumn("_net", F.explode(F.array_compact(F.array(cidr_struct(F.col(cidr))))))
        .select(
            *networks.columns, F.col("_net.ip_version"), F.col("_net.masklen"), F.col("_net.net_key")
        )
    )


def mask_lengths(keyed: DataFrame) -> DataFrame:
    """At most two rows: the mask lengths in use per IP version."""
    return keyed.groupBy("ip_version").agg(F.collect_set("masklen").alias("_lens"))


def _wide(version: Column, masklen: Column) -> Column:
    """Prefixes short enough to cover many addresses: up to /16 in IPv4, any in IPv6 but hosts."""
    return ((version == 4) & (masklen <= 16)) | ((version == 6) & (masklen < 128))


def _probes(df: DataFrame, hex_col: str, lengths: DataFrame, identity: str) -> DataFrame:
    return (
        df.withColumn("ip_version", hex_version(F.col(hex_col)))
        .join(F.broadcast(lengths), "ip_version")
        .withColumn("masklen", F.explode("_lens"))
        .drop("_lens")
        .withColumn("net_key", prefix_key(F.col(hex_col), F.col("masklen")))
        .withColumn(
            "_salt",
            F.when(
                _wide(F.col("ip_version"), F.col("masklen")),
                F.pmod(F.xxhash64(identity), F.lit(SALTS)),
            ).otherwise(F.lit(0)),
        )
    )


def _salted(keyed: DataFrame) -> DataFrame:
    zero, last = F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")
    salts = F.when(
        _wide(F.col("ip_version"), F.col("masklen")), F.sequence(zero, last)
    ).otherwise(F.array(zero))
    return keyed.withColumn("_salt", F.explode(salts))


def _distinct_addresses(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .select(F.col(column).alias("address"))
        .distinct()
        .withColumn("_hex", F.explode(F.array_compact(F.array(ip_hex(F.col("address"))))))
    )


def memberships(df: DataFrame, column: str, networks: DataFrame) -> DataFrame:
    """``(address, asset_id)``: every asset with a network containing the address."""
    keyed = network_keys(networks).select(*_TRIPLE, "asset_id").distinct()
    probes = _probes(_distinct_addresses(df, column), "_hex", mask_lengths(keyed), "address")
    return (
        probes.join(_salted(keyed), [*_TRIPLE, "_salt"]).select("address", "asset_id").distinct()
    )


def longest_match(df: DataFrame, column: str, networks: DataFrame) -> DataFrame:
    """``(address, asset_id, criticality, masklen)`` for the distinct addresses that resolve.

    ``networks`` carries ``asset_id, cidr, is_primary, is_active, created_at, criticality``.
    Preference: longest prefix, then primary, then the older asset, then the smaller id; only
    active assets. The last three choose one network per key before the join, so each probe
    meets at most one row."""
    active = network_keys(networks.filter("is_active"))
    best = active.groupBy(*_TRIPLE).agg(
        F.min_by(
            F.struct("asset_id", "criticality"),
            F.struct((~F.col("is_primary")).alias("a"), "created_at", "asset_id"),
        ).alias("asset")
    )
    probes = _probes(_distinct_addresses(df, column), "_hex", mask_lengths(best), "address")
    hits = probes.join(_salted(best), [*_TRIPLE, "_salt"])
    return (
        hits.groupBy("address")
        .agg(F.max_by(F.struct("asset", "masklen"), "masklen").alias("m"))
        .select(
            "address",
            F.col("m.asset.asset_id").alias("asset_id"),
            F.col("m.asset.criticality").alias("criticality"),
            F.col("m.masklen").alias("masklen"),
        )
    )


def resolve_assets(
    df: DataFrame, column: str, networks: DataFrame, prefix: str = ""
) -> DataFrame:
    """``df`` plus ``asset_id``, ``criticality``, ``masklen`` of the address in ``column``; NULL
    where nothing matches. Each distinct address is resolved once and joined back."""
    names = {n: prefix + n for n in ("asset_id", "criticality", "masklen")}
    found = longest_match(df, column, networks).withColumnsRenamed(names)
    return df.join(found.withColumnRenamed("address", column), column, "left").select(
        *df.columns, *names.values()
    )


def network_overlaps(
    candidates: DataFrame, existing: DataFrame, exclude: DataFrame | None = None
) -> DataFrame:
    """``(asset_id, cidr, other_asset_id, other_cidr)``: candidate networks that overlap a
    network of another asset, among the existing ones or within the candidates themselves.
    Two networks overlap exactly when one is a prefix of the other, so each pair is found by
    looking the longer one up among the shorter. ``exclude`` lists asset ids whose existing
    networks are about to be replaced."""
    if exclude is not None:
        existing = existing.join(exclude.select("asset_id").distinct(), "asset_id", "left_anti")
    mine = network_keys(candidates.select("asset_id", "cidr").distinct())
    theirs = network_keys(existing.select("asset_id", "cidr").distinct())
    other = theirs.withColumn("_new", F.lit(False)).unionByName(
        mine.withColumn("_new", F.lit(True))
    )

    def contained(longer: DataFrame, shorter: DataFrame) -> DataFrame:
        hexed = longer.withColumn("_hex", F.rpad("net_key", F.when(F.col("ip_version") == 4, 8).otherwise(32), "0"))
        ups = _probes(
            hexed.withColumnsRenamed({"masklen": "_own_len"}).drop("net_key", "ip_version"),
            "_hex",
            mask_lengths(shorter),
            "cidr",
        ).filter(F.col("masklen") <= F.col("_own_len"))
        return ups.withColumnsRenamed({"asset_id": "_l_asset", "cidr": "_l_cidr"}).join(
            _salted(shorter), [*_TRIPLE, "_salt"]
        )

    down = contained(mine, other).select(
        F.col("_l_asset").alias("asset_id"),
        F.col("_l_cidr").alias("cidr"),
        F.col("asset_id").alias("other_asset_id"),
        F.col("cidr").alias("other_cidr"),
    )
    up = contained(other, mine).select(
        "asset_id",
        "cidr",
        F.col("_l_asset").alias("other_asset_id"),
        F.col("_l_cidr").alias("other_cidr"),
    )
    return down.unionByName(up).filter("asset_id <> other_asset_id").distinct()


def overlap_witnesses(
    candidates: DataFrame, existing: DataFrame, exclude: DataFrame | None = None
) -> DataFrame:
    """``(asset_id, cidr, other_asset_id, other_cidr)``: every candidate network that overlaps a
    network of another asset, with one such network. The same rule as :func:`network_overlaps`
    without its pairs: networks under one prefix are first reduced to those of the smallest and
    the largest asset, of which one is another asset's if any is, so the work grows with the
    networks and the mask lengths in use."""
    if exclude is not None:
        existing = existing.join(exclude.select("asset_id").distinct(), "asset_id", "left_anti")
    mine = network_keys(candidates.select("asset_id", "cidr").distinct())
    other = network_keys(existing.select("asset_id", "cidr").distinct()).unionByName(mine)

    def reduced(keyed: DataFrame) -> DataFrame:
        net = F.struct(F.col("asset_id").alias("a"), F.col("cidr").alias("c"))
        return keyed.groupBy(*_TRIPLE).agg(F.min(net).alias("_low"), F.max(net).alias("_high"))

    def above(longer: DataFrame, shorter: DataFrame) -> DataFrame:
        """Each network once per mask length of ``shorter`` up to its own."""
        width = F.when(F.col("ip_version") == 4, 8).otherwise(32)
        hexed = longer.withColumn("_hex", F.rpad("net_key", width, "0"))
        return _probes(
            hexed.withColumnRenamed("masklen", "_own_len").drop("net_key", "ip_version"),
            "_hex",
            mask_lengths(shorter),
            "cidr",
        ).filter(F.col("masklen") <= F.col("_own_len"))

    wider = above(mine, other).join(_salted(reduced(other)), [*_TRIPLE, "_salt"])
    inner = mine.join(reduced(above(other, mine)), _TRIPLE)
    witness = F.when(F.col("_low.a") != F.col("asset_id"), F.col("_low")).when(
        F.col("_high.a") != F.col("asset_id"), F.col("_high")
    )
    found = wider.select("asset_id", "cidr", witness.alias("_w")).unionByName(
        inner.select("asset_id", "cidr", witness.alias("_w"))
    )
    return (
        found.groupBy("asset_id", "cidr")
        .agg(F.min("_w").alias("_w"))
        .filter("_w IS NOT NULL")
        .select("asset_id", "cidr", F.col("_w.a").alias("other_asset_id"), F.col("_w.c").alias("other_cidr"))
    )
