"""Addresses as Column expressions.

Spark has no address type. An address is carried as canonical text; where it must be compared,
it becomes fixed-width hex (8 digits for IPv4, 32 for IPv6), because fixed-width hex orders like
the number it spells and a prefix of ``m`` bits is a prefix of the text.
"""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.binding import let

# fixed values: networks treated as internal. Documentation ranges are external on purpose.
INTERNAL_NETWORKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
)

# the same networks as one pattern over canonical text, so the test is a single native match
INTERNAL_PATTERN = (
    r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\."
    r"|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
    r"|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
    r"|^::1?$|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^ff[0-9a-f]{2}:"
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V6_HALF = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7})?$"


def _v4_hex(text: Column) -> Column:
    octets = F.split(text, r"\.")
    digits = [F.lpad(F.hex(F.get(octets, F.lit(i)).try_cast("bigint")), 2, "0") for i in range(4)]
    return F.lower(F.concat(*digits))


def _groups(half: Column) -> Column:
    return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")


def _pure_hex_groups(low: Column) -> Column:
    """A dotted tail, as in ``::ffff:10.0.0.1``, rewritten as two hex groups."""

    def rewrite(tail: Column) -> Column:
        return F.concat(
            F.regexp_extract(low, r"^(.*:)[0-9.]+$", 1),
            F.substring(tail, 1, 4),
            F.lit(":"),
            F.substring(tail, 5, 4),
        )

    dotted = F.regexp_extract(low, r":([0-9.]+)$", 1)
    return F.when(
        low.contains("."), let(F.when(dotted.rlike(V4_PATTERN), _v4_hex(dotted)), rewrite)
    ).otherwise(low)


def _expand(halves: Column) -> Column:
    left, right = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))

    def full(sides: Column) -> Column:
        known = F.size(sides["l"]) + F.size(sides["r"])
        complete = F.when(F.size(halves) == 1, known == 8).otherwise(
            (F.size(halves) == 2) & (known <= 7)
        )
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - known, F.lit(0)))
        padded = F.transform(F.concat(sides["l"], zeros, sides["r"]), lambda g: F.lpad(g, 4, "0"))
        return F.when(complete, F.array_join(padded, ""))

    shaped = left.rlike(_V6_HALF) & (right.isNull() | right.rlike(_V6_HALF))
    return F.when(
        shaped, let(F.struct(_groups(left).alias("l"), _groups(right).alias("r")), full)
    )


def _v6_hex(text: Column) -> Column:
    return let(
        F.lower(text), lambda low: let(F.split(_pure_hex_groups(low), "::"), _expand)
    )


def ip_hex(text: Column) -> Column:
    """8 or 32 lower-case hex digits, or NULL when the text is not an address."""
    return F.when(text.rlike(V4_PATTERN), _v4_hex(text)).when(
        text.contains(":"), _v6_hex(text)
    )


def hex_version(hex_text: Column) -> Column:
    return F.when(F.length(hex_text) == 8, F.lit(4)).when(F.length(hex_text) == 32, F.lit(6))


def ip_version(text: Column) -> Column:
    return hex_version(ip_hex(text))


def _fold_zeros(framed: Column) -> Column:
    """``:1:0:0:2:`` to ``1::2``: the longest run of two or more zero groups, leftmost of
    equals."""
    folded = F.regexp_replace(framed, "^:|:$", "")
    for run in range(2, 9):
        zeros = ":" + "0:" * run
        at = F.instr(framed, zeros)
        head = F.substr(framed, F.lit(2), F.greatest(at - 2, F.lit(0)))
        rest = F.substr(framed, at + len(zeros))
        folded = F.when(
            at > 0, F.concat(head, F.lit("::"), F.regexp_replace(rest, ":$", ""))
        ).otherwise(folded)
    return folded


def hex_to_text(hex_text: Column) -> Column:
    """Canonical text: dotted quad, or IPv6 with its longest run of zero groups folded."""

    def spell(h: Column) -> Column:
        quad = F.concat_ws(".", *[F.conv(F.substring(h, 2 * i + 1, 2), 16, 10) for i in range(4)])
        groups = [F.regexp_replace(F.substring(h, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)]
        framed = F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":"))
        return F.when(F.length(h) == 8, quad).when(F.length(h) == 32, let(framed, _fold_zeros))

    return let(hex_text, spell)


def ip_canonical(text: Column) -> Column:
    """The one spelling of an address, NULL when it is not one."""
    return F.when(text.rlike(V4_PATTERN), text).when(
        text.contains(":"), hex_to_text(_v6_hex(text))
    )


def _bounds(cidr: str) -> tuple[int, str, str]:
    net = ip_network(cidr, strict=False)
    width = 8 if net.version == 4 else 32
    return (
        width,
        format(int(net.network_address), f"0{width}x"),
        format(int(net.broadcast_address), f"0{width}x"),
    )


def hex_in(hex_text: Column, cidr: str) -> Column:
    width, low, high = _bounds(cidr)
    return (F.length(hex_text) == width) & hex_text.between(low, high)


def ip_in(text: Column, cidr: str) -> Column:
    """Membership of a literal network. A v4 address is never inside a v6 network."""
    return F.coalesce(hex_in(ip_hex(text), cidr), F.lit(False))


def is_internal(text: Column) -> Column:
    """Whether canonical address text lies in :data:`INTERNAL_NETWORKS`."""
    return text.rlike(INTERNAL_PATTERN)


def prefix_key(hex_text: Column, masklen: Column) -> Column:
    """The first ``masklen`` bits of a hex address, as hex with the last digit masked."""
    whole = F.floor(masklen / 4).cast("int")
    digit = F.substr(hex_text, whole + 1, F.lit(1))
    kept = masklen % 4
    masked = (
        F.when(kept == 1, F.translate(digit, "0123456789abcdef", "0000000088888888"))
        .when(kept == 2, F.translate(digit, "0123456789abcdef", "000044448888cccc"))
        .when(kept == 3, F.translate(digit, "0123456789abcdef", "0022446688aaccee"))
        .otherwise(F.lit(""))
    )
    return F.concat(F.substr(hex_text, F.lit(1), whole), masked)


def _network(net: Column) -> Column:
    base, masklen = net["h"], net["m"]
    width = F.length(base) * 4

    def build(key: Column) -> Column:
        return F.struct(
            hex_version(base).alias("ip_version"),
            masklen.alias("masklen"),
            key.alias("net_key"),
            base.alias("net_hex"),
            (F.substr(F.rpad(key, 32, "0"), F.lit(1), F.length(base)) == base).alias("strict"),
        )

    return F.when(
        base.isNotNull() & masklen.between(0, width), let(prefix_key(base, masklen), build)
    )


def cidr_struct(cidr: Column) -> Column:
    """``{ip_version, masklen, net_key, net_hex, strict}`` of a network; NULL if unreadable.
    ``strict`` is false when host bits are set. An address alone is a full-length network."""

    def read(parts: Column) -> Column:
        def finish(base: Column) -> Column:
            given = F.get(parts, F.lit(1))
            masklen = F.when(given.isNull(), F.length(base) * 4).when(
                given.rlike("^[0-9]{1,3}$"), given.try_cast("int")
            )
            return let(
                F.struct(base.alias("h"), masklen.cast("int").alias("m")), _network
            )

        return F.when(F.size(parts) <= 2, let(ip_hex(F.get(parts, F.lit(0))), finish))

    return let(F.split(F.trim(cidr), "/"), read)
