"""Replaying requests against a state machine, however many one case has.

A request is a function from states to states. Written as text, its k-th character is the state
that state k goes to, so ``translate`` applies it to a state and also composes two of them. A block
of up to ``BLOCK`` requests in order is one such function, a block of those blocks again, until
every case has one block. On the way down each block learns the state it starts in from the block
above. No task ever walks more than one block, so a case with a billion requests costs five levels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.pieces import numbered
from netquarry.session import stored

#: A block holds two to this power of requests, or of the blocks below.
BITS = 6


class Machine:
    """States and, for each target, the states a request may come from. A request for another
    target, or from another state, changes nothing."""

    def __init__(self, legal: Mapping[str, Sequence[str]]) -> None:
        if len(legal) > 26:
            raise ValueError("at most 26 states")
        self.states = list(legal)
        self.letters = "".join(chr(ord("a") + i) for i in range(len(self.states)))
        self.legal = legal

    def letter(self, status: Column) -> Column:
        """The state as a letter, ``-`` for one that the machine does not know."""
        pairs = [F.lit(x) for s, c in zip(self.states, self.letters, strict=True) for x in (s, c)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit("-"))

    def status(self, letter: Column) -> Column:
        pairs = [F.lit(x) for s, c in zip(self.states, self.letters, strict=True) for x in (c, s)]
        return F.try_element_at(F.create_map(*pairs), letter)

    def move(self, target: Column) -> Column:
        """The function of a request for ``target``."""
        pairs: list[Column] = []
        for to, place in zip(self.states, self.letters, strict=True):
            goes = (
                place if to in self.legal[s] else c
                for s, c in zip(self.states, self.letters, strict=True)
            )
            pairs += [F.lit(to), F.lit("".join(goes))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), target), F.lit(self.letters))

    def apply(self, letters: Column, function: Column) -> Column:
        """The state after ``function``; of a function, both in a row."""
        return F.call_function("translate", letters, F.lit(self.letters), function)


def states_before(
    rows: DataFrame, starts: DataFrame, key: str, order: Sequence[str], target: str, machine: Machine
) -> DataFrame:
    """``rows`` with ``_before``: the letter of the state each request meets, requests of a ``key``
    being applied in ``order``. ``starts`` is ``(key, _before)``, one row per key. Requests of keys
    that are not there are left out."""
    placed = numbered(rows, [key], order, "_n").withColumn("_p", F.col("_n") - 1).drop("_n")
    one = [c for c in placed.columns if c not in (key, "_p")]
    items = placed.select(
        key, "_p", machine.move(F.col(target)).alias("_move"), F.struct(*one).alias("_row")
    )
    levels: list[DataFrame] = []
    while True:
        payload = [c for c in items.columns if c not in (key, "_p")]
        blocks = stored(
            items.groupBy(key, F.shiftright("_p", BITS).alias("_block")).agg(
                F.array_sort(F.collect_list(F.struct("_p", *payload))).alias("_items")
            ),
            "replay-blocks",
        )
        levels.append(blocks)
        if not blocks.agg(F.max("_block")).first()[0]:
            break
        whole = F.aggregate(
            F.col("_items._move"), F.lit(machine.letters), lambda f, g: machine.apply(f, g)
        )
        items = blocks.select(key, F.col("_block").alias("_p"), whole.alias("_move"))

    # the uppermost level has one block per key
    known = starts.select(key, F.lit(0).cast("bigint").alias("_block"), "_before")
    for blocks in reversed(levels):
        trail = F.aggregate(
            F.col("_items._move"),
            F.col("_before"),
            lambda t, g: F.concat(t, machine.apply(F.right(t, F.lit(1)), g)),
        )
        walked = blocks.join(known, [key, "_block"]).select(key, "_items", trail.alias("_trail"))
        each = walked.select(key, "_trail", F.posexplode("_items").alias("_i", "_item")).select(
            key,
            "_item",
            F.substring("_trail", F.col("_i") + 1, F.lit(1)).alias("_before"),
        )
        known = each.select(key, F.col("_item._p").alias("_block"), "_before")
    return each.select(key, "_item._row.*", "_before").select(*rows.columns, "_before")
