"""Rank triples: two opposite conventions, validation, inversion, slots to messages.

A baseline subject gives a rank to each slot. A candidate source lists slots in
order. The two are inverse permutations, so an ordering is inverted once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paneloom.schema import MESSAGE_ORDERS, SLOTS


def triple(a: Column, b: Column, c: Column) -> Column:
    return F.array(a.cast("int"), b.cast("int"), c.cast("int"))


def is_triple(ranks: Column) -> Column:
    """True only for a permutation of 1, 2, 3; never null."""
    want = F.array(*[F.lit(s) for s in SLOTS])
    return F.coalesce(F.array_sort(ranks) == want, F.lit(False))


def valid_triple(ranks: Column) -> Column:
    return F.when(is_triple(ranks), ranks)


def invert(ordering: Column) -> Column:
    """Slots in order to the rank of each slot; anything else becomes null."""
    by_slot = F.array(*[F.array_position(ordering, F.lit(s)).cast("int") for s in SLOTS])
    return F.when(is_triple(ordering), by_slot)


def message_order(index: Column) -> Column:
    """Order index, clamped to 0..5 and null read as 0, to the message in each slot."""
    orders = F.array(*[F.array(*[F.lit(m) for m in order]) for order in MESSAGE_ORDERS])
    clamped = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(index.cast("int"), F.lit(0))))
    return F.element_at(orders, clamped + 1)


def ranks_by_message(shown: Column, ranks: Column) -> Column:
    """Array of (message, rank): each slot's rank goes to the message shown there."""
    pairs = F.zip_with(shown, ranks, lambda m, r: F.struct(m.alias("message"), r.alias("rank")))
    return F.filter(pairs, lambda p: p["message"].isNotNull())


def kendall_tau(a: Column, b: Column) -> Column:
    """Concordant minus discordant slot pairs over three; a tie counts as discordant."""
    total = F.lit(0)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        same = (a[i] - a[j]) * (b[i] - b[j]) > 0
        total = total + F.when(same, 1).otherwise(-1)
    return total / F.lit(3.0)
