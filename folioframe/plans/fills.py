"""Fills of orders, from sightings that tell cumulative amounts.

A sighting says how much of an order is filled by then. What was filled between two sightings is their difference; a
difference below 0 is a correction. The differences are taken over all sightings by the time they carry, so neither
the order in which they come nor the batches they come in matter, and a late one splits the fill that it falls into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators.merge import one_per_key, split_bad
from folioframe.operators.sequence import with_previous
from folioframe.schemas import KEYS

ORDER_KEYS = list(KEYS["domestic_orders"])
SIGHTING = [*ORDER_KEYS, "seen_at", "place"]
VALUES = ["filled_qty", "filled_amount", "is_cancelled"]


def sightings(rows: DataFrame) -> DataFrame:
    """One row per order, time and place of sighting, of any batch or of such rows: copies are one. Rows without a
    key, or that do not say how much is filled, are left out."""
    good, _ = split_bad(rows, *ORDER_KEYS, "filled_qty")
    filled = good.select(*SIGHTING, "filled_qty", F.coalesce("filled_amount", F.lit(0)).alias("filled_amount"),
                         F.coalesce("is_cancelled", F.lit(False)).alias("is_cancelled"))
    # Of copies that differ all the same, the higher one, whatever batch it came in.
    return one_per_key(filled, tuple(SIGHTING), VALUES)


def fills(seen: DataFrame, tasks: int | None = None) -> DataFrame:
    """The events of each order, from `sightings`: kind, filled_qty and filled_amount (differences), their average
    price, and the time before which and after which the event took place (`seen_at`, `previous_seen_at`).

    `kind` is `fill`, `correction` (less is filled than was said before, or only the amount changed) or `cancel` (the
    order is cancelled from now on and nothing else changed). The quantities of an order's events add up to what its
    latest sighting says.
    """
    rows = with_previous(seen, ORDER_KEYS, ["seen_at", "place"], [*VALUES, "seen_at"], tasks=tasks)
    changed = {
        "filled_qty": F.col("filled_qty") - F.coalesce("previous_filled_qty", F.lit(0)),
        "filled_amount": F.col("filled_amount") - F.coalesce("previous_filled_amount", F.lit(0)),
        "cancelled": F.col("is_cancelled") & ~F.coalesce("previous_is_cancelled", F.lit(False)),
    }
    events = rows.select(*SIGHTING, "previous_seen_at", *[value.alias(name) for name, value in changed.items()])
    kind = (F.when(F.col("filled_qty") > 0, "fill")
            .when((F.col("filled_qty") < 0) | (F.col("filled_amount") != 0), "correction")
            .when(F.col("cancelled"), "cancel"))
    price = F.when((F.col("filled_qty") > 0) & (F.col("filled_amount") > 0), F.col("filled_amount") / F.col("filled_qty"))
    return events.withColumns({"kind": kind, "price": price}).filter(F.col("kind").isNotNull())
