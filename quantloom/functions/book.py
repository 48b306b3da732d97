"""Features of one order-book snapshot held as sorted arrays of levels.

``bids`` (best first, descending) and ``asks`` (best first, ascending) are
``array<struct<price: double, qty: double>>``.  Everything is a column
expression over those arrays, so a snapshot is a row and nothing is exploded.
A book without both sides, or crossed, has no trusted features.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band widths in basis points (fixed values).
BANDS = (1, 2, 5, 10, 25, 50, 100)


def best(side: str) -> Column:
    return F.get(F.col(side), F.lit(0))


def mid() -> Column:
    return (best("bids")["price"] + best("asks")["price"]) / 2


def classification() -> Column:
    bid, ask = best("bids")["price"], best("asks")["price"]
    return (
        F.when(bid.isNull() | ask.isNull(), "one_sided").when(bid == ask, "locked").when(bid > ask, "crossed").otherwise("normal")
    )


def absolute_spread() -> Column:
    return best("asks")["price"] - best("bids")["price"]


def relative_spread() -> Column:
    return absolute_spread() / mid()


def _sum(levels: Column, value) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + value(x))


def depth(side: str, bps: int) -> Column:
    """Quantity within an inclusive band around the mid, by multiplication only."""
    m = mid()
    if side == "bids":
        inside = F.filter(F.col(side), lambda x: (m - x["price"]) * 10_000 <= m * bps)
    else:
        inside = F.filter(F.col(side), lambda x: (x["price"] - m) * 10_000 <= m * bps)
    return _sum(inside, lambda x: x["qty"])


def depths(side: str, m: Column) -> Column:
    """The depths of all ``BANDS`` around a mid (a column of its own) in one
    pass over a side's levels: a struct with a field ``b<bps>`` each."""
    start = F.struct(m.alias("m"), *(F.lit(0.0).alias(f"b{b}") for b in BANDS))

    def add(s: Column, x: Column) -> Column:
        away = ((s["m"] - x["price"]) if side == "bids" else (x["price"] - s["m"])) * 10_000
        return F.struct(s["m"].alias("m"), *(F.when(away <= s["m"] * b, s[f"b{b}"] + x["qty"]).otherwise(s[f"b{b}"]).alias(f"b{b}") for b in BANDS))

    return F.aggregate(F.col(side), start, add)


def imbalance_of(b: Column, a: Column) -> Column:
    return (b - a) / F.nullif(b + a, F.lit(0.0))


def imbalance(bps: int) -> Column:
    return imbalance_of(depth("bids", bps), depth("asks", bps))


def weighted_midpoint() -> Column:
    b, a = best("bids"), best("asks")
    return (b["price"] * b["qty"] + a["price"] * a["qty"]) / (b["qty"] + a["qty"])


def microprice() -> Column:
    b, a = best("bids"), best("asks")
    return (a["price"] * b["qty"] + b["price"] * a["qty"]) / (b["qty"] + a["qty"])


def entropy_and_concentration() -> tuple[Column, Column]:
    """Normalised Shannon entropy and Herfindahl index of displayed quantity.

    The index is the sum of squares over the squared total, one division: the
    sum of rounded shares depends on the order of the levels and may fall below
    a half of the last digit that the index is exactly."""
    both = F.concat("bids", "asks")
    total, n = _sum(both, lambda x: x["qty"]), F.size(both)

    def plogp(side: str) -> Column:
        share = F.filter(F.transform(F.col(side), lambda x: x["qty"] / total), lambda w: w > 0)
        return F.aggregate(share, F.lit(0.0), lambda s, w: s - w * F.log(w))

    return F.when(n > 1, (plogp("bids") + plogp("asks")) / F.log(n)), _sum(both, lambda x: x["qty"] * x["qty"]) / (total * total)


def wall_distance(side: str, notional: float) -> Column:
    """Distance in bps of the nearest level of at least that notional."""
    wall = F.get(F.filter(F.col(side), lambda x: x["price"] * x["qty"] >= notional), F.lit(0))["price"]
    return F.abs(wall - mid()) / mid() * 10_000


def gap_density(side: str, tick: float) -> Column:
    """Missing ticks over the tick span from the inside to the outermost level."""
    prices = F.transform(F.col(side), lambda x: x["price"])
    span = F.round((F.array_max(prices) - F.array_min(prices)) / tick)
    return F.when(span > 0, (span + 1 - F.size(side)) / span)


def executable_notional(side: str, bps: int) -> Column:
    """Notional that trades within an inclusive slippage of the best price."""
    p0 = best(side)["price"]
    inside = F.filter(F.col(side), lambda x: F.abs(x["price"] - p0) * 10_000 <= p0 * bps)
    return _sum(inside, lambda x: x["price"] * x["qty"])


def sweep_cost(side: str, notional: float) -> Column:
    """Relative cost of consuming that notional, against the mid; null if the
    side holds less."""
    start = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("qty"))

    def take(s: Column, x: Column) -> Column:
        used = F.least(s["left"], x["price"] * x["qty"])
        return F.struct((s["left"] - used).alias("left"), (s["qty"] + used / x["price"]).alias("qty"))

    done = F.aggregate(F.col(side), start, take)
    return F.when(done["left"] <= 0, F.abs(F.lit(float(notional)) / done["qty"] / mid() - 1))


def slope_and_convexity(side: str, tick: float) -> tuple[Column, Column]:
    """Least-squares quadratic of cumulative depth on tick distance through the
    first three levels (exact for three points): the linear coefficient and
    the second derivative.  Fewer levels are missing."""
    top = F.slice(F.col(side), 1, 3)
    x = [F.round(F.abs(F.get(top, F.lit(k))["price"] - F.get(top, F.lit(0))["price"]) / tick) for k in range(3)]
    q = [F.get(top, F.lit(k))["qty"] for k in range(3)]
    y = [q[0], q[0] + q[1], q[0] + q[1] + q[2]]
    first = (y[1] - y[0]) / (x[1] - x[0])
    second = (y[2] - y[1]) / (x[2] - x[1])
    curve = (second - first) / (x[2] - x[0])
    linear = first - curve * (x[0] + x[1])
    enough = F.size(top) == 3
    return F.when(enough, linear), F.when(enough, 2 * curve)


def quality_score(gaps: Column, checksum_failures: Column, crossed: Column) -> Column:
    """A million less penalties, not below 0."""
    return F.greatest(F.lit(1_000_000) - 250_000 * gaps - 300_000 * checksum_failures - 50_000 * crossed, F.lit(0))
