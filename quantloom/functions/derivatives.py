"""Derivative, fast-state and operational features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mark_index_divergence(mark: Column, index: Column) -> Column:
    return mark / F.nullif(index, F.lit(0.0)) - 1


def relative_change(now: Column, before: Column) -> Column:
    return now / F.nullif(before, F.lit(0.0)) - 1


def annualized_basis(basis: Column, seconds_to_expiry: Column) -> Column:
    return F.when(seconds_to_expiry > 0, basis / (seconds_to_expiry / 31_536_000.0))


def depth_disappearance(bid_change: Column, ask_change: Column) -> Column:
    return F.greatest(-bid_change, -ask_change, F.lit(0.0))


def cancellation_burst(rate: Column, ratio: Column) -> Column:
    return F.when((rate >= 0) & (ratio >= 0), F.log1p(rate * ratio))


def dispersion_acceleration(now: Column, before: Column, elapsed_ns: Column) -> Column:
    return F.when(elapsed_ns > 0, (now - before) / (elapsed_ns / 1e9))


def open_interest_destruction(price_return: Column, oi_change: Column) -> Column:
    return F.when(oi_change >= -1, F.greatest(-oi_change, F.lit(0.0)) * F.abs(price_return))


def liquidation_pressure(velocity: Column, completeness: Column, destruction: Column) -> Column:
    valid = (velocity >= 0) & completeness.between(0, 1) & (destruction >= 0)
    return F.when(valid, F.log1p(velocity * completeness * (1 + destruction)))


def trigger_health(source_lost: Column, missing: Column, quality: Column, coverage: Column) -> Column:
    """Health of a trigger from its inputs (quality and coverage in millionths)."""
    return F.when(source_lost, "unavailable").when((missing > 0) | (quality < 900_000) | (coverage < 1_000_000), "degraded").otherwise("healthy")


def disk_pressure(used: Column, capacity: Column) -> Column:
    return used / F.nullif(capacity, F.lit(0.0))


def cusp_potential(y: Column, alpha: Column, beta: Column) -> Column:
    return F.pow(y, 4) / 4 - beta * y * y / 2 - alpha * y


def cusp_gradient(y: Column, alpha: Column, beta: Column) -> Column:
    return F.pow(y, 3) - beta * y - alpha


def cusp_discriminant(alpha: Column, beta: Column) -> Column:
    """Positive inside the fold (three equilibria), zero on it."""
    return 4 * F.pow(beta, 3) - 27 * alpha * alpha


def cusp_roots(alpha: Column, beta: Column) -> Column:
    """Real roots of y^3 - beta y - alpha, ascending (closed forms, then three
    Newton steps)."""
    disc = cusp_discriminant(alpha, beta)
    third = F.acos(F.greatest(F.least(3 * alpha / (2 * beta) * F.sqrt(3 / beta), F.lit(1.0)), F.lit(-1.0))) / 3
    three = F.array(*(2 * F.sqrt(beta / 3) * F.cos(third - 2 * 3.141592653589793 * k / 3) for k in range(3)))
    inner = F.sqrt(F.greatest(alpha * alpha / 4 - F.pow(beta, 3) / 27, F.lit(0.0)))
    one = F.array(F.cbrt(alpha / 2 + inner) + F.cbrt(alpha / 2 - inner))

    def polish(r: Column) -> Column:
        slope = 3 * r * r - beta
        return F.when(F.abs(slope) > 1e-12, r - cusp_gradient(r, alpha, beta) / slope).otherwise(r)

    out = F.when(disc > 0, three).otherwise(one)
    for _ in range(3):  # one transform a step, so each step computes a root once
        out = F.transform(out, polish)
    return F.array_sort(out)


def cusp_topology(alpha: Column, beta: Column, tolerance: float = 1e-9) -> Column:
    disc = cusp_discriminant(alpha, beta)
    return (
        F.when((F.abs(alpha) <= tolerance) & (F.abs(beta) <= tolerance), "critical")
        .when((F.abs(disc) <= tolerance) & (beta > 0), "fold")
        .when(disc > 0, "three")
        .otherwise("one")
    )


def cusp_barriers(roots: Column) -> tuple[Column, Column]:
    """Heights of the two barriers between three roots a < b < c of zero sum:
    c (b-a)^3 / 4 and -a (c-b)^3 / 4; missing outside the fold."""
    a, b, c = (F.get(roots, F.lit(k)) for k in range(3))
    three = F.size(roots) == 3
    return F.when(three, c * F.pow(b - a, 3) / 4), F.when(three, -a * F.pow(c - b, 3) / 4)
