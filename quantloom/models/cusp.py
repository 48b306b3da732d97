"""Cusp model beyond its roots: controls from features, stationary likelihood,
posterior by Laplace, the gate of a candidate, and the online engine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.models import sequential
from quantloom.models.roots import cubic_roots

PPM = 1_000_000


@dataclass(frozen=True)
class ControlFeature:
    """A feature of the controls: its normalisation, weights and whether it is required."""

    name: str
    center: float
    scale: float
    alpha: float
    beta: float
    required: bool = False


def controls(features: list[ControlFeature], intercepts: tuple[float, float]) -> tuple[Column, Column, Column, Column]:
    """Alpha, beta, the optional features that are missing (they count as their
    centre), and the reason there are no controls (a required one is missing)."""
    known = {f.name: F.col(f.name).isNotNull() for f in features}
    z = {f.name: F.coalesce((F.col(f.name) - f.center) / f.scale, F.lit(0.0)) for f in features}
    reason = F.when(~F.coalesce(*(F.when(~known[f.name], F.lit(False)) for f in features if f.required), F.lit(True)), "required_feature_missing")
    total = lambda part, start: sum((z[f.name] * getattr(f, part) for f in features), F.lit(start))
    missing = F.array_compact(F.array(*(F.when(~known[f.name], f.name) for f in features if not f.required)))
    made = [F.when(reason.isNull(), total(part, start)) for part, start in zip(("alpha", "beta"), intercepts, strict=True)]
    return made[0], made[1], missing, reason


def stationary_loss(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, scale: np.ndarray, weight: np.ndarray, bound: float = 6.0, points: int = 1201) -> float:
    """Mean negative log of the stationary density exp(-2 V / scale^2), whose
    normaliser is a quadrature over ``[-bound, bound]``."""
    grid = np.linspace(-bound, bound, points)
    potential = lambda x, a, b: x**4 / 4 - b * x * x / 2 - a * x
    total = 0.0
    for at in range(0, len(y), 512):
        part = slice(at, at + 512)
        a, b, heat = alpha[part, None], beta[part, None], 2 / scale[part, None] ** 2
        log_density = -heat * potential(grid[None], a, b)
        top = log_density.max(axis=1, keepdims=True)
        log_norm = np.log(np.trapezoid(np.exp(log_density - top), grid, axis=1)) + top[:, 0]
        total += float(weight[part] @ (heat[:, 0] * potential(y[part], alpha[part], beta[part]) + log_norm))
    return total / float(weight.sum())


def laplace(hessian: np.ndarray, rows: float, least: float = 1e-9) -> tuple[np.ndarray, bool]:
    """Covariance at a mode from the mean loss's Hessian; a Hessian that is not
    positive definite is raised to be, and reported."""
    values, vectors = np.linalg.eigh((hessian + hessian.T) / 2 * rows)
    good = bool((values > least).all())
    values = np.maximum(values, max(least, 1e-6 * float(np.abs(values).max(initial=0))))
    return (vectors / values) @ vectors.T, good


def draws(mode: np.ndarray, covariance: np.ndarray, n: int, seed: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(covariance)
    return mode + np.random.default_rng(seed).standard_normal((n, len(mode))) * np.sqrt(np.maximum(values, 0)) @ vectors.T


#: Checks of the gate, in their order (fixed values).
CHECKS = (
    "required_baselines", "positive_primary_score", "improved_fold_fraction", "minimum_positive_events", "independent_episodes", "multi_regime_improvement",
    "recent_fold_safety", "calibration", "alert_budget_improvement", "coefficient_stability", "sign_scaling_parity", "numerical_reliability",
)


def gate(folds: DataFrame, keys: list[str], policy: dict[str, float]) -> DataFrame:
    """One row per candidate: the failed checks and whether it is ``eligible``
    or ``research_only``.  ``folds``: ``fold`` (in time order), ``regime``,
    ``weight``, ``baseline``, ``candidate`` (Brier scores), ``positives``,
    ``episodes``, ``slope``, ``intercept``, ``ece``, ``alert_delta``, ``drift``,
    ``parity``, ``failures``, ``baselines``."""
    improved = F.col("candidate") < F.col("baseline")
    fold_skill = 1 - F.col("candidate") / F.nullif(F.col("baseline"), F.lit(0.0))
    inside = F.col("slope").between(policy["slope_low"], policy["slope_high"]) & (F.abs("intercept") <= policy["intercept"]) & (F.col("ece") <= policy["ece"])
    total = lambda c: F.sum(F.col("weight") * F.col(c))
    skill = 1 - total("candidate") / F.nullif(total("baseline"), F.lit(0.0))
    passed = {
        "required_baselines": F.min("baselines") >= policy["baselines"],
        "positive_primary_score": F.coalesce(F.round(skill * PPM) > 0, F.lit(False)),
        "improved_fold_fraction": F.avg(improved.cast("double")) * PPM >= policy["improved_ppm"],
        "minimum_positive_events": F.sum("positives") >= policy["positives"],
        "independent_episodes": F.sum("episodes") >= policy["episodes"],
        "multi_regime_improvement": F.count_distinct(F.when(improved, F.col("regime"))) >= policy["regimes"],
        "recent_fold_safety": F.coalesce(F.max_by(fold_skill, "fold") >= policy["recent"], F.lit(False)),
        "calibration": F.bool_and(inside),
        "alert_budget_improvement": total("alert_delta") <= 0,
        "coefficient_stability": F.max("drift") <= policy["drift"],
        "sign_scaling_parity": F.bool_and("parity"),
        "numerical_reliability": F.sum("failures") == 0,
    }
    failed = F.array_compact(F.array(*(F.when(~passed[c], c) for c in CHECKS)))
    out = folds.groupBy(*keys).agg(failed.alias("failed"), skill.alias("brier_skill"), F.count("*").alias("folds"))
    return out.withColumn("status", F.when(F.size("failed") == 0, "eligible").otherwise("research_only"))


def online(rows: DataFrame, key: str, samples: np.ndarray, stay: float = 0.98, sigma: float = 0.25, switch: float = 0.8) -> DataFrame:
    """Snapshots of a key's events in order: ``p_upper`` (probability of the
    upper branch), ``followed`` (1 for upper, with hysteresis) and ``region``
    (share of the parameter draws inside the cusp).  ``rows``: ``key``, ``t``,
    ``seq``, ``state``, ``alpha``, ``beta``; ``samples`` are shifts of alpha and
    beta.  A row without controls leaves the tracker as it is.  State per key:
    one probability and one branch."""

    def start(_):
        held = {"p": 0.5, "now": None}

        def step(packed: np.ndarray) -> list[np.ndarray]:
            out = np.full((len(packed), 3), np.nan)
            for k, (y, a, b) in enumerate(packed):
                if not np.isfinite([y, a, b]).all():
                    continue
                shifted = samples + [a, b]
                inside = (4 * shifted[:, 1] ** 3 > 27 * shifted[:, 0] ** 2) & (shifted[:, 1] > 0)
                found = cubic_roots(a, b)
                lower, upper = (found[0], found[-1]) if len(found) == 3 else (np.nan, found[0]) if found[0] > 0 else (found[0], np.nan)
                held["p"], held["now"] = sequential.follow(held["p"], held["now"], y, lower, upper, stay, sigma, switch)
                out[k] = held["p"], float(held["now"] == "upper"), inside.mean()
            return list(out.T)

        return step

    packed = rows.select(key, "t", "seq", F.struct("state", "alpha", "beta").alias("x"))
    return sequential.stream_series(packed, key, "x", start, f"{key} long, seq long, p_upper double, followed double, region double")


def fold_skills(predictions: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """Brier scores of a candidate (``p``) and of a baseline (``q``) by fold."""
    square = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    return predictions.groupBy(*keys, fold).agg(F.count("*").alias("weight"), square("q").alias("baseline"), square("p").alias("candidate"), F.sum("y").alias("positives"))

