"""Whether a model applies: novelty of its inputs, distances, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_profile(training: DataFrame, numbers: list[str], categories: list[str]) -> dict:
    """Ranges and category sets of training rows, in one aggregation.  The sets
    are of venues, products and the like and small by design."""
    aggs = [f(c).alias(f"{c}_{n}") for c in numbers for n, f in (("lo", F.min), ("hi", F.max))]
    row = training.agg(*aggs, *[F.collect_set(c).alias(c) for c in categories]).first().asDict()
    return {"ranges": {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in numbers}, "sets": {c: sorted(row[c]) for c in categories}}


def novelty(profile: dict) -> tuple[Column, Column]:
    """Names of the inputs out of range or in an unseen category, and whether there are any."""
    out = [F.when(F.col(c).isNull() | ~F.col(c).between(lo, hi), f"{c}_out_of_range") for c, (lo, hi) in profile["ranges"].items()]
    out += [F.when(F.col(c).isNull() | ~F.col(c).isin(*known), f"{c}_unseen") for c, known in profile["sets"].items()]
    reasons = F.array_compact(F.array(*out))
    return reasons, F.size(reasons) > 0


def quadratic_form(centred: list[Column], inverse: list[list[float]]) -> Column:
    """x' A x with the inverse covariance as literals (the model's size)."""
    total = F.lit(0.0)
    for i, x in enumerate(centred):
        for j, y in enumerate(centred):
            if inverse[i][j]:
                total = total + x * y * F.lit(float(inverse[i][j]))
    return total


def robust_profile(training: DataFrame, columns: list[str], winsor: float = 8.0, shrinkage: float = 0.1) -> dict:
    """Median and MAD per column, then the winsorised and shrunk covariance of
    the scaled columns: three aggregations whose results have the model's size."""
    import numpy as np

    centre = training.agg(*[F.median(c).alias(c) for c in columns]).first().asDict()
    spread = training.agg(*[(F.median(F.abs(F.col(c) - centre[c])) * 1.4826).alias(c) for c in columns]).first().asDict()
    if any(not spread[c] for c in columns):
        raise ValueError("a feature without spread")
    z = [F.greatest(F.least((F.col(c) - centre[c]) / spread[c], F.lit(winsor)), F.lit(-winsor)) for c in columns]
    n = len(columns)
    row = training.agg(F.count("*").alias("n"), *[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first().asDict()
    cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / (row["n"] - 1)
    cov = (1 - shrinkage) * cov + shrinkage * np.eye(n) * np.trace(cov) / n
    return {"columns": columns, "centre": centre, "scale": spread, "inverse": np.linalg.inv(cov).tolist()}


def robust_distance(profile: dict) -> Column:
    z = [(F.col(c) - profile["centre"][c]) / profile["scale"][c] for c in profile["columns"]]
    return quadratic_form(z, profile["inverse"])
