"""Scenario paths: empirical innovations, jumps, mean-reverting volatility,
impact and liquidation feedback.

Each path has its own seed (path number mixed into the scenario's), so paths
are made in any order on any executor and are the same again after a loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scoring import hazen
from quantloom.models.fitted import splitmix64

SECONDS_PER_YEAR = 31_536_000.0

#: Parameters with their defaults.
DEFAULTS = {
    "volatility": 0.6, "long_run": 0.6, "persistence": 0.95, "vol_of_vol": 0.5, "step_seconds": 60.0, "jump_probability": 0.01, "systemic": 0.3, "skew": 0.1,
    "fragility": 0.2, "fragility_multiplier": 1.0, "volatility_multiplier": 1.0, "trigger": 0.01, "sensitivity": 0.5, "feedback": 0.2, "open_interest": 1e8, "largest_step": 0.2,
}


def simulate(spark: SparkSession, innovations: list[float], paths: int, steps: int, seed: int, counts: list[int] | None = None, **changed: float) -> DataFrame:
    """``path``, ``step``, ``log_return`` (cumulative), ``volatility``,
    ``liquidated`` (cumulative).  ``innovations`` are the empirical
    values, ``counts`` how often each occurs (once each without it)."""
    p = DEFAULTS | changed
    draw = np.array(innovations, float)
    upto = np.cumsum(np.ones(len(draw), np.int64) if counts is None else np.array(counts, np.int64))
    # The largest twentieth of all occurrences, by size.
    by_size = np.argsort(np.abs(draw), kind="stable")[::-1]
    n_jumps = max(1, int(upto[-1]) // 20)
    last = np.minimum(np.cumsum(np.diff(upto, prepend=0)[by_size]), n_jumps)
    jumps, jumps_upto = np.abs(draw)[by_size][::-1] * 0.05, np.cumsum(np.diff(last, prepend=0)[::-1])

    def choice(rng: np.random.Generator, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return values[np.searchsorted(ends, rng.choice(int(ends[-1]), steps), "right")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = np.sqrt(p["step_seconds"] / SECONDS_PER_YEAR)
        for frame in frames:
            for path in frame["id"]:
                rng = np.random.Generator(np.random.PCG64(splitmix64((seed << 32) ^ int(path))[1]))
                own, common = choice(rng, draw, upto), choice(rng, draw, upto)
                hit, size = rng.random(steps) < p["jump_probability"], choice(rng, jumps, jumps_upto) * rng.choice([-1.0, 1.0], steps)
                vol, total, interest, rows = p["volatility"], 0.0, p["open_interest"], []
                for k in range(steps):
                    z = np.sqrt(1 - p["systemic"] ** 2) * own[k] + p["systemic"] * common[k]
                    tilt = np.clip(1 + (0.25 if z >= 0 else -0.25) * p["skew"], 0.5, 1.5)
                    raw = np.clip(vol * scale * z * tilt + (size[k] if hit[k] else 0.0), -p["largest_step"], p["largest_step"])
                    moved = raw * (1 + 0.10 * p["fragility_multiplier"] * p["fragility"] + 0.02 * p["volatility_multiplier"] * vol)
                    forced = min(interest * p["sensitivity"] * max(-moved - p["trigger"], 0.0), interest)
                    moved -= p["feedback"] * forced / interest if interest > 0 else 0.0
                    interest -= forced
                    total += moved
                    vol = float(np.clip(p["long_run"] + p["persistence"] * (vol - p["long_run"]) + p["vol_of_vol"] * p["long_run"] * scale * own[k], 0.01, 10.0))
                    rows.append((int(path), k + 1, float(total), vol, float(p["open_interest"] - interest)))
                yield pd.DataFrame(rows, columns=["path", "step", "log_return", "volatility", "liquidated"])

    return spark.range(paths).repartition(max(1, min(paths, spark.sparkContext.defaultParallelism))).mapInPandas(
        run, "path long, step int, log_return double, volatility double, liquidated double"
    )


def summarize(paths: DataFrame, step: int, threshold: float) -> DataFrame:
    """Hazen quantiles of the return at a step, and the share at or below a threshold."""
    rows = paths.filter(F.col("step") == step)
    v = F.collect_list("log_return")
    return rows.agg(
        *(hazen(v, q / 100).alias(f"p{q:02d}") for q in (5, 25, 50, 75, 95)), F.avg((F.col("log_return") <= threshold).cast("double")).alias("threshold_probability")
    )


def sweep_cost_bps(notional: float, depth: float, volatility: float, fragility: float, impact_bps: float, most_bps: float) -> float:
    """Square-root impact, capped."""
    return min(impact_bps * (notional / depth) ** 0.5 * (1 + fragility + volatility), most_bps)
