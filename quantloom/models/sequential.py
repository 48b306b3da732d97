"""Sequential models over one ordered series: run lengths, hidden states,
branches.  They are recursions, so each series is folded by one task; series
are spread over the cluster.  ``stream_series`` holds a series' state only;
``per_series`` holds its rows, for models that read a series more than once
(expectation-maximisation)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def stream_series(df: DataFrame, key: str, value: str, start: Callable[[object], Callable[[np.ndarray], list[np.ndarray]]], schema: str, partitions: int | None = None) -> DataFrame:
    """Each key's values in order of ``(t, seq)`` through a function that
    ``start(key)`` makes; it is called with one batch's values after the
    other (a struct's fields side by side) and returns as many rows.  Output:
    ``key``, ``seq`` and those columns (``schema`` names all)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            if pa.types.is_struct(values.type):
                values = np.stack([f.to_numpy(zero_copy_only=False).astype(float) for f in values.flatten()], axis=1)
            else:
                values = values.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            made = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if step is None or keys[a] != now:
                    now, step = keys[a], start(keys[a])
                made.append(step(values[a:b]))
            columns = [np.concatenate(c) for c in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, from_pandas=True) for c in columns)], names)

    rows = df.select(key, "seq", value, "t")
    dealt = rows.repartition(partitions, key) if partitions else rows.repartition(key)
    return dealt.sortWithinPartitions(key, "t", "seq").select(key, "seq", value).mapInArrow(fold, schema)


def per_series(df: DataFrame, key: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fold`` of each key's rows in order of ``(t, seq)``."""
    return df.groupBy(key).applyInPandas(lambda g: fold(g.sort_values(["t", "seq"], kind="stable")), schema)


def _logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze(axis) if axis is not None else float(out.squeeze())


class RunLengths:
    """Bayesian online changepoint detection with a constant hazard and a
    normal-inverse-gamma prior (mean, strength, shape, scale).  Holds one entry
    per run length up to ``longest``; a missing value changes nothing."""

    def __init__(self, hazard: float, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 1.0), longest: int = 250) -> None:
        self.hazard, self.prior, self.longest = hazard, prior, longest
        self.stats = [np.array([x]) for x in prior]
        self.log_run = np.zeros(1)
        # The density's gamma functions depend on the shape alone, and shapes are the prior's and halves more.
        shapes = prior[2] + np.arange(longest + 1) / 2
        self.gamma = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in shapes])

    def update(self, values: np.ndarray) -> np.ndarray:
        """Per value: the probability that a run has just begun, the likeliest
        run length, its expectation, and the probability cut off."""
        out = np.full((len(values), 4), np.nan)
        stay, leave = math.log1p(-self.hazard), math.log(self.hazard)
        for k, x in enumerate(values):
            if math.isnan(x):
                continue
            mu, kappa, alpha, beta = self.stats
            dof, scale2 = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
            density = self.gamma[: len(alpha)] - 0.5 * np.log(np.pi * dof * scale2) - (dof + 1) / 2 * np.log1p((x - mu) ** 2 / (dof * scale2))
            joint = self.log_run + density
            grown = joint + stay
            joined = np.concatenate([[_logsumexp(joint + leave)], grown[: self.longest]])
            evidence = _logsumexp(joined)
            cut = float(np.exp(grown[self.longest] - np.logaddexp(evidence, grown[self.longest]))) if len(grown) > self.longest else 0.0
            self.log_run = joined - evidence
            p = np.exp(self.log_run)
            out[k] = p[0], float(p.argmax()), float(p @ np.arange(len(p))), cut
            more, keep = kappa + 1, slice(0, self.longest)
            after = ((kappa * mu + x) / more, more, alpha + 0.5, beta + kappa * (x - mu) ** 2 / (2 * more))
            self.stats = [np.concatenate([[first], new[keep]]) for first, new in zip(self.prior, after, strict=True)]
        return out


def run_lengths(values: np.ndarray, hazard: float, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 1.0), longest: int = 250) -> np.ndarray:
    """``RunLengths`` over a whole series."""
    return RunLengths(hazard, prior, longest).update(values)


class LambdaVolatility:
    """Lambda-weighted variance of returns as they come: per return the
    variance after it, and the sum and number of squared one-step residuals."""

    def __init__(self, decay: float) -> None:
        self.decay, self.variance, self.squares, self.n = decay, None, 0.0, 0

    def update(self, returns: np.ndarray) -> list[np.ndarray]:
        out = np.empty((len(returns), 3))
        for k, r in enumerate(returns):
            x = r * r
            if self.variance is None:
                self.variance = x
            else:
                self.squares += (x - self.variance) ** 2
                self.n += 1
                self.variance = self.decay * self.variance + (1 - self.decay) * x
            out[k] = self.variance, self.squares, self.n
        return [out[:, 0], out[:, 1], out[:, 2].astype(np.int64)]


def lambda_volatility(returns: np.ndarray, decay: float) -> tuple[float, float, float, float]:
    """Lambda-weighted variance of returns, and the forecast's interval from the
    root mean square of its one-step residuals."""
    if not len(returns):
        raise ValueError("no returns")
    variance, squares, n = (c[-1].item() for c in LambdaVolatility(decay).update(returns))
    half = 1.96 * math.sqrt(squares / n) if n else 0.0
    return variance, max(variance - half, 0.0), variance + half, math.sqrt(variance)


class StudentHMM:
    """Hidden Markov model with Student-t emissions of diagonal scale, fitted by
    expectation-maximisation with pseudocounts and a scale floor."""

    def __init__(self, states: int, dof: float = 5.0, floor: float = 1e-4, pseudo: float = 1.0) -> None:
        self.states, self.dof, self.floor, self.pseudo = states, dof, floor, pseudo

    def _log_emission(self, x: np.ndarray) -> np.ndarray:
        dims = x.shape[1]
        z = ((x[:, None] - self.location[None]) ** 2 / self.scale[None]).sum(axis=2)
        const = math.lgamma((self.dof + dims) / 2) - math.lgamma(self.dof / 2) - dims / 2 * math.log(self.dof * math.pi) - 0.5 * np.log(self.scale).sum(axis=1)
        self.weight = (self.dof + dims) / (self.dof + z)
        return const - (self.dof + dims) / 2 * np.log1p(z / self.dof)

    def _filter(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Causal state probabilities, emissions (each row up to a factor), the
        rows' scales, and the log-likelihood."""
        emit = self._log_emission(x)
        top = emit.max(axis=1)
        e = np.exp(emit - top[:, None])
        out, scale = np.empty_like(e), np.empty(len(x))
        state = self.start
        for k in range(len(x)):
            state = (state @ self.move if k else state) * e[k]
            scale[k] = state.sum()
            state = out[k] = state / scale[k]
        return out, e, scale, float(np.log(scale).sum() + top.sum())

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Causal state probabilities (use these as features) and log-likelihood."""
        out, _, _, total = self._filter(x)
        return out, total

    def fit(self, x: np.ndarray, rounds: int = 30) -> StudentHMM:
        n, k = len(x), self.states
        order = np.argsort(x[:, 0], kind="stable")
        parts = np.array_split(order, k)  # a deterministic start: quantile groups of the first dimension
        self.location = np.array([x[p].mean(axis=0) for p in parts])
        self.scale = np.maximum(np.array([x[p].var(axis=0) for p in parts]), self.floor)
        self.start, self.move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
        for _ in range(rounds):
            ahead, e, scale, _ = self._filter(x)
            weight, behind = self.weight, np.ones((n, k))
            carried = e / scale[:, None]
            for t in range(n - 2, -1, -1):
                behind[t] = self.move @ (carried[t + 1] * behind[t + 1])
            smooth = ahead * behind
            smooth /= smooth.sum(axis=1, keepdims=True)
            moved = self.move * (ahead[:-1].T @ (carried[1:] * behind[1:])) + self.pseudo
            self.move = moved / moved.sum(axis=1, keepdims=True)
            first = smooth[0] + self.pseudo
            self.start = first / first.sum()
            latent = smooth * weight
            self.location = (latent.T @ x) / latent.sum(axis=0)[:, None]
            spread = (x[:, None] - self.location[None]) ** 2
            # The diagonal scale is divided by plain occupancy, not by the latent weights.
            self.scale = np.maximum((latent[:, :, None] * spread).sum(axis=0) / smooth.sum(axis=0)[:, None], self.floor)
        return self


def follow(p: float, now: str | None, y: float, lower: float, upper: float, stay: float = 0.98, sigma: float = 0.25, switch: float = 0.8) -> tuple[float, str]:
    """One step of a two-branch filter with hysteresis: the probability of the
    upper branch, and the branch followed.  A branch without a root (NaN) has
    no weight; the other is followed only once its probability reaches
    ``switch``."""
    ahead = p * stay + (1 - p) * (1 - stay)
    weights = [0.0 if math.isnan(root) else prior * math.exp(-0.5 * ((y - root) / sigma) ** 2) for prior, root in ((1 - ahead, lower), (ahead, upper))]
    total = sum(weights)
    p = weights[1] / total if total > 0 else ahead
    best = "upper" if p > 0.5 else "lower"
    if now is not None and best != now:
        chance, kept = (p, 1 - p) if best == "upper" else (1 - p, p)
        if chance < switch and kept > 0:
            best = now
    return p, best


def track_branches(state: np.ndarray, lower: np.ndarray, upper: np.ndarray, stay: float = 0.98, sigma: float = 0.25, switch: float = 0.8) -> list[tuple[float, str]]:
    """``follow`` over a whole series."""
    p, now, out = 0.5, None, []
    for y, lo, hi in zip(state, lower, upper, strict=True):
        p, now = follow(p, now, y, lo, hi, stay, sigma, switch)
        out.append((p, now))
    return out
