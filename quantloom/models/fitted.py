"""Fitted models on bounded rows: calibration, stacking, hazards, cusp, HAR,
applicability.  Sums that grow with the data (Gram matrices, counts) come from
Spark aggregates; what is solved here has the size of the model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.models.roots import cubic_roots

#: Robust scale of the median absolute deviation, winsor limit (fixed values).
MAD_SCALE, WINSOR = 1.4826, 8.0


def gram(df: DataFrame, columns: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, deviations and standardised normal equations of a regression in
    one aggregation: (d+1) x (d+2) numbers however many rows there are."""
    x = [F.lit(1.0), *(F.col(c) for c in columns), F.col(target)]
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*sums).first().asDict()
    m = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i, len(x)):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m[:-1, :-1], m[:-1, -1], int(m[0, 0])


def har_fit(df: DataFrame, columns: list[str], target: str, ridge: float) -> np.ndarray:
    """Ridge regression on standardised predictors, the intercept unpenalised;
    returns intercept and coefficients on the raw scale."""
    full, response, n = gram(df, columns, target)
    if n < len(columns) + 2:
        raise ValueError("too few rows")
    mean = full[0, 1:] / n
    deviation = np.sqrt(np.maximum(np.diag(full)[1:] / n - mean * mean, 0))
    deviation[deviation == 0] = 1.0
    turn = np.eye(len(columns) + 1)
    turn[1:, 0] = -mean / deviation
    turn[1:, 1:] = np.diag(1 / deviation)
    a = turn @ full @ turn.T + ridge * np.diag([0.0] + [1.0] * len(columns))
    return turn.T @ np.linalg.solve(a, turn @ response)


def projected_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: np.ndarray, project, start: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weighted logistic regression by projected gradient with backtracking."""

    def loss(b):
        z = x @ b
        return float(w @ (np.logaddexp(0, z) - y * z)) + 0.5 * float(penalty @ (b * b))

    b, step = project(start), 1.0
    value = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
        slope = x.T @ (w * (p - y)) + penalty * b
        while True:
            new = project(b - step * slope)
            move = new - b
            new_value = loss(new)
            if new_value <= value + slope @ move + move @ move / (2 * step) + 1e-15 or step < 1e-14:
                break
            step /= 2
        if np.abs(move).max() < 1e-10:
            return new
        b, value, step = new, new_value, step * 1.5
    return b


def platt(logit: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and a slope that is not negative; only the slope is penalised."""
    x = np.column_stack([np.ones_like(logit), logit])
    return projected_logistic(x, y, w / w.sum(), np.array([0.0, ridge]), lambda b: np.array([b[0], max(b[1], 0.0)]), np.array([0.0, 1.0]))


def beta_calibration(logit: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Three parameters on (-softplus(-z), softplus(z), 1), the first two not negative."""
    x = np.column_stack([-np.logaddexp(0, -logit), np.logaddexp(0, logit), np.ones_like(logit)])
    return projected_logistic(x, y, w / w.sum(), np.array([ridge, ridge, 0.0]), lambda b: np.array([max(b[0], 0.0), max(b[1], 0.0), b[2]]), np.array([1.0, 1.0, 0.0]))


def isotonic(logit: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators (equal logits first pooled), then one global
    shrink of 0.5 / (effective size + 1) from both ends: upper logits and values."""
    order = np.argsort(logit, kind="stable")
    blocks: list[list[float]] = []
    for z, p, v in zip(logit[order], (y * w)[order], w[order], strict=True):
        if blocks and blocks[-1][0] == z:
            blocks[-1][1] += p
            blocks[-1][2] += v
        else:
            blocks.append([z, p, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] > blocks[-1][1] * blocks[-2][2]:
            z, p, v = blocks.pop()
            blocks[-1] = [z, blocks[-1][1] + p, blocks[-1][2] + v]
    eps = 0.5 / (w.sum() ** 2 / (w * w).sum() + 1)
    return np.array([b[0] for b in blocks]), np.array([eps + (1 - 2 * eps) * b[1] / b[2] for b in blocks])


def joint_curve(values: np.ndarray) -> np.ndarray:
    """Probabilities by horizon; a curve that decreases is refused, not repaired."""
    if (np.diff(values) < 0).any():
        raise ValueError("probability decreases with the horizon")
    return values


def simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with entries not negative that sum to 1."""
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def stack(x: np.ndarray, y: np.ndarray, w: np.ndarray, constraint: str = "none", locked: tuple[int, ...] = (), ridge: float = 1e-2) -> np.ndarray:
    """Stacked logits: intercept, then a weight per module.  Missing entries
    (NaN) become the module's mean; locked modules weigh exactly 0."""
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)

    def project(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        b[[1 + k for k in locked]] = 0.0
        free = [k for k in range(1, len(b)) if k - 1 not in locked]
        if constraint == "non_negative":
            b[free] = np.maximum(b[free], 0)
        elif constraint == "simplex":
            b[free] = simplex(b[free])
        return b

    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.array([0.0] + [ridge] * x.shape[1])
    return projected_logistic(design, y, w / w.sum(), penalty, project, np.array([0.0] + [1 / x.shape[1]] * x.shape[1]))


def hazard_fit(x: np.ndarray, cause: np.ndarray, causes: int, l1: float = 1e-3, l2: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Multinomial logit with survival (0) as reference and an elastic net, by
    proximal gradient with backtracking: (features + 1) x causes."""
    x = np.column_stack([np.ones(len(x)), x])
    y = (cause[:, None] == np.arange(1, causes + 1)[None]).astype(float)
    b, step = np.zeros((x.shape[1], causes)), 1.0

    def parts(b):
        z = np.column_stack([np.zeros(len(x)), x @ b])
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        p = e / e.sum(axis=1, keepdims=True)
        loss = float((np.log(e.sum(axis=1)) + top[:, 0] - (y * z[:, 1:]).sum(axis=1)).mean()) + 0.5 * l2 * float((b[1:] ** 2).sum())
        slope = x.T @ (p[:, 1:] - y) / len(x)
        slope[1:] += l2 * b[1:]
        return loss, slope

    loss, slope = parts(b)
    for _ in range(rounds):
        while True:
            new = b - step * slope
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
            move = new - b
            new_loss, new_slope = parts(new)
            if new_loss <= loss + (slope * move).sum() + (move * move).sum() / (2 * step) + 1e-15 or step < 1e-12:
                break
            step /= 2
        done = np.abs(move).max() < 1e-9
        b, loss, slope, step = new, new_loss, new_slope, step * 1.5
        if done:
            break
    return b


class RobustDistance:
    """Mahalanobis distance with median and MAD, winsorised and shrunk
    covariance; nearest training row in the same scale."""

    def __init__(self, rows: np.ndarray, shrinkage: float = 0.1) -> None:
        self.center = np.median(rows, axis=0)
        self.scale = np.median(np.abs(rows - self.center), axis=0) * MAD_SCALE
        if len(rows) < 3 or (self.scale <= np.finfo(float).eps).any():
            raise ValueError("too few rows or a feature without spread")
        self.rows = (rows - self.center) / self.scale
        z = np.clip(self.rows, -WINSOR, WINSOR)
        cov = z.T @ z / (len(rows) - 1)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(len(cov)) * np.trace(cov) / len(cov)
        self.inverse = np.linalg.inv(cov)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return np.einsum("ij,jk,ik->i", z, self.inverse, z)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return np.sqrt(np.maximum((z * z).sum(1)[:, None] + (self.rows**2).sum(1)[None] - 2 * z @ self.rows.T, 0).min(axis=1))


#: Availability, most serious first (fixed values).
AVAILABILITY = ("model_incompatible", "source_unhealthy", "insufficient_data", "out_of_distribution", "experimental", "degraded")


def availability(flags: dict):
    """The most serious signal, and all active ones in order (columns)."""
    first = F.coalesce(*(F.when(flags[s], s) for s in AVAILABILITY if s in flags), F.lit("available"))
    return first, F.array_compact(F.array(*(F.when(flags[s], s) for s in AVAILABILITY if s in flags)))


def barriers(alpha: float, beta: float) -> tuple[float, float] | None:
    """Heights of the two barriers inside the fold: with sorted roots a < b < c
    of zero sum, c (b-a)^3 / 4 and -a (c-b)^3 / 4."""
    roots = cubic_roots(alpha, beta)
    if len(roots) != 3:
        return None
    a, b, c = roots
    return c * (b - a) ** 3 / 4, -a * (c - b) ** 3 / 4


def transition_fit(y: np.ndarray, dy: np.ndarray, dt: np.ndarray, features: np.ndarray, ridge: float = 1e-3, dof: float = 5.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Drift alpha + beta y - y^3 with alpha and beta linear in the features;
    Student-t innovations by iterated weighted least squares: coefficients of
    (1, features) for alpha then beta, and the innovation scale."""
    base = np.column_stack([np.ones(len(y)), features])
    x = np.hstack([base, base * y[:, None]]) * dt[:, None]
    target = dy + y**3 * dt
    w, scale = np.ones(len(y)), 1.0
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        a = (x * w[:, None] / dt[:, None]).T @ x + ridge * np.eye(x.shape[1])
        b = np.linalg.solve(a, (x * w[:, None] / dt[:, None]).T @ target)
        z2 = (target - x @ b) ** 2 / dt
        scale = max(float((w * z2).mean()), 1e-12)
        w = (dof + 1) / (dof + z2 / scale)
    return b, math.sqrt(scale)


def splitmix64(state: int) -> tuple[int, int]:
    """Next state and output of the generator."""
    mask = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & mask
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    return state, z ^ (z >> 31)


def bootstrap_weights(blocks: int, seed: int) -> np.ndarray:
    """How often each time block is drawn in one replicate."""
    out, state = np.zeros(blocks, np.int64), seed
    for _ in range(blocks):
        state, z = splitmix64(state)
        out[z % blocks] += 1
    return out


def coupled_equilibria(a1: float, b1: float, a2: float, b2: float, c: float, tol: float = 1e-9) -> list[tuple]:
    """All stationary points of V1(x) + V2(y) - c x y: (x, y, potential,
    stability), by x then y.

    The first equation gives c y as a cubic p(x); put into the second one, times
    c^3, that is a polynomial of degree nine in x alone.  Its real roots, each
    with the real roots of the second equation in y, hold all solutions."""
    p = np.poly1d([1.0, 0.0, -b1, -a1])
    both = p if c == 0 else p**3 - b2 * c * c * p - np.poly1d([c**4, a2 * c**3])
    near = lambda z: z.real[np.abs(z.imag) < 1e-3 * np.maximum(1, np.abs(z))]
    points = [(x, y) for x in near(both.roots) for y in near(np.roots([1.0, 0.0, -b2, -(a2 + c * x)]))]
    if not points:
        return []
    x, y = np.array(points).T

    def slopes() -> np.ndarray:
        return np.stack([x**3 - b1 * x - a1 - c * y, y**3 - b2 * y - a2 - c * x], axis=1)

    def curvature() -> np.ndarray:
        return np.stack([np.stack([3 * x * x - b1, np.full(len(x), -c)], 1), np.stack([np.full(len(x), -c), 3 * y * y - b2], 1)], 1)

    for _ in range(20):  # least-squares steps, so a degenerate point is no obstacle
        step = np.einsum("kij,kj->ki", np.linalg.pinv(curvature(), rcond=1e-10), slopes())
        x, y = x - step[:, 0], y - step[:, 1]
    good = np.abs(slopes()).max(axis=1) <= tol * np.maximum(1, np.abs(x) ** 3 + np.abs(y) ** 3)
    values = np.linalg.eigvalsh(curvature())
    found: dict[tuple[float, float], tuple] = {}
    for k in np.flatnonzero(good).tolist():
        low, high = values[k]
        kind = "degenerate" if min(abs(low), abs(high)) <= tol else {2: "unstable", 1: "saddle", 0: "stable"}[int(low < 0) + int(high < 0)]
        v = (x[k] ** 4 + y[k] ** 4) / 4 - (b1 * x[k] ** 2 + b2 * y[k] ** 2) / 2 - a1 * x[k] - a2 * y[k] - c * x[k] * y[k]
        found.setdefault((round(float(x[k]), 6) + 0.0, round(float(y[k]), 6) + 0.0), (float(x[k]), float(y[k]), float(v), kind))
    return [found[k] for k in sorted(found)]
