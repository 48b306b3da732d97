"""Choice among fitted models on bounded rows: calibrators, hidden-state
counts, modules of a stack, penalties of a hazard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from quantloom.models import fitted, sequential


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _log_loss(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    q = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / w.sum())


@dataclass
class Calibrator:
    """A fitted map from logits to probabilities."""

    kind: str
    values: tuple

    def __call__(self, z: np.ndarray) -> np.ndarray:
        if self.kind == "identity":
            return _sigmoid(z)
        if self.kind == "platt":
            return _sigmoid(self.values[0] + self.values[1] * z)
        if self.kind == "beta":
            a, b, c = self.values
            return _sigmoid(-a * np.logaddexp(0, -z) + b * np.logaddexp(0, z) + c)
        upper, level = self.values
        return level[np.minimum(np.searchsorted(upper, z), len(upper) - 1)]


def calibrate(kind: str, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> Calibrator:
    if kind == "identity":
        return Calibrator(kind, ())
    fit = {"platt": fitted.platt, "beta": fitted.beta_calibration, "isotonic": fitted.isotonic}[kind]
    return Calibrator(kind, tuple(fit(z, y, w)))


def effective_size(w: np.ndarray) -> float:
    return float(w.sum() ** 2 / (w * w).sum())


def select_calibrator(z: np.ndarray, y: np.ndarray, w: np.ndarray, fitting: np.ndarray, least_size: float = 200.0) -> tuple[Calibrator, dict[str, float]]:
    """Each kind fitted where ``fitting``, scored by log loss on the rest; the
    best (ties to the simpler) is fitted again on all.  An isotonic map needs
    an effective size on the fitting part."""
    kinds = ["identity", "platt", "beta"] + (["isotonic"] if effective_size(w[fitting]) >= least_size else [])
    rest = ~fitting
    scores = {k: _log_loss(calibrate(k, z[fitting], y[fitting], w[fitting])(z[rest]), y[rest], w[rest]) for k in kinds}
    best = min(kinds, key=lambda k: (scores[k], kinds.index(k)))
    return calibrate(best, z, y, w), scores


def ablations(x: np.ndarray, y: np.ndarray, w: np.ndarray, constraint: str = "none") -> dict[int, float]:
    """By how much the stack's loss grows without each module (refitted with the
    module locked at nothing)."""
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)

    def loss(locked: tuple[int, ...]) -> float:
        b = fitted.stack(x, y, w, constraint, locked)
        return _log_loss(_sigmoid(b[0] + filled @ b[1:]), y, w)

    whole = loss(())
    return {k: loss((k,)) - whole for k in range(x.shape[1])}


def hazard_path(x: np.ndarray, cause: np.ndarray, causes: int, penalties: Sequence[float]) -> dict[float, np.ndarray]:
    """Independent fits along a path of penalties."""
    return {p: fitted.hazard_fit(x, cause, causes, l1=p) for p in penalties}


def select_states(folds: Sequence[tuple[np.ndarray, np.ndarray]], counts: Sequence[int], stability: float = 0.0) -> tuple[int, dict[int, float]]:
    """Number of hidden states by the mean held-out log-likelihood of a value
    over walk-forward folds, less ``stability`` times its deviation between
    folds; ties to fewer states."""
    scores = {}
    for k in counts:
        each = [sequential.StudentHMM(k).fit(train).forward(held)[1] / len(held) for train, held in folds]
        scores[k] = float(np.mean(each) - stability * np.std(each))
    return max(counts, key=lambda k: (scores[k], -k)), scores


def describe_states(model: sequential.StudentHMM, mean: np.ndarray, deviation: np.ndarray, names: Sequence[str]) -> list[dict[str, str]]:
    """Each state's locations against a baseline, in words: ``high`` or ``low``
    beyond one deviation, else ``usual``."""
    z = (model.location - mean) / deviation
    word = lambda v: "high" if v > 1 else "low" if v < -1 else "usual"
    return [{n: word(v) for n, v in zip(names, row, strict=True)} for row in z]
