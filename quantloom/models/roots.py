"""Numerics: real roots of the cusp's cubic, Brent's methods, finite differences."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def cubic_roots(alpha: float, beta: float, tolerance: float = 1e-12) -> list[float]:
    """Distinct real roots of y^3 - beta y - alpha, ascending: the scaled cubic
    in closed form, then Newton steps."""
    scale = max(abs(alpha) ** (1 / 3), math.sqrt(abs(beta)))
    if scale < 1e-100:  # its cube would underflow
        return [0.0]
    a, b = alpha / scale**3, beta / scale**2
    disc = 4 * b**3 - 27 * a * a
    if disc > tolerance:
        angle = math.acos(max(-1.0, min(1.0, 3 * a / (2 * b) * math.sqrt(3 / b)))) / 3
        roots = [2 * math.sqrt(b / 3) * math.cos(angle - 2 * math.pi * k / 3) for k in range(3)]
    elif disc < -tolerance or b <= 0:
        inner = math.sqrt(max(a * a / 4 - b**3 / 27, 0))
        roots = [math.cbrt(a / 2 + inner) + math.cbrt(a / 2 - inner)]
    else:  # on the fold: a simple and a double root
        roots = [math.cbrt(4 * a), -math.cbrt(a / 2)]
    out = []
    for y in roots:
        for _ in range(3):
            slope = 3 * y * y - b
            if abs(slope) > 1e-9:
                y -= (y**3 - b * y - a) / slope
        out.append(y * scale)
    return sorted(set(out))


def topology(alpha: float, beta: float, tolerance: float = 1e-9) -> str:
    if abs(alpha) <= tolerance and abs(beta) <= tolerance:
        return "critical"
    disc = 4 * beta**3 - 27 * alpha * alpha
    return "fold" if abs(disc) <= tolerance and beta > 0 else "three" if disc > 0 else "one"


def brent_root(f: Callable[[float], float], a: float, b: float, tol: float = 1e-12) -> float:
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        raise ValueError("no sign change")
    c, fc, d = a, fa, b - a
    e = d
    for _ in range(200):
        if fb * fc > 0:
            c, fc, d = a, fa, b - a
            e = d
        if abs(fc) < abs(fb):
            a, b, c, fa, fb, fc = b, c, b, fb, fc, fb
        half = (c - b) / 2
        if abs(half) <= tol or fb == 0:
            return b
        if abs(e) >= tol and abs(fa) > abs(fb):
            s = fb / fa
            if a == c:
                p, q = 2 * half * s, 1 - s
            else:
                r, t = fb / fc, fa / fc
                p, q = s * (2 * half * t * (t - r) - (b - a) * (r - 1)), (t - 1) * (r - 1) * (s - 1)
            p, q = abs(p), -q if p > 0 else q
            if 2 * p < min(3 * half * q - abs(tol * q), abs(e * q)):
                e, d = d, p / q
            else:
                d = e = half
        else:
            d = e = half
        a, fa = b, fb
        b += d if abs(d) > tol else math.copysign(tol, half)
        fb = f(b)
    return b


def golden_minimum(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10) -> float:
    r = (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def fold_distance(alpha: float, beta: float, whiten: tuple[float, float] = (1.0, 1.0), points: int = 257) -> float:
    """Distance in whitened controls to the fold curve alpha = 2 s^3,
    beta = 3 s^2, negative inside: a grid and a refined minimum."""
    top = 2 * (math.sqrt(max(beta, 0) / 3) + math.cbrt(abs(alpha) / 2) + 1)
    d2 = lambda s: ((alpha - 2 * s**3) / whiten[0]) ** 2 + ((beta - 3 * s * s) / whiten[1]) ** 2
    grid = np.linspace(-top, top, points)
    k = int(np.argmin([d2(s) for s in grid]))
    s = golden_minimum(d2, grid[max(k - 1, 0)], grid[min(k + 1, points - 1)])
    inside = 4 * beta**3 - 27 * alpha * alpha > 0 and beta > 0
    return (-1 if inside else 1) * math.sqrt(d2(s))


def fold_distances(alpha: np.ndarray, beta: np.ndarray, points: int = 257, steps: int = 30) -> np.ndarray:
    """``fold_distance`` of many controls at once, unwhitened: the best point of
    a grid, then Newton steps on half the slope of the squared distance that
    stay next to it."""
    top = 2 * (np.sqrt(np.maximum(beta, 0) / 3) + np.cbrt(np.abs(alpha) / 2) + 1)
    s = np.empty(len(alpha))
    unit = np.linspace(-1, 1, points)
    for at in range(0, len(alpha), 4096):
        a, b, grid = alpha[at : at + 4096, None], beta[at : at + 4096, None], top[at : at + 4096, None] * unit
        best = ((a - 2 * grid**3) ** 2 + (b - 3 * grid * grid) ** 2).argmin(axis=1)
        s[at : at + 4096] = grid[np.arange(len(best)), best]
    wide = 2 * top / (points - 1)
    low, high = s - wide, s + wide
    for _ in range(steps):
        slope = 2 * s**5 + 3 * s**3 - alpha * s * s - beta * s
        bend = 10 * s**4 + 9 * s * s - 2 * alpha * s - beta
        s = np.clip(s - np.where(bend > 0, slope / np.where(bend > 0, bend, 1), 0), low, high)
    inside = (4 * beta**3 - 27 * alpha * alpha > 0) & (beta > 0)
    return np.where(inside, -1, 1) * np.sqrt((alpha - 2 * s**3) ** 2 + (beta - 3 * s * s) ** 2)


def central_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    out = np.empty_like(x)
    for k in range(len(x)):
        step = np.zeros_like(x)
        step[k] = h * max(1.0, abs(x[k]))
        out[k] = (f(x + step) - f(x - step)) / (2 * step[k])
    return out
