"""Elastic net for several responses: coefficients enter or leave all responses together.

Fits read sums only (rows, sums and products of predictors and responses), so rows may
lie anywhere: on the driver as arrays, or in a DataFrame that ``moments`` has added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from stanzagraph.functions.linalg import Moments

#: What is left of a column's mean square about its mean, as a share, if the column is constant.
CONSTANT = 1e-14


@dataclass(frozen=True)
class Fit:
    penalty: float
    intercepts: np.ndarray
    coefficients: np.ndarray  # predictors x responses


def elastic_net(x: np.ndarray, y: np.ndarray, penalty: float, alpha: float = 1.0, factors: Sequence[float] | None = None, standardize: bool = True) -> Fit:
    """Least squares / 2n + penalty (alpha |row| + (1 - alpha) |row|^2 / 2), row by row of coefficients.

    Factors multiply the penalty of a predictor and are scaled to sum to the predictors;
    standardizing is undone in the result.
    """
    m, shift, p = _added_up(x, y)
    return shifted(net_of_moments(m, p, penalty, alpha, factors, standardize), shift)


def cross_validated(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, factors: Sequence[float] | None = None, folds: int = 10) -> Fit:
    """The fit at the first penalty of least squared error; row i is in fold i mod the folds."""
    both = _columns(x, y)
    shift, p = both.mean(axis=0), np.shape(x)[1]
    fold = np.arange(len(both)) % min(folds, len(both))
    parts = [_sums(both[fold == f] - shift) for f in range(fold.max() + 1)]
    return shifted(cross_validated_moments(parts, p, alpha, factors), shift)


def _columns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    return np.c_[x, y[:, None] if y.ndim == 1 else y]


def _sums(v: np.ndarray) -> Moments:
    return Moments(len(v), v.sum(axis=0), v.T @ v)


def _added_up(x: np.ndarray, y: np.ndarray) -> tuple[Moments, np.ndarray, int]:
    both = _columns(x, y)
    shift = both.mean(axis=0)
    return _sums(both - shift), shift, np.shape(x)[1]


def shifted(fit: Fit, shift: np.ndarray) -> Fit:
    """The fit for columns that lie ``shift`` further out than those it was made for."""
    p = len(fit.coefficients)
    return Fit(fit.penalty, fit.intercepts + shift[p:] - shift[:p] @ fit.coefficients, fit.coefficients)


def _weights(p: int, factors: Sequence[float] | None) -> np.ndarray:
    weight = np.ones(p) if factors is None else np.asarray(factors, float)
    return weight * p / weight.sum() if weight.sum() > 0 else weight


def _products(m: Moments, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean products about the means of predictors with predictors and with responses, and the predictors' spreads (0: constant)."""
    about = m.scatter / m.n
    variance = np.where(np.diag(about) > CONSTANT * np.diag(m.gram) / m.n, np.diag(about), 0)[:p]
    return about[:p, :p], about[:p, p:], np.sqrt(variance)


def net_of_moments(m: Moments, predictors: int, penalty: float, alpha: float = 1.0, factors: Sequence[float] | None = None, standardize: bool = True, tolerance: float = 1e-12, rounds: int = 10_000, start: np.ndarray | None = None) -> Fit:
    """elastic_net() of rows known by the moments of their predictors, then their responses.

    Columns should lie about 0, as products of columns far out cancel.
    """
    p, weight = predictors, _weights(predictors, factors)
    xx, xy, spread = _products(m, p)
    used = spread > 0
    scale = np.where(used & standardize, spread, 1)
    xx, xy = xx / np.outer(scale, scale), xy / scale[:, None]
    b = np.zeros_like(xy) if start is None else start * scale[:, None]
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(used):
            g = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            norm, cut = np.linalg.norm(g), penalty * alpha * weight[j]
            new = np.zeros_like(g) if norm <= cut else g * (1 - cut / norm) / (xx[j, j] + penalty * (1 - alpha) * weight[j])
            most = max(most, float(np.abs(new - b[j]).max()))
            b[j] = new
        if most < tolerance:
            break
    b = np.where(used[:, None], b / scale[:, None], 0.0)
    means = m.means
    return Fit(penalty, means[p:] - means[:p] @ b, b)


def penalty_path(m: Moments, predictors: int, alpha: float = 1.0, factors: Sequence[float] | None = None, steps: int = 60) -> np.ndarray:
    """Penalties from the least at which penalized rows are all zero, evenly spaced in logarithms."""
    weight = _weights(predictors, factors)
    xx, xy, spread = _products(m, predictors)
    scale = np.where(spread > 0, spread, 1)
    xx, left = xx / np.outer(scale, scale), xy / scale[:, None]
    free = weight == 0
    if free.any():
        left = left - xx[:, free] @ np.linalg.lstsq(xx[np.ix_(free, free)], left[free], rcond=None)[0]
    norms = np.linalg.norm(left, axis=1) * (spread > 0)
    top = max([0.0, *(norms[~free] / weight[~free])]) / max(alpha, 1e-3)
    top = top if top > 0 else 1e-6
    return np.geomspace(top, top * (1e-2 if m.n < predictors else 1e-4), steps)


def squared_error(m: Moments, predictors: int, fit: Fit) -> float:
    """The sum of squares that ``fit`` leaves of rows known by their moments."""
    d = np.r_[-fit.coefficients, np.eye(fit.coefficients.shape[1])]
    a = fit.intercepts
    return float(np.einsum("ik,ij,jk->", d, m.gram, d) - 2 * (m.sums @ d) @ a + m.n * (a @ a))


def cross_validated_moments(parts: Sequence[Moments], predictors: int, alpha: float = 1.0, factors: Sequence[float] | None = None) -> Fit:
    """cross_validated() of folds known by their moments."""
    whole = Moments(sum(m.n for m in parts), sum(m.sums for m in parts), sum(m.gram for m in parts))
    path = penalty_path(whole, predictors, alpha, factors)
    errors = np.zeros(len(path))
    for out in parts:
        rest, start = Moments(whole.n - out.n, whole.sums - out.sums, whole.gram - out.gram), None
        if rest.n == 0:
            continue
        for k, penalty in enumerate(path):
            fit = net_of_moments(rest, predictors, penalty, alpha, factors, start=start)
            start = fit.coefficients
            errors[k] += squared_error(out, predictors, fit)
    return net_of_moments(whole, predictors, float(path[int(np.argmin(errors))]), alpha, factors)
