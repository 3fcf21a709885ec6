"""Polynomials through one track's points: robust weights, smoothing, prediction, ends of pieces."""

from __future__ import annotations

import numpy as np


def _solve(a: np.ndarray, w: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients of one track (a: points by powers) or of many of equal length at once (one axis more in front)."""
    at = a.swapaxes(-1, -2)
    m = at @ (w[..., None] * a) + ridge * np.eye(a.shape[-1])
    try:
        return np.linalg.solve(m, at @ (w[..., None] * y))
    except np.linalg.LinAlgError:
        if a.ndim == 2:
            return np.linalg.lstsq(a, y, rcond=None)[0]
        return np.stack([_solve(*one, ridge) for one in zip(a, w, y)])


def robust_weights(x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Weights of points along a track by cubic fits over their positions in it: exp(-(residual / median residual)^2 / 2), within 0.001 .. 1; 1 below three points."""
    return robust_weights_all(x[None], rounds)[0]


def robust_weights_all(x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """robust_weights of many tracks of equal length: x (tracks, points, axes)."""
    n = x.shape[1]
    w = np.ones(x.shape[:2])
    if n < 3:
        return w
    a = np.broadcast_to(np.arange(n, dtype=float)[:, None] ** np.arange(min(3, n - 1), -1, -1), (len(x), n, min(3, n - 1) + 1))
    for _ in range(max(1, rounds)):
        r = np.sqrt(((x - a @ _solve(a, w, x)) ** 2).sum(2))
        w = np.clip(np.exp(-0.5 * (r / (np.median(r, 1)[:, None] + 2e-12)) ** 2), 0.001, 1.0)
    return w


def robust_residual(x: np.ndarray, rounds: int = 3, weight: np.ndarray | None = None) -> float:
    """Root mean square distance of a track's points from their robust cubic, by robust_weights unless they are given; 0 below three points."""
    n = len(x)
    if n < 3:
        return 0.0
    a = np.arange(n, dtype=float)[:, None] ** np.arange(min(3, n - 1), -1, -1)
    return float(np.sqrt(((x - a @ _solve(a, robust_weights(x, rounds) if weight is None else weight, x)) ** 2).sum(1).mean()))


def predict(t: np.ndarray, x: np.ndarray, at: float, window: int = 6, degree: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """Position, velocity at a time and the fit's residual, by a robust polynomial through the `window` points nearest in time; a line up to three points, at rest for one."""
    place, v, r = predict_all(t[None], x[None], np.array([at], float), window, degree)
    return place[0], v[0], float(r[0])


def predict_all(t: np.ndarray, x: np.ndarray, at: np.ndarray, window: int = 6, degree: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """predict of many tracks of equal length: t (tracks, points), x (tracks, points, axes), a time each."""
    if t.shape[1] > window:
        near = np.sort(np.argsort(np.abs(t - at[:, None]), axis=1, kind="stable")[:, :window], axis=1)
        t, x = np.take_along_axis(t, near, 1), np.take_along_axis(x, near[:, :, None], 1)
    n = t.shape[1]
    if n == 1:
        return x[:, 0].copy(), np.zeros((len(x), x.shape[2])), np.zeros(len(x))
    d = t - t[:, -1:]
    p = np.arange(min(degree, 1 if n <= 3 else n - 1) + 1)
    a = d[:, :, None] ** p
    beta = _solve(a, robust_weights_all(x) if n >= 4 else np.ones(t.shape), x, 1e-12)
    tau = (at - t[:, -1])[:, None]
    v = ((p[1:] * tau ** (p[1:] - 1))[:, :, None] * beta[:, 1:]).sum(1)
    return ((tau**p)[:, None, :] @ beta)[:, 0], v, np.sqrt(((x - a @ beta) ** 2).sum(2).mean(1))


def _windows(n: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First point of a window of w around each of n points, shifted inward at the ends, and the points of each."""
    start = np.clip(np.arange(n) - w // 2, 0, n - w)
    return start, start[:, None] + np.arange(w)


def local_fit(t: np.ndarray, x: np.ndarray, weight: np.ndarray, window: int, order: int, least: int, leave_out: bool, ridge: float) -> tuple | None:
    """Coefficients of a weighted polynomial around each point in units of half a window, that unit, and the weight behind each; None below `least` points."""
    n = len(t)
    if n < least:
        return None
    w = min(window, n)
    degree = min(order, w - (2 if leave_out else 1))
    h = max(w // 2, 1)
    start, win = _windows(n, w)
    a = ((t[win] - t[:, None]) / h)[:, :, None] ** np.arange(degree + 1)
    wt = weight[win].copy()
    if leave_out:
        wt[np.arange(n), np.arange(n) - start] = 0.0
    atw = a.transpose(0, 2, 1) * wt[:, None, :]
    return np.linalg.solve(atw @ a + ridge * np.eye(degree + 1), atw @ x[win]), h, wt.sum(1)


def smooth(t: np.ndarray, x: np.ndarray, weight: np.ndarray, fps: float, window: int, order: int = 3, least: int = 5) -> tuple | None:
    """Position, velocity and acceleration by weighted local polynomials; None below `least` points."""
    found = local_fit(t, x, weight, window, order, least, False, 1e-12)
    if found is None:
        return None
    c, h, _ = found
    zero = np.zeros_like(x)
    return c[:, 0], (c[:, 1] / h * fps if c.shape[1] > 1 else zero), (2 * c[:, 2] / h**2 * fps**2 if c.shape[1] > 2 else zero)


def leave_one_out(t: np.ndarray, x: np.ndarray, weight: np.ndarray, window: int = 9, order: int = 2, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Where the other points of its window say that each point is, and the weight behind it; NaN below `least` points."""
    found = local_fit(t, x, weight, window, order, least, True, 1e-9)
    return (np.full_like(x, np.nan), np.zeros(len(t))) if found is None else (found[0][:, 0], found[2])


def end_fit(t: np.ndarray, x: np.ndarray, tail: bool, n: int = 10, degree: int = 1) -> tuple[np.ndarray, float, float]:
    """Coefficients of a polynomial through the first or last n points in time from the outermost, that time, and the residual an axis."""
    c, at, r = end_fits(t[None], x[None], tail, n, degree)
    return c[0], float(at[0]), float(r[0])


def end_fits(t: np.ndarray, x: np.ndarray, tail: bool, n: int = 10, degree: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """end_fit of many tracks of equal length."""
    m = min(n, t.shape[1])
    t, x = (t[:, -m:], x[:, -m:]) if tail else (t[:, :m], x[:, :m])
    at = t[:, -1] if tail else t[:, 0]
    d = max(0, min(degree, m - 2))
    a = (t - at[:, None])[:, :, None] ** np.arange(d + 1)
    c = _solve(a, np.ones(t.shape), x, 1e-12)
    r = np.sqrt(((x - a @ c) ** 2).sum((1, 2)) / max(m - d - 1, 1) / 3.0)
    return np.concatenate([c, np.zeros((len(x), degree - d, x.shape[2]))], 1), at, r
