"""Targets in one image: grown from local maxima, by connected components, or by local contrast. Images are 2D arrays (row, column) of grey values."""

from __future__ import annotations

from collections import deque

import numpy as np

COLUMNS = ("x", "y", "n", "nx", "ny", "sumg")


def _around(img: np.ndarray, steps) -> np.ndarray:
    """Largest of the given neighbours of every pixel; the image ends in -1."""
    wide = np.pad(img.astype(int), 1, constant_values=-1)
    h, w = img.shape
    return np.max([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in steps], axis=0)


SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))
CORNERS = ((-1, -1), (1, -1), (-1, 1), (1, 1))


def _target(ys, xs, img, threshold: int, limits: dict) -> tuple | None:
    """Centre, size and brightness of a set of pixels, or None outside of the limits. Grey above the threshold weighs."""
    n, nx, ny = len(xs), int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1)
    g = img[ys, xs].astype(int)
    total = int(g.sum())
    inside = all(limits.get(k, (0, 10**9))[0] <= v <= limits.get(k, (0, 10**9))[1] for k, v in (("n", n), ("nx", nx), ("ny", ny)))
    if not inside or total <= limits.get("sumg", 0):
        return None
    w = g - threshold
    s = int(w.sum())
    x, y = ((np.asarray(xs) * w).sum() / s, (np.asarray(ys) * w).sum() / s) if s > 0 else (xs[0], ys[0])
    return float(x) + 0.5, float(y) + 0.5, n, nx, ny, total


def grow(img: np.ndarray, threshold: int, discontinuity: int, limits: dict) -> list[tuple]:
    """Targets (COLUMNS) grown from local maxima above the threshold, in order of rows.

    From each maximum of its eight neighbours that no target has taken, pixels join over their sides while they are above the threshold and no brighter than the
    pixel before by more than the discontinuity, nor are their own neighbours. The outermost rows and columns don't count. limits: (least, most) of n, nx and ny,
    and the brightness sumg that must be exceeded; beyond the most pixels a target still takes pixels but grows no further from them.
    """
    img = np.asarray(img).astype(int)
    h, w = img.shape
    sides = _around(img, SIDES)
    peak = (img > threshold) & (img >= np.maximum(sides, _around(img, CORNERS)))
    free = img > threshold
    out, most = [], limits.get("n", (0, 10**9))[1]
    for y, x in zip(*np.nonzero(peak[1 : h - 1, 1 : w - 1])):
        y, x = y + 1, x + 1
        if not free[y, x]:
            continue
        ys, xs, queue = [y], [x], deque([(y, x)])
        free[y, x] = False
        while queue:
            cy, cx = queue.popleft()
            level = img[cy, cx] + discontinuity
            for dy, dx in SIDES:
                ny, nx = cy + dy, cx + dx
                if 1 <= ny < h - 1 and 1 <= nx < w - 1 and free[ny, nx] and img[ny, nx] <= level and sides[ny, nx] <= level:
                    free[ny, nx] = False
                    ys.append(ny)
                    xs.append(nx)
                    if len(ys) <= most:
                        queue.append((ny, nx))
        found = _target(ys, xs, img, threshold, limits)
        if found:
            out.append(found)
    return out


def label(mask: np.ndarray, reach: int = 1, corners: bool = False) -> np.ndarray:
    """Numbers from 1 of connected sets of a mask in order of rows; pixels up to reach apart are connected (over sides only if reach is 1 and not corners)."""
    out = np.zeros(mask.shape, int)
    h, w = mask.shape
    steps = SIDES + CORNERS if corners and reach == 1 else SIDES if reach == 1 else [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    count = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        count += 1
        out[y, x], queue = count, deque([(y, x)])
        while queue:
            cy, cx = queue.popleft()
            for dy, dx in steps:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not out[ny, nx]:
                    out[ny, nx] = count
                    queue.append((ny, nx))
    return out


def components(img: np.ndarray, threshold: int, limits: dict) -> list[tuple]:
    """Targets (COLUMNS) of connected sets of pixels above the threshold."""
    img = np.asarray(img).astype(int)
    marks = label(img > threshold)
    out = []
    for n in range(1, marks.max() + 1):
        ys, xs = np.nonzero(marks == n)
        found = _target(ys, xs, img, threshold, limits)
        if found:
            out.append(found)
    return out


def peaks(img: np.ndarray, threshold: int, limits: dict, prominence: float = 2.0, share: float = 0.02) -> list[tuple]:
    """Targets (COLUMNS) of connected sets split at their maxima.

    Pixels are dealt from the brightest down to the basin of their brightest neighbour's; a basin whose peak stands less than max(prominence, share * (peak - threshold))
    above the saddle to a higher one is part of that.
    """
    img = np.asarray(img).astype(int)
    h, w = img.shape
    of = np.zeros(img.shape, int)
    top: list[int] = [0]
    parent = [0]

    def root(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    ys, xs = np.nonzero(img > threshold)
    for k in np.lexsort((xs, ys, -img[ys, xs])):
        y, x = ys[k], xs[k]
        near = sorted({root(of[ny, nx]) for ny, nx in ((y + dy, x + dx) for dy, dx in SIDES) if 0 <= ny < h and 0 <= nx < w and of[ny, nx]}, key=lambda a: (-top[a], a))
        if not near:
            parent.append(len(top))
            top.append(img[y, x])
            of[y, x] = len(top) - 1
            continue
        of[y, x] = near[0]
        for other in near[1:]:
            if top[other] - img[y, x] < max(prominence, share * (top[other] - threshold)):
                parent[other] = near[0]
    of = np.array([root(a) for a in of.ravel()]).reshape(of.shape)
    out = []
    for n in sorted(set(of.ravel()) - {0}, key=lambda n: tuple(np.argwhere(of == n)[0])):
        found = _target(*np.nonzero(of == n), img, threshold, limits)
        if found:
            out.append(found)
    return out


def local_mean(img: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, the image mirrored at its ends."""
    before, after = size // 2, size - size // 2 - 1
    wide = np.pad(np.asarray(img, float), ((before, after), (before, after)), mode="symmetric")
    total = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / (size * size)


def bubbles(img: np.ndarray, window: int = 25, contrast: float = 7.0, reach: int = 4, least: int = 1, most: int = 5000) -> list[tuple[float, float, int]]:
    """(x, y, pixels) of sets of pixels that stand `contrast` local deviations above the local mean, fragments up to reach apart joined; weighted by contrast."""
    img = np.asarray(img, float)
    mean = local_mean(img, window)
    z = (img - mean) / np.sqrt(np.maximum(local_mean(img * img, window) - mean * mean, 1e-6))
    marks = label(z >= contrast, reach)
    out = []
    for n in range(1, marks.max() + 1):
        ys, xs = np.nonzero(marks == n)
        w = z[ys, xs]
        if least <= len(xs) <= most and w.sum() > 0:
            out.append((float((w * xs).sum() / w.sum()), float((w * ys).sum() / w.sum()), len(xs)))
    return out


def grey_bytes(img: np.ndarray, mode: str = "fixed", low: float | None = None, high: float | None = None, percentiles=(0.5, 99.9)) -> np.ndarray:
    """An image as bytes; values beyond the range clip. fixed: the type's whole range (unsigned ones by a shift), range: low .. high, stretch: between percentiles."""
    img = np.asarray(img)
    if img.ndim == 3:
        img = img.mean(axis=2)
    if img.dtype == np.uint8:
        return img
    if mode == "fixed":
        if np.issubdtype(img.dtype, np.unsignedinteger):
            return (img >> (img.dtype.itemsize * 8 - 8)).astype(np.uint8)
        low, high = (float(np.iinfo(img.dtype).min), float(np.iinfo(img.dtype).max)) if np.issubdtype(img.dtype, np.integer) else (0.0, 1.0)
    elif mode == "stretch":
        low, high = (float(v) for v in np.percentile(img, percentiles))
        high = high if high > low else float(img.max()) or 1.0
    elif mode != "range" or low is None or high is None or high <= low:
        raise ValueError(f"no such scaling: {mode} {low} {high}")
    return np.clip((img.astype(float) - low) / (high - low) * 255.0, 0, 255).astype(np.uint8)


def suggest_range(img: np.ndarray, percentiles=(0.5, 99.9)) -> tuple[int, int]:
    """A range of grey for a whole run from one image."""
    low, high = np.percentile(np.asarray(img), percentiles)
    return int(low), int(high)
