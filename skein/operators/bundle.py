"""Least squares over cameras and points where Spark adds up the normal equations: the points of a camera lie in many tasks, points are eliminated
in the tasks that hold them (Schur complement), and the driver solves the small system of the cameras alone."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import shared
from skein.engines import calibration
from skein.functions import optics
from skein.functions.numeric import Arrays
from skein.functions.optics import Camera

XYZ = ("x", "y", "z")
#: Where a step is small enough, and rounds at most.
LIMIT, ROUNDS = calibration.LIMIT, calibration.ROUNDS
# Sides of a block of the cameras' system, step of derivatives by a point's place, first damping and where it ends.
SIDE, STEP, DAMP, STUCK = len(calibration.EXTERIOR), 1e-3, 1e-6, 1e12


def _metric(c: Camera, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack(optics.to_metric(Arrays, c, u, v), 1)


def _gathered(points: DataFrame, width: int, run) -> dict[int, np.ndarray]:
    """Sums of run(cam, rows) -> `width` numbers over all points of each camera, added up map-side and by Spark."""
    names = [f"s{k}" for k in range(width)]

    def task(batches):
        import pandas as pd

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for cam, rows in b.groupby("cam"):
                with np.errstate(all="ignore"):
                    total[int(cam)] = total.get(int(cam), 0.0) + run(int(cam), rows)
        if total:
            yield pd.DataFrame([[c, *v] for c, v in total.items()], columns=["cam", *names]).astype({"cam": "int64"})

    kind = "cam long, " + ", ".join(f"{n} double" for n in names)
    found = points.mapInPandas(task, kind).groupBy("cam").agg(*[F.sum(n).alias(n) for n in names])
    return {r["cam"]: np.array(r[1:], float) for r in found.collect()}  # a row a camera


def _packed(j: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A'A (upper part), A'e, e'e and how many equations, as one row of numbers."""
    a = j.T @ j
    return np.concatenate([a[np.triu_indices(len(a))], j.T @ e, [e @ e, len(e)]])


def _unpacked(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    a = np.zeros((n, n))
    a[np.triu_indices(n)] = row[: n * (n + 1) // 2]
    a = a + np.triu(a, 1).T
    return a, row[n * (n + 1) // 2 : -2], float(row[-2]), int(row[-1])


def orient(points: DataFrame, start: dict[int, Camera], names=calibration.EXTERIOR, rounds: int = ROUNDS, limit: float = LIMIT, damped: bool = True) -> dict[int, Camera]:
    """Cameras whose named parameters fit known points (cam, x, y, z, u, v in pixels), all at once: a job a round, whose sums hold every point of every camera.

    Damped Gauss-Newton as engines.calibration.orient. Cameras without points stay as they are; points with nulls are dropped.
    """
    names = tuple(names)
    points = points.dropna(subset=["cam", *XYZ, "u", "v"])
    n = len(names)
    best, trial = dict(start), dict(start)
    held: dict[int, tuple] = {}
    damp, open_ = dict.fromkeys(start, DAMP if damped else 0.0), set(start)
    for _ in range(rounds):
        now = {c: trial[c] for c in open_}

        def system(cam, rows, now=now):
            if cam not in now:
                return np.zeros(n * (n + 1) // 2 + n + 2)
            c, x = now[cam], rows[list(XYZ)].to_numpy()
            e = _metric(c, rows["u"].to_numpy(), rows["v"].to_numpy()).ravel() - calibration.images(c, x).ravel()
            return _packed(calibration.derivatives(c, x, names), e)

        sums = _gathered(points.where(F.col("cam").isin([int(c) for c in now])), n * (n + 1) // 2 + n + 2, system)
        for cam in sorted(open_):
            if cam not in sums:
                open_.discard(cam)
                continue
            new = _unpacked(sums[cam], n)
            before = held.get(cam)
            if before is not None and damped and not (np.isfinite(new[2]) and np.isfinite(new[0]).all() and new[2] <= before[2]):
                damp[cam] *= 16
                if damp[cam] > STUCK:
                    open_.discard(cam)
            else:
                small = before is not None and bool((np.abs(_values(trial[cam], names) - _values(best[cam], names)) < limit).all())
                best[cam], held[cam] = trial[cam], new
                damp[cam] = max(damp[cam] / 4, 1e-12) if damped else 0.0
                if small:
                    open_.discard(cam)
            if cam in open_:
                a, y, _, _ = held[cam]
                step = np.linalg.solve(a + damp[cam] * np.diag(np.diag(a) + 1e-12), y)
                trial[cam] = replace(best[cam], **{k: getattr(best[cam], k) + float(s) for k, s in zip(names, step, strict=True)})
        if not open_:
            break
    return best if damped else trial


def _values(c: Camera, names) -> np.ndarray:
    return np.array([getattr(c, k) for k in names], float)


def resect(points: DataFrame, start: dict[int, Camera]) -> dict[int, Camera]:
    """Orientations without lens distortion, by up to RAW_ROUNDS full steps until one is below RAW_LIMIT."""
    bare = {k: replace(c, k1=0.0, k2=0.0, k3=0.0, p1=0.0, p2=0.0, scx=1.0, she=0.0) for k, c in start.items()}
    return orient(points, bare, rounds=calibration.RAW_ROUNDS + 1, limit=calibration.RAW_LIMIT, damped=False)


def full(points: DataFrame, start: dict[int, Camera], lens=calibration.LENS[:2]) -> dict[int, Camera]:
    """Resection, then orientation, then interior and the named lens parameters too."""
    found = orient(points, resect(points, {k: calibration.guard(c) for k, c in start.items()}))
    found = orient(points, found, (*calibration.EXTERIOR, *calibration.INTERIOR, *lens))
    return {k: calibration.guard(c) for k, c in found.items()}


def direct_linear(points: DataFrame, base: dict[int, Camera]) -> dict[int, Camera]:
    """Cameras without a start: the 12 x 12 sums of the direct linear transformation, solved by the engine from their smallest direction."""
    points = points.dropna(subset=["cam", *XYZ, "u", "v"])
    spread = points.groupBy("cam").agg(*[F.avg(a).alias(a) for a in XYZ], F.avg(sum(F.col(a) * F.col(a) for a in XYZ)).alias("q")).collect()
    frames = {r["cam"]: (np.array([r[a] for a in XYZ]), float(np.sqrt(max(r["q"] - sum(r[a] ** 2 for a in XYZ), 0.0) / 3)) or 1.0) for r in spread}

    def system(cam, rows):
        shift, size = frames[cam]
        q = np.c_[(rows[list(XYZ)].to_numpy() - shift) / size, np.ones(len(rows))]
        seen = _metric(base[cam], rows["u"].to_numpy(), rows["v"].to_numpy())
        zero = np.zeros_like(q)
        a = np.concatenate([np.c_[q, zero, -seen[:, :1] * q], np.c_[zero, q, -seen[:, 1:] * q]])
        return (a.T @ a)[np.triu_indices(12)]

    out = {}
    for cam, row in _gathered(points, 78, system).items():
        a = np.zeros((12, 12))
        a[np.triu_indices(12)] = row
        _, vectors = np.linalg.eigh(a + np.triu(a, 1).T)
        out[cam] = calibration.from_projection(vectors[:, 0].reshape(3, 4), *frames[cam], base[cam])
    return out


def errors(points: DataFrame, rig: dict[int, Camera]) -> dict[int, tuple[float, int]]:
    """Root mean square pixel error and number of points of each camera."""

    def run(cam, rows):
        d = ((calibration.pixels(rig[cam], rows[list(XYZ)].to_numpy()) - rows[["u", "v"]].to_numpy()) ** 2).sum(1)
        ok = np.isfinite(d)
        return np.array([d[ok].sum(), ok.sum(), len(d)], float)

    found = _gathered(points.dropna(subset=["cam", *XYZ, "u", "v"]), 3, run)
    return {k: (float(np.sqrt(s / n)) if n else float("nan"), int(m)) for k, (s, n, m) in found.items()}


def shared_focal(points: DataFrame, start: dict[int, Camera], lengths: list[float], rounds: int = 12) -> tuple[float, dict[int, Camera], dict[float, float]]:
    """The principal distance of a list that all cameras share best, its cameras, and the root mean square pixel error of each length tried."""
    points = shared.table(points)
    tried = {}
    for cc in lengths:
        rig = orient(points, {k: replace(c, cc=float(cc)) for k, c in start.items()}, rounds=rounds)
        found = errors(points, rig).values()
        tried[float(cc)] = (float(np.sqrt(sum(e * e * n for e, n in found) / sum(n for _, n in found))), rig)
    best = min(tried, key=lambda cc: (tried[cc][0], cc))
    shared.drop(points)
    return best, tried[best][1], {cc: e for cc, (e, _) in tried.items()}


def usable_views(views: DataFrame, least: int = 12, cameras: int = 2) -> DataFrame:
    """Views (view, cam, point, u, v) with enough points in a camera, of plates that enough cameras see so; nulls are dropped, a point counts once a camera."""
    rows = views.dropna(subset=["view", "cam", "point", "u", "v"])
    enough = rows.groupBy("view", "cam").agg(F.count_distinct("point").alias("n")).where(F.col("n") >= least)
    together = enough.groupBy("view").agg(F.count("*").alias("cams")).where(F.col("cams") >= cameras)
    return rows.join(enough.select("view", "cam"), ["view", "cam"], "left_semi").join(together.select("view"), "view", "left_semi")


def _linear(rig: list[Camera], b, weight: float) -> dict:
    """Everything of a batch of points at the present cameras: residuals and slopes by point (p) and camera (c), in sensor millimetres."""
    n, cams = len(b), len(rig)
    x, home = b[list(XYZ)].to_numpy(float), b[["hx", "hy", "hz"]].to_numpy(float)
    u = np.full((n, cams, 2), np.nan)
    for k, seen in enumerate(b["seen"]):
        for s in seen:
            u[k, int(s["cam"])] = s["u"], s["v"]
    v = np.eye(3) * weight + np.zeros((n, 3, 3))
    ep, w = weight * (home - x), np.zeros((n, cams, SIDE, 3))
    uc, ec, cost = np.zeros((cams, SIDE, SIDE)), np.zeros((cams, SIDE)), float(weight * ((home - x) ** 2).sum())
    for c in range(cams):
        at = np.flatnonzero(np.isfinite(u[:, c]).all(1))
        if not len(at):
            continue
        p = x[at]
        base = calibration.images(rig[c], p)
        e = _metric(rig[c], u[at, c, 0], u[at, c, 1]) - base
        jc = calibration.derivatives(rig[c], p).reshape(len(at), 2, SIDE)
        jp = np.stack([(calibration.images(rig[c], p + STEP * d) - calibration.images(rig[c], p - STEP * d)) / (2 * STEP) for d in np.eye(3)], 2)
        v[at] += np.einsum("nij,nik->njk", jp, jp)
        ep[at] += np.einsum("nij,ni->nj", jp, e)
        w[at, c] = np.einsum("nij,nik->njk", jc, jp)
        uc[c] += np.einsum("nij,nik->jk", jc, jc)
        ec[c] += np.einsum("nij,ni->j", jc, e)
        cost += float((e * e).sum())
    return {"v": v, "ep": ep, "w": w, "uc": uc, "ec": ec, "cost": cost}


def _system(points: DataFrame, rig: list[Camera], weight: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The cameras' system after all points are eliminated, and the cost. Blocks of pairs of cameras add up map-side."""
    cams = len(rig)
    names = [f"s{k}" for k in range(SIDE * SIDE)]

    def task(batches):
        import pandas as pd

        total, right, cost = np.zeros((cams, SIDE, cams, SIDE)), np.zeros((cams, SIDE)), 0.0
        for b in batches:
            t = _linear(rig, b, weight)
            inverse = np.linalg.inv(t["v"])
            y = np.einsum("pcid,pde->pcie", t["w"], inverse)
            total -= np.einsum("pcie,pbje->cibj", y, t["w"])
            right += t["ec"] - np.einsum("pcie,pe->ci", y, t["ep"])
            for c in range(cams):
                total[c, :, c] += t["uc"][c]
            cost += t["cost"]
        rows = [[a, c, *total[a, :, c].ravel()] for a in range(cams) for c in range(a, cams)]
        rows += [[a, -1, *right[a], *np.zeros(SIDE * SIDE - SIDE)] for a in range(cams)]
        yield pd.DataFrame([*rows, [-1, -1, cost, *np.zeros(SIDE * SIDE - 1)]], columns=["a", "b", *names]).astype({"a": "int64", "b": "int64"})

    found = points.mapInPandas(task, "a long, b long, " + ", ".join(f"{n} double" for n in names)).groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in names]).collect()
    s, r, cost = np.zeros((cams, SIDE, cams, SIDE)), np.zeros((cams, SIDE)), 0.0
    for row in found:  # a row a pair of cameras
        a, b, values = row["a"], row["b"], np.array(row[2:], float)
        if a < 0:
            cost = values[0]
        elif b < 0:
            r[a] = values[:SIDE]
        else:
            s[a, :, b] = values.reshape(SIDE, SIDE)
            s[b, :, a] = values.reshape(SIDE, SIDE).T
    return s.reshape(cams * SIDE, -1), r.ravel(), cost


def joint(seen: DataFrame, nominal: DataFrame, rig: list[Camera], weight: float = 1.0, rounds: int = 20, limit: float = 1e-7) -> tuple[list[Camera], DataFrame, dict]:
    """Cameras' places and angles and the points of a plate together: least total image error, the points held to their nominal places by weight.

    seen: (point, cam, u, v in pixels); nominal: (point, x, y, z). Returns the cameras, points (point, x, y, z) and facts: cost before and after, rounds, points.
    Points that fewer than two cameras see, and rows with nulls, don't count. Each round reads the points twice: for the sums, and to move the points after the cameras.
    weight ties the frame, so it must be above 0.
    """
    if weight <= 0:
        raise ValueError("points must be held to their places")
    rows = seen.dropna(subset=["point", "cam", "u", "v"]).where(F.col("cam").between(0, len(rig) - 1))
    each = rows.groupBy("point").agg(F.collect_list(F.struct("cam", "u", "v")).alias("seen"), F.count_distinct("cam").alias("n")).where("n >= 2").drop("n")
    start = nominal.dropna(subset=["point", *XYZ]).select("point", *XYZ, *[F.col(a).alias(f"h{a}") for a in XYZ])
    points = shared.table(each.join(start, "point"))
    n = points.count()
    if n < 4:
        return list(rig), points.select("point", *XYZ), {"skipped": "fewer than four points in two cameras", "points": n}
    kind = points.schema

    def moved(now, delta):
        def task(batches):
            for b in batches:
                t = _linear(now, b, weight)
                step = np.linalg.solve(t["v"], (t["ep"] - np.einsum("pcid,ci->pd", t["w"], delta))[:, :, None])[:, :, 0]
                yield b.assign(**{a: b[a] + step[:, k] for k, a in enumerate(XYZ)})

        return task

    a, y, cost = _system(points, rig, weight)
    first, damp, done = cost, DAMP, 0
    for done in range(1, rounds + 1):
        delta = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), y).reshape(len(rig), SIDE)
        trial = [replace(c, **{k: getattr(c, k) + float(d) for k, d in zip(calibration.EXTERIOR, row, strict=True)}) for c, row in zip(rig, delta, strict=True)]
        new = shared.table(points.mapInPandas(moved(rig, delta), kind))
        a2, y2, after = _system(new, trial, weight)
        if np.isfinite(after) and after <= cost:
            shared.drop(points)
            still = cost - after <= limit * max(cost, 1e-300)
            points, rig, a, y, cost, damp = new, trial, a2, y2, after, max(damp / 4, 1e-12)
            if still:
                break
        else:
            shared.drop(new)
            damp *= 16
            if damp > STUCK:
                break
    return rig, points.select("point", *XYZ), {"before": first, "after": cost, "rounds": done, "points": n}
