"""Rigs of cameras on tables: projection, rays, triangulation, epipolar candidates and the cascade of camera matches.

A rig is a list of optics.Camera, a handful. Targets are rows (frame, cam, pnr, x, y[, n, nx, ny, sumg]) in
pixels, points rows (frame, id, x, y, z).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry, optics
from skein.functions.numeric import Arrays, Columns
from skein.functions.optics import Camera, Volume

XYZ = ("x", "y", "z")
#: Cameras of a rig at most; a rig travels with its tasks.
MOST_CAMERAS = 64
# Fixed value: stands for a coordinate that isn't there.
MISSING = -1e10
# Fixed value: second number of a sector, which no cell of a sensor has.
_SECTOR = -(1 << 62)


def _checked(rig: list[Camera]) -> list[Camera]:
    if len(rig) > MOST_CAMERAS:
        raise ValueError(f"a rig of {len(rig)} cameras")
    return rig


def over_cameras(df: DataFrame, rig: list[Camera], run, schema: str) -> DataFrame:
    """df's columns and those of run(camera, rows of that camera) -> arrays, batch by batch in Arrow; the rig travels with the task.

    Formulas of cameras are long, and Catalyst would repeat them wherever a filter meets their results; over arrays they run once.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    keep = [c for c in df.columns if c not in names]
    _checked(rig)

    def task(batches):
        for b in batches:
            out = np.full((len(names), len(b)), np.nan)
            cams = b["cam"].to_numpy()
            for cam in np.unique(cams):
                at = np.flatnonzero(cams == cam)
                with np.errstate(all="ignore"):
                    for n, v in enumerate(run(rig[int(cam)], b.iloc[at])):
                        out[n, at] = v
            yield b[keep].assign(**dict(zip(names, out)))

    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name in keep] + T.StructType.fromDDL(schema).fields
    return df.mapInPandas(task, T.StructType(fields))


def _xyz(rows) -> list[np.ndarray]:
    return [rows[a].to_numpy() for a in XYZ]


def project(points: DataFrame, rig: list[Camera], flat: bool = False, rounds: int = optics.SHIFT_ROUNDS, limit: float = optics.SHIFT_LIMIT) -> DataFrame:
    """Every point in every camera: the point's columns with cam, u, v; pixels, or ideal sensor millimetres if flat."""
    rows = points.withColumn("cam", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(rig) - 1).cast("long"))))
    see = optics.flat if flat else optics.pixel
    return over_cameras(rows, rig, lambda c, r: see(Arrays, c, _xyz(r), rounds=rounds, limit=limit), "u double, v double")


def flat_targets(targets: DataFrame, rig: list[Camera], limit: float = optics.LENS_LIMIT) -> DataFrame:
    """Targets with fx, fy: pixels to millimetres, lens distortion removed, about the principal point."""
    def run(c, r):
        return optics.to_flat(Arrays, c, *optics.to_metric(Arrays, c, r["x"].to_numpy(), r["y"].to_numpy()), limit=limit)

    return over_cameras(targets, rig, run, "fx double, fy double")


def rays(flat: DataFrame, rig: list[Camera], x: str = "fx", y: str = "fy") -> DataFrame:
    """Rows with the ray of their ideal image point: vertex vx, vy, vz and direction dx, dy, dz."""
    def run(c, r):
        vertex, direction = optics.ray(Arrays, c, r[x].to_numpy(), r[y].to_numpy())
        return [*vertex, *direction]

    return over_cameras(flat, rig, run, ", ".join(f"{k}{a} double" for k in "vd" for a in XYZ))


def lookup(wanted: DataFrame, flat: DataFrame) -> DataFrame:
    """Ideal coordinates of targets (frame, cam, pnr); MISSING where there is no such target."""
    found = flat.select("frame", "cam", "pnr", "fx", "fy")
    return wanted.join(found, ["frame", "cam", "pnr"], "left").withColumns({c: F.coalesce(c, F.lit(MISSING)) for c in ("fx", "fy")})


def triangulate(seen: DataFrame, method: str = "pairs", key: tuple[str, ...] = ("frame", "id")) -> DataFrame:
    """Points of rays (key, cam, vertex, direction): key, x, y, z, rcm, cams; null positions for points of one ray.

    pairs: mean of the midpoints of all pairs of rays; weighted: by the squared sine of their angle; lsq: the point nearest to all rays. rcm is the mean distance
    of the pairs' closest points. A point's rays are a row's array, as many as cameras; the pairs of that array stay in the same partition.
    """
    parts = F.struct("cam", *[F.array(*[F.col(f"{k}{a}") for a in XYZ]).alias(k) for k in "vd"])
    each = seen.groupBy(*key).agg(F.sort_array(F.collect_list(parts)).alias("r"))
    n = F.size("r")
    where = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    pairs = each.select(*key, n.alias("cams"), "r", F.explode_outer(where).alias("p")).select(*key, "cams", "r", F.get("r", F.col("p.i")).alias("a"), F.get("r", F.col("p.j")).alias("b"), (F.col("p.i") == 0).alias("_i0"), (F.col("p.j") == 1).alias("_j1"))
    vec = lambda c: tuple(F.col(c).getItem(k) for k in range(3))
    mid, gap = geometry.skew_midpoint(vec("a.v"), vec("a.d"), vec("b.v"), vec("b.d"))
    cross = geometry.cross(vec("a.d"), vec("b.d"))
    size = geometry.dot(vec("a.d"), vec("a.d")) * geometry.dot(vec("b.d"), vec("b.d"))
    rows = pairs.select(*key, "cams", F.when(F.col("_i0") & F.col("_j1"), F.col("r")).alias("r"), *[m.alias(a) for m, a in zip(mid, XYZ)], gap.alias("gap"), (geometry.dot(cross, cross) / size).alias("w"))
    sums = rows.groupBy(*key).agg(F.max("cams").alias("cams"), F.first("r", ignorenulls=True).alias("r"), F.avg("gap").alias("rcm"), F.sum("w").alias("w"), *[F.avg(a).alias(a) for a in XYZ], *[F.sum(F.col("w") * F.col(a)).alias(f"w{a}") for a in XYZ])
    if method == "pairs":
        at = [F.col(a) for a in XYZ]
    elif method == "weighted":
        at = [F.when(F.col("w") > 1e-12, F.col(f"w{a}") / F.col("w")).otherwise(F.col(a)) for a in XYZ]
    elif method == "lsq":
        return _nearest_to_rays(sums, key)
    else:
        raise ValueError(method)
    return sums.select(*key, *[p.alias(f"_{a}") for p, a in zip(at, XYZ)], "rcm", "cams").select(*key, *[F.col(f"_{a}").alias(a) for a in XYZ], "rcm", F.col("cams").cast("long").alias("cams"))


def _nearest_to_rays(sums: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Positions by the summed normal equations of each point's rays; the mean of the pairs where these are singular."""
    fields = ", ".join(f"{n} {t}" for n, t in sums.select(*key, *XYZ).dtypes)

    def run(batches):
        for b in batches:
            n = b["r"].map(len).to_numpy()
            of = np.repeat(np.arange(len(b)), n)
            v, d = (np.array([list(x[k]) for r in b["r"] for x in r], float).reshape(-1, 3) for k in "vd")
            terms = {k: np.bincount(of, t, len(b)) for k, t in optics.normal_terms(v.T, d.T).items()}
            with np.errstate(all="ignore"):
                det, at = optics.solve_normal(Arrays, terms)
            good = (det > 1e-9) & (n > 1)
            yield b.assign(**{a: np.where(good, p, b[a].to_numpy(float)) for a, p in zip(XYZ, at)}).drop(columns="r")

    return sums.select(*key, *XYZ, "rcm", "cams", F.coalesce("r", F.array().cast(sums.schema["r"].dataType)).alias("r")).mapInPandas(run, f"{fields}, rcm double, cams long")


def single_camera(flat: DataFrame, rig: list[Camera], volume: Volume) -> DataFrame:
    """Points of one camera's targets, (frame, pnr, x, y, z): each ray's point midway through the volume."""
    seen = rays(flat.where("cam = 0"), rig[:1])
    t = (F.lit((volume.z_min[0] + volume.z_max[0]) / 2) - F.col("vz")) / F.col("dz")
    flat_ray = F.abs("dz") <= 1e-10
    return seen.select("frame", "pnr", *[F.when(flat_ray, F.col(f"v{a}")).otherwise(F.col(f"v{a}") + t * F.col(f"d{a}")).alias(a) for a in XYZ])


def segments(flat: DataFrame, rig: list[Camera], cam: int, other: int, volume: Volume) -> DataFrame:
    """Targets of cam with their epipolar segment in the other camera: xa, ya at the lowest and xb, yb at the highest z."""
    def run(c, r):
        return optics.epipolar_segment(Arrays, c, rig[other], r["fx"].to_numpy(), r["fy"].to_numpy(), volume)

    return over_cameras(flat.where(F.col("cam") == cam), rig, run, "xa double, ya double, xb double, yb double")


def epipolar_curve(flat: DataFrame, rig: list[Camera], cam: int, other: int, volume: Volume, n: int) -> DataFrame:
    """(frame, pnr, k, z, u, v): n points of each target's ray, equally spaced from the lowest to the highest z, in the other camera's pixels."""
    steps = flat.where(F.col("cam") == cam).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("z", F.lit(float(volume.z_min[0])) + F.col("k") * F.lit((volume.z_max[0] - volume.z_min[0]) / max(1, n - 1)))

    def run(c, r):
        vertex, direction = optics.ray(Arrays, c, r["fx"].to_numpy(), r["fy"].to_numpy())
        return optics.pixel(Arrays, rig[other], optics.at_height(Arrays, vertex, direction, r["z"].to_numpy()))

    return over_cameras(steps, rig, run, "u double, v double").select("frame", "pnr", "k", "z", "u", "v")


def _corners(c: Camera) -> tuple[float, ...]:
    """Undistorted bounds of the sensor: left, low, right, high."""
    w, h = c.pix_x * c.imx / 2, c.pix_y * c.imy / 2
    return tuple(float(v) for s in (-1, 1) for v in optics.undistort(Arrays, c, s * w - c.xh, s * h - c.yh))


def _ratio(a: str, b: str) -> Column:
    return F.least(a, b).cast("double") / F.greatest(a, b)


def _pole(rig: list[Camera], cam: int, other: int) -> tuple[Callable[[Column, Column], tuple[Column, Column]], float] | None:
    """Where the epipolar lines of cam meet in the other camera's plane: (x, y) -> (distance ahead of it, angle about it), and the distance of the sensor's centre.

    Lines that meet far off are parallel: their distance takes the angle's place, at distance 1. None where they meet on the sensor or near it. Refraction bends lines
    a little, so the angle is a guide to which targets may lie on one, no test.
    """
    c, left, low, right, high = rig[other], *_corners(rig[other])
    m, off = c.turned(Arrays), [float(a - b) for a, b in zip((rig[cam].x0, rig[cam].y0, rig[cam].z0), (c.x0, c.y0, c.z0))]
    u, v, deep = (float(sum(m[k][j] * off[k] for k in range(3))) for j in range(3))
    cx, cy, reach = (left + right) / 2, (low + high) / 2, float(np.hypot(right - left, high - low)) / 2
    side = float(np.hypot(u, v))
    if not side or not np.isfinite([u, v, deep, cx, cy, reach]).all():
        return None
    if abs(deep) * reach * 1e5 < side * c.cc:  # parallel
        return (lambda x, y: (F.lit(1.0), (u * y - v * x) / side)), 1.0
    px, py = -c.cc * u / deep, -c.cc * v / deep
    away = float(np.hypot(cx - px, cy - py))
    if away < 2 * reach:
        return None
    ax, ay = (cx - px) / away, (cy - py) / away
    ahead = lambda x, y: (x - px) * ax + (y - py) * ay
    return (lambda x, y: (ahead(x, y), F.atan2((y - py) * ax - (x - px) * ay, ahead(x, y)))), away


def candidates(flat: DataFrame, rig: list[Camera], cam: int, other: int, volume: Volume, eps: float, least: dict | None = None, cell: float | None = None, most: int | None = None) -> DataFrame:
    """Edges (frame, p1, p2, corr, dist) of targets of two cameras: within eps of the epipolar segment and of its bounding box (strictly), ratios of n, nx, ny not below
    and of sumg above `least`; corr = (4 q_sumg + 2 q_n + q_nx + q_ny) * (sumg1 + sumg2).

    Epipolar lines meet in one point, so the strip is an equi-join of sectors about it, as wide as the strip: a segment is dealt to the few it may pass, a target to its own.
    Segments that come near that point, and all where it lies on the sensor, take cells of a 2D grid instead. With `most`, the first in order of x stay.
    """
    q = {"n": 0.0, "nx": 0.0, "ny": 0.0, "sumg": 0.0} | (least or {})
    cell = cell or 16 * eps
    left_, low_, right_, high_ = _corners(rig[other])
    a = segments(flat, rig, cam, other, volume)
    a = a.withColumn("xb", F.when(F.col("xa") == F.col("xb"), F.col("xb") + 1e-10).otherwise(F.col("xb")))
    a = a.withColumn("m", (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).withColumn("b", F.col("ya") - F.col("m") * F.col("xa"))
    a = a.withColumns({"x1": F.least("xa", "xb"), "x2": F.greatest("xa", "xb"), "y1": F.least("ya", "yb"), "y2": F.greatest("ya", "yb")})
    a = a.where((F.col("x2") > left_) & (F.col("x1") < right_) & (F.col("y2") > low_) & (F.col("y1") < high_))
    at = lambda v: F.floor(v / cell).cast("long")
    thick = eps * F.sqrt(1 + F.col("m") * F.col("m"))

    def rows_of(cx: Column) -> Column:
        p = F.col("m") * F.greatest(cx * cell, F.col("x1") - eps) + F.col("b")
        r = F.col("m") * F.least((cx + 1) * cell, F.col("x2") + eps) + F.col("b")
        low, high = F.greatest(F.least(p, r) - thick, F.col("y1") - eps), F.least(F.greatest(p, r) + thick, F.col("y2") + eps)
        return F.transform(F.when(high >= low, F.sequence(at(low), at(high))).otherwise(F.array().cast("array<bigint>")), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    cells = F.flatten(F.transform(F.sequence(at(F.col("x1") - eps), at(F.col("x2") + eps)), rows_of))
    own = ("n", "nx", "ny", "sumg")
    homes, pole = F.array(F.struct(at(F.col("fx")).alias("cx"), at(F.col("fy")).alias("cy"))), _pole(rig, cam, other)
    if pole:
        # cells and sectors share one join
        polar, away = pole
        wide, near_by = 4 * eps / away, max(away / 4, 10 * eps)
        size = F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
        past = {k: F.lit(3 * eps) * (F.col(f"{k}b") - F.col(f"{k}a")) / size for k in "xy"}  # what lies in strip and box lies beside the segment lengthened so
        ends = [polar(F.col(f"x{e}") + sign * past["x"], F.col(f"y{e}") + sign * past["y"]) for e, sign in (("a", -1), ("b", 1))]
        a = a.withColumns({f"_{k}{n}": v for n, end in enumerate(ends) for k, v in zip("dt", end)})
        ahead = F.least("_d0", "_d1")
        slack = 1.01 * eps / ahead
        sectors = F.sequence(F.floor((F.least("_t0", "_t1") - slack) / wide), F.floor((F.greatest("_t0", "_t1") + slack) / wide))
        sectors = F.transform(sectors, lambda k: F.struct(k.cast("long").alias("cx"), F.lit(_SECTOR).cast("long").alias("cy")))
        cells = F.when((ahead >= near_by) & (size < float("inf")), sectors).otherwise(cells)
        homes = F.concat(homes, F.array(F.struct(F.floor(polar(F.col("fx"), F.col("fy"))[1] / wide).cast("long").alias("cx"), F.lit(_SECTOR).cast("long").alias("cy"))))
    left = a.select("frame", F.col("pnr").alias("p1"), "m", "b", "x1", "x2", "y1", "y2", *[F.col(c).alias(f"{c}1") for c in own], F.explode(cells).alias("c"))
    left = left.select("*", "c.cx", "c.cy").drop("c")
    right = flat.where(F.col("cam") == other).select("frame", F.col("pnr").alias("p2"), F.col("fx").alias("x"), F.col("fy").alias("y"), *[F.col(c).alias(f"{c}2") for c in own], F.explode(homes).alias("c"))
    right = right.select("*", "c.cx", "c.cy").drop("c")
    dist = F.abs((F.col("y") - F.col("m") * F.col("x") - F.col("b")) / F.sqrt(F.col("m") * F.col("m") + 1))
    pairs = left.join(right.hint("merge"), ["frame", "cx", "cy"]).withColumn("dist", dist)
    near = (F.col("x") > F.col("x1") - eps) & (F.col("x") < F.col("x2") + eps) & (F.col("y") > F.col("y1") - eps) & (F.col("y") < F.col("y2") + eps) & (F.col("dist") < eps)
    like = {c: _ratio(f"{c}1", f"{c}2") for c in own}
    good = reduce(lambda u, v: u & v, [like[c] >= q[c] for c in ("n", "nx", "ny")]) & (like["sumg"] > q["sumg"])
    corr = (4 * like["sumg"] + 2 * like["n"] + like["nx"] + like["ny"]) * (F.col("sumg1") + F.col("sumg2"))
    out = pairs.where(near & good).select("frame", "p1", "p2", corr.alias("corr"), "dist", "x")
    if most:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("frame", "p1").orderBy("x", "p2"))).where(F.col("_r") <= most)
    return out.select("frame", "p1", "p2", "corr", "dist")


def edges(flat: DataFrame, rig: list[Camera], volume: Volume, eps: float, **more) -> dict[tuple[int, int], DataFrame]:
    """Candidate edges of all pairs of cameras; targets are projected and corrected once, not for each pair again."""
    from skein.shared import kept

    flat = kept(flat)
    return {(a, b): candidates(flat, rig, a, b, volume, eps, **more) for a, b in itertools.combinations(range(len(rig)), 2)}


def cliques(found: dict[tuple[int, int], DataFrame], cams: tuple[int, ...], least: float) -> DataFrame:
    """(frame, p: array of as many as cams, corr): targets that are candidates of each other pairwise; score = sum of corr / sum of dist above least."""

    def edge(a: int, b: int) -> DataFrame:
        return found[a, b].select("frame", F.col("p1").alias(f"p{a}"), F.col("p2").alias(f"p{b}"), F.col("corr").alias(f"c{a}_{b}"), F.col("dist").alias(f"d{a}_{b}"))

    out, pairs = None, sorted(itertools.combinations(cams, 2), key=lambda p: (p[1], p[0]))
    for a, b in pairs:
        out = edge(a, b) if out is None else out.join(edge(a, b), ["frame", *[f"p{c}" for c in (a, b) if f"p{c}" in out.columns]])
    add = lambda kind: reduce(lambda u, v: u + v, [F.col(f"{kind}{a}_{b}") for a, b in pairs])
    return out.select("frame", F.array(*[F.col(f"p{c}") for c in cams]).alias("p"), (add("c") / F.greatest(add("d"), F.lit(1e-12))).alias("corr")).where(F.col("corr") > least)


def _spread(found: DataFrame, cams: tuple[int, ...], n: int) -> DataFrame:
    """p of all n cameras, -2 for those that are not in cams."""
    return found.select("frame", F.array(*[F.get("p", F.lit(cams.index(c))) if c in cams else F.lit(-2).cast("long") for c in range(n)]).alias("p"), "corr")


def take_best(found: DataFrame) -> DataFrame:
    """Of cliques (frame, p, corr), those that a pass by falling corr (ties by p) takes if none of their targets is used yet. A frame is one task."""

    def run(rows):
        rows = rows.assign(_k=[tuple(p) for p in rows["p"]]).sort_values(["corr", "_k"], ascending=[False, True])
        used, kept = set(), []
        for key in rows["_k"]:
            ends = [(c, t) for c, t in enumerate(key) if t >= 0]
            free = not any(e in used for e in ends)
            kept.append(free)
            if free:
                used.update(ends)
        return rows[np.array(kept, bool)][["frame", "p", "corr"]]

    return found.groupBy("frame").applyInPandas(run, "frame long, p array<long>, corr double")


def _used(found: DataFrame) -> DataFrame:
    return found.select("frame", F.posexplode("p").alias("cam", "pnr")).where("pnr >= 0")


def _free(edge: DataFrame, used: DataFrame, a: int, b: int) -> DataFrame:
    for cam, p in ((a, "p1"), (b, "p2")):
        edge = edge.join(used.where(F.col("cam") == cam).select("frame", F.col("pnr").alias(p)), ["frame", p], "left_anti")
    return edge


def pairs_allowed(cams: int, all_cams: bool = False, pair_flag: bool = False) -> bool:
    """Whether matches of two cameras count: with two cameras, or on request, never where all cameras must agree."""
    return not all_cams and (cams == 2 or pair_flag)


def cascade(found: dict[tuple[int, int], DataFrame], n: int, least: float, all_cams: bool = False, pair_flag: bool = False) -> DataFrame:
    """Matches (frame, n_cams, p, corr) of four, then three, then two cameras; each class chooses by falling score among targets that no class before has used.

    Pairs must be the only candidate of their first target, and count only if pairs_allowed.
    """
    from skein.shared import kept

    found = {k: kept(v) for k, v in found.items()}
    out = None
    for size in (4, 3, 2):
        if size > n or (size < n and all_cams) or (size == 4 and n != 4) or (size == 2 and not pairs_allowed(n, all_cams, pair_flag)):
            continue
        pool = found
        if size == 2:
            alone = lambda e: e.withColumn("_n", F.count("*").over(Window.partitionBy("frame", "p1"))).where("_n = 1").drop("_n")
            pool = {k: alone(e) for k, e in found.items()}
        if out is not None:
            used = kept(_used(out))
            pool = {(a, b): _free(e, used, a, b) for (a, b), e in pool.items()}
        each = [_spread(cliques(pool, cams, least), cams, n) for cams in itertools.combinations(range(n), size)]
        best = kept(take_best(reduce(DataFrame.union, each)).select("frame", F.lit(size).alias("n_cams"), "p", "corr"))
        out = best if out is None else out.union(best)
    return out


def numbered(matches: DataFrame) -> DataFrame:
    """Matches with id: their number in the frame, larger classes first, then by falling score."""
    return matches.withColumn("id", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("n_cams").desc(), F.col("corr").desc(), "p")).cast("long") - 1)


def match_points(matches: DataFrame, flat: DataFrame, rig: list[Camera], method: str = "lsq") -> DataFrame:
    """3D points (frame, id, x, y, z, rcm, cams, cam_ids) of numbered matches."""
    seen = matches.select("frame", "id", F.posexplode("p").alias("cam", "pnr")).withColumn("cam", F.col("cam").cast("long")).where("pnr >= 0")
    found = rays(seen.join(flat.select("frame", "cam", "pnr", "fx", "fy"), ["frame", "cam", "pnr"]), rig)
    ids = matches.select("frame", "id", F.transform("p", lambda t: F.when(t >= 0, t).otherwise(F.lit(-1).cast("long"))).alias("cam_ids"))
    return triangulate(found, method).join(ids, ["frame", "id"])


def unified(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points (frame, id, x, y, z, cam_ids) with xy: an array of a struct (x, y) a camera, null where the camera has no such target."""
    seen = points.select("frame", "id", F.posexplode("cam_ids").alias("cam", "pnr")).withColumn("cam", F.col("cam").cast("long"))
    at = seen.join(targets.select("frame", "cam", "pnr", F.struct("x", "y").alias("xy")), ["frame", "cam", "pnr"], "left")
    lists = at.groupBy("frame", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cam", "xy"))), lambda c: c["xy"]).alias("xy"))
    return points.join(lists, ["frame", "id"], "left")


def search_box(points: DataFrame, rig: list[Camera], half: tuple[float, float, float]) -> DataFrame:
    """(frame, id, cam, u, v, left, right, up, down): each point's image and how far the images of the corners of the box around it reach, inside the sensor."""

    def run(c, r):
        at = _xyz(r)
        u, v = optics.pixel(Arrays, c, at)
        corners = [optics.pixel(Arrays, c, [x + sign * h for x, sign, h in zip(at, signs, half)]) for signs in itertools.product((-1, 1), repeat=3)]
        # a corner that is nowhere is no lowest and is the highest, as in Spark's order
        low, high = ([reduce(f, [k[n] for k in corners]) for n in (0, 1)] for f in (np.fmin, np.maximum))
        return [u, v, u - np.maximum(low[0], 0.0), np.fmin(high[0], float(c.imx)) - u, v - np.maximum(low[1], 0.0), np.fmin(high[1], float(c.imy)) - v]

    rows = points.select("frame", "id", *XYZ, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(_checked(rig)) - 1).cast("long"))).alias("cam"))
    names = ("u", "v", "left", "right", "up", "down")
    return over_cameras(rows, rig, run, ", ".join(f"{k} double" for k in names)).select("frame", "id", "cam", *names)


def pixel_candidates(boxes: DataFrame, targets: DataFrame, matched: bool = True, most: int = 4, cell: float = 8.0) -> DataFrame:
    """(frame, id, cam, pnr, tnr, d, rank): the nearest targets strictly inside each box around (u, v); those that are matched (tnr >= 0), or else those that are not."""
    from skein.shared import kept

    same, like = same_boxes(kept(boxes))
    found = _place_candidates(like, kept(targets), matched, most, cell)
    return same.join(found.hint("merge"), ["frame", "cam", "at"]).select("frame", "id", "cam", "pnr", "tnr", "d", "rank")


BOX = ("u", "v", "left", "right", "up", "down")


def same_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which box is like which (frame, cam, id, at: the least id of an equal box), and one box (frame, cam, at, u, v, left, right, up, down) of each kind."""
    like = boxes.groupBy("frame", "cam", *BOX).agg(F.min("id").alias("at"))
    return boxes.join(like.hint("merge"), ["frame", "cam", *BOX]).select("frame", "cam", "id", "at"), like


def _place_candidates(boxes: DataFrame, targets: DataFrame, matched: bool, most: int, cell: float) -> DataFrame:
    """(frame, at, cam, pnr, tnr, d, rank) of different boxes. Of targets at one place the first `most` by number can matter, so places are paired, not copies."""
    at = lambda v: F.floor(v / cell).cast("long")
    box = boxes.withColumns({"x0": F.col("u") - F.col("left"), "x1": F.col("u") + F.col("right"), "y0": F.col("v") - F.col("up"), "y1": F.col("v") + F.col("down")}).where("x1 >= x0 AND y1 >= y0")
    cells = F.flatten(F.transform(F.sequence(at(F.col("x0")), at(F.col("x1"))), lambda cx: F.transform(F.sequence(at(F.col("y0")), at(F.col("y1"))), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    left = box.select("frame", "at", "cam", "u", "v", "x0", "x1", "y0", "y1", F.explode(cells).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    free = F.coalesce("tnr", F.lit(-1)) < 0
    here = F.row_number().over(Window.partitionBy("frame", "cam", "x", "y").orderBy("pnr"))
    right = targets.where(~free if matched else free).select("frame", "cam", "pnr", "x", "y", "tnr").withColumn("_n", here).where(F.col("_n") <= most)
    place = right.groupBy("frame", "cam", "x", "y").agg(F.sort_array(F.collect_list(F.struct("pnr", "tnr"))).alias("who"))  # `most` at most
    place = place.withColumns({"cx": at(F.col("x")), "cy": at(F.col("y")), "first": F.col("who")[0]["pnr"]})
    near = left.join(place.hint("merge"), ["frame", "cam", "cx", "cy"]).where("x > x0 AND x < x1 AND y > y0 AND y < y1")
    d = F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))
    by = Window.partitionBy("frame", "at", "cam")
    # a place beyond the first `most` by (d, first number) has as many targets before it
    near = near.select("frame", "at", "cam", d.alias("d"), "first").withColumn("_p", F.row_number().over(by.orderBy("d", "first"))).where(F.col("_p") <= most)
    each = near.join(place.select("frame", "cam", "first", "who").hint("merge"), ["frame", "cam", "first"]).select("frame", "at", "cam", "d", F.inline("who"))
    return each.withColumn("rank", F.row_number().over(by.orderBy("d", "pnr")).cast("long")).where(F.col("rank") <= most).select("frame", "at", "cam", "pnr", "tnr", "d", "rank")


def candidate_votes(boxes: DataFrame, targets: DataFrame, least: int = 2) -> DataFrame:
    """votes() of pixel_candidates: equal boxes of a point in all cameras have equal votes, so these are counted once a kind and then told to every point."""
    from skein.shared import kept

    same, like = same_boxes(kept(boxes))
    kind = same.groupBy("frame", "id").agg(F.sort_array(F.collect_list(F.struct("cam", "at"))).alias("kind"))  # as many as cameras
    first = kind.groupBy("frame", "kind").agg(F.min("id").alias("of"))
    found = _place_candidates(like, kept(targets), True, 4, 8.0)
    one = first.select("frame", F.col("of").alias("id"), F.inline("kind")).join(found.hint("merge"), ["frame", "cam", "at"])
    told = votes(one, least).withColumnRenamed("id", "of")
    return kind.join(first.hint("merge"), ["frame", "kind"]).select("frame", "id", "of").join(told.hint("merge"), ["frame", "of"]).select("frame", "id", "tnr", "votes", "rank")


def votes(found: DataFrame, least: int = 2) -> DataFrame:
    """(frame, id, tnr, votes, rank): particles that several cameras name, most named first, then nearest."""
    by = found.groupBy("frame", "id", "tnr").agg(F.count_distinct("cam").alias("votes"), F.min("d").alias("d")).where(F.col("votes") >= least)
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("frame", "id").orderBy(F.col("votes").desc(), "d", "tnr")).cast("long")).select("frame", "id", "tnr", "votes", "rank")


def volume_bounds(spark, rig: list[Camera], volume: Volume) -> tuple[float, float, float, float, float, float]:
    """(x high, x low, y high, y low, z high, z low) of the rays of all sensors' corners between the volume's lowest and highest z."""
    low, high = min(volume.z_min), max(volume.z_max)
    at = []
    for c in rig:
        for px, py in itertools.product((0.0, float(c.imx)), (0.0, float(c.imy))):
            x, y = optics.to_metric(Arrays, c, px, py)
            vertex, direction = optics.ray(Arrays, c, *optics.undistort(Arrays, c, x - c.xh, y - c.yh))
            at += [optics.at_height(Arrays, vertex, direction, z)[:2] for z in (low, high)]
    xs, ys = np.array(at, float).T
    return float(np.nanmax(xs)), float(np.nanmin(xs)), float(np.nanmax(ys)), float(np.nanmin(ys)), high, low


def shift_table(spark, c: Camera, volume: Volume, cam: int = 0, width: float = 2.0) -> DataFrame:
    """(cam, ir, iz, f): radial shift on a grid of radius and height over the glass, `width` apart, of all the camera may see of the volume."""
    low, high = min(volume.z_min), max(volume.z_max)
    low, high = low - low % width, high + width - high % width
    reach, bottom, top, up = 0.0, low, high, 0.0
    for px, py in itertools.product((0.0, float(c.imx)), (0.0, float(c.imy))):
        x, y = optics.to_metric(Arrays, c, px, py)
        vertex, direction = optics.ray(Arrays, c, *optics.undistort(Arrays, c, x - c.xh, y - c.yh))
        for z in (low, high):
            frame = optics.glass_frame(Arrays, c, optics.at_height(Arrays, vertex, direction, z))
            reach, bottom, top, up = max(reach, float(frame["radius"])), min(bottom, float(frame["height"])), max(top, float(frame["height"])), float(frame["camera"])
    nr, nz = int((reach + width - reach % width) / width + 1), int((top - bottom) / width + 1)
    cells = spark.range(nr * nz).select(F.expr(f"id div {nz}").alias("ir"), (F.col("id") % nz).alias("iz"))
    N = Columns()
    f = optics.radial_shift(N, N.let(F.col("ir") * F.lit(width)), N.let(F.lit(bottom) + F.col("iz") * F.lit(width)), F.lit(up), F.lit(float(c.n1)), [F.lit(float(c.n2))], F.lit(float(c.n3)), [F.lit(float(c.d))])
    return N.run(cells, cam=F.lit(cam).cast("long"), f=f).select("cam", "ir", "iz", "f").withColumn("bottom", F.lit(bottom)).withColumn("width", F.lit(width))


def shift_lookup(points: DataFrame, table: DataFrame, radius: str = "radius", height: str = "height") -> DataFrame:
    """Points (cam, radius, height) with f: bilinear between the four grid points around; 0 outside of the grid. The grid is a few thousand rows a camera."""
    shape = F.broadcast(table.groupBy("cam").agg(F.max("bottom").alias("_bottom"), F.max("width").alias("_w")))  # a row a camera
    r, z = F.col(radius) / F.col("_w"), (F.col(height) - F.col("_bottom")) / F.col("_w")
    rows = points.join(shape, "cam").withColumns({"_ir": F.floor(r).cast("long"), "_iz": F.floor(z).cast("long"), "_sr": r - F.floor(r), "_sz": z - F.floor(z)})
    for dr, dz in itertools.product((0, 1), repeat=2):
        part = F.broadcast(table.select("cam", (F.col("ir") - dr).alias("_ir"), (F.col("iz") - dz).alias("_iz"), F.col("f").alias(f"_f{dr}{dz}")))
        rows = rows.join(part, ["cam", "_ir", "_iz"], "left")
    sr, sz = F.col("_sr"), F.col("_sz")
    f = F.col("_f00") * (1 - sr) * (1 - sz) + F.col("_f01") * (1 - sr) * sz + F.col("_f10") * sr * (1 - sz) + F.col("_f11") * sr * sz
    return rows.withColumn("f", F.coalesce(f, F.lit(0.0))).drop(*[c for c in rows.columns if c.startswith("_")])


def dumbbell(points: DataFrame, length: float, weight: float) -> DataFrame:
    """One row (points, miss, length_error, score) of dumbbell ends (frame, end 0 or 1, x, y, z, rcm): mean ray miss and mean relative error of the length."""
    ends = points.groupBy("frame").agg(F.count("*").alias("n"), F.sum("rcm").alias("miss"), *[(F.max(F.when(F.col("end") == 0, F.col(a))) - F.max(F.when(F.col("end") == 1, F.col(a)))).alias(a) for a in XYZ])
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    error = F.when(d > length, 1 - F.lit(length) / d).otherwise(1 - d / F.lit(length))
    sums = ends.agg(F.sum("n").alias("points"), F.sum("miss").alias("m"), F.sum(error).alias("e"))
    miss, err = F.col("m") / F.col("points"), F.col("e") / (F.col("points") / 2)
    return sums.select("points", miss.alias("miss"), err.alias("length_error"), (miss + weight * err).alias("score"))


def standard_rig(n: int = 4, centre: tuple = (0.0, 0.0, 0.0), distance: float = 300.0, spread: float = 80.0, focal: float = 60.0, **more) -> list[Camera]:
    """n cameras on a ring of radius spread, distance above the centre, looking at it."""
    out = []
    for k in range(n):
        angle = 2 * np.pi * (k + 0.5) / n
        at = (centre[0] + spread * np.cos(angle), centre[1] + spread * np.sin(angle), centre[2] + distance)
        m = optics.look_at(Arrays, at, centre, (0.0, 1.0, 0.0))
        omega, phi, kappa = (float(a) for a in optics.angles(Arrays, m))
        out.append(Camera(x0=float(at[0]), y0=float(at[1]), z0=float(at[2]), omega=omega, phi=phi, kappa=kappa, cc=focal, **more))
    return out
