"""Queries on cameras, rays, triangulation and matching, each beside its DuckDB twin. Where the twin is the truth itself, the query goes there and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import optics, vectors
from skein.functions.numeric import Arrays, Columns
from skein.functions.optics import Camera, Volume
from skein.operators import stereo
from skein.plans.catalogue import query
from skein.sources import binding

XYZ = ("x", "y", "z")
_T = f"t AS ({binding.TRUTH_SQL})"
_POINTS = f"WITH {_T} SELECT frame, pid AS id, x, y, z FROM t"
VOLUME = Volume((-40.0, 60.0), (-40.0, -40.0), (60.0, 60.0))
#: Cameras above a tank: lens, glass and water.
LENS = {"k1": 2e-4, "k2": 1e-6, "k3": 0.0, "p1": 2e-5, "p2": 3e-5, "scx": 1.002, "she": 0.003, "xh": 0.05, "yh": -0.04}
SOFT = LENS | {"k1": 2e-5, "k2": 1e-8}
WATER = {"n1": 1.0, "n2": 1.46, "n3": 1.33, "d": 5.0, "gx": 0.0, "gy": 0.0, "gz": 90.0}
#: Parallel cameras that look down, without lens or glass: their geometry is a line of SQL.
PLAIN = [Camera(x0=float(x), y0=float(y), z0=320.0, cc=64.0, imx=4096, imy=4096, pix_x=0.015625, pix_y=0.015625) for x, y in ((-30, -10), (50, -14), (44, 32), (-26, 30))]


def rig(n: int = 4, medium: dict | None = None) -> list[Camera]:
    return stereo.standard_rig(n, (10.0, 10.0, 10.0), 300.0, 80.0, 60.0, imx=4096, imy=4096, pix_x=0.012, pix_y=0.012, **LENS, **(WATER if medium is None else medium))


def _points(spark, sf_dir) -> DataFrame:
    return binding.truth(spark, sf_dir).withColumnRenamed("pid", "id")


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


# --- vectors and rotations ---------------------------------------------------------------------------------------------------------------

_V = "v AS (SELECT frame, pid AS id, x AS a0, y AS a1, z AS a2, (pid % 5 - 2) / 2e0 AS b0, (pid % 7 - 3) / 4e0 AS b1, (pid % 3 - 1) / 2e0 AS b2 FROM t)"


@query("vector_algebra", f"""WITH {_T}, {_V} SELECT frame, id, a0 + b0 AS s0, a1 + b1 AS s1, a2 + b2 AS s2, a0 - b0 AS d0, a1 - b1 AS d1, a2 - b2 AS d2, a0 * 3 AS m0, a1 * 3 AS m1, a2 * 3 AS m2,
  a1 * b2 - a2 * b1 AS c0, a2 * b0 - a0 * b2 AS c1, a0 * b1 - a1 * b0 AS c2, a0 * b0 + a1 * b1 + a2 * b2 AS dot, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS norm, sqrt((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1) + (a2 - b2) * (a2 - b2)) AS distance,
  CASE WHEN b0 * b0 + b1 * b1 + b2 * b2 > 0 THEN round(b0 / sqrt(b0 * b0 + b1 * b1 + b2 * b2), 6) ELSE 0e0 END AS u0, a0 = b0 AND a1 = b1 AND a2 = b2 AS same, abs(a0 - b0) < 5 AND abs(a1 - b1) < 5 AND abs(a2 - b2) < 5 AS near, a0 > 2 AND a0 < 9 AND a1 > 0 AND a1 < 15 AND a2 > 5 AND a2 < 20 AS inside FROM v""")
def vector_algebra(spark, sf_dir):
    n = F.col("id")
    rows = _points(spark, sf_dir).select("frame", "id", F.col("x").alias("a0"), F.col("y").alias("a1"), F.col("z").alias("a2"), ((n % 5 - 2) / F.lit(2.0)).alias("b0"), ((n % 7 - 3) / F.lit(4.0)).alias("b1"), ((n % 3 - 1) / F.lit(2.0)).alias("b2"))
    a, b = [tuple(F.col(f"{k}{i}") for i in range(3)) for k in "ab"]
    N = Columns
    out = {"s": vectors.add(a, b), "d": vectors.subtract(a, b), "m": vectors.scale(a, 3), "c": vectors.cross(a, b)}
    cols = [c.alias(f"{k}{i}") for k, v in out.items() for i, c in enumerate(v)]
    return rows.select("frame", "id", *cols, vectors.dot(a, b).alias("dot"), vectors.norm(N, a).alias("norm"), vectors.distance(N, a, b).alias("distance"), F.round(vectors.unit(N, b)[0], 6).alias("u0"), vectors.equal(a, b).alias("same"), vectors.close(N, a, b, 5.0).alias("near"), vectors.inside(a, ((2, 9), (0, 15), (5, 20))).alias("inside"))


_ANGLES = "a AS (SELECT frame, pid AS id, (pid % 11 - 5) / 8e0 AS omega, (pid % 9 - 4) / 8e0 AS phi, (pid % 13 - 6) / 4e0 AS kappa FROM t)"


def _angled(spark, sf_dir):
    n = F.col("id")
    return _points(spark, sf_dir).select("frame", "id", ((n % 11 - 5) / F.lit(8.0)).alias("omega"), ((n % 9 - 4) / F.lit(8.0)).alias("phi"), ((n % 13 - 6) / F.lit(4.0)).alias("kappa"))


@query("rotation_angles", f"WITH {_T}, {_ANGLES} SELECT * FROM a")
def rotation_angles(spark, sf_dir):
    N = Columns()
    m = [[N.let(x) for x in row] for row in optics.rotation(N, F.col("omega"), F.col("phi"), F.col("kappa"))]
    omega, phi, kappa = optics.angles(N, m)
    return _rounded(N.run(_angled(spark, sf_dir), omega=omega, phi=phi, kappa=kappa), "omega", "phi", "kappa")


@query("rotation_matrix", f"""WITH {_T}, {_ANGLES} SELECT frame, id, round(cos(phi) * cos(kappa), 6) + 0e0 AS m00, round(sin(phi), 6) + 0e0 AS m02, round(-sin(omega) * cos(phi), 6) + 0e0 AS m12, round(cos(omega) * cos(kappa) - sin(omega) * sin(phi) * sin(kappa), 6) + 0e0 AS m11,
  round(sin(omega) * sin(kappa) - cos(omega) * sin(phi) * cos(kappa), 6) + 0e0 AS m20, round(cos(omega) * cos(phi), 6) + 0e0 AS m22 FROM a""")
def rotation_matrix(spark, sf_dir):
    m = optics.rotation(Columns, F.col("omega"), F.col("phi"), F.col("kappa"))
    return _angled(spark, sf_dir).select("frame", "id", *[(F.round(m[i][j], 6) + 0.0).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 2), (1, 2), (1, 1), (2, 0), (2, 2))])


@query("rotation_vectors", f"WITH {_T}, {_ANGLES} SELECT frame, id, omega AS rx, phi AS ry, kappa AS rz FROM a")
def rotation_vectors(spark, sf_dir):
    N = Columns()
    m = [[N.let(x) for x in row] for row in optics.from_rotation_vector(N, (F.col("omega"), F.col("phi"), F.col("kappa")))]
    r = optics.rotation_vector(N, m)
    return _rounded(N.run(_angled(spark, sf_dir).select("frame", "id", "omega", "phi", "kappa"), rx=r[0], ry=r[1], rz=r[2]).drop("omega", "phi", "kappa"), "rx", "ry", "rz")


@query("look_at", f"""WITH {_T}, p AS (SELECT frame, pid AS id, x + 1 AS bx, y - 3 AS by_, z + 40 AS bz FROM t), n AS (SELECT *, sqrt(bx * bx + by_ * by_ + bz * bz) AS n FROM p) SELECT frame, id, round(bx / n, 6) + 0e0 AS zx, round(by_ / n, 6) + 0e0 AS zy, round(bz / n, 6) + 0e0 AS zz, 0e0 AS xy, 1e0 AS det FROM n""")
def look_at(spark, sf_dir):
    """Cameras at every point that look at (-1, 3, -40): their z axes, the dot product of x and z axes, and the determinant."""
    N = Columns()
    m = [[N.let(v) for v in row] for row in optics.look_at(N, [F.col(a) for a in XYZ], (-1.0, 3.0, -40.0), (0.0, 1.0, 0.0))]
    det = sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))
    out = N.run(_points(spark, sf_dir), zx=m[0][2], zy=m[1][2], zz=m[2][2], xy=m[0][0] * m[0][2] + m[1][0] * m[1][2] + m[2][0] * m[2][2], det=det)
    return _rounded(out.drop(*XYZ), "zx", "zy", "zz", "xy", "det")


# --- lens and glass ------------------------------------------------------------------------------------------------------------------------


def _seen_by(rows: DataFrame, c: Camera, run, *names: str) -> DataFrame:
    """Rows with the named results of run(camera, rows) for one camera: iterated formulas run over arrays, as rounds of columns are interpreted row by row."""
    return stereo.over_cameras(rows.withColumn("cam", F.lit(0).cast("long")), [c], run, ", ".join(f"{k} double" for k in names)).drop("cam")


@query("lens_roundtrip", f"WITH {_T} SELECT frame, pid AS id, x AS ax, y AS ay, x AS ex, y AS ey, x AS fx, y AS fy FROM t")
def lens_roundtrip(spark, sf_dir):
    """Distorted and corrected again by both inverses, and flat to distorted and back."""

    def run(c, r):
        x, y = r["x"].to_numpy(), r["y"].to_numpy()
        u, v = optics.distort(Arrays, c, x, y)
        return [*optics.undistort(Arrays, c, u, v, 60), *optics.undistort_exact(Arrays, c, u, v), *optics.to_flat(Arrays, c, *optics.from_flat(Arrays, c, x, y))]

    names = ("ax", "ay", "ex", "ey", "fx", "fy")
    return _rounded(_seen_by(_points(spark, sf_dir), Camera(**SOFT), run, *names).drop(*XYZ), *names)


@query("brown_correct", f"WITH {_T} SELECT frame, pid, x AS cx, y AS cy FROM t")
def brown_correct(spark, sf_dir):
    def run(c, r):
        return optics.undistort(Arrays, c, *optics.distort(Arrays, c, r["x"].to_numpy(), r["y"].to_numpy()), 60)

    return _rounded(_seen_by(binding.truth(spark, sf_dir), Camera(**SOFT), run, "cx", "cy").drop(*XYZ), "cx", "cy")


@query("interlaced_pixels", f"WITH {_T} SELECT frame, pid AS id, x AS x1, y AS y1, x AS x2, y AS y2 FROM t")
def interlaced_pixels(spark, sf_dir):
    """Pixels of both interlaced kinds to the sensor and back."""
    c = PLAIN[0]
    rows = _points(spark, sf_dir)
    back = [optics.to_pixel(Columns, c, *optics.to_metric(Columns, c, F.col("x"), F.col("y"), mode), mode) for mode in (1, 2)]
    return rows.select("frame", "id", *[v.alias(f"{a}{k + 1}") for k, p in enumerate(back) for a, v in zip("xy", p)])


@query("distortion_fold", f"""WITH {_T}, c AS (SELECT DISTINCT pid % 50 AS id, -(pid % 50) / 1024e0 AS k1 FROM t), r AS (SELECT id, k1, 6e0 * (n / 199e0) AS r FROM c, unnest(range(0, 200)) AS u(n))
SELECT id, round(min(r) FILTER (WHERE 1 + 3 * k1 * r * r <= 0), 6) AS fold FROM r GROUP BY id HAVING count(*) FILTER (WHERE 1 + 3 * k1 * r * r <= 0) > 0""")
def distortion_fold(spark, sf_dir):
    rows = _points(spark, sf_dir).select((F.col("id") % 50).alias("id")).distinct().withColumn("k1", -F.col("id") / F.lit(1024.0))
    c = Camera(k1=F.col("k1"))
    return rows.select("id", F.round(optics.fold_radius(Columns, c, F.lit(6.0)), 6).alias("fold")).where(~F.isnan("fold"))


@query("flat_project", f"WITH {_T}, c(cam, x0, y0) AS (VALUES (0, -30e0, -10e0), (1, 50e0, -14e0), (2, 44e0, 32e0), (3, -26e0, 30e0)) SELECT frame, pid AS id, CAST(cam AS BIGINT) AS cam, round(64 * (x - x0) / (320 - z), 6) + 0e0 AS u, round(64 * (y - y0) / (320 - z), 6) + 0e0 AS v FROM t, c")
def flat_project(spark, sf_dir):
    return _rounded(stereo.project(_points(spark, sf_dir), PLAIN, flat=True).drop(*XYZ), "u", "v")


@query("pixel_project", f"WITH {_T}, c(cam, x0, y0) AS (VALUES (0, -30e0, -10e0), (1, 50e0, -14e0), (2, 44e0, 32e0), (3, -26e0, 30e0)) SELECT frame, pid AS id, CAST(cam AS BIGINT) AS cam, round(64 * (x - x0) / (320 - z) * 64 + 2048, 5) AS u, round(2048 - 64 * (y - y0) / (320 - z) * 64, 5) AS v FROM t, c")
def pixel_project(spark, sf_dir):
    return stereo.project(_points(spark, sf_dir), PLAIN).drop(*XYZ).withColumns({c: F.round(c, 5) for c in "uv"})


def _fine(points: DataFrame, cameras: list[Camera], flat: bool = True) -> DataFrame:
    """Images with the refraction iterated to the end, so that the way back meets the start."""
    return stereo.project(points, cameras, flat=flat, rounds=200, limit=1e-10)


@query("ray_roundtrip", f"WITH {_T}, c AS (SELECT unnest([0, 1, 2, 3]) AS cam) SELECT frame, pid AS id, CAST(cam AS BIGINT) AS cam, x, y, z, 1e0 AS length FROM t, c")
def ray_roundtrip(spark, sf_dir):
    """Through water, glass and back along the refracted ray to the point's height."""
    seen = stereo.rays(_fine(_points(spark, sf_dir), rig()), rig(), "u", "v")
    t = (F.col("z") - F.col("vz")) / F.col("dz")
    out = seen.select("frame", "id", "cam", (F.col("vx") + t * F.col("dx")).alias("x"), (F.col("vy") + t * F.col("dy")).alias("y"), "z", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).alias("length"))
    return _rounded(out, "x", "y", "length")


@query("sight_rays", f"WITH {_T} SELECT frame, pid AS id, x, y, z FROM t")
def sight_rays(spark, sf_dir):
    """From pixels, lens included."""
    def run(c, r):
        vertex, direction = optics.sight(Arrays, c, r["u"].to_numpy(), r["v"].to_numpy())
        return optics.at_height(Arrays, vertex, direction, r["z"].to_numpy())[:2]

    c = rig()[0]
    rows = _fine(_points(spark, sf_dir), [c], flat=False).drop("x", "y", "cam")
    return _rounded(_seen_by(rows, c, run, "x", "y").select("frame", "id", *XYZ), "x", "y")


@query("glass_frame", _POINTS)
def glass_frame(spark, sf_dir):
    """Into the frame of a slanted glass and back."""
    c, N = Camera(x0=20.0, y0=-30.0, z0=300.0, gx=3.0, gy=-4.0, gz=80.0, d=5.0), Columns()
    frame = optics.glass_frame(N, c, [F.col(a) for a in XYZ])
    back = optics.from_glass_frame(N, frame, frame["radius"], frame["height"])
    return _rounded(N.run(_points(spark, sf_dir), bx=back[0], by_=back[1], bz=back[2]).select("frame", "id", *[F.col(b).alias(a) for a, b in zip(XYZ, ("bx", "by_", "bz"))]), *XYZ)


@query("layer_shift", f"WITH {_T} SELECT frame, pid AS id, true AS meets FROM t")
def layer_shift(spark, sf_dir):
    """Two layers of glass: the shifted point's straight ray, refracted by Snell's law at each face, passes through the point."""
    def run(c, r):
        x, y, z = (r[a].to_numpy() for a in XYZ)
        sx, sy = optics.shifted(Arrays, c, [x, y, z - 60], [1.5, 1.4], [4.0, 3.0], 400, 1e-9)
        beta = np.arctan(np.hypot(sx - 5, sy - 5) / (300 - (z - 60)))
        sine = lambda n: np.arcsin(np.sin(beta) / n)
        reach = (300 - 4.0) * np.tan(beta) + 4.0 * np.tan(sine(1.5)) + 3.0 * np.tan(sine(1.4)) - (z - 60 + 3.0) * np.tan(sine(1.33))
        return [np.abs(reach - np.hypot(x - 5, y - 5))]

    rows = _seen_by(_points(spark, sf_dir), Camera(x0=5.0, y0=5.0, z0=300.0, n1=1.0, n3=1.33), run, "off")
    return rows.select("frame", "id", (F.col("off") < 1e-6).alias("meets"))


@query("lut_bilinear", f"""WITH {_T}, p AS (SELECT frame, pid AS id, pid % 4 AS cam, abs(x) AS radius, z AS height FROM t), g AS (SELECT *, floor(radius / 2) AS ir, floor((height + 30) / 2) AS iz, radius / 2 - floor(radius / 2) AS sr, (height + 30) / 2 - floor((height + 30) / 2) AS sz FROM p)
SELECT frame, id, cam, CASE WHEN ir + 1 > 8 OR iz < 0 OR iz + 1 > 30 THEN 0e0 ELSE (1 + ir / 64 + iz / 128 + cam / 4e0) * (1 - sr) * (1 - sz) + (1 + ir / 64 + (iz + 1) / 128 + cam / 4e0) * (1 - sr) * sz + (1 + (ir + 1) / 64 + iz / 128 + cam / 4e0) * sr * (1 - sz) + (1 + (ir + 1) / 64 + (iz + 1) / 128 + cam / 4e0) * sr * sz END AS f FROM g""")
def lut_bilinear(spark, sf_dir):
    lut = spark.range(4 * 9 * 31).select((F.col("id") % 4).alias("cam"), (F.expr("id div 4") % 9).alias("ir"), F.expr("id div 36").alias("iz")).select("*", (1 + F.col("ir") / F.lit(64.0) + F.col("iz") / F.lit(128.0) + F.col("cam") / F.lit(4.0)).alias("f"), F.lit(-30.0).alias("bottom"), F.lit(2.0).alias("width"))
    rows = _points(spark, sf_dir).select("frame", "id", (F.col("id") % 4).alias("cam"), F.abs("x").alias("radius"), F.col("z").alias("height"))
    return stereo.shift_lookup(rows, lut).select("frame", "id", "cam", "f")


@query("lut_project", f"WITH {_T} SELECT frame, pid AS id, true AS near FROM t")
def lut_project(spark, sf_dir):
    """The refraction table against the iteration it stands for, within a thousandth of a millimetre on the sensor."""
    c = rig()[0]
    points = _points(spark, sf_dir)
    N = Columns()
    frame = optics.glass_frame(N, c, [F.col(a) for a in XYZ])
    rows = N.run(points, radius=frame["radius"], height=frame["height"], cam=F.lit(0).cast("long"))
    rows = stereo.shift_lookup(rows, stereo.shift_table(spark, c, VOLUME))

    def run(c, r):
        at = [r[k].to_numpy() for k in XYZ]
        a, b = optics.flat(Arrays, c, at, factor=r["f"].to_numpy()), optics.flat(Arrays, c, at, rounds=200, limit=1e-10)
        return [np.abs(a[0] - b[0]), np.abs(a[1] - b[1])]

    near = (F.col("du") < 1e-3) & (F.col("dv") < 1e-3) & (F.col("f") > 0)
    return _seen_by(rows.select("frame", "id", *XYZ, "f"), c, run, "du", "dv").select("frame", "id", near.alias("near"))


@query("volume_bounds", f"WITH {_T}, h AS (SELECT min(z) AS z FROM t UNION ALL SELECT max(z) FROM t) SELECT round(max(x), 6) AS x_high, round(min(x), 6) AS x_low, round(max(y), 6) AS y_high, round(min(y), 6) AS y_low, max(z) AS z_high, min(z) AS z_low FROM (SELECT z, x0 + sx * 32e0 * (320 - z) / 64 AS x, y0 + sy * 32e0 * (320 - z) / 64 AS y FROM (VALUES (-30e0, -10e0), (50e0, -14e0), (44e0, 32e0), (-26e0, 30e0)) AS c(x0, y0), (VALUES (-1), (1)) AS a(sx), (VALUES (-1), (1)) AS b(sy), h)")
def volume_bounds(spark, sf_dir):
    """What the cameras see between the heights of the lowest and the highest point."""
    low, high = _points(spark, sf_dir).agg(F.min("z"), F.max("z")).first()
    found = stereo.volume_bounds(spark, PLAIN, Volume((-40.0, 60.0), (low, low), (high, high)))
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(k) for k, v in zip(("x_high", "x_low", "y_high", "y_low", "z_high", "z_low"), found)])


# --- rays to points ------------------------------------------------------------------------------------------------------------------------


def _triangulated(spark, sf_dir, method):
    seen = stereo.rays(_fine(_points(spark, sf_dir), rig()), rig(), "u", "v").select("frame", "id", "cam", *[f"{k}{a}" for k in "vd" for a in XYZ])
    return _rounded(stereo.triangulate(seen, method), *XYZ, "rcm")


_BACK = f"WITH {_T} SELECT frame, pid AS id, x, y, z, 0e0 AS rcm, 4 AS cams FROM t"


@query("triangulate_pairs", _BACK)
def triangulate_pairs(spark, sf_dir):
    return _triangulated(spark, sf_dir, "pairs")


@query("triangulate_weighted", _BACK)
def triangulate_weighted(spark, sf_dir):
    return _triangulated(spark, sf_dir, "weighted")


@query("triangulate_lsq", _BACK)
def triangulate_lsq(spark, sf_dir):
    return _triangulated(spark, sf_dir, "lsq")


@query("single_camera_points", f"WITH {_T} SELECT frame, pid AS pnr, round(-30 + (x + 30) * (320 - 10) / (320 - z) + 1.3e-9, 6) AS x, round(-10 + (y + 10) * (320 - 10) / (320 - z) + 1.3e-9, 6) AS y, 10e0 AS z FROM t")
def single_camera_points(spark, sf_dir):
    flat = stereo.project(_points(spark, sf_dir), PLAIN[:1], flat=True).select("frame", F.col("id").alias("pnr"), "cam", F.col("u").alias("fx"), F.col("v").alias("fy"))
    return stereo.single_camera(flat, PLAIN, VOLUME).withColumns({c: F.round(F.col(c) + 1.3e-9, 6) for c in "xyz"})


@query("mid_volume_points", f"WITH {_T} SELECT frame, pid AS id, round(-30 + (x + 30) * 310 / (320 - z) + 1.3e-9, 6) AS mx, round(-10 + (y + 10) * 310 / (320 - z) + 1.3e-9, 6) AS my, 10e0 AS mz FROM t")
def mid_volume_points(spark, sf_dir):
    N = Columns()
    rows = stereo.project(_points(spark, sf_dir), PLAIN[:1], flat=True)
    at = optics.mid_point(N, PLAIN[0], F.col("u"), F.col("v"), VOLUME)
    return N.run(rows, mx=F.round(at[0] + 1.3e-9, 6), my=F.round(at[1] + 1.3e-9, 6), mz=F.round(at[2], 6)).select("frame", "id", "mx", "my", "mz")


@query("dumbbell", f"""WITH {_T}, d AS (SELECT a.frame, a.pid, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS d, (a.pid % 8) / 16e0 AS m FROM t a JOIN t b ON b.frame = a.frame AND b.pid = a.pid + 1 WHERE a.pid % 2 = 1)
SELECT 2 * count(*) AS points, round(sum(m) * 2 / (2 * count(*)), 6) AS miss, round(avg(CASE WHEN d > 12 THEN 1 - 12 / d ELSE 1 - d / 12 END), 6) AS length_error, round(sum(m) * 2 / (2 * count(*)) + 0.5e0 * avg(CASE WHEN d > 12 THEN 1 - 12 / d ELSE 1 - d / 12 END), 6) AS score FROM d""")
def dumbbell(spark, sf_dir):
    n = F.col("id")
    rows = _points(spark, sf_dir).select((F.col("frame") * 10_000_000 + F.expr("(id + 1) div 2")).alias("frame"), ((n + 1) % 2).alias("end"), *XYZ, (((n - (n - 1) % 2) % 8) / F.lit(16.0)).alias("rcm"))
    whole = rows.join(rows.groupBy("frame").agg(F.count("*").alias("c")).where("c = 2").select("frame"), "frame")
    return stereo.dumbbell(whole, 12.0, 0.5).withColumns({c: F.round(c, 6) for c in ("miss", "length_error", "score")})


# --- matching ------------------------------------------------------------------------------------------------------------------------------

_CAM = "c(cam, x0, y0) AS (VALUES (0, -30e0, -10e0), (1, 50e0, -14e0), (2, 44e0, 32e0), (3, -26e0, 30e0))"
_FLAT = f"g AS MATERIALIZED (SELECT frame, cam, pid AS pnr, 64 * (x - x0) / (320 - z) AS fx, 64 * (y - y0) / (320 - z) AS fy, pid % 13 + 4 AS n, 3 AS nx, 3 AS ny, pid % 97 + 20 AS sumg, x0, y0 FROM t, c)"
EPS = 0.004


def _sized(seen: DataFrame) -> DataFrame:
    n = F.col("pnr")
    return seen.withColumns({"n": n % 13 + 4, "nx": F.lit(3), "ny": F.lit(3), "sumg": n % 97 + 20})


def _flat(spark, sf_dir) -> DataFrame:
    return _sized(stereo.project(_points(spark, sf_dir), PLAIN, flat=True).select("frame", "cam", F.col("id").alias("pnr"), F.col("u").alias("fx"), F.col("v").alias("fy")))


@query("epipolar_segments", f"WITH {_T}, {_CAM}, {_FLAT} SELECT frame, pnr, round(fx + 64 * (-30e0 - 44e0) / 360, 6) AS xa, round(fy + 64 * (-10e0 - 32e0) / 360, 6) AS ya, round(fx + 64 * (-30e0 - 44e0) / 260, 6) AS xb, round(fy + 64 * (-10e0 - 32e0) / 260, 6) AS yb FROM g WHERE cam = 0")
def epipolar_segments(spark, sf_dir):
    return _rounded(stereo.segments(_flat(spark, sf_dir), PLAIN, 0, 2, VOLUME).select("frame", "pnr", "xa", "ya", "xb", "yb"), "xa", "ya", "xb", "yb")


@query("epipolar_curve", f"WITH {_T}, {_CAM}, {_FLAT}, k AS (SELECT unnest(range(0, 5)) AS k) SELECT frame, pnr, k, -40 + k * 25e0 AS z, round((fx + 64 * (-30e0 - 50e0) / (360 - k * 25e0)) * 64 + 2048, 5) AS u, round(2048 - (fy + 64 * (-10e0 + 14e0) / (360 - k * 25e0)) * 64, 5) AS v FROM g, k WHERE cam = 0")
def epipolar_curve(spark, sf_dir):
    return stereo.epipolar_curve(_flat(spark, sf_dir), PLAIN, 0, 1, VOLUME, 5).withColumns({c: F.round(c, 5) for c in "uv"})


def _band(a: int, b: int) -> str:
    """Candidates of two parallel cameras, brute force."""
    return f"""s{a}{b} AS (SELECT l.*, l.fx + 64 * (l.x0 - r.x0) / 360 AS xa, l.fy + 64 * (l.y0 - r.y0) / 360 AS ya, l.fx + 64 * (l.x0 - r.x0) / 260 AS xb, l.fy + 64 * (l.y0 - r.y0) / 260 AS yb FROM g l, c r WHERE l.cam = {a} AND r.cam = {b}),
m{a}{b} AS (SELECT *, (yb - ya) / (xb - xa) AS m, ya - (yb - ya) / (xb - xa) * xa AS b FROM s{a}{b}),
e{a}{b} AS MATERIALIZED (SELECT l.frame, l.pnr AS p1, r.pnr AS p2, (4 * CAST(least(l.sumg, r.sumg) AS DOUBLE) / greatest(l.sumg, r.sumg) + 2 * CAST(least(l.n, r.n) AS DOUBLE) / greatest(l.n, r.n) + 2) * (l.sumg + r.sumg) AS corr, abs((r.fy - m * r.fx - b) / sqrt(m * m + 1)) AS dist
  FROM m{a}{b} l JOIN g r ON r.frame = l.frame AND r.cam = {b} AND r.fx > least(xa, xb) - {EPS} AND r.fx < greatest(xa, xb) + {EPS} AND r.fy > least(ya, yb) - {EPS} AND r.fy < greatest(ya, yb) + {EPS} AND abs((r.fy - m * r.fx - b) / sqrt(m * m + 1)) < {EPS}
  WHERE CAST(least(l.n, r.n) AS DOUBLE) / greatest(l.n, r.n) >= 0.3 AND CAST(least(l.sumg, r.sumg) AS DOUBLE) / greatest(l.sumg, r.sumg) > 0.25)"""


_LEAST = {"n": 0.3, "sumg": 0.25}


@query("epipolar_band", f"WITH {_T}, {_CAM}, {_FLAT}, {_band(0, 2)} SELECT frame, p1, p2, round(corr, 5) AS corr, round(dist, 6) AS dist FROM e02")
def epipolar_band(spark, sf_dir):
    return stereo.candidates(_flat(spark, sf_dir), PLAIN, 0, 2, VOLUME, EPS, _LEAST).withColumns({"corr": F.round("corr", 5), "dist": F.round("dist", 6)})


@query("cliques4", f"""WITH {_T}, {_CAM}, {_FLAT}, {', '.join(_band(a, b) for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)))}
SELECT a.frame, a.p1 AS p0, a.p2 AS p1, b.p2 AS p2, c.p2 AS p3 FROM e01 a JOIN e02 b ON b.frame = a.frame AND b.p1 = a.p1 JOIN e12 d ON d.frame = a.frame AND d.p1 = a.p2 AND d.p2 = b.p2
JOIN e03 c ON c.frame = a.frame AND c.p1 = a.p1 JOIN e13 e ON e.frame = a.frame AND e.p1 = a.p2 AND e.p2 = c.p2 JOIN e23 f ON f.frame = a.frame AND f.p1 = b.p2 AND f.p2 = c.p2
WHERE (a.corr + b.corr + c.corr + d.corr + e.corr + f.corr) / greatest(a.dist + b.dist + c.dist + d.dist + e.dist + f.dist, 1e-12) > 33""")
def cliques4(spark, sf_dir):
    found = stereo.edges(_flat(spark, sf_dir), PLAIN, VOLUME, EPS, least=_LEAST)
    return stereo.cliques(found, (0, 1, 2, 3), 33.0).select("frame", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(4)])


_SEEN = "(pid * 13 + {cam} * 5 + frame * 7) % 11 <> 0"


#: The rig in air, where epipolar lines are straight.
AIR = rig(medium={"gz": 90.0})


def _seen(spark, sf_dir, cameras: list[Camera]) -> DataFrame:
    """Pixels of every camera; each misses an eleventh of the points."""
    apart = F.expr("id div 1280")  # customers 1280 apart start at one place
    points = _points(spark, sf_dir).withColumns({"x": F.col("x") + apart / F.lit(8.0), "z": F.col("z") + apart / F.lit(16.0)})
    seen = stereo.project(points, cameras, rounds=200, limit=1e-10).where((F.col("id") * 13 + F.col("cam") * 5 + F.col("frame") * 7) % 11 != 0)
    return _sized(seen.select("frame", "cam", F.col("id").alias("pnr"), F.col("u").alias("x"), F.col("v").alias("y")))


def _cascade(spark, sf_dir):
    flat = stereo.flat_targets(_seen(spark, sf_dir, AIR), AIR, limit=1e-12)
    return flat, stereo.cascade(stereo.edges(flat, AIR, VOLUME, 4e-4, cell=0.5), 4, 0.0)


_CAMS4 = ", ".join(f"CASE WHEN {_SEEN.format(cam=k)} THEN pid ELSE -2 END AS p{k}" for k in range(4))
_COUNT4 = " + ".join(f"({_SEEN.format(cam=k)})::INT" for k in range(4))


@query("match_cascade", f"WITH {_T} SELECT frame, {_COUNT4} AS n_cams, {_CAMS4} FROM t WHERE {_COUNT4} >= 3")
def match_cascade(spark, sf_dir):
    """Four cameras with lenses: quadruplets, then triplets, of all points seen by so many; the twin is the truth."""
    _, found = _cascade(spark, sf_dir)
    return found.select("frame", "n_cams", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(4)])


@query("matched_points", f"WITH {_T} SELECT frame, pid AS id, {_COUNT4} AS cams, x + (pid // 1280) / 8e0 AS x, y, z + (pid // 1280) / 16e0 AS z FROM t WHERE {_COUNT4} >= 3")
def matched_points(spark, sf_dir):
    """Matches triangulated; ids are those of their targets here, which are the truth's."""
    flat, found = _cascade(spark, sf_dir)
    rows = stereo.match_points(stereo.numbered(found), flat, AIR)
    return rows.select("frame", F.array_max("cam_ids").alias("id"), F.col("cams").cast("long").alias("cams"), *[(F.round(c, 6) + 0.0).alias(c) for c in XYZ])


@query("match_two_cameras", f"WITH {_T}, {_CAM}, {_FLAT}, {_band(0, 1)}, a AS (SELECT *, count(*) OVER (PARTITION BY frame, p1) AS n FROM e01), b AS (SELECT *, row_number() OVER (PARTITION BY frame, p2 ORDER BY corr / greatest(dist, 1e-12) DESC, p1) AS r FROM a WHERE n = 1) SELECT frame, 2 AS n_cams, p1 AS p0, p2 AS p1 FROM b WHERE r = 1")
def match_two_cameras(spark, sf_dir):
    """Pairs whose first target has one candidate alone; of several that name one second target, the best score."""
    flat = _flat(spark, sf_dir)
    found = stereo.cascade({(0, 1): stereo.candidates(flat, PLAIN, 0, 1, VOLUME, EPS, _LEAST)}, 2, 0.0)
    return found.select("frame", "n_cams", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"))


_IDS = ", ".join(f"CASE WHEN (pid + {k}) % {m} > 0 THEN pid ELSE -1 END" for k, m in enumerate((2, 3, 5, 7)))


def _with_ids(spark, sf_dir):
    n = F.col("id")
    return _points(spark, sf_dir).withColumn("cam_ids", F.array(*[F.when((n + k) % m > 0, n).otherwise(F.lit(-1).cast("long")) for k, m in enumerate((2, 3, 5, 7))]))


@query("unified_particle_table", f"WITH {_T}, p AS (SELECT frame, pid, [{_IDS}] AS ids, x, y, z FROM t) SELECT frame, pid AS id, x, y, z, {', '.join(f'CASE WHEN ids[{k + 1}] >= 0 AND (pid + frame) % 9 <> {k} THEN x + {k} END AS u{k}' for k in range(4))} FROM p")
def unified_particle_table(spark, sf_dir):
    cams = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cam")
    targets = _points(spark, sf_dir).select("frame", F.col("id").alias("pnr"), "x", "y", cams).where((F.col("pnr") + F.col("frame")) % 9 != F.col("cam")).withColumn("x", F.col("x") + F.col("cam"))
    rows = stereo.unified(_with_ids(spark, sf_dir), targets)
    return rows.select("frame", "id", *XYZ, *[F.get("xy", F.lit(k))["x"].alias(f"u{k}") for k in range(4)])


@query("target_lookup", f"WITH {_T} SELECT frame, pid AS pnr, 0 AS cam, CASE WHEN pid % 3 = 0 THEN -1e10 ELSE x END AS fx, CASE WHEN pid % 3 = 0 THEN -1e10 ELSE y END AS fy FROM t")
def target_lookup(spark, sf_dir):
    rows = _points(spark, sf_dir).select("frame", F.lit(0).cast("long").alias("cam"), F.col("id").alias("pnr"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    return stereo.lookup(rows.drop("fx", "fy"), rows.where("pnr % 3 <> 0"))


_PIX = f"s AS MATERIALIZED (SELECT frame, CAST(cam AS BIGINT) AS cam, pid AS id, 64 * (x - x0) / (320 - z) * 64 + 2048 AS u, 2048 - 64 * (y - y0) / (320 - z) * 64 AS v FROM t, (VALUES (0, -30e0, -10e0), (1, 50e0, -14e0), (2, 44e0, 32e0), (3, -26e0, 30e0)) AS c(cam, x0, y0))"
_CORNERS = "k AS (SELECT t.frame, CAST(cam AS BIGINT) AS cam, pid AS id, 64 * (x + sx * 0.5e0 - x0) / (320 - z - sz * 0.5e0) * 64 + 2048 AS u, 2048 - 64 * (y + sy * 0.5e0 - y0) / (320 - z - sz * 0.5e0) * 64 AS v FROM t, (VALUES (0, -30e0, -10e0), (1, 50e0, -14e0), (2, 44e0, 32e0), (3, -26e0, 30e0)) AS c(cam, x0, y0), (VALUES (-1), (1)) AS a(sx), (VALUES (-1), (1)) AS b(sy), (VALUES (-1), (1)) AS d(sz))"
_BOXES = f"{_PIX}, {_CORNERS}, h AS (SELECT frame, cam, id, min(u) AS x0, max(u) AS x1, min(v) AS y0, max(v) AS y1 FROM k GROUP BY ALL), b AS MATERIALIZED (SELECT s.*, u - greatest(x0, 0) AS lft, least(x1, 4096) - u AS rgt, v - greatest(y0, 0) AS up, least(y1, 4096) - v AS dwn FROM s JOIN h USING (frame, cam, id))"


@query("search_boxes", f"WITH {_T}, {_BOXES} SELECT frame, cam, id, round(u, 4) AS u, round(v, 4) AS v, round(lft, 4) AS \"left\", round(rgt, 4) AS \"right\", round(up, 4) AS up, round(dwn, 4) AS down FROM b")
def search_boxes(spark, sf_dir):
    return stereo.search_box(_points(spark, sf_dir), PLAIN, (0.5, 0.5, 0.5)).withColumns({c: F.round(c, 4) for c in ("u", "v", "left", "right", "up", "down")})


_NEAR = "n AS MATERIALIZED (SELECT b.frame, b.id, b.cam, q.id AS pnr, CASE WHEN q.id %% 5 > 0 THEN q.id ELSE -1 END AS tnr, sqrt((q.u - b.u) * (q.u - b.u) + (q.v - b.v) * (q.v - b.v)) AS d FROM b JOIN s q ON q.frame = b.frame AND q.cam = b.cam AND q.u > b.u - lft AND q.u < b.u + rgt AND q.v > b.v - up AND q.v < b.v + dwn WHERE (q.id %% 5 > 0) = %s)"
_RANK = "r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, id, cam ORDER BY d, pnr) AS rank FROM n) WHERE rank <= %d)"


def _boxes(spark, sf_dir):
    points = _points(spark, sf_dir)
    seen = stereo.project(points, PLAIN).select("frame", "cam", F.col("id").alias("pnr"), F.col("u").alias("x"), F.col("v").alias("y"), F.when(F.col("id") % 5 > 0, F.col("id")).otherwise(F.lit(-1).cast("long")).alias("tnr"))
    return stereo.search_box(points, PLAIN, (0.5, 0.5, 0.5)), seen


@query("pixel_candidates", f"WITH {_T}, {_BOXES}, {_NEAR % 'true'}, {_RANK % 4} SELECT frame, id, cam, pnr, tnr, round(d, 4) AS d, rank FROM r")
def pixel_candidates(spark, sf_dir):
    return stereo.pixel_candidates(*_boxes(spark, sf_dir)).withColumn("d", F.round("d", 4))


@query("pixel_candidates_free", f"WITH {_T}, {_BOXES}, {_NEAR % 'false'}, {_RANK % 1} SELECT frame, id, cam, pnr, tnr, round(d, 4) AS d, rank FROM r")
def pixel_candidates_free(spark, sf_dir):
    return stereo.pixel_candidates(*_boxes(spark, sf_dir), matched=False, most=1).withColumn("d", F.round("d", 4))


@query("candidate_votes", f"WITH {_T}, {_BOXES}, {_NEAR % 'true'}, {_RANK % 4} SELECT frame, id, tnr, count(DISTINCT cam) AS votes FROM r GROUP BY frame, id, tnr HAVING count(DISTINCT cam) >= 2")
def candidate_votes(spark, sf_dir):
    return stereo.candidate_votes(*_boxes(spark, sf_dir)).drop("rank")


@query("new_position_cameras", f"WITH {_T}, {_BOXES}, {_NEAR % 'false'}, {_RANK % 1} SELECT frame, id, count(*) AS cams FROM r GROUP BY frame, id")
def new_position_cameras(spark, sf_dir):
    """How many cameras hold a free target near each position's image."""
    return stereo.pixel_candidates(*_boxes(spark, sf_dir), matched=False, most=1).groupBy("frame", "id").agg(F.count("*").alias("cams"))
