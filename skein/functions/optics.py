"""Cameras behind glass: projection, lens distortion, refraction, rays and epipolar lines, for columns and arrays alike (namespace N).

A camera's axes are the columns of its rotation; it looks along -z of its own frame. The glass plane stands at the tip of the glass vector (from the origin), its
layers beyond it towards the camera; n1, n2 and n3 are the refractive indices of air, glass and the medium, d the thickness of the glass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

FIELDS = ("x0", "y0", "z0", "omega", "phi", "kappa", "cc", "xh", "yh", "gx", "gy", "gz", "k1", "k2", "k3", "p1", "p2", "scx", "she", "n1", "n2", "n3", "d", "imx", "imy", "pix_x", "pix_y")
# Rounds, damping and limits of the iterations.
SHIFT_ROUNDS, SHIFT_LIMIT = 40, 1e-3
AFFINE_ROUNDS, AFFINE_DAMPING = 20, 0.7
EXACT_ROUNDS, EXACT_DAMPING = 50, 0.5
LENS_LIMIT = 1e-8


def rotation(N, omega, phi, kappa) -> list[list]:
    """Rotation matrix of three angles."""
    so, co, sp, cp, sk, ck = N.sin(omega), N.cos(omega), N.sin(phi), N.cos(phi), N.sin(kappa), N.cos(kappa)
    return [[cp * ck, -cp * sk, sp], [co * sk + so * sp * ck, co * ck - so * sp * sk, -so * cp], [so * sk - co * sp * ck, so * ck + co * sp * sk, co * cp]]


def angles(N, m) -> tuple:
    """The angles of a rotation matrix."""
    return N.atan2(-m[1][2], m[2][2]), N.asin(N.clip(m[0][2], -1.0, 1.0)), N.atan2(-m[0][1], m[0][0])


@dataclass
class Camera:
    """Orientation, lens, glass, medium and sensor of one camera; values may be columns."""

    x0: Any = 0.0
    y0: Any = 0.0
    z0: Any = 100.0
    omega: Any = 0.0
    phi: Any = 0.0
    kappa: Any = 0.0
    cc: Any = 100.0
    xh: Any = 0.0
    yh: Any = 0.0
    gx: Any = 0.0
    gy: Any = 0.0
    gz: Any = 1e-6
    k1: Any = 0.0
    k2: Any = 0.0
    k3: Any = 0.0
    p1: Any = 0.0
    p2: Any = 0.0
    scx: Any = 1.0
    she: Any = 0.0
    n1: Any = 1.0
    n2: Any = 1.0
    n3: Any = 1.0
    d: Any = 1.0
    imx: Any = 1280
    imy: Any = 1024
    pix_x: Any = 0.012
    pix_y: Any = 0.012
    matrix: list = field(default_factory=list, repr=False)

    def turned(self, N) -> list[list]:
        return self.matrix or [[N.let(x) for x in row] for row in rotation(N, self.omega, self.phi, self.kappa)]


def of_columns(prefix: str = "") -> Camera:
    """The camera of a row's columns (FIELDS, with a prefix)."""
    return Camera(**{k: F.col(f"{prefix}{k}") for k in FIELDS})


def table(spark, cameras: list[Camera]):
    """cam and FIELDS of every camera: a dimension table with a row a camera."""
    rows = [(n, *[float(getattr(c, k)) for k in FIELDS]) for n, c in enumerate(cameras)]
    return spark.createDataFrame(rows, "cam long, " + ", ".join(f"{k} double" for k in FIELDS))


# --- pixels and lens -------------------------------------------------------------------------------------------------------------------


def to_metric(N, c: Camera, x, y, field_mode: int = 0) -> tuple:
    """Pixels to millimetres on the sensor; field_mode 1 and 2 are interlaced images (lines 2 y + 1 and 2 y)."""
    y = 2.0 * y + 1.0 if field_mode == 1 else 2.0 * y if field_mode == 2 else y
    return (x - c.imx * 0.5) * c.pix_x, (c.imy * 0.5 - y) * c.pix_y


def to_pixel(N, c: Camera, x, y, field_mode: int = 0) -> tuple:
    px, py = x / c.pix_x + c.imx * 0.5, c.imy * 0.5 - y / c.pix_y
    return px, ((py - 1.0) * 0.5 if field_mode == 1 else py * 0.5 if field_mode == 2 else py)


def _bent(c: Camera, x, y) -> tuple:
    """Displacement by radial and tangential distortion."""
    r2 = x * x + y * y
    radial = c.k1 * r2 + c.k2 * r2 * r2 + c.k3 * r2 * r2 * r2
    return x * radial + c.p1 * (r2 + 2.0 * x * x) + 2.0 * c.p2 * x * y, y * radial + c.p2 * (r2 + 2.0 * y * y) + 2.0 * c.p1 * x * y


def distort(N, c: Camera, x, y) -> tuple:
    """Lens distortion, then scale and shear."""
    dx, dy = _bent(c, x, y)
    return c.scx * (x + dx) - N.sin(c.she) * (y + dy), N.cos(c.she) * (y + dy)


def undistort(N, c: Camera, x, y, rounds: int = AFFINE_ROUNDS) -> tuple:
    """Inverse of distort by damped correction, ended where the relative change falls below LENS_LIMIT."""
    sin, cos = N.sin(c.she), N.cos(c.she)
    v = y / cos

    def step(s):
        a, b = distort(N, c, s["u"], s["v"])
        dv = (y - b) / cos
        du = (x - a + dv * sin) / c.scx
        u, v = s["u"] + AFFINE_DAMPING * du, s["v"] + AFFINE_DAMPING * dv
        size = N.sqrt(u * u + v * v)
        return {"u": u, "v": v, "stop": (size > 1e-10) & (AFFINE_DAMPING * N.sqrt(du * du + dv * dv) < LENS_LIMIT * size)}

    end = N.iterate(rounds, {"u": (x + v * sin) / c.scx, "v": v}, step)
    return end["u"], end["v"]


def undistort_exact(N, c: Camera, x, y, limit: float = LENS_LIMIT, rounds: int = EXACT_ROUNDS) -> tuple:
    """Inverse of distort by damped fixed-point steps until they are shorter than limit."""
    cos = N.cos(c.she)
    ya = y / cos
    xa = (x + ya * N.sin(c.she)) / c.scx

    def step(s):
        dx, dy = _bent(c, s["u"], s["v"])
        du, dv = xa - dx - s["u"], ya - dy - s["v"]
        return {"u": s["u"] + EXACT_DAMPING * du, "v": s["v"] + EXACT_DAMPING * dv, "stop": N.sqrt(du * du + dv * dv) < limit}

    end = N.iterate(rounds, {"u": xa, "v": ya}, step)
    return end["u"], end["v"]


def to_flat(N, c: Camera, x, y, limit: float = LENS_LIMIT) -> tuple:
    """Distorted sensor millimetres to the ideal camera's, about the principal point."""
    u, v = undistort_exact(N, c, x, y, limit)
    return u - c.xh, v - c.yh


def from_flat(N, c: Camera, x, y) -> tuple:
    return distort(N, c, x + c.xh, y + c.yh)


def fold_radius(N, c: Camera, r_max, n: int = 200):
    """First of n equally spaced radii up to r_max at which the radial law has stopped growing; NaN if none."""
    def bad(r):
        r2 = r * r
        return 1.0 + 3.0 * c.k1 * r2 + 5.0 * c.k2 * r2 * r2 + 7.0 * c.k3 * r2 * r2 * r2 <= 0

    return N.first(n, lambda k: r_max * (k / float(n - 1)), bad)


# --- refraction ------------------------------------------------------------------------------------------------------------------------


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _length(N, a):
    return N.sqrt(_dot(a, a))


def glass_frame(N, c: Camera, p) -> dict:
    """A point in the plane of the camera's foot and the glass normal: radius from the foot and height over the glass, the camera's height, and the frame."""
    g = (c.gx, c.gy, c.gz)
    size = N.let(_length(N, g))
    unit = [N.let(x / size) for x in g]
    up = N.let(_dot((c.x0, c.y0, c.z0), unit) - size)  # the camera's height over the near face of the medium
    high = N.let(_dot(p, unit) - size)
    foot = [N.let(a - up * u) for a, u in zip((c.x0, c.y0, c.z0), unit)]
    out = [N.let(a - high * u - f) for a, u, f in zip(p, unit, foot)]
    return {"radius": N.let(_length(N, out)), "height": high, "camera": up, "foot": foot, "out": out, "unit": unit}


def from_glass_frame(N, frame: dict, radius, height) -> list:
    """The point of a radius and height in the plane that glass_frame found."""
    r = frame["radius"]
    share = N.let(N.where(r > 0, radius / N.where(r > 0, r, 1.0), 0.0))
    return [f + height * u + share * o for f, u, o in zip(frame["foot"], frame["unit"], frame["out"])]


def radial_shift(N, radius, height, camera, n1, n2: list, n3, d: list, rounds: int = SHIFT_ROUNDS, limit: float = SHIFT_LIMIT):
    """Factor by which a point's radius must grow to be seen straight through the layers; 1 without refraction or where the rounds don't converge."""

    def sine(s, n):
        return N.asin(N.clip(s * n1 / n, -1.0, 1.0))

    below = height
    for x in d[1:]:
        below = below + x

    def step(s):
        beta = N.atan(s["r"] / (camera - height))
        sin = N.sin(beta)
        reach = (camera - d[0]) * N.tan(beta) - below * N.tan(sine(sin, n3))
        for n, x in zip(n2, d):
            reach = reach + x * N.tan(sine(sin, n))
        gap = radius - reach
        return {"r": s["r"] + gap, "stop": N.abs(gap) < limit}

    end = N.iterate(rounds, {"r": radius}, step)
    plain = (n1 == 1.0) & (n2[0] == 1.0) & (n3 == 1.0) if len(n2) == 1 else (radius != radius)
    return N.where(plain | ~end["stop"] | (radius == 0), 1.0, end["r"] / N.where(radius == 0, 1.0, radius))


def shifted(N, c: Camera, p, n2: list | None = None, d: list | None = None, rounds: int = SHIFT_ROUNDS, limit: float = SHIFT_LIMIT) -> tuple:
    """x and y at which a point under horizontal layers appears to the camera above them."""
    dx, dy = p[0] - c.x0, p[1] - c.y0
    f = N.let(radial_shift(N, N.let(N.sqrt(dx * dx + dy * dy)), p[2], c.z0, c.n1, n2 or [c.n2], c.n3, d or [c.d], rounds, limit))
    return c.x0 + dx * f, c.y0 + dy * f


def flat(N, c: Camera, p, factor=None, rounds: int = SHIFT_ROUNDS, limit: float = SHIFT_LIMIT) -> tuple:
    """Ideal image of a point in sensor millimetres, through the glass; factor gives the radial shift if it is known from a table."""
    frame = glass_frame(N, c, p)
    if factor is None:
        factor = radial_shift(N, frame["radius"], frame["height"], frame["camera"], c.n1, [c.n2], c.n3, [c.d], rounds, limit)
    seen = from_glass_frame(N, frame, frame["radius"] * N.let(factor), frame["height"])
    m = c.turned(N)
    rel = [N.let(a - b) for a, b in zip(seen, (c.x0, c.y0, c.z0))]
    deep = N.let(m[0][2] * rel[0] + m[1][2] * rel[1] + m[2][2] * rel[2])
    return tuple(N.let(-c.cc * (m[0][j] * rel[0] + m[1][j] * rel[1] + m[2][j] * rel[2]) / deep) for j in (0, 1))


def image(N, c: Camera, p, **more) -> tuple:
    """Distorted image in sensor millimetres."""
    return tuple(N.let(v) for v in from_flat(N, c, *flat(N, c, p, **more)))


def pixel(N, c: Camera, p, **more) -> tuple:
    """Image in pixels."""
    return to_pixel(N, c, *image(N, c, p, **more))


def ray(N, c: Camera, x, y) -> tuple[list, list]:
    """Point on the medium's face and direction in the medium of the ray of an ideal image point, refracted at both faces of the glass."""
    m = c.turned(N)
    size = N.let(N.sqrt(x * x + y * y + c.cc * c.cc))
    start = [N.let((row[0] * x + row[1] * y - row[2] * c.cc) / size) for row in m]
    g = (c.gx, c.gy, c.gz)
    long = N.let(_length(N, g))
    unit = [N.let(v / long) for v in g]
    down = N.let(_dot(start, unit))
    away = N.let(_dot((c.x0, c.y0, c.z0), unit) - long - c.d)
    hit = [a - s * away / down for a, s in zip((c.x0, c.y0, c.z0), start)]

    def bend(direction, cosine, ratio):
        side = [N.let(s - u * cosine) for s, u in zip(direction, unit)]
        n = N.let(_length(N, side))
        sine = N.let(N.sqrt(N.clip(1.0 - cosine * cosine, 0.0, 1.0)) * ratio)
        new = N.let(N.where(cosine >= 0, 1.0, -1.0) * N.sqrt(1.0 - sine * sine))
        return [N.let(N.where(n > 0, s / N.where(n > 0, n, 1.0), 0.0) * sine + u * new) for s, u in zip(side, unit)], new

    inside, cosine = bend(start, down, c.n1 / c.n2)
    leave = [N.let(h + i * c.d / N.abs(cosine)) for h, i in zip(hit, inside)]
    out, _ = bend(inside, cosine, c.n2 / c.n3)
    return leave, out


def at_height(N, vertex, direction, z) -> tuple:
    """Point of a ray at height z."""
    t = (z - vertex[2]) / direction[2]
    return vertex[0] + t * direction[0], vertex[1] + t * direction[1], z


def sight(N, c: Camera, x, y) -> tuple[list, list]:
    """Ray of a pixel."""
    return ray(N, c, *[N.let(v) for v in to_flat(N, c, *to_metric(N, c, x, y))])


@dataclass
class Volume:
    """Bounds of the measured volume: lowest and highest z at x_lay[0] and x_lay[1], linear between and beyond."""

    x_lay: tuple = (-100.0, 100.0)
    z_min: tuple = (-10.0, -10.0)
    z_max: tuple = (10.0, 10.0)

    def heights(self, x) -> tuple:
        part = (x - self.x_lay[0]) / (self.x_lay[1] - self.x_lay[0])
        return self.z_min[0] + part * (self.z_min[1] - self.z_min[0]), self.z_max[0] + part * (self.z_max[1] - self.z_max[0])


def epipolar_segment(N, a: Camera, b: Camera, x, y, volume: Volume, **more) -> tuple:
    """Ideal images in camera b of the two ends of the ray of an ideal point of camera a within the volume: x, y at the lowest and at the highest z."""
    vertex, direction = ray(N, a, x, y)
    ends = [N.let(z) if hasattr(z, "alias") else z for z in volume.heights(vertex[0])]
    return (*flat(N, b, [N.let(v) if hasattr(v, "alias") else v for v in at_height(N, vertex, direction, ends[0])], **more), *flat(N, b, [N.let(v) if hasattr(v, "alias") else v for v in at_height(N, vertex, direction, ends[1])], **more))


def mid_point(N, c: Camera, x, y, volume: Volume) -> tuple:
    """Point of an ideal image point's ray midway through the volume."""
    vertex, direction = ray(N, c, x, y)
    low, high = volume.heights(vertex[0])
    return at_height(N, vertex, direction, N.let(0.5 * (low + high)))


# --- rays to points --------------------------------------------------------------------------------------------------------------------


def normal_terms(vertex, direction) -> dict:
    """Terms of the normal equations of the point nearest to rays; they add up over the rays of a point (directions of length 1)."""
    u, v = direction, vertex
    along = _dot(u, v)
    return {
        "a00": 1.0 - u[0] * u[0], "a01": -u[0] * u[1], "a02": -u[0] * u[2], "a11": 1.0 - u[1] * u[1], "a12": -u[1] * u[2], "a22": 1.0 - u[2] * u[2],
        "b0": v[0] - u[0] * along, "b1": v[1] - u[1] * along, "b2": v[2] - u[2] * along,
    }


def solve_normal(N, s: dict) -> tuple:
    """Determinant and solution of summed normal terms."""
    c00, c01, c02 = s["a11"] * s["a22"] - s["a12"] * s["a12"], s["a02"] * s["a12"] - s["a01"] * s["a22"], s["a01"] * s["a12"] - s["a02"] * s["a11"]
    c11, c12, c22 = s["a00"] * s["a22"] - s["a02"] * s["a02"], s["a01"] * s["a02"] - s["a00"] * s["a12"], s["a00"] * s["a11"] - s["a01"] * s["a01"]
    det = N.let(s["a00"] * c00 + s["a01"] * c01 + s["a02"] * c02)
    b = s["b0"], s["b1"], s["b2"]
    return det, tuple((row[0] * b[0] + row[1] * b[1] + row[2] * b[2]) / det for row in ((c00, c01, c02), (c01, c11, c12), (c02, c12, c22)))


# --- rotations -------------------------------------------------------------------------------------------------------------------------


def look_at(N, position, target, up=(0.0, 0.0, 1.0), roll=0.0) -> list[list]:
    """Rotation of a camera at position that looks at target, its image upright against up and turned by roll. It looks along its -z."""
    back = [p - t for p, t in zip(position, target)]
    n = N.let(_length(N, back))
    z = [N.let(b / n) for b in back]
    x = [up[1] * z[2] - up[2] * z[1], up[2] * z[0] - up[0] * z[2], up[0] * z[1] - up[1] * z[0]]
    n = N.let(_length(N, x))
    x = [N.let(v / n) for v in x]
    y = [N.let(z[1] * x[2] - z[2] * x[1]), N.let(z[2] * x[0] - z[0] * x[2]), N.let(z[0] * x[1] - z[1] * x[0])]
    s, k = N.sin(roll), N.cos(roll)
    return [[k * a + s * b, k * b - s * a, e] for a, b, e in zip(x, y, z)]


def from_rotation_vector(N, r) -> list[list]:
    """Rotation matrix of a rotation vector (axis times angle)."""
    angle = N.let(_length(N, r))
    safe = N.where(angle > 1e-12, angle, 1.0)
    k = [N.let(v / safe) for v in r]
    s, c = N.let(N.where(angle > 1e-12, N.sin(angle), 0.0)), N.let(N.where(angle > 1e-12, N.cos(angle), 1.0))
    cross = [[0.0, -k[2], k[1]], [k[2], 0.0, -k[0]], [-k[1], k[0], 0.0]]
    return [[c * (1.0 if i == j else 0.0) + s * cross[i][j] + (1.0 - c) * k[i] * k[j] for j in range(3)] for i in range(3)]


def rotation_vector(N, m) -> list:
    """Rotation vector of a rotation matrix whose angle is below 180 degrees."""
    angle = N.let(N.acos(N.clip((m[0][0] + m[1][1] + m[2][2] - 1.0) / 2.0, -1.0, 1.0)))
    f = N.let(N.where(angle > 1e-9, angle / (2.0 * N.where(angle > 1e-9, N.sin(angle), 1.0)), 0.5))
    return [f * (m[2][1] - m[1][2]), f * (m[0][2] - m[2][0]), f * (m[1][0] - m[0][1])]
