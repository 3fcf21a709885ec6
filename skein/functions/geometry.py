"""Column functions: vectors, camera coordinates, lens distortion and scalar laws. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def pixel_to_metric(x: Column, y: Column, width: int, height: int, pix_x: float, pix_y: float) -> tuple[Column, Column]:
    """Pixels to sensor millimetres: origin in the middle, y upwards."""
    return (x - width / 2.0) * pix_x, (height / 2.0 - y) * pix_y


def metric_to_pixel(x: Column, y: Column, width: int, height: int, pix_x: float, pix_y: float) -> tuple[Column, Column]:
    return x / pix_x + width / 2.0, height / 2.0 - y / pix_y


def brown_distort(x: Column, y: Column, k1: float, k2: float, k3: float, p1: float, p2: float, scale: float, shear: float) -> tuple[Column, Column]:
    """Radial and tangential distortion, then scale and shear."""
    r2 = x * x + y * y
    radial = k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    u = x + x * radial + p1 * (r2 + 2 * x * x) + 2 * p2 * x * y
    v = y + y * radial + p2 * (r2 + 2 * y * y) + 2 * p1 * x * y
    sin, cos = F.sin(F.lit(shear)), F.cos(F.lit(shear))
    return scale * u - sin * v, cos * v


def skew_midpoint(p, u, q, v) -> tuple[tuple[Column, Column, Column], Column]:
    """Midpoint of and distance between the closest points of the rays p + s u and q + t v; parallel rays: of their vertices."""
    w = tuple(b - a for a, b in zip(p, q))
    perp = cross(u, v)
    scale = dot(perp, perp)
    parallel = scale < 1e-20
    s = F.when(parallel, 0.0).otherwise(dot(cross(w, v), perp) / scale)
    t = F.when(parallel, 0.0).otherwise(dot(cross(w, u), perp) / scale)
    a, b = tuple(x + s * d for x, d in zip(p, u)), tuple(x + t * d for x, d in zip(q, v))
    gap = tuple(y - x for x, y in zip(a, b))
    return tuple((x + y) / 2 for x, y in zip(a, b)), norm(gap)


# Fixed values of the ghost law: nodes of the relative ray miss and probabilities for three and for four cameras.
GHOST_X = (0.8, 1.05, 1.4, 1.9, 2.6, 3.5)
GHOST_3 = (0.09, 0.10, 0.20, 0.37, 0.62, 0.75)
GHOST_4 = (0.01, 0.03, 0.04, 0.09, 0.28, 0.45)
# Fixed values of the logistic law with brightness: constant, log miss, below four cameras, log spread, log spread below four cameras.
GHOST_BLOB = (-1.71, 2.34, 2.5, 1.73, 0.57)


def quality_weight(ghost: Column, power: float = 2.0, least: float = 0.05) -> Column:
    """(1 - ghost)^power, not below least."""
    return F.greatest(F.pow(1 - ghost, F.lit(power)), F.lit(least))


def interpolate(x: Column, xs: tuple[float, ...], ys: tuple[float, ...]) -> Column:
    """Piecewise-linear through (xs, ys), level beyond the ends."""
    out = F.when(x <= xs[0], ys[0])
    for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= b, p + (x - a) * F.lit((q - p) / (b - a)))
    return out.otherwise(ys[-1])


def ghost_probability(miss: Column, cams: Column, typical: Column) -> Column:
    """Chance that a point is a ghost by its ray miss relative to the typical one; 0.5 where there is no miss."""
    rel = miss / F.greatest(typical, F.lit(1e-6))
    law = F.when(cams >= 4, interpolate(rel, GHOST_X, GHOST_4)).otherwise(interpolate(rel, GHOST_X, GHOST_3))
    return F.when(miss.isNull() | F.isnan(miss), 0.5).otherwise(law)


def ghost_with_brightness(miss: Column, cams: Column, typical: Column, spread: Column) -> Column:
    """The same by a logistic law that also knows how far the cameras' brightnesses differ (standard deviation of logs)."""
    rel = F.log(F.greatest(miss / F.greatest(typical, F.lit(1e-6)), F.lit(1e-3)))
    three, far = F.when(cams < 4, 1.0).otherwise(0.0), F.log(spread + 0.05)
    c, r, t, s, ts = GHOST_BLOB
    z = c + r * rel + t * three + s * far + ts * far * three
    return F.when(miss.isNull() | spread.isNull() | F.isnan(miss) | F.isnan(spread), 0.5).otherwise(1 / (1 + F.exp(-z)))


def search_radius(speed: Column, v_max: float, a_max: float, aspect: float) -> tuple[Column, Column]:
    """Search radius along and across the motion: by acceleration for moving particles, by speed for those at rest."""
    moving = speed > 1e-6
    return F.when(moving, a_max * aspect).otherwise(v_max), F.when(moving, a_max).otherwise(v_max)


def multi_term_cost(distance: Column, intensity: Column, dt: float, weights=(1.0, 1.0, 1.0, 1.0), speed: Column | None = None, accel: Column | None = None) -> Column:
    """Weighted distance, speed, acceleration and difference of intensity; weights are normalised to 1. Speed and acceleration are the distance's where none are given."""
    d, v, a, i = (w / sum(weights) for w in weights)
    speed, accel = distance if speed is None else speed, distance if accel is None else accel
    return d * distance + v * speed / dt + a * accel / (dt * dt) + i * F.abs(intensity)
