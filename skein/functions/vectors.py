"""Three-vectors of columns or arrays."""

from __future__ import annotations


def add(a, b) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def subtract(a, b) -> tuple:
    return tuple(x - y for x, y in zip(a, b))


def scale(a, s) -> tuple:
    return tuple(x * s for x in a)


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(N, a):
    return N.sqrt(dot(a, a))


def distance(N, a, b):
    return norm(N, subtract(a, b))


def unit(N, a) -> tuple:
    """Direction of a; the zero vector stays zero."""
    n = norm(N, a)
    return tuple(N.where(n > 0, x / N.where(n > 0, n, 1.0), 0.0) for x in a)


def equal(a, b):
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])


def close(N, a, b, eps: float = 1e-10):
    """Equal within eps on every axis."""
    return (N.abs(a[0] - b[0]) < eps) & (N.abs(a[1] - b[1]) < eps) & (N.abs(a[2] - b[2]) < eps)


def inside(p, bounds):
    """Strictly within (low, high) on every axis."""
    parts = [(x > low) & (x < high) for x, (low, high) in zip(p, bounds)]
    return parts[0] & parts[1] & parts[2]
