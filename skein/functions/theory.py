"""Laws of ghosts and of what can be tracked, for columns and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Fixed value: displacement over spacing in images beyond which prediction fails more and more.
TRACKABLE = 0.25


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def expected_ghosts(points, cams: int, tolerance, length) -> Column:
    """points^cams * (tolerance / length)^(2 cams - 3); infinite for one camera or a tolerance of the whole length, 0 where nothing is there."""
    n, d, size = _lit(points).cast("double"), _lit(tolerance), _lit(length)
    law = F.pow(n, F.lit(float(cams))) * F.pow(d / size, F.lit(2.0 * cams - 3))
    return F.lit(INF) if cams < 2 else F.when((n <= 0) | (d <= 0) | (size <= 0), 0.0).when(d >= size, INF).otherwise(law)


def ghost_regime(points, cams: int, tolerance, length) -> Column:
    g = expected_ghosts(points, cams, tolerance, length)
    return F.when(g < 1, "sparse").when(g >= _lit(points), "dense").otherwise("intermediate")


def recommend_tolerance(points, cams: int, length, budget: float = 1.0) -> Column:
    """The tolerance that gives `budget` ghosts, at most the whole length."""
    if cams < 2 or budget <= 0:
        return F.lit(0.0)
    n, size = _lit(points).cast("double"), _lit(length)
    base = F.lit(float(budget)) / F.pow(n, F.lit(float(cams)))
    return F.when((n <= 0) | (size <= 0), 0.0).when(base > 1, size).otherwise(size * F.pow(base, F.lit(1.0 / (2 * cams - 3))))


def trackability(displacement, points, size) -> Column:
    """displacement * sqrt(points) / image size."""
    return F.when((_lit(size) <= 0) | (_lit(points) <= 0), INF).otherwise(_lit(displacement) * F.sqrt(_lit(points).cast("double")) / _lit(size))


def prediction_radius(error, spacing, safety: float = 0.5) -> Column:
    """The prediction's error, at most safety times the spacing."""
    cap = safety * _lit(spacing)
    return F.when(_lit(error) <= 0, cap).otherwise(F.least(_lit(error), cap))


def report(points: Column, cams: int, tolerance, length, displacement=None, size=None) -> list[Column]:
    """Columns ghosts, regime, tolerance, trackability and notes of a run of so many points."""
    best, regime = recommend_tolerance(points, cams, length), ghost_regime(points, cams, tolerance, length)
    track = F.lit(None).cast("double") if displacement is None or size is None else trackability(displacement, points, size)
    notes = F.concat_ws("; ", F.when(regime == "dense", "ghosts outnumber points").when(regime == "intermediate", "a tighter tolerance pays"), F.when((_lit(tolerance) > best) & (best > 0) & F.lit(cams > 2), "tolerance above that of one ghost"), F.when(track > TRACKABLE, "prediction fails for many").when(track.isNotNull(), "prediction works"))
    return [expected_ghosts(points, cams, tolerance, length).alias("ghosts"), regime.alias("regime"), best.alias("tolerance"), track.alias("trackability"), notes.alias("notes")]
