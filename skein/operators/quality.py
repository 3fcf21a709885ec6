"""Brightness, density and shared targets of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conflicts(rows: DataFrame) -> DataFrame:
    """Of points (frame, pid, cam, target, conf) sharing a target, the one of highest confidence stays, ties to the lower id."""
    best = F.row_number().over(Window.partitionBy("frame", "cam", "target").orderBy(F.col("conf").desc(), "pid"))
    return rows.withColumn("r", best).where("r = 1").drop("r")


def brightness_shares(rows: DataFrame) -> DataFrame:
    """Share of each member in its blob's brightness, rows (frame, blob, member, g); g <= 0 counts as the median of the positive ones."""
    blob = Window.partitionBy("frame", "blob")
    good = F.when(F.col("g") > 0, F.col("g").cast("double"))
    rows = rows.withColumn("g", F.coalesce(good, F.median(good).over(blob), F.lit(1.0)))
    return rows.select("frame", "blob", "member", F.round(F.col("g") / F.sum("g").over(blob), 6).alias("share"))


def brightness_spread(rows: DataFrame) -> DataFrame:
    """Standard deviation of log brightness over the cameras that see a point, rows (frame, pnr, sumg)."""
    return rows.where("sumg > 0").groupBy("frame", "pnr").agg(F.round(F.stddev_pop(F.log("sumg")), 6).alias("spread"))


# Classes of the longest step relative to the mean nearest-neighbour distance.
DENSITY = ((0.3, "low"), (0.6, "low_to_moderate"), (0.9, "moderate"))


def density_class(ratio):
    """Class of seeding density of a column of ratios."""
    out = F.when(ratio < DENSITY[0][0], DENSITY[0][1])
    for most, name in DENSITY[1:]:
        out = out.when(ratio < most, name)
    return out.otherwise("high")
