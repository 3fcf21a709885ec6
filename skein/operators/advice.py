"""What a run's data say about how to track it: statistics, scores of the trackers, limits, and rules as columns."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import quality, spatial
from skein.operators.linkage import AXES
from skein.shared import kept, quantile

# Share of dropouts that counts as gaps, growth and fall of counts, factors of the suggested limits.
GAP_SHARE, STABLE, GROWTH, FALL = 0.15, 0.1, 1.2, 0.8
MARGIN, ACCEL_SHARE, CAP = 3.0, 0.6, 2.5
RANKS = {"low": 0, "low_to_moderate": 1, "moderate": 2, "high": 3}
SPEED = {"fastest": 5, "fast": 4, "moderate": 2, "slow": 0}
ACCURACY = {"highest": 5, "high": 4, "standard": 2, "draft": 0}


def dataset(points: DataFrame, radius: float) -> DataFrame:
    """One row of a run's points: frames, counts, size, spacing (mean distance to the nearest point of the frame), displacement (to the nearest of the next frame: mean,
    deviation, quartile, median, 95th percentile, largest), class of density, gaps and whether counts are stable, growing, dropping or erratic."""
    finite = [F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in AXES]
    points = kept(points.where(finite[0] & finite[1] & finite[2]).select("frame", "id", *AXES))
    n = points.groupBy("frame").agg(F.count("*").alias("n"))
    half = F.row_number().over(Window.orderBy("frame")) <= F.floor(F.count("*").over(Window.partitionBy()) / 2)  # a row a frame
    counts = n.withColumn("early", half).agg(
        F.count("*").alias("frames"), F.avg("n").alias("mean_points"), F.max("n").alias("max_points"), F.min("n").alias("min_points"), F.stddev_pop("n").alias("sd_points"),
        F.avg(F.when(F.col("early"), F.col("n"))).alias("m1"), F.avg(F.when(~F.col("early"), F.col("n"))).alias("m2"),
    )
    size = points.agg(*[(F.max(a) - F.min(a)).alias(f"size_{a}") for a in AXES])
    near = spatial.nearest_distances(points, radius, "id").agg(F.avg(F.sqrt("d2")).alias("spacing"))
    step = kept(spatial.nearest_in_next(points, radius).select(F.sqrt("d2").alias("d")))
    moved = step.agg(F.max("d").alias("max_step"), F.avg("d").alias("mean_step"), F.stddev_pop("d").alias("sd_step"))
    p25, p50, p95 = (quantile(step, F.col("d"), q) for q in (0.25, 0.5, 0.95))
    one = counts.crossJoin(size).crossJoin(near).crossJoin(moved)  # one row each
    c = F.col
    ratio = F.when(c("spacing") > 0, c("max_step") / c("spacing"))
    gap = F.when(c("max_points") > 0, 1 - c("min_points") / c("max_points")).otherwise(0.0)
    kind = F.when(c("sd_points") <= STABLE * c("mean_points"), "stable").when(c("m2") > GROWTH * c("m1"), "growing").when(c("m2") < FALL * c("m1"), "dropping").otherwise("erratic")
    rounded = lambda x, name: F.round(x, 6).alias(name)
    return one.select(
        "frames", rounded(c("mean_points"), "mean_points"), "max_points", rounded(c("sd_points"), "sd_points"), *[f"size_{a}" for a in AXES], rounded(c("spacing"), "spacing"), rounded(c("max_step"), "max_step"), rounded(c("mean_step"), "mean_step"),
        rounded(c("sd_step"), "sd_step"), *[rounded(F.lit(v).cast("double"), k) for v, k in ((p25, "p25_step"), (p50, "p50_step"), (p95, "p95_step"))], F.when(ratio > 0, quality.density_class(ratio)).otherwise("unknown").alias("density"),
        rounded(gap, "gap_share"), (gap > GAP_SHARE).alias("has_gaps"), kind.alias("counts"),
    )


def _of(table: dict, column: Column, other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), column), F.lit(other))


def score_trackers(stats: DataFrame, table: DataFrame, priority: str = "default") -> DataFrame:
    """(name, score, rank) of every tracker for a run's statistics: fit of density, gaps, changing counts, and speed or accuracy if that is the priority; ties by speed's word, then name."""
    rows = table.crossJoin(F.broadcast(stats.select("density", "has_gaps", "counts").withColumnRenamed("density", "_density")))  # one row
    fit = F.greatest(F.lit(0.0), 3.0 - 1.5 * F.abs(_of(RANKS, F.col("density"), 2) - _of(RANKS, F.col("_density"), 1)))
    gaps = F.when(F.col("has_gaps"), F.when(F.col("gaps") | F.col("backward"), 3.0).otherwise(-1.0)).otherwise(0.0)
    new = F.when(F.col("counts").isin("dropping", "erratic", "growing") & F.col("new_particles"), 2.0).otherwise(0.0)
    own = F.when(F.col("name") == "unified", 1.0).otherwise(0.0)
    more = _of(SPEED, F.col("speed"), 2) if priority == "speed" else _of(ACCURACY, F.col("accuracy"), 2) + own if priority == "accuracy" else own
    scored = rows.select("name", "speed", (fit + gaps + new + more).cast("double").alias("score"))
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "speed", "name"))  # a row a tracker
    return scored.select("name", "score", rank.cast("long").alias("rank"))


def recommend(stats: DataFrame, table: DataFrame, priority: str = "default") -> DataFrame:
    """One row: the best tracker, its share of all scores, the next two, and suggested limits of step and acceleration."""
    scored = score_trackers(stats, table, priority)
    best = scored.agg(F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("tracker"), (F.max(F.when(F.col("rank") == 1, F.col("score"))) / F.sum("score")).alias("confidence"), F.array_compact(F.array(*[F.max(F.when((F.col("rank") == k) & (F.col("score") > 0), F.col("name"))) for k in (2, 3)])).alias("alternates"))
    return best.withColumn("confidence", F.round("confidence", 6)).crossJoin(stats.select(*limits()))  # one row each


def limits() -> list[Column]:
    """Suggested largest step and acceleration of statistics: three times the 95th percentile of the step and 0.6 of that, within 2.5 spacings; no more than a spacing where steps exceed it."""
    step = F.when(F.col("p95_step") > 0, F.col("p95_step")).otherwise(F.col("max_step")) * MARGIN
    cap = F.col("spacing") * CAP
    capped = (F.col("spacing") > 0) & (step > cap)
    accel = F.when(capped, F.least(step * ACCEL_SHARE, cap)).otherwise(step * ACCEL_SHARE)
    far = (F.col("spacing") > 0) & (F.col("p95_step") / F.col("spacing") > 1)
    return [F.round(F.when(capped, cap).otherwise(step), 6).alias("dv_max"), F.round(F.when(far, F.least(accel, F.col("spacing"))).otherwise(accel), 6).alias("dacc")]


def noise_percentile(sigma: np.ndarray, q: float) -> float:
    """The q-th percentile of the length of a vector of independent normal numbers, by bisection of its distribution (Imhof's integral)."""
    s2 = np.asarray(sigma, float) ** 2
    if not s2.any():
        return 0.0
    u = np.linspace(1e-4, 200.0 / s2.max(), 200_001)
    phase, amp = 0.5 * np.arctan(np.outer(u, s2)).sum(1), (1 + np.outer(u * u, s2 * s2)).prod(1) ** 0.25

    def below(x: float) -> float:
        f = np.sin(phase - 0.5 * u * x) / (u * amp)
        return 0.5 - float(((f[1:] + f[:-1]) / 2 * np.diff(u)).sum()) / math.pi

    low, high = 0.0, float(60 * s2.sum())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < q / 100 else (low, mid)
    return math.sqrt((low + high) / 2)


def trackcorr_limits(stats: dict, factor: float = 1.2, q: float = 99.5, ratio: float = 10.0, unit: float = 0.1) -> dict[str, float]:
    """Limits from kinematics.step_statistics: step an axis = its 99.9th percentile + 3 sqrt(2) noise, rounded up; dacc = factor times the q-th percentile of noise alone;
    the angle is off (270 gon) where the median step is below `ratio` times the step's noise, else 200."""
    out = {}
    for a in AXES:
        out[f"dv{a}"] = math.ceil((stats[f"p999_{a}"] + 3 * math.sqrt(2) * stats[f"noise_{a}"]) / unit - 1e-9) * unit
    sigma = np.array([stats[f"noise_{a}"] for a in AXES])
    out["dacc"] = math.ceil(factor * noise_percentile(math.sqrt(6) * sigma, q) / (unit / 2) - 1e-9) * (unit / 2)
    out["angle"] = 270.0 if stats["step_noise"] > 0 and stats["median_step"] / stats["step_noise"] < ratio else 200.0
    return out


def distance_weight(displacement: Column, spacing: Column, low: float = 0.1, high: float = 2.0, knee: float = 0.3) -> Column:
    """Weight of distance in the cost of linked points: high for slow runs, low for fast ones; 1 where the scale isn't known."""
    w = low + (high - low) / (1 + displacement / spacing / knee)
    return F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), w)), F.lit(1.0))


def conditioning(displacement: Column, z_noise: Column) -> tuple[Column, Column]:
    """Noise in depth over motion, and the verdict on tracks one by one."""
    ratio = F.when(displacement > 0, z_noise / displacement).otherwise(float("inf"))
    return ratio, F.when(ratio < 0.3, "well-conditioned").when(ratio < 1.0, "marginal").otherwise("poorly-conditioned")


def z_noise(rig, noise_px: float = 0.5, probe: float = 10.0) -> float:
    """Depth that a detection's error of noise_px stands for, in the camera that sees depth least."""
    from skein.engines import calibration

    worst = 0.0
    for c in rig:
        a, b = calibration.pixels(c, np.array([[0.0, 0.0, 0.0], [0.0, 0.0, probe]]))
        px = float(np.hypot(*(b - a))) / probe
        worst = max(worst, noise_px / px) if px > 0 else worst
    return worst


def advise(fps: float | None = None, most: float = 7.0, least: float = 0.5, factor: float = 8.0) -> list[Column]:
    """Columns of advice on measurements (three_cams, flagged, neighbours, ratio, median_kink, median_step): ghost rules, confirmation, brightness gate and smoothing."""
    c = F.col
    known = c("flagged").isNotNull()
    strict, light = known & ((c("three_cams") > 0.45) | (c("flagged") > 0.14)), known & (c("three_cams") < 0.2) & (c("flagged") < 0.04)
    free = (c("neighbours") <= most) & (c("ratio") >= least)
    out = [F.when(strict, 0.15).when(light, 0.3).otherwise(0.2).alias("q_seed"), F.when(strict, 6).otherwise(3).alias("q_young"), F.round(F.when(free, factor * c("median_kink")).otherwise(0.3), 6).alias("confirm_tol"), free.alias("confirm_auto"), F.when(c("median_step") >= 0.2, 0.5).alias("blob_gate"), F.lit(6).alias("reconnect_gap"), F.when(c("ratio") >= least, 6).alias("smooth_filter")]
    return [*out, F.lit(max(5, round(0.004 * fps) // 2 * 2 + 1)).alias("smoothing_window")] if fps else out


def probe_score(median_length: Column, share: Column, jump_rate: Column, weight: float = 0.5) -> Column:
    """median length * yield - weight * jump rate."""
    return F.coalesce(median_length, F.lit(0.0)) * F.coalesce(share, F.lit(0.0)) - weight * F.coalesce(jump_rate, F.lit(0.0))


def decision(resolved: dict, regime: dict, **more) -> str:
    """A record of what was decided and why, as JSON with sorted keys."""
    return json.dumps({"resolved_config": resolved, "regime_flags": regime, **more}, sort_keys=True, default=str)


def decisions(rows: DataFrame) -> DataFrame:
    """Rows with record: their columns as JSON."""
    return rows.withColumn("record", F.to_json(F.struct(*rows.columns)))


def search(spark: SparkSession, grid: dict[str, list], run, score) -> tuple[dict, list[tuple[float, dict]]]:
    """Coordinate descent over parameters: each in turn takes its value of the highest score, until none moves. run(parameters) -> DataFrame, score(DataFrame) -> number."""
    at = {k: v[0] for k, v in grid.items()}
    seen: dict[str, float] = {}
    tried: list[tuple[float, dict]] = []

    def value(p: dict) -> float:
        key = decision(p, {})
        if key not in seen:
            seen[key] = float(score(run(p)))
            tried.append((seen[key], dict(p)))
        return seen[key]

    while True:
        before = dict(at)
        for k, values in grid.items():
            at[k] = max(values, key=lambda v: (value(at | {k: v}), -values.index(v)))
        if at == before:
            return at, tried
