"""Window operators over trajectories: rows (trajid, frame, x[, y, z]), unique by (trajid, frame)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import kept, quantile


def _track():
    return Window.partitionBy("trajid").orderBy("frame")


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def velocity(rows: DataFrame, axes=("x",)) -> DataFrame:
    """Finite difference to the previous point; null at a track's first."""
    step = F.col("frame") - F.lag("frame").over(_track())
    return rows.select("trajid", "frame", *[((F.col(a) - F.lag(a).over(_track())) / step).alias(f"v{a}") for a in axes])


def acceleration(rows: DataFrame, axes=("x",)) -> DataFrame:
    """Second difference at interior points: previous - 2 * current + next."""
    out = rows.select("trajid", "frame", *[(F.lead(a).over(_track()) - 2 * F.col(a) + F.lag(a).over(_track())).alias(f"a{a}") for a in axes])
    return out.where(" AND ".join(f"a{a} IS NOT NULL" for a in axes))


def acceleration_residual(rows: DataFrame, axes=("x",)) -> DataFrame:
    """Root mean square of second differences of every track; 0 for fewer than three points."""
    found = acceleration(rows, axes).groupBy("trajid").agg(F.sum(_total([F.col(f"a{a}") * F.col(f"a{a}") for a in axes])).alias("s"), F.count("*").alias("n"))
    points = rows.groupBy("trajid").agg(F.count("*").alias("n_points"))
    return points.join(found, "trajid", "left").select("trajid", "n_points", F.coalesce(F.sqrt(F.col("s") / (F.col("n") * len(axes))), F.lit(0.0)).alias("residual"))


def kurtosis(rows: DataFrame, axes=("x",), dt: float = 1.0) -> DataFrame:
    """avg(a^4) / avg(a^2)^2 about zero of the accelerations at points whose neighbours are in the frames next to theirs, components pooled; null under two samples."""
    near = rows.select("trajid", "frame", *axes, (F.lead("frame").over(_track()) - F.lag("frame").over(_track())).alias("_span"))
    a = [(F.lead(x).over(_track()) - 2 * F.col(x) + F.lag(x).over(_track())) / (dt * dt) for x in axes]
    found = near.select("_span", *[c.alias(f"a{x}") for c, x in zip(a, axes)]).where("_span = 2").select(F.explode(F.array(*[F.col(f"a{x}") for x in axes])).alias("a"))
    square = F.col("a") * F.col("a")
    sums = found.agg(F.count("*").alias("n"), F.avg(square).alias("m2"), F.avg(square * square).alias("m4"))
    return sums.select(F.col("n").alias("samples"), F.when((F.col("n") >= 2) & (F.col("m2") > 0), F.round(F.col("m4") / (F.col("m2") * F.col("m2")), 6)).alias("kurtosis"))


def life(rows: DataFrame) -> DataFrame:
    """One row (tracks, mean_length, over_10, over_30): how long tracks are, and the shares of more than 10 and 30 points."""
    lengths = rows.groupBy("trajid").agg(F.count("*").alias("n"))
    return lengths.agg(F.count("*").alias("tracks"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(k) for k, c in (("mean_length", F.avg("n")), ("over_10", F.avg((F.col("n") > 10).cast("double"))), ("over_30", F.avg((F.col("n") > 30).cast("double"))))])


def physics(rows: DataFrame, axes=("x",), weight: float = 2.0, typical: float = 3.0) -> DataFrame:
    """life() and kurtosis() in one row with fluidity = mean length - weight * (kurtosis - typical, if above); null without tracks."""
    both = life(rows).crossJoin(kurtosis(rows, axes))  # one row each
    excess = F.coalesce(F.greatest(F.lit(0.0), F.col("kurtosis") - typical), F.lit(0.0))
    return both.withColumn("fluidity", F.when((F.col("tracks") > 0) & (F.col("mean_length") > 0), F.round(F.col("mean_length") - weight * excess, 6)))


def noise_sigma(rows: DataFrame, axis: str = "x", least: int = 5) -> DataFrame:
    """Position noise from the lag-1 covariance of second differences, one row (samples, pairs, sigma).

    Only points of consecutive frames in tracks of `least` points count; differences beyond six robust deviations are left out.
    sigma is 0 with fewer than ten samples or pairs. The medians are exact and no task holds the differences (shared.quantile).
    """
    frame, point = F.col("frame"), F.col(axis)
    run = (frame - F.lag("frame", 2).over(_track()) == 2) & (frame - F.lag("frame").over(_track()) == 1)
    second = F.when(run & (F.count("*").over(Window.partitionBy("trajid")) >= least), point - 2 * F.lag(axis).over(_track()) + F.lag(axis, 2).over(_track()))
    found = kept(rows.select("trajid", "frame", second.alias("a")).select("a", F.lag("a").over(_track()).alias("b")).where("a IS NOT NULL"))
    middle = quantile(found, F.col("a"), 0.5)
    mad = quantile(found, F.abs(F.col("a") - F.lit(middle)), 0.5) if middle is not None else None
    good = F.col("b").isNotNull() & (F.greatest(F.abs("a"), F.abs("b")) <= F.lit(6 * 1.4826 * (mad or 0.0)))
    sums = found.agg(F.count("*").alias("samples"), F.count_if(good).alias("pairs"), F.avg(F.when(good, F.col("a") * F.col("b"))).alias("c"))
    enough = (F.col("samples") >= 10) & (F.col("pairs") >= 10)
    return sums.select("samples", "pairs", F.round(F.when(enough, F.sqrt(F.greatest(-F.col("c") / 4, F.lit(0.0)))).otherwise(0.0), 6).alias("sigma"))


def step_statistics(rows: DataFrame, axes=("x", "y", "z"), least: int = 5) -> DataFrame:
    """One row: links between consecutive frames in tracks of `least` points, the 99.9th percentile of their absolute step an axis, the median step, the noise an axis and that of a step."""
    step = [(F.col(a) - F.lag(a).over(_track())).alias(f"d{a}") for a in axes]
    one = F.col("frame") - F.lag("frame").over(_track()) == 1
    found = kept(rows.select("trajid", one.alias("one"), (F.count("*").over(Window.partitionBy("trajid")) >= least).alias("long"), *step).where("one AND long"))
    length = F.sqrt(_total([F.col(f"d{a}") * F.col(f"d{a}") for a in axes]))
    far = {a: quantile(found, F.abs(f"d{a}"), 0.999) for a in axes}
    middle = quantile(found, length, 0.5)
    noise = {a: noise_sigma(rows, a, least).first()["sigma"] for a in axes}
    number = lambda x: F.round(F.lit(x).cast("double"), 6)
    whole = (2 * sum(v * v for v in noise.values())) ** 0.5
    return found.agg(F.count("*").alias("links")).select("links", *[number(v).alias(f"p999_{a}") for a, v in far.items()], number(middle).alias("median_step"), *[number(v).alias(f"noise_{a}") for a, v in noise.items()], number(whole).alias("step_noise"))


def _corner(axes) -> tuple[list[Column], list[Column]]:
    before = [F.col(a) - F.lag(a).over(_track()) for a in axes]
    after = [F.lead(a).over(_track()) - F.col(a) for a in axes]
    return before, after


def turning(rows: DataFrame, axes=("x", "y", "z")) -> DataFrame:
    """Turning angle in gon and norm of the velocity change at interior points: opposite 200, equal or a zero step 0."""
    v0, v1 = _corner(axes)
    names = [f"p{a}" for a in axes], [f"q{a}" for a in axes]
    steps = rows.select("trajid", "frame", *[c.alias(n) for c, n in zip(v0 + v1, names[0] + names[1])]).where(f"{names[0][0]} IS NOT NULL AND {names[1][0]} IS NOT NULL")
    p, q = ([F.col(n) for n in x] for x in names)
    n0, n1 = F.sqrt(_total([c * c for c in p])), F.sqrt(_total([c * c for c in q]))
    same = reduce(lambda a, b: a & b, [a == b for a, b in zip(p, q)])
    opposite = reduce(lambda a, b: a & b, [a == -b for a, b in zip(p, q)])
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _total([a * b for a, b in zip(p, q)]) / (n0 * n1)))
    angle = F.when((n0 == 0) | (n1 == 0) | same, 0.0).when(opposite, 200.0).otherwise(F.acos(cosine) * 200 / F.lit(3.141592653589793))
    return steps.select("trajid", "frame", F.round(angle, 6).alias("angle"), F.round(F.sqrt(_total([(b - a) * (b - a) for a, b in zip(p, q)])), 6).alias("acc"))


def velocity_jumps(rows: DataFrame, axes=("x",), ratio: float = 1.0) -> DataFrame:
    """Share of interior points where the velocity changes by more than ratio times the mean speed, or turns by over 90 degrees."""
    v0, v1 = _corner(axes)
    names = [f"p{a}" for a in axes], [f"q{a}" for a in axes]
    steps = rows.select("trajid", *[c.alias(n) for c, n in zip(v0 + v1, names[0] + names[1])]).where(f"{names[0][0]} IS NOT NULL AND {names[1][0]} IS NOT NULL")
    p, q = ([F.col(n) for n in x] for x in names)
    mean = (F.sqrt(_total([c * c for c in p])) + F.sqrt(_total([c * c for c in q]))) / 2
    change = F.sqrt(_total([(b - a) * (b - a) for a, b in zip(p, q)]))
    jump = (mean > 1e-9) & ((change > ratio * mean) | (_total([a * b for a, b in zip(p, q)]) < 0))
    return steps.groupBy("trajid").agg(F.count("*").alias("corners"), F.count_if(jump).alias("jumps"))


def lifetimes(rows: DataFrame) -> DataFrame:
    """How many tracks have each number of points."""
    return rows.groupBy("trajid").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("tracks"))


def index(rows: DataFrame) -> DataFrame:
    """First and last frame and length of every track."""
    return rows.groupBy("trajid").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length"))


def drop_spikes(rows: DataFrame, score: str, above: float, jump: float) -> DataFrame:
    """Drop interior points whose score exceeds above and the mean of both neighbours' by more than jump."""
    before, after = F.lag(score).over(_track()), F.lead(score).over(_track())
    marked = rows.withColumn("spike", F.coalesce((F.col(score) > above) & (F.col(score) - (before + after) / 2 > jump), F.lit(False)))
    return marked.where("NOT spike").drop("spike")


def trim_ends(rows: DataFrame, score: str, above: float, most: int = 3, share: float = 0.25) -> DataFrame:
    """Trim runs of points whose score exceeds above from both ends: at most `most` points an end and `share` of the track."""
    back = Window.partitionBy("trajid").orderBy(F.col("frame").desc())
    good = F.when(F.col(score) <= above, 1).otherwise(0)
    all_ = Window.partitionBy("trajid")
    marked = rows.withColumn("n", F.count("*").over(all_)).withColumn("i", F.row_number().over(_track())).withColumn("j", F.row_number().over(back))
    marked = marked.withColumn("g0", F.sum(good).over(_track())).withColumn("g1", F.sum(good).over(back))
    limit = F.least(F.lit(most).cast("long"), F.floor(F.col("n") * share))
    cut = ((F.col("g0") == 0) & (F.col("i") <= limit)) | ((F.col("g1") == 0) & (F.col("j") <= limit))
    return marked.where(~cut).drop("n", "i", "j", "g0", "g1")


def fill_gaps(rows: DataFrame, axes=("x",), most: int = 4, cubic: bool = False) -> DataFrame:
    """Points for missing frames where a gap has at most `most` frames, on the line between its ends or, if cubic, on the Hermite cubic whose end velocities are
    those of the steps before and after (of the gap itself where there is none); filled marks them."""
    w = _track()
    nxt = rows.withColumn("to", F.lead("frame").over(w))
    step = lambda a, far, near: (far - near) / F.greatest(F.lit(1), a)
    for a in axes:
        nxt = nxt.withColumn(f"{a}1", F.lead(a).over(w))
        if cubic:
            line = (F.lead(a).over(w) - F.col(a)) / (F.lead("frame").over(w) - F.col("frame"))
            nxt = nxt.withColumn(f"{a}v0", F.coalesce(step(F.col("frame") - F.lag("frame").over(w), F.col(a), F.lag(a).over(w)), line))
            nxt = nxt.withColumn(f"{a}v1", F.coalesce(step(F.lead("frame", 2).over(w) - F.lead("frame").over(w), F.lead(a, 2).over(w), F.lead(a).over(w)), line))
    gap = F.coalesce(F.col("to") - F.col("frame") - 1, F.lit(0))
    steps = nxt.withColumn("k", F.explode(F.when((gap > 0) & (gap <= most), F.sequence(F.lit(0).cast("long"), gap)).otherwise(F.array(F.lit(0).cast("long")))))
    span = F.col("to") - F.col("frame")

    def value(a):
        if not cubic:
            return F.when(F.col("k") == 0, F.col(a)).otherwise(F.col(a) + (F.col(f"{a}1") - F.col(a)) * F.col("k") / span)
        u = F.col("k") / span
        curve = (2 * u * u * u - 3 * u * u + 1) * F.col(a) + (u * u * u - 2 * u * u + u) * span * F.col(f"{a}v0") + (3 * u * u - 2 * u * u * u) * F.col(f"{a}1") + (u * u * u - u * u) * span * F.col(f"{a}v1")
        return F.when(F.col("k") == 0, F.col(a)).otherwise(F.round(curve, 6))

    return steps.select("trajid", (F.col("frame") + F.col("k")).alias("frame"), *[value(a).alias(a) for a in axes], (F.col("k") > 0).alias("filled"))


def savgol(rows: DataFrame, axis: str = "x") -> DataFrame:
    """Quadratic Savitzky-Golay smoothing over five points, unit weights; interior points only."""
    at = lambda k: F.lag(axis, k).over(_track()) if k > 0 else F.lead(axis, -k).over(_track())
    value = (-3 * at(2) + 12 * at(1) + 17 * F.col(axis) + 12 * at(-1) - 3 * at(-2)) / 35
    return rows.select("trajid", "frame", F.round(value, 6).alias("smooth")).where("smooth IS NOT NULL")


def sessions(rows: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Sessions of events (user_id, ts): those closer than gap belong together."""
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")
