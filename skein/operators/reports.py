"""Reports of a run on itself: link agreement, lengths, jumps, gaps, with flags, scores and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from skein.operators import linkage as ln
from skein.operators import spatial
from skein.shared import kept, quantile

# Limits beyond which a run's ratio is flagged, and the weights and limits of a track's quality score.
RECIPROCITY, MEDIAN_LENGTH, JUMP_RATE, GHOST_RATE = 0.7, 4.0, 0.1, 0.4
LENGTH_WEIGHT, RECIPROCAL_WEIGHT, SMOOTH_WEIGHT, GAP_WEIGHT, GAP_MOST = 0.4, 0.3, 0.3, 0.1, 0.4
#: Turning angle in degrees and relative change of velocity beyond which two steps are a jump.
JUMP_ANGLE, JUMP_RATIO = 90.0, 1.0


def from_histogram(found: DataFrame, q: float, name: str) -> DataFrame:
    """One row: quantile with linear interpolation of values (v, n), n how often each occurs. The table has a row a value, few for lengths."""
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    at = F.lit(q) * (total - 1)
    rows = found.withColumn("upto", F.sum("n").over(order)).withColumn("lo", F.floor(at)).withColumn("part", at - F.floor(at))
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return rows.agg(value(F.col("lo")).alias("a"), value(F.col("lo") + 1).alias("b"), F.max("part").alias("part")).select((F.col("a") + F.coalesce(F.col("b") - F.col("a"), F.lit(0)) * F.col("part")).alias(name))


def jump(p: list[Column], q: list[Column], angle: float = JUMP_ANGLE, ratio: float = JUMP_RATIO) -> Column:
    """Whether the velocities p and q of two steps jump: their difference exceeds ratio times the mean speed, or they turn by more than angle degrees."""
    dot = p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    n1, n2 = ln._norm(p), ln._norm(q)
    mean = (n1 + n2) / 2
    turned = (dot < 0) if angle == 90.0 else dot / (n1 * n2) < F.cos(F.radians(F.lit(angle)))
    return (mean > 1e-9) & ((ln._norm([b - a for a, b in zip(p, q)]) > ratio * mean) | ((n1 > 1e-9) & (n2 > 1e-9) & turned))


def corners(tracks: DataFrame) -> DataFrame:
    """(trajid, frame, p*, q*): velocities before and after every interior point of tracks (trajid, frame, x, y, z), over the frames really between."""
    w = Window.partitionBy("trajid").orderBy("frame")
    before = [((F.col(a) - F.lag(a).over(w)) / (F.col("frame") - F.lag("frame").over(w))).alias(f"p{a}") for a in ln.AXES]
    after = [((F.lead(a).over(w) - F.col(a)) / (F.lead("frame").over(w) - F.col("frame"))).alias(f"q{a}") for a in ln.AXES]
    return tracks.select("trajid", "frame", *before, *after).where("px IS NOT NULL AND qx IS NOT NULL")


def reciprocal_tracks(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(hf, hid, frame, id, x, y, z) of all points on chains of mutual edges of two points or more; a point takes the nearest of several parents."""
    parents = edges.groupBy((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id")).agg(F.max(F.struct(F.col("frame").alias("pf"), F.col("i").alias("pid"))).alias("p")).select("frame", "id", "p.pf", "p.pid")
    ends = edges.select("frame", F.col("i").alias("id")).union(edges.select(F.col("frame") + F.col("step"), "k")).distinct()
    return ln.heads(ends, parents).join(rows.select("frame", "id", *ln.AXES), ["frame", "id"])


def consistency(rows: DataFrame, steps: int = ln.STEPS) -> DataFrame:
    """One row of a linkage's self-consistency: reciprocity, lengths of chains of mutual edges, jumps, isolated points, gaps, and what to flag."""
    pairs = kept(ln.mutual(rows, steps))
    edges = kept(pairs.groupBy("frame", "i", "k").agg(F.min("step").alias("step")).select("frame", "i", "step", "k"))
    back = pairs.select(F.col("frame") + F.col("step"), "k").distinct().agg(F.count("*").alias("back"))
    lim = F.broadcast(rows.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")))  # one row, as are all that are joined below
    p, n, f = F.col("prev").isNotNull(), F.col("next").isNotNull(), F.col("frame")
    counts = rows.crossJoin(lim).agg(
        F.count("*").alias("particles"), F.count_if(~p & ~n).alias("alone"), F.count_if((f > F.col("lo")) & ~p & n).alias("unlinked_starts"), F.count_if((f < F.col("hi")) & p & ~n).alias("unlinked_ends"),
        F.count_if((f < F.col("hi")) & n).alias("forward"), F.count_if((f > F.col("lo")) & p).alias("backward"), (F.max("hi") - F.max("lo") + 1).alias("frames"),
    )
    kinds = edges.agg(F.count("*").alias("both"), *[F.count_if(F.col("step") == s).alias("step_1" if s == 1 else f"gap_{s - 1}") for s in range(1, steps + 1)])
    tracks = kept(reciprocal_tracks(rows, edges).withColumn("trajid", F.struct("hf", "hid")))
    lengths = kept(tracks.groupBy("trajid").agg(F.count("*").alias("v")).groupBy("v").agg(F.count("*").alias("n")))
    long = lengths.agg(F.max("v").alias("max_length"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"))
    jumps = corners(tracks).agg(F.avg(jump([F.col(f"p{a}") for a in ln.AXES], [F.col(f"q{a}") for a in ln.AXES]).cast("double")).alias("jump"))
    one = counts.crossJoin(kinds).crossJoin(back).crossJoin(long).crossJoin(jumps)
    for q, name in ((0.5, "median"), (0.1, "p10"), (0.9, "p90")):
        one = one.crossJoin(from_histogram(lengths, q, name))
    c = F.col
    share = F.when(c("forward") > 0, c("both") / c("forward")).otherwise(0.0)
    ghosts = F.when(c("particles") > 0, c("alone") / c("particles")).otherwise(0.0)
    jump_rate, median = F.coalesce("jump", F.lit(0.0)), F.coalesce("median", F.lit(0.0))
    match = F.when(c("tracks") > 0, 1 - F.least(F.lit(1.0), F.abs(median - c("frames")) / c("frames"))).otherwise(0.0)
    return one.select(
        "particles", F.round(share, 6).alias("reciprocity"), "tracks", median.alias("median_length"), F.round(F.coalesce("p10", F.lit(0.0)), 6).alias("p10_length"), F.round(F.coalesce("p90", F.lit(0.0)), 6).alias("p90_length"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"), F.round(jump_rate, 6).alias("jump_rate"), F.round(ghosts, 6).alias("ghost_rate"), "step_1", *[f"gap_{s}" for s in range(1, steps)], "unlinked_starts", "unlinked_ends",
        (c("forward") - c("both")).alias("broken_forward"), (c("backward") - c("back")).alias("broken_backward"), F.round(match, 6).alias("length_match"),
        (share < RECIPROCITY).alias("low_reciprocity"), (median < MEDIAN_LENGTH).alias("short_tracks"), (jump_rate > JUMP_RATE).alias("many_jumps"), (ghosts > GHOST_RATE).alias("many_ghosts"),
    )


def text(report: Row) -> str:
    """A report as lines of text."""
    flags = [n.replace("_", " ") for n in ("low_reciprocity", "short_tracks", "many_jumps", "many_ghosts") if report[n]]
    return "\n".join([
        f"points           {report['particles']}",
        f"reciprocity      {report['reciprocity']:.3f}",
        f"track lengths    n={report['tracks']} median={report['median_length']:.1f} p10={report['p10_length']:.1f} p90={report['p90_length']:.1f} max={report['max_length']}",
        f"jump rate        {report['jump_rate']:.3f}",
        f"ghost rate       {report['ghost_rate']:.3f}",
        "links            " + " ".join(f"{k}={report[k]}" for k in ("step_1", "gap_1", "gap_2", "unlinked_starts", "unlinked_ends", "broken_forward", "broken_backward")),
        "warnings         " + (", ".join(flags) or "none"),
    ])


def kink_statistics(edges: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """One row: median kink and step of edges of one step, their ratio, and the mean over frames of more than ten points of the median number of neighbours."""
    kink = quantile(ln.onward(edges, points), F.col("kink"), 0.5)
    one = edges.where("step = 1").join(ln._at(points, "i"), ["frame", "i"]).join(ln._at(points, "k", 1), ["frame", "k"])
    step = quantile(one, ln._norm([F.col(f"k{a}") - F.col(f"i{a}") for a in ln.AXES]), 0.5)
    near = spatial.neighbour_counts(points.select("frame", "id", *ln.AXES), radius, "id").groupBy("frame", F.col("neighbours").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("frame").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("frame"))
    ranked = near.withColumn("upto", F.sum("n").over(w)).withColumn("total", total).where("total > 10")
    middle = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    medians = ranked.groupBy("frame").agg(((middle(F.floor((F.col("total") - 1) / 2)) + middle(F.floor(F.col("total") / 2))) / 2).alias("m"))
    ratio = kink / step if kink is not None and step else None
    number = lambda x: F.round(F.lit(x).cast("double"), 6)
    return medians.agg(F.round(F.avg("m"), 6).alias("neighbours")).select(number(kink).alias("median_kink"), number(step).alias("median_step"), number(ratio).alias("ratio"), "neighbours")


def track_scores(rows: DataFrame, target: int | None = None) -> DataFrame:
    """(frame, id, score) of every point of a linkage: 0.4 length + 0.3 reciprocity + 0.3 smoothness - a penalty of gaps of its chain, within 0 .. 1.

    Chains follow each next that its end returns within STEPS frames, or else to the next frame, as a one-sided edge; single points score 0, and
    chains of two points are half smooth. Of several edges into one point, the mutual and shortest counts.
    """
    lim = rows.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
    if lim["lo"] is None:
        return rows.select("frame", "id", F.lit(0.0).alias("score"))
    target = max(1, lim["hi"] - lim["lo"] + 1) if target is None else target
    both = kept(ln.links(rows).withColumn("mutual", F.lit(True)))
    there = rows.select((F.col("frame") - 1).alias("frame"), F.col("id").alias("k"))
    lone = rows.where("next IS NOT NULL").select("frame", F.col("id").alias("i"), F.lit(1).cast("long").alias("step"), F.col("next").alias("k")).join(there, ["frame", "k"], "left_semi").join(both.select("frame", "i"), ["frame", "i"], "left_anti")
    edges = both.unionByName(lone.withColumn("mutual", F.lit(False)))
    best = F.max(F.struct(F.col("mutual"), F.col("frame").alias("pf"), F.col("i").alias("pid")))
    parents = kept(edges.groupBy((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id")).agg(best.alias("b")).select("frame", "id", "b.pf", "b.pid", "b.mutual"))
    found = ln.heads(rows, parents.select("frame", "id", "pf", "pid")).join(rows.select("frame", "id", *ln.AXES), ["frame", "id"]).join(parents.select("frame", "id", "pf", "mutual"), ["frame", "id"], "left").withColumn("trajid", F.struct("hf", "hid"))
    found = kept(found)
    kinks = corners(found).groupBy("trajid").agg(F.count_if(jump([F.col(f"p{a}") for a in ln.AXES], [F.col(f"q{a}") for a in ln.AXES])).alias("kinks"))
    sums = found.groupBy("trajid").agg(F.count("*").alias("n"), F.count("pf").alias("edges"), F.count_if("mutual").alias("both"), F.count_if(F.col("frame") - F.col("pf") > 1).alias("gaps")).join(kinks, "trajid", "left")
    n, e = F.col("n"), F.col("edges")
    smooth = F.when(n < 3, 0.5).otherwise(1 - F.coalesce("kinks", F.lit(0)) / (n - 2))
    raw = LENGTH_WEIGHT * F.least(F.lit(1.0), e / float(max(1, target - 1))) + RECIPROCAL_WEIGHT * F.col("both") / e + SMOOTH_WEIGHT * smooth - F.least(F.lit(GAP_MOST), GAP_WEIGHT * F.col("gaps") / e)
    score = F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return found.join(sums.select("trajid", F.round(score, 6).alias("score")), "trajid").select("frame", "id", "score")
