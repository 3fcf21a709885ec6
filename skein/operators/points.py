"""Quality of 3D points and of the blobs they share: support, ray misses, ghosts, brightness, uniqueness.

Points are rows (frame, id, x, y, z, cam_ids) with cam_ids an array of target numbers (negative: not seen); members of blobs are rows (frame, cam, blob, id, ...).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry
from skein.operators.linkage import AXES, heads
from skein.shared import kept, quantile

#: Four-camera points below which no line is fitted, and bins of the fit.
LEAST_FIT, FIT_BINS = 200, 12


def seen(cam_ids: str = "cam_ids") -> Column:
    """Number of cameras that see a point."""
    return F.size(F.filter(cam_ids, lambda c: c >= 0)).cast("long")


def seen_mask(cam_ids: str = "cam_ids") -> Column:
    return F.transform(cam_ids, lambda c: c >= 0)


def valid_cameras(xy: str = "xy") -> Column:
    """Of a particle's array of image places, which are there."""
    return F.transform(xy, lambda c: c.isNotNull())


def filter_low_support(points: DataFrame, least: int = 3) -> DataFrame:
    """Points that `least` cameras see. The table given stays as it is, so nothing is lost."""
    return points.where(seen() >= least)


def low_support_counts(points: DataFrame, least: int = 3) -> DataFrame:
    """(frame, dropped): points of each frame that too few cameras see."""
    return points.groupBy("frame").agg(F.count_if(seen() < least).alias("dropped"))


def centre_distance(points: DataFrame, centre: tuple | None = None) -> DataFrame:
    """Points with dist, the distance from a centre; by default the mean of all points."""
    if centre is None:
        row = points.agg(*[F.avg(a).alias(a) for a in AXES]).first()
        centre = tuple(row[a] or 0.0 for a in AXES)
    d = [F.col(a) - F.lit(float(c)) for a, c in zip(AXES, centre)]
    return points.withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def normalize_rcm(points: DataFrame, centre: tuple | None = None) -> DataFrame:
    """Points with rel: ray miss over its least-squares line in the distance from the centre; a denominator within 1e-6 of zero counts as 1e-6."""
    rows = centre_distance(points, centre)
    line = F.broadcast(rows.agg(F.regr_slope("rcm", "dist").alias("_a"), F.regr_intercept("rcm", "dist").alias("_b")))  # one row
    below = F.col("_a") * F.col("dist") + F.col("_b")
    return rows.crossJoin(line).withColumn("rel", F.col("rcm") / F.when(F.abs(below) < 1e-6, 1e-6).otherwise(below)).drop("_a", "_b", "dist")


def aware_threshold(points: DataFrame, base: float = 1.0, centre: tuple | None = None) -> DataFrame:
    """Points with threshold: base * (1 + distance / largest distance)."""
    rows = centre_distance(points, centre)
    far = F.broadcast(rows.agg(F.max("dist").alias("_far")))  # one row
    largest = F.when(F.coalesce(F.col("_far"), F.lit(0.0)) < 1e-9, 1.0).otherwise(F.col("_far"))
    return rows.crossJoin(far).withColumn("threshold", base * (1 + F.col("dist") / largest)).drop("_far", "dist")


def cycle_consistency(cam_ids: str = "cam_ids") -> Column:
    """(cameras that see it / cameras) squared."""
    share = seen(cam_ids) / F.size(cam_ids)
    return share * share


def epipolar_consistency(rcm: Column | None = None, cam_ids: str = "cam_ids") -> Column:
    """0 for points of fewer than two cameras, exp(-rcm / 5) where a miss is known, else the share of cameras."""
    n = seen(cam_ids)
    share = n / F.size(cam_ids)
    known = share if rcm is None else F.when(rcm.isNotNull() & (rcm >= 0), F.exp(-rcm / 5.0)).otherwise(share)
    return F.when(n < 2, 0.0).otherwise(known)


def doubtful_tracks(tracks: DataFrame, points: DataFrame, least: float = 0.5) -> DataFrame:
    """trajid and consistency of tracks (trajid, frame, id) of two points or more whose points' mean consistency is below least."""
    rcm = F.col("rcm") if "rcm" in points.columns else None
    scored = points.select("frame", "id", epipolar_consistency(rcm).alias("c"))
    sums = tracks.join(scored, ["frame", "id"], "left").groupBy("trajid").agg(F.count("*").alias("n"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("consistency"))
    return sums.where((F.col("n") >= 2) & (F.col("consistency") < least)).select("trajid", "consistency")


def smooth_tracks(tracks: DataFrame, most: float) -> DataFrame:
    """trajid of tracks whose root mean square of second differences, all components pooled, is at most `most`."""
    from skein.operators import kinematics

    return kinematics.acceleration_residual(tracks, AXES).where(F.col("residual") <= most).select("trajid")


def track_scores(tracks: DataFrame) -> DataFrame:
    """(trajid, score): points / (1 + acceleration residual); 0 for single points."""
    from skein.operators import kinematics

    n = F.col("n_points")
    return kinematics.acceleration_residual(tracks, AXES).select("trajid", F.when(n < 2, 0.0).otherwise(n / (1 + F.col("residual"))).alias("score"))


# --- ghosts ----------------------------------------------------------------------------------------------------------------------------


def fit_scale(points: DataFrame, centre: tuple | None = None) -> tuple[tuple[float, float, float], float, float]:
    """(centre, a, b): typical ray miss a + b * distance, a line through the medians of 12 bins of equally many four-camera points.

    With fewer than 200 such points the median miss of all points and no slope. The centre is the median of each axis.
    """
    if centre is None:
        centre = tuple(quantile(points, F.col(a), 0.5) or 0.0 for a in AXES)
    good = centre_distance(points.where((seen() >= 4) & F.col("rcm").isNotNull() & ~F.isnan("rcm")), centre)
    if good.count() < LEAST_FIT:
        return centre, quantile(points, F.col("rcm"), 0.5), 0.0
    good = kept(good.select("dist", "rcm"))
    cuts = [quantile(good, F.col("dist"), k / FIT_BINS) for k in range(1, FIT_BINS)]
    xs, ys = [], []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = good
        part = part if low is None else part.where(F.col("dist") >= low)
        part = part if high is None else part.where(F.col("dist") < high)
        x, y = quantile(part, F.col("dist"), 0.5), quantile(part, F.col("rcm"), 0.5)
        if x is not None:
            xs.append(x)
            ys.append(y)
    slope, level = np.polyfit(xs, ys, 1) if len(set(xs)) > 1 else (0.0, ys[0])
    return centre, float(level), float(slope)


def ghosts(points: DataFrame, scale: tuple, spread: str | None = None) -> DataFrame:
    """Points with ghost, their probability of being ghosts, by their miss relative to the scale's line; with the spread of brightness if given."""
    centre, level, slope = scale
    rows = centre_distance(points, centre)
    typical = F.lit(level) + F.lit(slope) * F.col("dist")
    law = geometry.ghost_probability(F.col("rcm"), seen(), typical) if spread is None else geometry.ghost_with_brightness(F.col("rcm"), seen(), typical, F.col(spread))
    return rows.withColumn("ghost", law).drop("dist")


def brightness_spread(rows: DataFrame) -> DataFrame:
    """(frame, id, spread): standard deviation over cameras of a point's log brightness (frame, id, cam, sumg) less the camera's median; sums below 1 count as 1."""
    logs = kept(rows.where("sumg IS NOT NULL").select("frame", "id", "cam", F.log(F.greatest(F.col("sumg").cast("double"), F.lit(1.0))).alias("b")))
    cams = [r["cam"] for r in logs.select("cam").distinct().collect()]  # a handful
    middle = {c: quantile(logs.where(F.col("cam") == c), F.col("b"), 0.5) for c in cams}
    off = F.element_at(F.create_map(*[F.lit(v) for c in cams for v in (c, middle[c])]), F.col("cam")) if cams else F.lit(0.0)
    return logs.groupBy("frame", "id").agg(F.stddev_pop(F.col("b") - off).alias("spread"))


# --- conflicts -------------------------------------------------------------------------------------------------------------------------


def _uses(points: DataFrame) -> DataFrame:
    return points.select("frame", "id", F.posexplode("cam_ids").alias("cam", "target")).where("target >= 0")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of edges (a, b) of any type: the smallest node of each connected set. Minima spread along edges and along labels, so long chains take few rounds."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hop = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("c2"))
        new = kept(hop.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("c2", "comp")).alias("comp")))
        label = new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            return label


def conflict_components(points: DataFrame) -> DataFrame:
    """(frame, id, comp): points of a frame that share targets, directly or through others, by their smallest id; a target's users meet its smallest one, not each other."""
    uses = _uses(points)
    first = uses.groupBy("frame", "cam", "target").agg(F.min("id").alias("lead"))
    edges = uses.join(first, ["frame", "cam", "target"]).where("id <> lead").select(F.struct("frame", "lead").alias("a"), F.struct("frame", F.col("id").alias("lead")).alias("b"))
    found = components(edges).select("node.frame", F.col("node.lead").alias("id"), F.col("comp.lead").alias("comp"))
    return points.select("frame", "id").join(found, ["frame", "id"], "left").select("frame", "id", F.coalesce("comp", "id").alias("comp"))


def component_sizes(found: DataFrame) -> DataFrame:
    """(frame, comp, size, kind): trivial, bipartite or ilp for one, two and more members."""
    n = found.groupBy("frame", "comp").agg(F.count("*").alias("size"))
    return n.withColumn("kind", F.when(F.col("size") <= 1, "trivial").when(F.col("size") == 2, "bipartite").otherwise("ilp"))


def unique_points(points: DataFrame, conf: str | None = None, most: int = 20) -> DataFrame:
    """Points with keep: of each component the choice of greatest total confidence in which no target is used twice, exact up to `most` members, else most confident
    first. Of two points the more confident stays, the first of equal ones."""
    found = kept(conflict_components(points))
    rows = points.select("frame", "id", "cam_ids", (F.col(conf) if conf else F.lit(1.0)).cast("double").alias("_conf")).join(found, ["frame", "id"])
    single = found.groupBy("frame", "comp").agg(F.count("*").alias("n"))
    rows = rows.join(single, ["frame", "comp"])

    def run(batch):
        from skein.engines import assignment

        batch = batch.sort_values("id")
        sets = [{(c, t) for c, t in enumerate(ids) if t >= 0} for ids in batch["cam_ids"]]
        keep = np.zeros(len(batch), bool)
        keep[assignment.independent(sets, batch["_conf"].to_numpy(), most)] = True
        return batch[["frame", "id"]].assign(keep=keep)

    alone = rows.where("n = 1").select("frame", "id", F.lit(True).alias("keep"))
    chosen = rows.where("n > 1").groupBy("frame", "comp").applyInPandas(run, "frame long, id long, keep boolean")
    return points.join(alone.union(chosen), ["frame", "id"])


def unique_tracks(uses: DataFrame, scores: DataFrame, most: int = 50) -> DataFrame:
    """(trajid, keep) of tracks that share observations (trajid, frame, cam, target): the choice of greatest total score (trajid, score) in each component."""
    first = uses.groupBy("frame", "cam", "target").agg(F.min("trajid").alias("lead"))
    edges = uses.join(first, ["frame", "cam", "target"]).where("trajid <> lead").select(F.col("lead").alias("a"), F.col("trajid").alias("b"))
    comp = components(edges)
    rows = scores.join(comp.withColumnRenamed("node", "trajid"), "trajid", "left")
    sets = uses.groupBy("trajid").agg(F.collect_set(F.struct("frame", "cam", "target")).alias("obs"))
    loose = rows.where("comp IS NULL").select("trajid", F.lit(True).alias("keep"))

    def run(batch):
        from skein.engines import assignment

        batch = batch.sort_values("trajid")
        obs = [{tuple(o.values()) if isinstance(o, dict) else tuple(o) for o in v} for v in batch["obs"]]
        keep = np.zeros(len(batch), bool)
        keep[assignment.independent(obs, batch["score"].to_numpy(float), most)] = True
        return batch[["trajid"]].assign(keep=keep)

    chosen = rows.where("comp IS NOT NULL").join(sets, "trajid").groupBy("comp").applyInPandas(run, "trajid long, keep boolean")
    return loose.union(chosen)


def prune_claimed(points: DataFrame, claimed: DataFrame) -> DataFrame:
    """Points none of whose targets is claimed (frame, cam, target)."""
    taken = _uses(points).join(claimed.select("frame", "cam", "target"), ["frame", "cam", "target"], "left_semi").select("frame", "id").distinct()
    return points.join(taken, ["frame", "id"], "left_anti")


def peel(points: DataFrame, n: int = 3) -> DataFrame:
    """Points with layer by falling camera support in each frame (tracking.layers)."""
    from skein.operators import tracking

    return tracking.layers(points.withColumn("_s", seen()), "_s", n).drop("_s")


def ilp_wanted(choice, ghost_rate: float = 0.0, density: float = 0.0) -> bool:
    """Whether to solve conflicts exactly: as chosen, or if ghosts exceed 15 percent or a frame holds 500 points or more."""
    word = str(choice).strip().lower()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in ("0", "false", "no", "off"):
        return False
    return ghost_rate > 0.15 or density >= 500.0


# --- shared blobs ----------------------------------------------------------------------------------------------------------------------


def shared_blobs(members: DataFrame) -> DataFrame:
    """Members with share: how many points of the frame use their blob."""
    return members.withColumn("share", F.count("*").over(Window.partitionBy("frame", "cam", "blob")))


def signatures(members: DataFrame, q: float = 0.5) -> DataFrame:
    """(trajid, cam, signature): a track's median brightness in a camera over the frames in which it has its blob to itself; members (trajid, frame, cam, blob, sumg)."""
    alone = shared_blobs(members).where("share = 1 AND sumg > 0")
    return alone.groupBy("trajid", "cam").agg(F.expr(f"percentile(sumg, {q})").alias("signature"))


def row_signatures(members: DataFrame, q: float = 0.5) -> DataFrame:
    """Members with their track's signature in their camera; null where it has none."""
    return members.join(signatures(members, q), ["trajid", "cam"], "left")


def shares(g: str = "g") -> Column:
    """Share of each member in its blob's brightness; g <= 0 counts as the median of the positive ones, and all as equal where none is."""
    blob = Window.partitionBy("frame", "cam", "blob")
    good = F.when(F.col(g) > 0, F.col(g).cast("double"))
    filled = F.coalesce(good, F.median(good).over(blob), F.lit(1.0))
    return filled / F.sum(filled).over(blob)


def split_blobs(members: DataFrame, var_centre: float, effective: bool = False, least: float = 0.05) -> DataFrame:
    """Corrected pixel place and variance of every member (frame, cam, blob, id, u, v predicted, var, g brightness) of a blob at (cu, cv).

    The centre is the brightness-weighted mean of its members: a member gets the part of what is left over that its weight and variance bear. Alone, the
    prediction and the centre are blended by their variances. effective: without its own prediction, from the centre and the others, shares not below `least`.
    """
    blob = Window.partitionBy("frame", "cam", "blob")
    rows = members.withColumn("_w", shares())
    if effective:
        rows = rows.withColumn("_w", F.greatest("_w", F.lit(least))).withColumn("_w", F.col("_w") / F.sum("_w").over(blob))
    w, var = F.col("_w"), F.col("var")
    many = F.count("*").over(blob)
    mean = {c: F.sum(w * F.col(c)).over(blob) for c in "uv"}
    if effective:
        place = {c: F.when(many == 1, F.col(f"c{c}")).otherwise((F.col(f"c{c}") - mean[c] + w * F.col(c)) / w) for c in "uv"}
        noise = F.when(many == 1, F.lit(var_centre)).otherwise((var_centre + F.sum(w * w * var).over(blob) - w * w * var) / (w * w))
    else:
        total = F.sum(w * w * var).over(blob) + var_centre
        gain = F.when(many == 1, var / (var + var_centre)).otherwise(var * w / total)
        place = {c: F.col(c) + gain * (F.col(f"c{c}") - mean[c]) for c in "uv"}
        noise = F.when(many == 1, var * var_centre / (var + var_centre)).otherwise(var * (1 - w * w * var / total))
    out = rows.select("frame", "cam", "blob", "id", *[p.alias(f"s{c}") for c, p in place.items()], noise.alias("s_var"))
    return out


def chains(linkage: DataFrame) -> DataFrame:
    """(hf, hid, frame, id): the head of every point's chain, over mutual links of up to three steps (linkage.chain)."""
    from skein.operators import linkage as ln

    return heads(linkage, ln.chain(linkage))
