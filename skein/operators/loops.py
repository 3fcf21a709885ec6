"""Loops in which matching and tracking help each other: refined points of shared blobs, the holistic loop, and tracking in layers from the surest points down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import shared
from skein.functions.optics import Camera, Volume
from skein.operators import calibrate, corrective, linkage, merging, pieces, points, stereo, tracking, windows

XYZ = ("x", "y", "z")


def _images(rows: DataFrame, who: DataFrame, rig: list[Camera], u: str, v: str) -> DataFrame:
    """who (frame, id, cam, ...) with the images of rows (frame, id, x, y, z) in their cameras."""
    seen = stereo.project(rows.select("frame", "id", *XYZ), rig).select("frame", "id", "cam", F.col("u").alias(u), F.col("v").alias(v))
    return who.withColumn("cam", F.col("cam").cast("long")).join(seen, ["frame", "id", "cam"], "left")


def refine_merged(
    rows: DataFrame, members: DataFrame, blobs: DataFrame, signatures: DataFrame, rig: list[Camera], rounds: int = 3, window: int = 9, order: int = 2, var_centre: float = 0.01, gate: float = 4.0, prior: bool = True
) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Points of tracks refined where several share a blob, by turns: where its path leads tells a point's part of a blob, its parts of blobs tell where it is.

    rows: (trajid, frame, id, x, y, z); members: (frame, id, cam, blob); blobs: (frame, cam, blob, x, y, sumg, ...); signatures: (trajid, cam, signature).
    Each round: a track's local polynomial without the point itself predicts it; a blob's centre is dealt to its members by brightness (points.split_blobs, effective); parts farther
    than `gate` deviations from the prediction are left out; points are fitted to their weighted images and, with prior, to the prediction.
    Returns the rows, the observations of the last round (frame, id, cam, u, v, var, pu, pv) and for each round var (of predictions, square pixels), gated, and error (mean square pixel distance of blobs to the weighted images of their members).
    Tracks too short for a prediction take blobs' centres. Groups are a track or a blob.
    """
    blob = blobs.select("frame", F.col("cam").cast("long").alias("cam"), "blob", F.col("x").alias("cu"), F.col("y").alias("cv"))
    who = members.select("frame", "id", F.col("cam").cast("long").alias("cam"), "blob").join(blob, ["frame", "cam", "blob"])
    share = who.groupBy("frame", "cam", "blob").agg(F.count("*").alias("share"))
    who = who.join(share, ["frame", "cam", "blob"]).join(rows.select("frame", "id", "trajid"), ["frame", "id"])
    who = shared.table(who.join(signatures.withColumn("cam", F.col("cam").cast("long")), ["trajid", "cam"], "left").select("frame", "id", "cam", "blob", "cu", "cv", "share", F.col("signature").alias("g")))
    at, facts, seen = shared.table(rows.select("trajid", "frame", "id", *XYZ)), [], None
    for _ in range(rounds):
        ahead = pieces.leave_one_out(at.select("trajid", "frame", *XYZ), window, order).where("x IS NOT NULL AND NOT isnan(x)")
        said = at.select("trajid", "frame", "id").join(ahead, ["trajid", "frame"])
        told = shared.table(_images(said, who, rig, "pu", "pv"))
        known = F.col("pu").isNotNull() & ~F.isnan("pu")
        far = (F.col("pu") - F.col("cu")) * (F.col("pu") - F.col("cu")) + (F.col("pv") - F.col("cv")) * (F.col("pv") - F.col("cv"))
        found = told.where(known & (F.col("share") == 1)).agg(F.avg(far / 2)).first()[0]
        var = 0.25 if found is None else max(found - var_centre, 0.01)
        ready = told.select("frame", "id", "cam", "blob", "cu", "cv", "g", "pu", "pv", F.when(known, F.col("pu")).otherwise(F.col("cu")).alias("u"), F.when(known, F.col("pv")).otherwise(F.col("cv")).alias("v"), F.when(known, F.lit(var)).otherwise(F.lit(1.0)).alias("var"))
        split = points.split_blobs(ready, var_centre, effective=True).join(ready.select("frame", "id", "cam", "pu", "pv"), ["frame", "id", "cam"])
        split = split.withColumn("gated", F.coalesce(((F.col("su") - F.col("pu")) * (F.col("su") - F.col("pu")) + (F.col("sv") - F.col("pv")) * (F.col("sv") - F.col("pv"))) / (F.col("s_var") + var) > gate * gate, F.lit(False)))
        if seen is not None:
            shared.drop(seen)
        seen = shared.table(split.select("frame", "id", "cam", F.col("su").alias("u"), F.col("sv").alias("v"), F.col("s_var").alias("var"), "pu", "pv", "gated"))
        free = seen.where("NOT gated")
        if prior:  # two sightings of one camera are one of their weighted mean
            a, b = 1 / F.col("var"), F.when(F.col("pu").isNotNull() & ~F.isnan("pu"), F.lit(1 / var)).otherwise(F.lit(0.0))
            free = seen.withColumn("_a", F.when(F.col("gated"), F.lit(0.0)).otherwise(a)).withColumn("_b", b).where("_a + _b > 0")
            mix = {c: (F.col("_a") * F.col(c) + F.col("_b") * F.coalesce(F.col(f"p{c}"), F.lit(0.0))) / (F.col("_a") + F.col("_b")) for c in "uv"}
            free = free.select("frame", "id", "cam", mix["u"].alias("u"), mix["v"].alias("v"), (1 / (F.col("_a") + F.col("_b"))).alias("var"))
        fit = calibrate.triangulate_weighted(free.select("frame", "id", "cam", "u", "v", "var"), at, rig).select("frame", "id", *[F.col(a).alias(f"n{a}") for a in XYZ])
        new = shared.table(at.join(fit, ["frame", "id"], "left").select("trajid", "frame", "id", *[F.coalesce(F.nanvl(F.col(f"n{a}"), F.col(a)), F.col(a)).alias(a) for a in XYZ]))
        shared.drop(at, told)
        at = new
        facts.append({"var": var, "gated": seen.where("gated").count(), "error": blob_error(at, who, rig)})
    return at, seen.select("frame", "id", "cam", "u", "v", "var", "pu", "pv"), facts


def blob_error(at: DataFrame, who: DataFrame, rig: list[Camera]) -> float:
    """Mean square distance in pixels of blobs' centres (cu, cv) to the mean of their members' images, weighted by brightness g."""
    weighed = _images(at, who, rig, "mu", "mv").withColumn("w", points.shares())
    mean = weighed.groupBy("frame", "cam", "blob").agg(F.sum(F.col("w") * F.col("mu")).alias("mu"), F.sum(F.col("w") * F.col("mv")).alias("mv"), F.first("cu").alias("cu"), F.first("cv").alias("cv"))
    d = (F.col("mu") - F.col("cu")) * (F.col("mu") - F.col("cu")) + (F.col("mv") - F.col("cv")) * (F.col("mv") - F.col("cv"))
    return float(mean.agg(F.avg(d)).first()[0] or 0.0)


def holistic(
    at: DataFrame, members: DataFrame, blobs: DataFrame, rig: list[Camera], volume: Volume, eps: float, link: Callable[[DataFrame], DataFrame], rounds: int = 2, radius: float = 2.0, least: float = 0.25, residual: bool = True, **more
) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    """Points (frame, id, x, y, z), members, edges and facts of the loop: link, adopt blobs, tell brightness, refine, bring to birth what hides in blobs, link again.

    at: (frame, id, x, y, z); members: (frame, id, cam, blob); link: points -> edges (frame, i, step, k). Points keep their ids, births follow them; births that no track takes go in the
    end, and the rest is linked once more. The loop stops early when a round adopts and bears nothing. residual asks a birth for a target left over in a used blob.
    """
    at, members = shared.table(at.select("frame", "id", *XYZ)), shared.table(members.select("frame", "id", F.col("cam").cast("long").alias("cam"), "blob"))
    first = shared.table(at.select("frame", "id"))
    edges, facts = shared.table(link(at)), []
    for n in range(1, rounds + 1):
        tracks = shared.table(linkage.seal(tracking.linkage_of(at, edges)))
        new = shared.table(merging.extend_membership(at, members, blobs, rig, radius, alone=False).select("frame", "id", "cam", "blob"))
        adopted = new.count()
        members = shared.table(members.union(new))
        bright = members.join(tracks.select("frame", "id", "trajid"), ["frame", "id"]).join(blobs.select("frame", F.col("cam").cast("long").alias("cam"), "blob", "sumg"), ["frame", "cam", "blob"])
        signs = shared.table(merging.estimate_signatures(bright.select("trajid", "frame", "cam", "blob", "sumg")))
        fine, seen, rounds_ = refine_merged(tracks, members, blobs, signs, rig, rounds=2)
        here = _images(fine, members, rig, "xu", "xv").join(fine.select("frame", "id", "trajid"), ["frame", "id"]).join(signs, ["trajid", "cam"], "left")
        here = here.join(seen.select("frame", "id", "cam", "pu", "pv"), ["frame", "id", "cam"], "left")
        place = {p: F.coalesce(F.nanvl(F.col(f"p{p}"), F.col(f"x{p}")), F.col(f"x{p}")).alias(f"p{p}") for p in "uv"}
        known = shared.table(here.select("frame", "id", "cam", F.col("signature").alias("s"), *place.values()))
        targets = shared.table(merging.birth_targets(members, known, blobs, least))
        born = merging.birth_points(targets, rig, volume, eps, residual=residual, **more)
        last = at.groupBy("frame").agg(F.max("id").alias("_last"))
        born = shared.table(born.join(last, "frame", "left").withColumn("id", F.col("id") + F.coalesce("_last", F.lit(-1)) + 1).select("frame", "id", *XYZ, "blobs"))
        births = born.count()
        at = shared.table(fine.select("frame", "id", *XYZ).union(born.select("frame", "id", *XYZ)))
        members = shared.table(members.union(born.select("frame", "id", F.posexplode("blobs").alias("cam", "blob")).where("blob >= 0").select("frame", "id", F.col("cam").cast("long"), "blob")))
        edges = shared.table(link(at))
        facts.append({"round": n, "adopted": adopted, "births": births, "links": edges.count(), "error": rounds_[-1]["error"]})
        shared.drop(targets, known, signs, new)
        if not adopted and not births:
            break
    ends = edges.select("frame", F.col("i").alias("id")).union(edges.select((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id"))).union(first).distinct()
    before = at.count()
    at = shared.table(at.join(ends, ["frame", "id"], "left_semi"))
    gone = before - at.count()
    if gone:
        members = shared.table(members.join(at.select("frame", "id"), ["frame", "id"], "left_semi"))
        edges = shared.table(link(at))
    if facts:
        facts[-1]["unlinked_births"] = gone
    return at, members, edges, facts


def peel_and_track(
    at: DataFrame, targets: DataFrame, rig: list[Camera], link: Callable[[DataFrame], DataFrame], accel: float, core: int | None = None, least: int = 3, max_gap: int = 2, passes: int = 1, frames: int = windows.FRAMES, **more
) -> tuple[DataFrame, list[dict]]:
    """Rows (frame, id, prev, next, x, y, z, cam_ids) tracked in layers: points of `core` cameras or more first, then what shares no target with their tracks, then ends led on.

    at: (frame, id, x, y, z, cam_ids); core is all cameras unless given. Core tracks are cut at kinks above accel, and count from `least` points. Points that share a target with a
    core track and aren't in one go. Returns facts too: core points and tracks, points left, and the corrective rounds.
    """
    at = shared.table(at.select("frame", "id", *XYZ, F.col("cam_ids").cast("array<long>").alias("cam_ids")))
    n = len(rig) if core is None else core
    sure = at.where(F.size(F.filter("cam_ids", lambda t: t >= 0)) >= n)
    bare = linkage.enforce_reciprocity(tracking.linkage_of(sure.drop("cam_ids"), link(sure.drop("cam_ids"))))
    bare = linkage.without_edges(bare, linkage.prune_kinks(bare, accel))
    sealed = shared.table(linkage.seal(bare, least))
    edges = linkage.links(bare).join(sealed.select("frame", F.col("id").alias("i")), ["frame", "i"], "left_semi")
    edges = shared.table(edges.join(sealed.select("frame", F.col("id").alias("i"), "trajid"), ["frame", "i"]).withColumn("to", F.col("frame") + F.col("step")).join(sealed.select(F.col("frame").alias("to"), F.col("id").alias("k"), F.col("trajid")), ["to", "k", "trajid"]).select("frame", "i", "step", "k"))
    first = at.join(sealed.select("frame", "id"), ["frame", "id"], "left_semi")
    claimed = shared.table(first.select("frame", F.posexplode("cam_ids").alias("cam", "target")).where("target >= 0").select("frame", F.col("cam").cast("int").alias("cam"), "target"))
    rest = shared.table(points.prune_claimed(at.join(sealed.select("frame", "id"), ["frame", "id"], "left_anti"), claimed))
    more_edges = link(rest.drop("cam_ids"))
    every = shared.table(first.union(rest.select(*first.columns)))
    linked = tracking.linkage_of(every.drop("cam_ids"), edges.union(more_edges.select("frame", "i", "step", "k")))
    rows = linkage.enforce_reciprocity(linked).join(every.select("frame", "id", "cam_ids"), ["frame", "id"])
    facts = [{"core": sealed.count(), "tracks": sealed.select("trajid").distinct().count(), "rest": rest.count()}]
    found, rounds = corrective.correct(rows, targets, rig, passes, accel=accel, max_gap=max_gap, frames=frames, **more)
    return found, facts + rounds
