"""After matching: blobs that points missed are adopted, points that nobody saw are born from what is left over, and tracks' brightness is told from blobs that hold several.

members: (frame, id, cam, blob), which point uses which blob; blobs: (frame, cam, blob, x, y in pixels, sumg, n, nx, ny); several points may use one blob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import shared
from skein.functions import optics
from skein.functions.numeric import Arrays
from skein.functions.optics import Camera, Volume
from skein.operators import linking, points, stereo

XYZ = ("x", "y", "z")
#: A camera and a frame as one number, for choices within both.
CAMERAS = stereo.MOST_CAMERAS


def near_blobs(images: DataFrame, blobs: DataFrame, radius: float) -> DataFrame:
    """(frame, id, cam, blob, d): blobs closer than radius to images (frame, id, cam, u, v). Images go to their cell alone, blobs to the nine around theirs."""
    at = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = images.where("NOT isnan(u) AND NOT isnan(v)").withColumns({"cx": at("u"), "cy": at("v")})
    ring = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a AS a, b AS b))))")).alias("s")
    right = blobs.select("frame", "cam", "blob", F.col("x").alias("bx"), F.col("y").alias("by"), ring)
    right = right.select("frame", "cam", "blob", "bx", "by", (F.floor(F.col("bx") / radius).cast("long") + F.col("s.a")).alias("cx"), (F.floor(F.col("by") / radius).cast("long") + F.col("s.b")).alias("cy"))
    d = F.hypot(F.col("u") - F.col("bx"), F.col("v") - F.col("by"))
    return left.join(right, ["frame", "cam", "cx", "cy"]).select("frame", "id", "cam", "blob", d.alias("d")).where(F.col("d") < radius)


def extend_membership(at: DataFrame, members: DataFrame, blobs: DataFrame, rig: list[Camera], radius: float = 2.0, least: int = 3, alone: bool = True) -> DataFrame:
    """New members (frame, id, cam, blob, d) of points (frame, id, x, y, z): in cameras where a point of `least` cameras or more has no blob, the one its image falls on.

    alone: only blobs that nobody uses, each for one point: nearest first over each camera's frame (ties by point, then blob). Otherwise each point takes its nearest
    blob, whoever uses it. Images in no camera, and points without members, adopt nothing.
    """
    has = members.groupBy("frame", "id").agg(F.collect_set(F.col("cam").cast("long")).alias("has")).where(F.size("has") >= least)
    every = F.sequence(F.lit(0).cast("long"), F.lit(len(rig) - 1).cast("long"))
    missing = at.select("frame", "id", *XYZ).join(has, ["frame", "id"]).withColumn("cam", F.explode(F.array_except(every, "has"))).drop("has")
    seen = stereo.over_cameras(missing, rig, lambda c, r: optics.pixel(Arrays, c, [r[a].to_numpy() for a in XYZ]), "u double, v double")
    if not alone:
        near = near_blobs(seen, blobs, radius)
        return near.groupBy("frame", "id", "cam").agg(F.min(F.struct("d", "blob")).alias("b")).select("frame", "id", "cam", "b.blob", "b.d")
    free = blobs.join(members.select("frame", "cam", "blob").distinct(), ["frame", "cam", "blob"], "left_anti")
    near = near_blobs(seen, free, radius)
    named = near.select((F.col("frame") * CAMERAS + F.col("cam")).alias("frame"), F.col("id").cast("long").alias("i"), F.col("blob").cast("long").alias("k"), F.col("d").alias("cost"))
    won = linking.greedy(named)
    return won.select(F.floor(F.col("frame") / CAMERAS).cast("long").alias("frame"), F.col("i").alias("id"), F.pmod("frame", F.lit(CAMERAS)).cast("long").alias("cam"), F.col("k").alias("blob"), F.col("cost").alias("d"))


def birth_targets(members: DataFrame, known: DataFrame, blobs: DataFrame, least: float = 0.5, shift: float = 3.0) -> DataFrame:
    """Targets of unseen points: blobs that nobody uses (kind 0), and what is left of a blob after its members (kind 1).

    known: (frame, id, cam, s, pu, pv), members' brightness and where their paths say they are. A blob all of whose members are known, brighter than they are together
    by `least` of the camera's median brightness, holds one more of that brightness; as the blob's centre is the weighted mean, its place follows; places farther than
    `shift` from the centre don't count. Returns frame, cam, pnr, x, y, sumg, n, nx, ny, src (the blob), kind.
    """
    cams = [r["cam"] for r in blobs.select("cam").distinct().collect()]  # a handful
    typical = {c: shared.quantile(known.where(F.col("cam") == c), F.col("s"), 0.5) for c in cams}
    rows = [(int(c), m) for c, m in typical.items() if m is not None]
    medians = F.broadcast(blobs.sparkSession.createDataFrame(rows, "cam long, median double"))  # a row a camera
    told = F.col("s").isNotNull() & F.col("pu").isNotNull() & F.col("pv").isNotNull() & ~F.isnan("s") & ~F.isnan("pu") & ~F.isnan("pv")
    used = members.select("frame", "id", "cam", "blob").join(known.select("frame", "id", "cam", "s", "pu", "pv"), ["frame", "id", "cam"], "left")
    used = used.groupBy("frame", "cam", "blob").agg(F.min(told).alias("told"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("pu")).alias("mu"), F.sum(F.col("s") * F.col("pv")).alias("mv"))
    both = blobs.join(used, ["frame", "cam", "blob"], "left").withColumn("cam", F.col("cam").cast("long")).join(medians, "cam", "left")
    size = [F.col(c) for c in ("n", "nx", "ny")]
    free = both.where("told IS NULL").select("frame", "cam", (F.col("blob") * 2).alias("pnr"), "x", "y", "sumg", *size, F.col("blob").alias("src"), F.lit(0).alias("kind"))
    rest = F.col("sumg") - F.col("s")
    left = both.where("told").where(rest >= least * F.col("median")).where(rest > 0)
    place = {c: (F.col("sumg") * F.col(c) - F.col(f"m{p}")) / rest for c, p in (("x", "u"), ("y", "v"))}
    left = left.withColumns({"px": place["x"], "py": place["y"]}).where(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= shift)
    left = left.select("frame", "cam", (F.col("blob") * 2 + 1).alias("pnr"), F.col("px").alias("x"), F.col("py").alias("y"), rest.alias("sumg"), *size, F.col("blob").alias("src"), F.lit(1).alias("kind"))
    return free.union(left)


def birth_points(targets: DataFrame, rig: list[Camera], volume: Volume, eps: float, least: int = 3, residual: bool = True, **more) -> DataFrame:
    """Points (frame, id, x, y, z, rcm, n_resid, blobs: the source blob a camera, -1 where none) matched among birth_targets: `least` cameras or more, and a residual target unless residual is False.

    Matches are one to one, so no target is used twice; ids are numbers in the frame.
    """
    flat = shared.table(stereo.flat_targets(targets, rig))
    found = stereo.numbered(stereo.cascade(stereo.edges(flat, rig, volume, eps, **more), len(rig), 0.0)).where(F.col("n_cams") >= least)
    found = shared.table(found)
    at = stereo.match_points(found, flat, rig).select("frame", "id", *XYZ, "rcm")
    each = found.select("frame", "id", F.posexplode("p").alias("cam", "pnr")).withColumn("cam", F.col("cam").cast("long"))
    each = each.join(targets.select("frame", "cam", "pnr", "src", "kind"), ["frame", "cam", "pnr"], "left")
    source = F.transform(F.sort_array(F.collect_list(F.struct("cam", F.coalesce("src", F.lit(-1)).cast("long").alias("src")))), lambda c: c["src"])
    of = each.groupBy("frame", "id").agg(F.coalesce(F.sum("kind"), F.lit(0)).cast("long").alias("n_resid"), source.alias("blobs"))
    born = at.join(of, ["frame", "id"])
    return born.where("n_resid > 0") if residual else born


def births(at: DataFrame, members: DataFrame, known: DataFrame, blobs: DataFrame, rig: list[Camera], volume: Volume, eps: float, rounds: int = 2, residual: bool = False, **more) -> tuple[DataFrame, DataFrame]:
    """Points (frame, id, x, y, z, round) born in rounds and their members (frame, id, cam, blob): each round's births use their blobs, so the next doesn't find them again.

    Ids go on from the frame's highest. A blob shared with a birth has a member of unknown brightness from then on, and so has no residual in later rounds. Ends when a round has no births.
    """
    spark = at.sparkSession
    ids = at.select("frame", F.col("id").cast("long"))
    who = members.select("frame", F.col("id").cast("long"), F.col("cam").cast("long"), F.col("blob").cast("long"))
    points_, new = spark.createDataFrame([], "frame long, id long, x double, y double, z double, round long"), spark.createDataFrame([], "frame long, id long, cam long, blob long")
    for n in range(1, rounds + 1):
        targets = shared.table(birth_targets(who.union(new), known, blobs))
        born = birth_points(targets, rig, volume, eps, residual=residual, **more)
        last = ids.union(points_.select("frame", "id")).groupBy("frame").agg(F.max("id").alias("_last"))
        born = shared.table(born.join(last, "frame", "left").withColumn("id", F.col("id") + F.coalesce("_last", F.lit(-1)) + 1).drop("_last"))
        if born.isEmpty():
            break
        points_ = points_.union(born.select("frame", "id", *XYZ, F.lit(n).cast("long").alias("round")))
        new = new.union(born.select("frame", "id", F.posexplode("blobs").alias("cam", "blob")).withColumn("cam", F.col("cam").cast("long")).where("blob >= 0"))
        shared.drop(targets)
    return points_, new


def estimate_signatures(members: DataFrame, rounds: int = 3, start: float = 0.2, low: float = 0.75, high: float = 1.3, least: int = 2, cross: bool = True, ratio: float = 1.35) -> DataFrame:
    """(trajid, cam, signature): tracks' brightness in each camera, estimated together with what each blob holds; members are (trajid, frame, cam, blob, sumg).

    It starts at a low quantile of the frames where a track has its blob to itself, as something unseen may hide there. Then, in rounds: a blob is explained where its brightness is
    low .. high times the sum of its members' signatures; a member's share of it is in proportion, and a track's signature the median of its shares, if it has `least`.
    cross: brightness in a camera is about the camera's gain times the track's own; where a signature is missing or above ratio times what the other cameras say, theirs stands.
    Gains need ten tracks known in all cameras. Groups are a track's or a blob's rows; medians over all tracks narrow histograms.
    """
    rows = members.select("trajid", "frame", "cam", "blob", F.col("sumg").cast("double").alias("sumg"))
    found = shared.table(points.signatures(rows, start))
    for _ in range(rounds):
        told = rows.join(found, ["trajid", "cam"], "left")
        sums = told.groupBy("frame", "cam", "blob").agg(F.sum("signature").alias("s"), F.count("signature").alias("k"), F.count("*").alias("n"), F.max("sumg").alias("g"))
        good = sums.where((F.col("k") == F.col("n")) & (F.col("s") > 0)).where((F.col("g") / F.col("s")).between(low, high)).select("frame", "cam", "blob", "s", "g")
        shares = told.join(good, ["frame", "cam", "blob"]).withColumn("v", F.col("g") * F.col("signature") / F.col("s"))
        new = shares.groupBy("trajid", "cam").agg(F.expr("percentile(v, 0.5)").alias("new"), F.count("*").alias("k")).where(F.col("k") >= least).select("trajid", "cam", "new")
        before, found = found, shared.table(found.join(new, ["trajid", "cam"], "left").select("trajid", "cam", F.coalesce("new", "signature").alias("signature")))
        shared.drop(before)
    cams = [r["cam"] for r in rows.select("cam").distinct().orderBy("cam").collect()]
    if not cross or len(cams) < 2:
        return found
    by = found.where("signature > 0").groupBy("trajid").agg(F.count("*").alias("n"), F.avg(F.log("signature")).alias("mean"))
    whole = shared.table(found.join(by.where(F.col("n") == len(cams)), "trajid").select("trajid", "cam", (F.log("signature") - F.col("mean")).alias("v")))
    if whole.select("trajid").distinct().count() < 10:
        return found
    spark = members.sparkSession
    gains = F.broadcast(spark.createDataFrame([(c, shared.quantile(whole.where(F.col("cam") == F.lit(c)), F.col("v"), 0.5)) for c in cams], f"cam {dict(rows.dtypes)['cam']}, gain double").withColumn("gain", F.exp("gain")))
    told = found.join(gains, "cam").withColumn("rel", F.col("signature") / F.col("gain"))
    each = told.groupBy("trajid").agg(F.collect_list(F.struct("cam", "rel", "signature")).alias("all"))
    every = each.crossJoin(gains)  # a handful of cameras
    others = F.sort_array(F.transform(F.filter("all", lambda o: (o["cam"] != F.col("cam")) & (o["rel"] > 0)), lambda o: o["rel"]))
    every = every.withColumns({"_o": others, "signature": F.get(F.filter("all", lambda o: o["cam"] == F.col("cam")), F.lit(0))["signature"]})
    n = F.size("_o")
    middle = (F.get("_o", F.floor((n - 1) / 2).cast("int")) + F.get("_o", F.floor(n / 2).cast("int"))) / 2
    said = F.when(n > 0, F.col("gain") * middle)
    worse = F.col("signature").isNull() | (F.col("signature") > ratio * F.col("_said"))
    return every.withColumn("_said", said).select("trajid", "cam", F.when(F.col("_said").isNotNull() & worse, F.col("_said")).otherwise(F.col("signature")).alias("signature")).where("signature IS NOT NULL")


def first_user(members: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs with tnr: the lowest point of the frame that uses it, -1 if none does."""
    by = members.groupBy("frame", "cam", "blob").agg(F.min("id").alias("tnr"))
    return blobs.join(by, ["frame", "cam", "blob"], "left").withColumn("tnr", F.coalesce("tnr", F.lit(-1)))

