"""Queries on the quality of points, shared blobs, tracks as wholes, statistics and advice, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import geometry, theory
from skein.operators import advice, pieces, points, spatial, tracking
from skein.plans import trackers
from skein.plans.catalogue import query
from skein.sources import binding

XYZ = ("x", "y", "z")
_T, _D = f"t AS ({binding.TRUTH_SQL})", f"d AS ({binding.DROPPED_SQL})"
_IDS = "[CASE WHEN pid % 2 > 0 THEN pid % 40 ELSE -1 END, CASE WHEN pid % 3 > 0 THEN (pid * 7) % 50 ELSE -1 END, CASE WHEN pid % 5 > 0 THEN pid ELSE -1 END, pid]"
_P = f"p AS (SELECT frame, pid AS id, x, y, z, {_IDS} AS cam_ids, (pid % 64) / 16e0 AS rcm, (pid * 13) % 64 / 64e0 AS conf FROM t)"
_SEEN = "len(list_filter(cam_ids, lambda c: c >= 0))"


def _t(spark, sf_dir):
    return binding.truth(spark, sf_dir).withColumnRenamed("pid", "id")


def _points(spark, sf_dir):
    n = F.col("id")
    ids = F.array(F.when(n % 2 > 0, n % 40).otherwise(-1), F.when(n % 3 > 0, (n * 7) % 50).otherwise(-1), F.when(n % 5 > 0, n).otherwise(-1), n)
    return _t(spark, sf_dir).select("frame", "id", *XYZ, ids.alias("cam_ids"), ((n % 64) / F.lit(16.0)).alias("rcm"), ((n * 13) % 64 / F.lit(64.0)).alias("conf"))


# --- filters and scores of points ----------------------------------------------------------------------------------------------------------


@query("frame_slice", f"WITH {_T} SELECT * FROM t WHERE frame = 3")
def frame_slice(spark, sf_dir):
    return binding.truth(spark, sf_dir).where("frame = 3")


@query("frames_in_range", f"WITH {_T} SELECT * FROM t WHERE frame BETWEEN 2 AND 5")
def frames_in_range(spark, sf_dir):
    return binding.truth(spark, sf_dir).where(F.col("frame").between(2, 5))


@query("seen_cameras", f"WITH {_T}, {_P} SELECT frame, id, {_SEEN} AS seen, cam_ids[1] >= 0 AS first, cam_ids[3] >= 0 AS third FROM p")
def seen_cameras(spark, sf_dir):
    return _points(spark, sf_dir).select("frame", "id", points.seen().alias("seen"), F.get(points.seen_mask(), F.lit(0)).alias("first"), F.get(points.seen_mask(), F.lit(2)).alias("third"))


@query("valid_camera_mask", f"WITH {_T} SELECT frame, pid AS id, pid % 3 <> 0 AS a, pid % 4 <> 0 AS b FROM t")
def valid_camera_mask(spark, sf_dir):
    xy = F.array(*[F.when(F.col("id") % m != 0, F.struct("x", "y")) for m in (3, 4)])
    valid = points.valid_cameras("xy")
    return _t(spark, sf_dir).withColumn("xy", xy).select("frame", "id", F.get(valid, F.lit(0)).alias("a"), F.get(valid, F.lit(1)).alias("b"))


@query("filter_low_support", f"WITH {_T}, {_P} SELECT frame, id, x, y, z FROM p WHERE {_SEEN} >= 3")
def filter_low_support(spark, sf_dir):
    return points.filter_low_support(_points(spark, sf_dir)).select("frame", "id", *XYZ)


@query("low_support_counts", f"WITH {_T}, {_P} SELECT frame, count(*) FILTER (WHERE {_SEEN} < 3) AS dropped FROM p GROUP BY frame")
def low_support_counts(spark, sf_dir):
    return points.low_support_counts(_points(spark, sf_dir))


_DIST = "c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p), e AS (SELECT p.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM p, c)"


@query("normalize_rcm", f"WITH {_T}, {_P}, {_DIST}, l AS (SELECT regr_slope(rcm, dist) AS a, regr_intercept(rcm, dist) AS b FROM e) SELECT frame, id, round(rcm / CASE WHEN abs(a * dist + b) < 1e-6 THEN 1e-6 ELSE a * dist + b END, 6) AS rel FROM e, l")
def normalize_rcm(spark, sf_dir):
    return points.normalize_rcm(_points(spark, sf_dir)).select("frame", "id", F.round("rel", 6).alias("rel"))


@query("aware_threshold", f"WITH {_T}, {_P}, {_DIST} SELECT frame, id, round(1.5e0 * (1 + dist / max(dist) OVER ()), 6) AS threshold FROM e")
def aware_threshold(spark, sf_dir):
    return points.aware_threshold(_points(spark, sf_dir), 1.5).select("frame", "id", F.round("threshold", 6).alias("threshold"))


@query("point_consistency", f"WITH {_T}, {_P} SELECT frame, id, ({_SEEN} / 4e0) * ({_SEEN} / 4e0) AS cycles, round(CASE WHEN {_SEEN} < 2 THEN 0e0 ELSE exp(-rcm / 5) END, 6) AS epipolar, CASE WHEN {_SEEN} < 2 THEN 0e0 ELSE {_SEEN} / 4e0 END AS plain FROM p")
def point_consistency(spark, sf_dir):
    return _points(spark, sf_dir).select("frame", "id", points.cycle_consistency().alias("cycles"), F.round(points.epipolar_consistency(F.col("rcm")), 6).alias("epipolar"), points.epipolar_consistency().alias("plain"))


@query("doubtful_tracks", f"WITH {_T}, {_P} SELECT id AS trajid, round(avg(CASE WHEN {_SEEN} < 2 THEN 0e0 ELSE exp(-rcm / 5) END), 6) AS consistency FROM p GROUP BY id HAVING count(*) >= 2 AND avg(CASE WHEN {_SEEN} < 2 THEN 0e0 ELSE exp(-rcm / 5) END) < 0.63")
def doubtful_tracks(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return points.doubtful_tracks(rows.select(F.col("id").alias("trajid"), "frame", "id"), rows, 0.63).withColumn("consistency", F.round("consistency", 6))


_BENT = "b AS (SELECT pid AS trajid, frame, x, y, CASE WHEN (pid + frame) % 5 = 0 THEN z + (pid % 7) / 4e0 ELSE z END AS z FROM d)"
_W = "OVER (PARTITION BY trajid ORDER BY frame)"
_RES = f"s AS (SELECT trajid, {', '.join(f'lead({a}) {_W} - 2 * {a} + lag({a}) {_W} AS a{a}' for a in XYZ)} FROM b), r AS (SELECT trajid, count(*) AS n, coalesce(sqrt(sum(ax * ax + ay * ay + az * az) / (3 * count(ax))), 0) AS r FROM s GROUP BY trajid)"


def _bent(spark, sf_dir):
    """Straight tracks with drop-outs; some points are off."""
    n, f = F.col("pid"), F.col("frame")
    return binding.dropped_out(binding.truth(spark, sf_dir)).select(n.alias("trajid"), "frame", "x", "y", F.when((n + f) % 5 == 0, F.col("z") + (n % 7) / F.lit(4.0)).otherwise(F.col("z")).alias("z"))


@query("smooth_tracks", f"WITH {_D}, {_BENT}, {_RES} SELECT trajid FROM r WHERE r <= 0.5")
def smooth_tracks(spark, sf_dir):
    return points.smooth_tracks(_bent(spark, sf_dir), 0.5)


@query("trajectory_score", f"WITH {_D}, {_BENT}, {_RES} SELECT trajid, round(CASE WHEN n < 2 THEN 0e0 ELSE n / (1 + r) END, 6) AS score FROM r")
def trajectory_score(spark, sf_dir):
    return points.track_scores(_bent(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("ghost_by_distance", f"""WITH {_T}, {_P}, q AS (SELECT *, sqrt((x - 9) * (x - 9) + (y - 9) * (y - 9) + (z - 9) * (z - 9)) AS dist FROM p), r AS (SELECT *, rcm / greatest(0.5e0 + 0.0625e0 * dist, 1e-6) AS rel FROM q)
SELECT frame, id, round(CASE WHEN {_SEEN} >= 4 THEN {{four}} ELSE {{three}} END, 6) AS ghost FROM r""".format(
    **{name: "CASE WHEN rel <= 0.8 THEN " + str(ys[0]) + "e0 " + " ".join(f"WHEN rel <= {b}e0 THEN {p}e0 + (rel - {a}e0) * ({q}e0 - {p}e0) / ({b}e0 - {a}e0)" for a, b, p, q in zip(geometry.GHOST_X, geometry.GHOST_X[1:], ys, ys[1:])) + f" ELSE {ys[-1]}e0 END" for name, ys in (("four", geometry.GHOST_4), ("three", geometry.GHOST_3))}))
def ghost_by_distance(spark, sf_dir):
    return points.ghosts(_points(spark, sf_dir), ((9.0, 9.0, 9.0), 0.5, 0.0625)).select("frame", "id", F.round("ghost", 6).alias("ghost"))


@query("fit_scale")
def fit_scale(spark, sf_dir):
    """One row: the line of typical ray misses; held against plain numpy in pytest."""
    (cx, cy, cz), a, b = points.fit_scale(_points(spark, sf_dir))
    return spark.range(1).select(*[F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in (("cx", cx), ("cy", cy), ("cz", cz), ("level", a), ("slope", b))])


@query("brightness_offsets", f"""WITH {_T}, g AS (SELECT frame, pid AS id, c AS cam, ln(greatest(CAST((pid * (7 + c) + frame * 3) % 90 AS DOUBLE), 1e0)) AS b FROM t, unnest(range(0, 3)) AS u(c)), m AS (SELECT cam, median(b) AS m FROM g GROUP BY cam)
SELECT frame, id, round(stddev_pop(b - m), 6) AS spread FROM g JOIN m ON m.cam = g.cam GROUP BY frame, id""")
def brightness_offsets(spark, sf_dir):
    rows = _t(spark, sf_dir).withColumn("cam", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return points.brightness_spread(rows.select("frame", "id", "cam", ((F.col("id") * (7 + F.col("cam")) + F.col("frame") * 3) % 90).alias("sumg"))).withColumn("spread", F.round("spread", 6))


# --- conflicts -----------------------------------------------------------------------------------------------------------------------------

_SPARSE = "p AS (SELECT frame, pid AS id, [CASE WHEN pid % 9 < 2 THEN pid // 9 ELSE -1 END, CASE WHEN pid % 9 BETWEEN 1 AND 3 THEN pid // 9 ELSE -1 END, CASE WHEN pid % 4 = 0 THEN pid // 8 ELSE -1 END] AS cam_ids FROM t)"
_USES = "u AS MATERIALIZED (SELECT frame, id, unnest([0, 1, 2]) AS cam, unnest(cam_ids) AS target FROM p), v AS MATERIALIZED (SELECT * FROM u WHERE target >= 0), l AS MATERIALIZED (SELECT DISTINCT a.frame, a.id, b.id AS other FROM v a JOIN v b USING (frame, cam, target))"
_COMP = "w(frame, id, comp) AS (SELECT frame, id, id FROM p UNION SELECT w.frame, w.id, l.other FROM w JOIN l ON l.frame = w.frame AND l.id = w.comp), k AS MATERIALIZED (SELECT frame, id, min(comp) AS comp FROM w GROUP BY frame, id)"


def _sparse(spark, sf_dir):
    n = F.col("id")
    block = F.expr("id div 9")
    ids = F.array(F.when(n % 9 < 2, block).otherwise(-1), F.when((n % 9).between(1, 3), block).otherwise(-1), F.when(n % 4 == 0, F.expr("id div 8")).otherwise(-1))
    return _t(spark, sf_dir).select("frame", "id", *XYZ, ids.alias("cam_ids"), ((n * 13) % 64 / F.lit(64.0)).alias("conf"))


@query("conflict_components", f"WITH RECURSIVE {_T}, {_SPARSE}, {_USES}, {_COMP} SELECT * FROM k")
def conflict_components(spark, sf_dir):
    return points.conflict_components(_sparse(spark, sf_dir))


@query("component_kinds", f"WITH RECURSIVE {_T}, {_SPARSE}, {_USES}, {_COMP} SELECT frame, comp, count(*) AS size, CASE WHEN count(*) <= 1 THEN 'trivial' WHEN count(*) = 2 THEN 'bipartite' ELSE 'ilp' END AS kind FROM k GROUP BY frame, comp")
def component_kinds(spark, sf_dir):
    return points.component_sizes(points.conflict_components(_sparse(spark, sf_dir)))


@query("uniqueness_ilp")
def uniqueness_ilp(spark, sf_dir):
    """Held against brute force in pytest."""
    return points.unique_points(_sparse(spark, sf_dir), "conf").select("frame", "id", "keep")


@query("unique_tracks")
def unique_tracks(spark, sf_dir):
    """Tracks whose observations overlap; held against brute force in pytest."""
    n = F.col("id")
    uses = _t(spark, sf_dir).select(n.alias("trajid"), "frame", F.lit(0).alias("cam"), F.when((n + F.col("frame")) % 13 == 0, n + 1).otherwise(n).alias("target"))
    scores = uses.select("trajid").distinct().withColumn("score", ((F.col("trajid") * 29) % 97).cast("double"))
    return points.unique_tracks(uses, scores)


@query("prune_claimed", f"WITH {_T}, {_P} SELECT frame, id FROM p WHERE NOT (cam_ids[1] % 5 = 1 AND cam_ids[1] >= 0)")
def prune_claimed(spark, sf_dir):
    rows = _points(spark, sf_dir)
    claimed = rows.select("frame", F.lit(0).alias("cam"), F.get("cam_ids", F.lit(0)).alias("target")).where("target >= 0 AND target % 5 = 1").distinct()
    return points.prune_claimed(rows, claimed).select("frame", "id")


@query("peel_layers", f"WITH {_T}, {_P}, r AS (SELECT frame, id, row_number() OVER (PARTITION BY frame ORDER BY {_SEEN} DESC, id DESC) - 1 AS r, count(*) OVER (PARTITION BY frame) AS n FROM p) SELECT frame, id, CASE WHEN r < floor(n * CAST(1 AS DOUBLE) / 3) THEN 0 WHEN r < floor(n * CAST(2 AS DOUBLE) / 3) THEN 1 ELSE 2 END AS layer FROM r")
def peel_layers(spark, sf_dir):
    return points.peel(_points(spark, sf_dir)).select("frame", "id", "layer")


# --- shared blobs --------------------------------------------------------------------------------------------------------------------------

_MEM = "m AS (SELECT frame, c AS cam, pid // (1 + (pid + c) % 3) AS blob, pid AS id, pid AS trajid, (pid * 31 + frame * 5) % 50 - 4 AS g, (pid * 31 + frame * 5) % 50 - 4 AS sumg, x AS u, y AS v, 0.25e0 + (pid % 4) / 8e0 AS var, 10e0 AS cu, 9e0 AS cv FROM t, unnest(range(0, 2)) AS k(c))"


def _members(spark, sf_dir):
    n, c, f = F.col("id"), F.col("cam"), F.col("frame")
    rows = _t(spark, sf_dir).withColumn("cam", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    g = (n * 31 + f * 5) % 50 - 4
    return rows.select("frame", "cam", F.expr("id div (1 + (id + cam) % 3)").alias("blob"), "id", n.alias("trajid"), g.alias("g"), g.alias("sumg"), F.col("x").alias("u"), F.col("y").alias("v"), (0.25 + (n % 4) / F.lit(8.0)).alias("var"), F.lit(10.0).alias("cu"), F.lit(9.0).alias("cv"))


@query("shared_blobs", f"WITH {_T}, {_MEM} SELECT frame, cam, blob, id, count(*) OVER (PARTITION BY frame, cam, blob) AS share FROM m")
def shared_blobs(spark, sf_dir):
    return points.shared_blobs(_members(spark, sf_dir)).select("frame", "cam", "blob", "id", "share")


_SIG = "a AS (SELECT *, count(*) OVER (PARTITION BY frame, cam, blob) AS share FROM m), s AS (SELECT trajid, cam, median(sumg) AS signature FROM a WHERE share = 1 AND sumg > 0 GROUP BY trajid, cam)"


@query("track_signatures", f"WITH {_T}, {_MEM}, {_SIG} SELECT trajid, cam, round(signature, 6) AS signature FROM s")
def track_signatures(spark, sf_dir):
    return points.signatures(_members(spark, sf_dir)).withColumn("signature", F.round("signature", 6))


@query("row_signatures", f"WITH {_T}, {_MEM}, {_SIG} SELECT m.frame, m.cam, m.id, round(coalesce(signature, -1), 6) AS signature FROM m LEFT JOIN s ON s.trajid = m.trajid AND s.cam = m.cam")
def row_signatures(spark, sf_dir):
    return points.row_signatures(_members(spark, sf_dir)).select("frame", "cam", "id", F.round(F.coalesce("signature", F.lit(-1.0)), 6).alias("signature"))


_SHARE = "q AS (SELECT *, coalesce(CASE WHEN g > 0 THEN CAST(g AS DOUBLE) END, median(CASE WHEN g > 0 THEN g END) OVER b, 1e0) AS f, count(*) OVER b AS n FROM m WINDOW b AS (PARTITION BY frame, cam, blob)), w AS (SELECT *, f / sum(f) OVER (PARTITION BY frame, cam, blob) AS w FROM q)"


@query("split_blobs", f"""WITH {_T}, {_MEM}, {_SHARE}, e AS (SELECT *, sum(w * u) OVER b AS mu, sum(w * v) OVER b AS mv, sum(w * w * var) OVER b + 0.5e0 AS tot FROM w WINDOW b AS (PARTITION BY frame, cam, blob)),
k AS (SELECT *, CASE WHEN n = 1 THEN var / (var + 0.5e0) ELSE var * w / tot END AS gain FROM e)
SELECT frame, cam, blob, id, round(u + gain * (cu - mu) + 1.3e-9, 6) AS su, round(v + gain * (cv - mv) + 1.3e-9, 6) AS sv, round(CASE WHEN n = 1 THEN var * 0.5e0 / (var + 0.5e0) ELSE var * (1 - w * w * var / tot) END + 1.3e-9, 6) AS s_var FROM k""")
def split_blobs(spark, sf_dir):
    return points.split_blobs(_members(spark, sf_dir), 0.5).withColumns({c: F.round(F.col(c) + 1.3e-9, 6) for c in ("su", "sv", "s_var")})


@query("split_blobs_effective", f"""WITH {_T}, {_MEM}, {_SHARE}, x AS (SELECT * EXCLUDE (w), greatest(w, 0.05e0) AS w0 FROM w), y AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY frame, cam, blob) AS w FROM x),
e AS (SELECT *, sum(w * u) OVER b AS mu, sum(w * v) OVER b AS mv, sum(w * w * var) OVER b AS tot FROM y WINDOW b AS (PARTITION BY frame, cam, blob))
SELECT frame, cam, blob, id, round(CASE WHEN n = 1 THEN cu ELSE (cu - mu + w * u) / w END + 1.3e-8, 5) AS su, round(CASE WHEN n = 1 THEN cv ELSE (cv - mv + w * v) / w END + 1.3e-8, 5) AS sv, round(CASE WHEN n = 1 THEN 0.5e0 ELSE (0.5e0 + tot - w * w * var) / (w * w) END + 1.3e-8, 5) AS s_var FROM e""")
def split_blobs_effective(spark, sf_dir):
    return points.split_blobs(_members(spark, sf_dir), 0.5, effective=True).withColumns({c: F.round(F.col(c) + 1.3e-8, 5) for c in ("su", "sv", "s_var")})


# --- tracks as wholes ------------------------------------------------------------------------------------------------------------------------


@query("weighted_savgol")
def weighted_savgol(spark, sf_dir):
    """Held against a plain fit a point in pytest."""
    rows = pieces.smooth(_bent(spark, sf_dir).withColumn("weight", 1 + F.col("frame") / F.lit(8.0)), 1.0, 5, 2)
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in (*XYZ, "u", "v", "w", "ax", "ay", "az")})


@query("savgol_straight", f"WITH {_D}, c AS (SELECT pid FROM d GROUP BY pid HAVING count(*) >= 5), v AS (SELECT d.pid AS trajid, frame, x, y, z FROM d JOIN c ON c.pid = d.pid) SELECT trajid, frame, x, y, z, ((trajid * 31) % 33 - 16) / 64e0 AS u, ((trajid * 37) % 33 - 16) / 64e0 AS v, ((trajid * 41) % 33 - 16) / 64e0 AS w, 0e0 AS ax, 0e0 AS ay, 0e0 AS az FROM v")
def savgol_straight(spark, sf_dir):
    """Straight lines come back with their velocity and no acceleration, whatever the gaps."""
    rows = pieces.smooth(binding.dropped_out(binding.truth(spark, sf_dir)).withColumnRenamed("pid", "trajid"), 1.0, 7, 3)
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in (*XYZ, "u", "v", "w", "ax", "ay", "az")})


@query("leave_one_out", f"WITH {_D}, c AS (SELECT pid FROM d GROUP BY pid HAVING count(*) >= 5) SELECT d.pid AS trajid, frame, round(x + 3e-5, 4) AS x, round(y + 3e-5, 4) AS y, round(z + 3e-5, 4) AS z FROM d JOIN c ON c.pid = d.pid")
def leave_one_out(spark, sf_dir):
    """On straight lines the neighbours of a point say where it is."""
    rows = pieces.leave_one_out(binding.dropped_out(binding.truth(spark, sf_dir)).withColumnRenamed("pid", "trajid"), 5, 2)
    return rows.where("x IS NOT NULL").select("trajid", "frame", *[(F.round(F.col(a) + 3e-5, 4) + 0.0).alias(a) for a in XYZ])


@query("irls_smooth")
def irls_smooth(spark, sf_dir):
    """Robust weights and residuals of tracks; held against a plain version in pytest."""
    return pieces.robust(_bent(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("weight", "residual")})


@query("predict_next", f"WITH {_T} SELECT pid AS trajid, 8 AS frame, {', '.join(f'{a} + (({m} * pid) % 33 - 16) / 64e0 AS {a}' for a, m in zip(XYZ, (31, 37, 41)))} FROM t WHERE frame = 7")
def predict_next(spark, sf_dir):
    rows = pieces.predict_next(binding.truth(spark, sf_dir).withColumnRenamed("pid", "trajid"))
    return rows.select("trajid", "frame", *[(F.round(a, 6) + 0.0).alias(a) for a in XYZ])


_APART = "q AS (SELECT pid, frame, x + 32 * (pid % 100) AS x, y + 32 * ((pid // 100) % 100) AS y, z FROM t WHERE frame <> 3 + pid % 2)"


def _broken(spark, sf_dir):
    """Customers far apart, each track broken at a missing frame: pieces 2 pid and 2 pid + 1."""
    rows = binding.truth(spark, sf_dir).where("frame <> 3 + pid % 2")
    x, y = F.col("x") + 32 * (F.col("pid") % 100), F.col("y") + 32 * (F.expr("pid div 100") % 100)
    return rows.select((2 * F.col("pid") + (F.col("frame") > 3 + F.col("pid") % 2).cast("long")).alias("trajid"), "frame", x.alias("x"), y.alias("y"), "z")


@query("reconnect_pieces", f"WITH {_T} SELECT DISTINCT 2 * pid AS a, 2 * pid + 1 AS b FROM t")
def reconnect_pieces(spark, sf_dir):
    """Straight pieces meet again, all of them and no others."""
    return pieces.reconnect(_broken(spark, sf_dir), least=3)


@query("reconnected_tracks", f"WITH {_T}, {_APART} SELECT 2 * pid AS trajid, count(*) AS points FROM q GROUP BY pid")
def reconnected_tracks(spark, sf_dir):
    rows = _broken(spark, sf_dir)
    return pieces.reconnected(rows, pieces.reconnect(rows, least=3)).groupBy("trajid").agg(F.count("*").alias("points"))


@query("stitch_fragments", f"WITH {_T} SELECT DISTINCT 2 * pid AS a, 2 * pid + 1 AS b, 2 AS gap FROM t")
def stitch_fragments(spark, sf_dir):
    return pieces.stitch(_broken(spark, sf_dir), 2, 1.0)


@query("stitch_robust", f"WITH {_T} SELECT DISTINCT 2 * pid AS a, 2 * pid + 1 AS b FROM t")
def stitch_robust(spark, sf_dir):
    """Pieces of consecutive frames."""
    rows = binding.truth(spark, sf_dir)
    x, y = F.col("x") + 32 * (F.col("pid") % 100), F.col("y") + 32 * (F.expr("pid div 100") % 100)
    return pieces.stitch_robust(rows.select((2 * F.col("pid") + (F.col("frame") > 3).cast("long")).alias("trajid"), "frame", x.alias("x"), y.alias("y"), "z"), 0.5, 0.5)


@query("split_kinks", f"""WITH {_D}, {_BENT}, v AS (SELECT trajid, frame, {', '.join(f'{a} - lag({a}) {_W} AS p{a}, lead({a}) {_W} - {a} AS q{a}' for a in XYZ)} FROM b),
n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS n1, sqrt(qx * qx + qy * qy + qz * qz) AS n2, px * qx + py * qy + pz * qz AS dot FROM v), c AS (SELECT trajid, frame FROM n WHERE n1 >= 1e-9 AND n2 >= 1e-9 AND dot < cos(radians(120e0)) * n1 * n2)
SELECT b.trajid, b.frame, (SELECT count(*) FROM c WHERE c.trajid = b.trajid AND c.frame < b.frame) AS piece FROM b""")
def split_kinks(spark, sf_dir):
    rows = _bent(spark, sf_dir)
    return pieces.split_at(rows, pieces.kinks(rows)).select("trajid", "frame", "piece")


# --- theory, statistics, advice ----------------------------------------------------------------------------------------------------------------

_N = "n AS (SELECT frame, count(*) AS points FROM t GROUP BY frame)"


@query("ghost_scaling", f"""WITH {_T}, {_N}, g AS (SELECT *, pow(points, 4e0) * pow(0.05e0 / 20, 5e0) AS x FROM n)
SELECT frame, points, round(x, 6) AS ghosts, CASE WHEN x < 1 THEN 'sparse' WHEN x >= points THEN 'dense' ELSE 'intermediate' END AS regime FROM g""")
def ghost_scaling(spark, sf_dir):
    n = _t(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("points"))
    return n.select("frame", "points", F.round(theory.expected_ghosts(F.col("points"), 4, 0.05, 20.0), 6).alias("ghosts"), theory.ghost_regime(F.col("points"), 4, 0.05, 20.0).alias("regime"))


@query("theory_report", f"""WITH {_T}, {_N} SELECT frame, round(pow(points, 3e0) * pow(0.05e0 / 20, 3e0), 6) AS ghosts, CASE WHEN pow(points, 3e0) * pow(0.05e0 / 20, 3e0) < 1 THEN 'sparse' WHEN pow(points, 3e0) * pow(0.05e0 / 20, 3e0) >= points THEN 'dense' ELSE 'intermediate' END AS regime,
  round(20 * pow(1 / pow(points, 3e0), 1e0 / 3), 6) AS tolerance, round(0.5e0 * sqrt(points) / 1000, 6) AS trackability, round(least(0.3e0, 0.5e0 * 20 / cbrt(points)), 6) AS radius FROM n""")
def theory_report(spark, sf_dir):
    n = _t(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("points"))
    p = F.col("points")
    rows = n.select("frame", *theory.report(p, 3, 0.05, 20.0, 0.5, 1000.0), theory.prediction_radius(0.3, 20.0 / F.cbrt(p)).alias("radius"))
    return rows.drop("notes").withColumns({c: F.round(c, 6) for c in ("ghosts", "tolerance", "trackability", "radius")})


_STATS = """n AS (SELECT frame, count(*) AS n FROM e GROUP BY frame), s AS (SELECT sqrt(min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))) AS d FROM e a JOIN e b ON b.frame = a.frame AND b.pid <> a.pid GROUP BY a.frame, a.pid),
m AS (SELECT sqrt(min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))) AS d FROM e a JOIN e b ON b.frame = a.frame + 1 GROUP BY a.frame, a.pid),
h AS (SELECT n, row_number() OVER (ORDER BY frame) <= floor(count(*) OVER () / 2) AS early FROM n),
k AS (SELECT count(*) AS frames, avg(n) AS mean_points, max(n) AS max_points, min(n) AS min_points, stddev_pop(n) AS sd_points, avg(n) FILTER (WHERE early) AS m1, avg(n) FILTER (WHERE NOT early) AS m2 FROM h),
z AS (SELECT max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z FROM e), q AS (SELECT avg(d) AS spacing FROM s),
v AS (SELECT max(d) AS max_step, avg(d) AS mean_step, stddev_pop(d) AS sd_step, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.95) AS p95 FROM m),
o AS (SELECT frames, round(mean_points, 6) AS mean_points, max_points, round(sd_points, 6) AS sd_points, size_x, size_y, size_z, round(spacing, 6) AS spacing, round(max_step, 6) AS max_step, round(mean_step, 6) AS mean_step, round(sd_step, 6) AS sd_step, round(p25, 6) AS p25_step, round(p50, 6) AS p50_step, round(p95, 6) AS p95_step,
  CASE WHEN max_step / spacing < 0.3 THEN 'low' WHEN max_step / spacing < 0.6 THEN 'low_to_moderate' WHEN max_step / spacing < 0.9 THEN 'moderate' ELSE 'high' END AS density, round(1 - min_points / max_points, 6) AS gap_share, 1 - min_points / max_points > 0.15 AS has_gaps,
  CASE WHEN sd_points <= 0.1 * mean_points THEN 'stable' WHEN m2 > 1.2 * m1 THEN 'growing' WHEN m2 < 0.8 * m1 THEN 'dropping' ELSE 'erratic' END AS counts FROM k, z, q, v)"""
_THIN = "e AS (SELECT pid, frame, x, y, z FROM t UNION ALL SELECT pid + 10000000, frame, x + 0.5, y + 0.25, z + 0.125 FROM t WHERE frame < 4 AND pid % 4 = 0)"


def _thin(spark, sf_dir):
    """All points, and companions of a quarter of the customers that leave halfway."""
    t = _t(spark, sf_dir).select("frame", "id", "x", "y", "z")
    return t.union(t.where("frame < 4 AND id % 4 = 0").select("frame", F.col("id") + 10000000, F.col("x") + 0.5, F.col("y") + 0.25, F.col("z") + 0.125))


@query("dataset_stats", f"WITH {_T}, {_THIN}, {_STATS} SELECT * FROM o")
def dataset_stats(spark, sf_dir):
    return advice.dataset(_thin(spark, sf_dir), 1.0)


_TABLE = ", ".join(f"('{t.name}', '{t.speed}', '{t.density}', {t.gaps or t.backward}, {t.new_particles})" for t in trackers.TRACKERS)
_SCORE = f"""w(name, speed, dens, gap, fresh) AS (VALUES {_TABLE}), y AS (SELECT name, speed, greatest(0e0, 3e0 - 1.5e0 * abs(CASE dens WHEN 'low' THEN 0 WHEN 'low_to_moderate' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END - CASE o.density WHEN 'low' THEN 0 WHEN 'low_to_moderate' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END))
  + CASE WHEN has_gaps THEN CASE WHEN gap THEN 3e0 ELSE -1e0 END ELSE 0e0 END + CASE WHEN counts IN ('dropping', 'erratic', 'growing') AND fresh THEN 2e0 ELSE 0e0 END + CASE WHEN name = 'unified' THEN 1e0 ELSE 0e0 END AS score FROM w, o),
r AS (SELECT name, score, row_number() OVER (ORDER BY score DESC, speed, name) AS rank FROM y)"""


@query("tracker_recommendation", f"WITH {_T}, {_THIN}, {_STATS}, {_SCORE} SELECT * FROM r")
def tracker_recommendation(spark, sf_dir):
    return advice.score_trackers(advice.dataset(_thin(spark, sf_dir), 1.0), trackers.trackers(spark))


@query("recommendation", f"""WITH {_T}, {_THIN}, {_STATS}, {_SCORE}, u AS (SELECT CASE WHEN p95_step > 0 THEN p95_step ELSE max_step END * 3e0 AS step, spacing * 2.5e0 AS cap, spacing, p95_step FROM o)
SELECT (SELECT name FROM r WHERE rank = 1) AS tracker, round((SELECT max(score) FROM r WHERE rank = 1) / (SELECT sum(score) FROM r), 6) AS confidence, round(CASE WHEN spacing > 0 AND step > cap THEN cap ELSE step END, 6) AS dv_max,
  round(CASE WHEN p95_step / spacing > 1 THEN least(CASE WHEN step > cap THEN least(step * 0.6e0, cap) ELSE step * 0.6e0 END, spacing) ELSE CASE WHEN step > cap THEN least(step * 0.6e0, cap) ELSE step * 0.6e0 END END, 6) AS dacc FROM u""")
def recommendation(spark, sf_dir):
    return advice.recommend(advice.dataset(_thin(spark, sf_dir), 1.0), trackers.trackers(spark)).drop("alternates")


@query("tracker_table", f"WITH {_T} SELECT frame, name, speed, dens AS density, n AS points FROM (SELECT frame, count(*) AS n FROM t GROUP BY frame), (VALUES {_TABLE}) AS w(name, speed, dens, gap, fresh)")
def tracker_table(spark, sf_dir):
    """Every tracker beside each frame and its number of points; trackers are a handful."""
    size = _t(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("points"))
    return size.crossJoin(F.broadcast(trackers.trackers(spark).select("name", "speed", "density")))


@query("advice", f"""WITH {_T}, a AS (SELECT DISTINCT pid % 90 AS id, (pid % 10) / 16e0 AS three_cams, CASE WHEN pid % 9 = 0 THEN NULL ELSE (pid % 15) / 64e0 END AS flagged, pid % 10 AS neighbours, (pid % 5) / 4e0 AS ratio, (pid % 18) / 32e0 AS median_kink, (pid % 6) / 16e0 AS median_step FROM t)
SELECT id, CASE WHEN flagged IS NOT NULL AND (three_cams > 0.45 OR flagged > 0.14) THEN 0.15e0 WHEN flagged IS NOT NULL AND three_cams < 0.2 AND flagged < 0.04 THEN 0.3e0 ELSE 0.2e0 END AS q_seed, CASE WHEN flagged IS NOT NULL AND (three_cams > 0.45 OR flagged > 0.14) THEN 6 ELSE 3 END AS q_young,
  round(CASE WHEN neighbours <= 7 AND ratio >= 0.5 THEN 8 * median_kink ELSE 0.3e0 END, 6) AS confirm_tol, neighbours <= 7 AND ratio >= 0.5 AS confirm_auto, CASE WHEN median_step >= 0.2 THEN 0.5e0 ELSE 0e0 END AS blob_gate, 21 AS smoothing_window FROM a""")
def advice_rules(spark, sf_dir):
    n = F.col("id")
    rows = _t(spark, sf_dir).select((n % 90).alias("id")).distinct()
    rows = rows.select("id", ((n % 10) / F.lit(16.0)).alias("three_cams"), F.when(n % 9 != 0, (n % 15) / F.lit(64.0)).alias("flagged"), (n % 10).alias("neighbours"), ((n % 5) / F.lit(4.0)).alias("ratio"), ((n % 18) / F.lit(32.0)).alias("median_kink"), ((n % 6) / F.lit(16.0)).alias("median_step"))
    out = rows.select("id", *advice.advise(5000.0)).drop("reconnect_gap", "smooth_filter")
    return out.withColumn("blob_gate", F.coalesce("blob_gate", F.lit(0.0)))


@query("conditioning", f"WITH {_T}, m AS (SELECT frame, pid AS id, (pid % 16) / 64e0 AS d FROM t) SELECT frame, id, round(CASE WHEN d > 0 THEN 0.0625e0 / d ELSE 1e300 END, 6) AS ratio, CASE WHEN d > 0 AND 0.0625e0 / d < 0.3 THEN 'well-conditioned' WHEN d > 0 AND 0.0625e0 / d < 1 THEN 'marginal' ELSE 'poorly-conditioned' END AS verdict FROM m")
def conditioning(spark, sf_dir):
    ratio, verdict = advice.conditioning(F.col("d"), F.lit(0.0625))
    rows = _t(spark, sf_dir).select("frame", "id", ((F.col("id") % 16) / F.lit(64.0)).alias("d"))
    return rows.select("frame", "id", F.round(F.least(ratio, F.lit(1e300)), 6).alias("ratio"), verdict.alias("verdict"))


@query("distance_weight", f"WITH {_T}, m AS (SELECT frame, pid AS id, (pid % 16) / 64e0 AS d, (1 + pid % 5) / 16e0 AS s FROM t) SELECT frame, id, round(least(2e0, greatest(0.1e0, 0.1e0 + 1.9e0 / (1 + d / s / 0.3e0))), 6) AS weight FROM m")
def distance_weight(spark, sf_dir):
    n = F.col("id")
    return _t(spark, sf_dir).select("frame", "id", F.round(advice.distance_weight((n % 16) / F.lit(64.0), (1 + n % 5) / F.lit(16.0)), 6).alias("weight"))


@query("probe_score", f"WITH {_T} SELECT frame, pid AS id, (pid % 9) * ((pid % 4) / 4e0) - 0.5e0 * ((pid % 8) / 8e0) AS score FROM t")
def probe_score(spark, sf_dir):
    n = F.col("id")
    return _t(spark, sf_dir).select("frame", "id", advice.probe_score(n % 9, (n % 4) / F.lit(4.0), (n % 8) / F.lit(8.0)).alias("score"))


@query("decision_records", f"WITH {_T} SELECT pid AS id, 'unified' AS tracker, (pid + frame) % 3 AS rounds FROM t")
def decision_records(spark, sf_dir):
    """Decisions to JSON and back."""
    rows = _t(spark, sf_dir).select("id", F.lit("unified").alias("tracker"), ((F.col("id") + F.col("frame")) % 3).alias("rounds"))
    return advice.decisions(rows).select(F.from_json("record", "id long, tracker string, rounds long").alias("r")).select("r.*")


@query("quality_weights", f"WITH {_T} SELECT frame, pid AS id, round(greatest(pow(1 - (pid % 64) / 64e0, 3e0), 0.05e0), 6) AS weight FROM t")
def quality_weights(spark, sf_dir):
    return _t(spark, sf_dir).select("frame", "id", F.round(geometry.quality_weight((F.col("id") % 64) / F.lit(64.0), 3.0), 6).alias("weight"))


@query("multi_term_cost", f"WITH {_T} SELECT frame, pid AS id, round(0.5e0 * abs(x) + 0.25e0 * abs(y) / 0.5e0 + 0.125e0 * abs(z) / 0.25e0 + 0.125e0 * abs(pid % 7 - 3), 6) AS cost FROM t")
def multi_term_cost(spark, sf_dir):
    cost = geometry.multi_term_cost(F.abs("x"), F.col("id") % 7 - 3, 0.5, (4.0, 2.0, 1.0, 1.0), F.abs("y"), F.abs("z"))
    return _t(spark, sf_dir).select("frame", "id", F.round(cost, 6).alias("cost"))


# --- order and sets --------------------------------------------------------------------------------------------------------------------------


@query("sorted_targets", f"WITH {_T} SELECT frame, pid AS id, row_number() OVER (PARTITION BY frame ORDER BY y, pid) AS by_y, row_number() OVER (PARTITION BY frame ORDER BY x, pid) AS by_x FROM t")
def sorted_targets(spark, sf_dir):
    rank = lambda c: F.row_number().over(Window.partitionBy("frame").orderBy(c, "id")).cast("long")
    return _t(spark, sf_dir).select("frame", "id", rank("y").alias("by_y"), rank("x").alias("by_x"))


@query("sorted_pairs", f"WITH {_T} SELECT pid AS id, list_transform(list_sort(list({{'v': (frame * 5 + pid) % 8, 'f': frame}})), lambda s: s.f)[1] AS first, list_transform(list_sort(list({{'v': (frame * 5 + pid) % 8, 'f': frame}})), lambda s: s.f)[8] AS last FROM t GROUP BY pid")
def sorted_pairs(spark, sf_dir):
    """Values with what they belong to, sorted inside a group."""
    pairs = F.sort_array(F.collect_list(F.struct(((F.col("frame") * 5 + F.col("id")) % 8).alias("v"), F.col("frame").alias("f"))))
    return _t(spark, sf_dir).groupBy("id").agg(pairs.alias("p")).select("id", F.get("p", F.lit(0))["f"].alias("first"), F.get("p", F.lit(7))["f"].alias("last"))


@query("link_sets", f"WITH {_T}, a AS (SELECT frame, pid FROM t WHERE pid % 2 = 0), b AS (SELECT frame, pid FROM t WHERE pid % 3 = 0) SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b)")
def link_sets(spark, sf_dir):
    t = binding.truth(spark, sf_dir).select("frame", "pid")
    a, b = t.where("pid % 2 = 0"), t.where("pid % 3 = 0")
    named = lambda k, rows: rows.select(F.lit(k).alias("kind"), "frame", "pid")
    return named("both", a.intersect(b)).union(named("first", a.subtract(b))).union(named("any", a.union(b).distinct()))


@query("frame_times", f"WITH {_T} SELECT frame, pid AS id, frame / 500e0 AS seconds, printf('frame_%06d', frame) AS name FROM t")
def frame_times(spark, sf_dir):
    return _t(spark, sf_dir).select("frame", "id", (F.col("frame") / F.lit(500.0)).alias("seconds"), F.format_string("frame_%06d", F.col("frame")).alias("name"))


@query("nearest_next", f"WITH {_T} SELECT a.frame, a.pid AS i, min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS d2 FROM t a JOIN t b ON b.frame = a.frame + 1 GROUP BY a.frame, a.pid")
def nearest_next(spark, sf_dir):
    return spatial.nearest_in_next(_t(spark, sf_dir), 1.0)


@query("resolve_components")
def resolve_components(spark, sf_dir):
    """Links of least total cost in each component, by places; held against brute force in pytest."""
    return tracking.assign(_t(spark, sf_dir), 0.8).select("frame", "i", "k", F.round("cost", 6).alias("cost"))
