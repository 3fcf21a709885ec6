"""Queries of the library, each beside its DuckDB twin: name -> (function, SQL or None)."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import geometry
from skein.operators import images, kinematics, linking, matching, quality, spatial
from skein.plans import catalogue
from skein.sources import binding, store, text
from skein.streaming import streams

FLAGSHIP = "traj_accel_residual"
RADIUS = 2.0
XYZ = ("x", "y", "z")
_E, _T, _D = f"e AS ({binding.TRACKS_SQL})", f"t AS ({binding.TRUTH_SQL})", f"d AS ({binding.DROPPED_SQL})"
_W = "OVER (PARTITION BY trajid ORDER BY frame)"
_ALL, _query = catalogue.ALL, catalogue.query
_MODULES = ("linkage_queries", "tracking_queries", "camera_queries", "quality_queries", "image_queries", "source_queries", "calibration_queries", "merge_queries")


def _gather() -> dict[str, tuple]:
    for name in _MODULES:
        import_module(f"skein.plans.{name}")
    return _ALL


def queries() -> dict:
    return {name: f for name, (f, _) in _gather().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _gather().items() if sql}


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.tracks(spark, sf_dir)


def _t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.truth(spark, sf_dir)


def _tt(points: DataFrame) -> DataFrame:
    return points.withColumnRenamed("pid", "trajid")


# --- windows over trajectories -------------------------------------------------------------------------------------------------------

_ACC = f"a AS (SELECT * FROM (SELECT trajid, frame, lead(x) {_W} - 2 * x + lag(x) {_W} AS ax FROM e) WHERE ax IS NOT NULL)"


@_query("traj_accel_residual", f"""WITH {_E}, {_ACC}, s AS (SELECT trajid, sqrt(sum(ax * ax) / count(*)) AS r FROM a GROUP BY trajid)
SELECT e.trajid, count(*) AS n_points, coalesce(any_value(s.r), 0) AS residual FROM e LEFT JOIN s ON s.trajid = e.trajid GROUP BY e.trajid""")
def traj_accel_residual(spark, sf_dir):
    return kinematics.acceleration_residual(_e(spark, sf_dir))


@_query("window_velocity", f"WITH {_E} SELECT trajid, frame, (x - lag(x) {_W}) / (frame - lag(frame) {_W}) AS vx FROM e")
def window_velocity(spark, sf_dir):
    return kinematics.velocity(_e(spark, sf_dir))


@_query("window_acceleration", f"WITH {_E}, {_ACC} SELECT * FROM a")
def window_acceleration(spark, sf_dir):
    return kinematics.acceleration(_e(spark, sf_dir))


@_query("velocity_jump_rate", f"""WITH {_E}, s AS (SELECT trajid, x - lag(x) {_W} AS p, lead(x) {_W} - x AS q FROM e)
SELECT trajid, count(*) AS corners, CAST(count(*) FILTER (WHERE (abs(p) + abs(q)) / 2 > 1e-9 AND (abs(q - p) > (abs(p) + abs(q)) / 2 OR p * q < 0)) AS BIGINT) AS jumps
FROM s WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY trajid""")
def velocity_jump_rate(spark, sf_dir):
    return kinematics.velocity_jumps(_e(spark, sf_dir))


_TW = "OVER (PARTITION BY pid ORDER BY frame)"


@_query("turning_angle", f"""WITH {_D}, s AS (SELECT pid AS trajid, frame, {', '.join(f'{a} - lag({a}) {_TW} AS p{a}, lead({a}) {_TW} - {a} AS q{a}' for a in XYZ)} FROM d),
n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS n0, sqrt(qx * qx + qy * qy + qz * qz) AS n1 FROM s WHERE px IS NOT NULL AND qx IS NOT NULL)
SELECT trajid, frame, round(CASE WHEN n0 = 0 OR n1 = 0 OR (px = qx AND py = qy AND pz = qz) THEN 0e0 WHEN px = -qx AND py = -qy AND pz = -qz THEN 200e0
  ELSE acos(least(1e0, greatest(-1e0, (px * qx + py * qy + pz * qz) / (n0 * n1)))) * 200 / pi() END, 6) AS angle,
  round(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)), 6) AS acc FROM n""")
def turning_angle(spark, sf_dir):
    return kinematics.turning(_tt(binding.dropped_out(_t(spark, sf_dir))))


@_query("track_lifetime", f"WITH {_E} SELECT length, count(*) AS tracks FROM (SELECT trajid, count(*) AS length FROM e GROUP BY trajid) GROUP BY length")
def track_lifetime(spark, sf_dir):
    return kinematics.lifetimes(_e(spark, sf_dir))


@_query("traj_index", f"WITH {_E} SELECT trajid, min(frame) AS first, max(frame) AS last, count(*) AS length FROM e GROUP BY trajid")
def traj_index(spark, sf_dir):
    return kinematics.index(_e(spark, sf_dir))


@_query("drop_spikes", f"""WITH {_E}, s AS (SELECT *, lag(x) {_W} AS b, lead(x) {_W} AS n FROM e)
SELECT trajid, frame, x FROM s WHERE NOT coalesce(x > 100 AND x - (b + n) / 2 > 20, false)""")
def drop_spikes(spark, sf_dir):
    return kinematics.drop_spikes(_e(spark, sf_dir), "x", 100.0, 20.0)


@_query("trim_ends", f"""WITH {_E}, s AS (SELECT *, count(*) OVER (PARTITION BY trajid) AS n, row_number() {_W} AS i, row_number() OVER (PARTITION BY trajid ORDER BY frame DESC) AS j,
  sum(CASE WHEN x <= 60 THEN 1 ELSE 0 END) {_W} AS g0, sum(CASE WHEN x <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY trajid ORDER BY frame DESC) AS g1 FROM e)
SELECT trajid, frame, x FROM s WHERE NOT ((g0 = 0 AND i <= least(3, floor(n * 0.25))) OR (g1 = 0 AND j <= least(3, floor(n * 0.25))))""")
def trim_ends(spark, sf_dir):
    return kinematics.trim_ends(_e(spark, sf_dir), "x", 60.0)


@_query("fill_gaps", f"""WITH {_D}, n AS (SELECT *, lead(frame) {_TW} AS nf, {', '.join(f'lead({a}) {_TW} AS n{a}' for a in XYZ)} FROM d),
k AS (SELECT *, unnest(CASE WHEN nf - frame - 1 BETWEEN 1 AND 4 THEN range(0, nf - frame) ELSE [0] END) AS k FROM n)
SELECT pid AS trajid, frame + k AS frame, {', '.join(f'CASE WHEN k = 0 THEN {a} ELSE {a} + (n{a} - {a}) * k / (nf - frame) END AS {a}' for a in XYZ)}, k > 0 AS filled FROM k""")
def fill_gaps(spark, sf_dir):
    return kinematics.fill_gaps(_tt(binding.dropped_out(_t(spark, sf_dir))), XYZ)


@_query("savgol_interior", f"""WITH {_E}, s AS (SELECT trajid, frame, round((-3 * lag(x, 2) {_W} + 12 * lag(x) {_W} + 17 * x + 12 * lead(x) {_W} - 3 * lead(x, 2) {_W}) / 35, 6) AS smooth FROM e)
SELECT * FROM s WHERE smooth IS NOT NULL""")
def savgol_interior(spark, sf_dir):
    return kinematics.savgol(_e(spark, sf_dir))


@_query("session_gaps", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY user_id, k""")
def session_gaps(spark, sf_dir):
    return kinematics.sessions(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts"))


# --- spatial joins -------------------------------------------------------------------------------------------------------------------

_D2 = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)"
_PAIRS = f"p AS (SELECT a.frame, a.pid AS i, b.pid AS k, {_D2} AS d2 FROM t a JOIN t b ON a.frame = b.frame AND {_D2} <= 4)"


@_query("radius_join", f"WITH {_T}, {_PAIRS} SELECT * FROM p WHERE i <> k")
def radius_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    return spatial.radius_join(spatial.side(t, "i"), spatial.side(t, "k"), RADIUS).where("i <> k")


@_query("knn_join", f"WITH {_T}, {_PAIRS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY d2, k) AS rank FROM p) WHERE rank <= 4")
def knn_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    return spatial.nearest(spatial.side(t, "i"), spatial.side(t, "k"), RADIUS, 4)


@_query("box_candidates_topk", f"""WITH {_T}, p AS (SELECT a.frame, a.pid AS i, b.pid AS k, {_D2} AS d2 FROM t a JOIN t b ON a.frame + 1 = b.frame AND abs(b.x - a.x) < 1.5 AND abs(b.y - a.y) < 1 AND abs(b.z - a.z) < 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY d2, k) AS rank FROM p) WHERE rank <= 32""")
def box_candidates_topk(spark, sf_dir):
    t = _t(spark, sf_dir)
    return spatial.box_candidates(spatial.side(t, "i"), spatial.side(t, "k", shift=-1), (1.5, 1.0, 2.0))


@_query("neighbour_count", f"WITH {_T}, {_PAIRS} SELECT t.frame, t.pid, count(p.k) AS neighbours FROM t LEFT JOIN p ON p.frame = t.frame AND p.i = t.pid AND p.k <> t.pid GROUP BY t.frame, t.pid")
def neighbour_count(spark, sf_dir):
    return spatial.neighbour_counts(_t(spark, sf_dir), RADIUS)


@_query("nn_spacing", f"""WITH {_T}, n AS (SELECT a.frame, a.pid AS i, sqrt(min({_D2})) AS d FROM t a JOIN t b ON a.frame = b.frame AND a.pid <> b.pid GROUP BY a.frame, a.pid)
SELECT frame, count(*) AS points, round(avg(d), 6) AS mean_nn, round(min(d), 6) AS min_nn, round(max(d), 6) AS max_nn FROM n GROUP BY frame""")
def nn_spacing(spark, sf_dir):
    return spatial.spacing_unbounded(_t(spark, sf_dir), RADIUS)


# --- cameras -------------------------------------------------------------------------------------------------------------------------

_CAMS = ", ".join(f"({c}, {s})" for c, s in matching.CAMERAS.items())
_TG = f"g AS MATERIALIZED (SELECT t.frame, CAST(cam AS BIGINT) AS cam, t.pid AS pnr, t.x + shift * t.z / 64e0 AS u, t.y AS v, t.pid % 97 + 20 AS sumg FROM t, (VALUES {_CAMS}) AS k(cam, shift))"


def _edge_sql(a: int, b: int) -> str:
    return f"""e{a}{b} AS MATERIALIZED (SELECT l.frame, l.pnr AS p1, r.pnr AS p2, l.sumg + r.sumg AS corr, abs(r.v - l.v) AS dist FROM g l JOIN g r ON l.frame = r.frame AND l.cam = {a} AND r.cam = {b}
  AND abs(r.v - l.v) < 0.125 AND r.u >= l.u AND r.u - l.u <= 4 AND CAST(least(l.sumg, r.sumg) AS DOUBLE) / greatest(l.sumg, r.sumg) >= 0.5)"""


def _targets(spark, sf_dir):
    return matching.targets(_t(spark, sf_dir))


def _edges(t, cams):
    return {(a, b): matching.epipolar_candidates(t, a, b, 0.125, 4.0, 0.5) for n, b in enumerate(cams) for a in cams[:n]}


@_query("camera_targets", f"WITH {_T}, {_TG} SELECT * FROM g")
def camera_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@_query("epipolar_candidates", f"WITH {_T}, {_TG}, {_edge_sql(0, 1)} SELECT * FROM e01")
def epipolar_candidates(spark, sf_dir):
    return _edges(_targets(spark, sf_dir), (0, 1))[0, 1]


@_query("cliques3", f"""WITH {_T}, {_TG}, {_edge_sql(0, 1)}, {_edge_sql(0, 2)}, {_edge_sql(1, 2)}
SELECT a.frame, a.p1 AS p0, a.p2 AS p1, b.p2 AS p2, a.corr + b.corr + c.corr AS corr, a.dist + b.dist + c.dist AS dist
FROM e01 a JOIN e02 b ON b.frame = a.frame AND b.p1 = a.p1 JOIN e12 c ON c.frame = a.frame AND c.p1 = a.p2 AND c.p2 = b.p2""")
def cliques3(spark, sf_dir):
    return matching.cliques(_edges(_targets(spark, sf_dir), (0, 1, 2)), (0, 1, 2))


@_query("pairs_unique", f"""WITH {_T}, {_TG}, {_edge_sql(0, 1)}
SELECT frame, p1, p2, corr, dist FROM (SELECT *, count(*) OVER (PARTITION BY frame, p1) AS n1, count(*) OVER (PARTITION BY frame, p2) AS n2 FROM e01) WHERE n1 = 1 AND n2 = 1""")
def pairs_unique(spark, sf_dir):
    return matching.unique_pairs(_edges(_targets(spark, sf_dir), (0, 1))[0, 1])


@_query("pixel_metric_roundtrip", f"WITH {_T} SELECT frame, pid, (x - 512e0) * 0.015625e0 AS mx, (384e0 - y) * 0.015625e0 AS my, x AS px, y AS py FROM t")
def pixel_metric_roundtrip(spark, sf_dir):
    t = _t(spark, sf_dir)
    mx, my = geometry.pixel_to_metric(F.col("x"), F.col("y"), 1024, 768, 0.015625, 0.015625)
    px, py = geometry.metric_to_pixel(F.col("mx"), F.col("my"), 1024, 768, 0.015625, 0.015625)
    return t.select("frame", "pid", mx.alias("mx"), my.alias("my")).select("frame", "pid", "mx", "my", px.alias("px"), py.alias("py"))


@_query("brown_distort", f"""WITH {_T}, n AS (SELECT frame, pid, x / 64 AS x, y / 64 AS y, (x * x + y * y) / 4096 AS r2 FROM t)
SELECT frame, pid, round(1.01e0 * (x + x * (0.01e0 * r2 + 0.001e0 * r2 * r2) + 0.002e0 * (r2 + 2 * x * x) + 2 * 0.003e0 * x * y) - sin(0.01e0) * (y + y * (0.01e0 * r2 + 0.001e0 * r2 * r2) + 0.003e0 * (r2 + 2 * y * y) + 2 * 0.002e0 * x * y), 6) AS dx,
  round(cos(0.01e0) * (y + y * (0.01e0 * r2 + 0.001e0 * r2 * r2) + 0.003e0 * (r2 + 2 * y * y) + 2 * 0.002e0 * x * y), 6) AS dy FROM n""")
def brown_distort(spark, sf_dir):
    u, v = geometry.brown_distort(F.col("x") / 64, F.col("y") / 64, 0.01, 0.001, 0.0, 0.002, 0.003, 1.01, 0.01)
    return _t(spark, sf_dir).select("frame", "pid", F.round(u, 6).alias("dx"), F.round(v, 6).alias("dy"))


@_query("skew_midpoint", f"""WITH {_T}, r AS (SELECT frame, pid, x, y, z, x - 100 AS ux, y AS uy, z + 50 AS uz, x + 100 AS vx, y - 3 AS vy, z + 50 AS vz FROM t)
SELECT frame, pid, round(x, 5) AS mx, round(y, 5) AS my, round(z, 5) AS mz, true AS close FROM r""")
def skew_midpoint(spark, sf_dir):
    return _midpoints(_t(spark, sf_dir))


def _midpoints(points):
    c = F.col
    p, q = (F.lit(100.0), F.lit(0.0), F.lit(-50.0)), (F.lit(-100.0), F.lit(3.0), F.lit(-50.0))
    u, v = (c("x") - 100, c("y"), c("z") + 50), (c("x") + 100, c("y") - 3, c("z") + 50)
    m, gap = geometry.skew_midpoint(p, u, q, v)
    return points.select("frame", "pid", *[(F.round(x, 5) + 0.0).alias(n) for x, n in zip(m, ("mx", "my", "mz"))], (gap < 1e-6).alias("close"))


@_query("camera_support", f"WITH {_T} SELECT frame, pid, CAST((pid % 2 > 0)::INT + (pid % 3 > 0)::INT + (pid % 5 > 0)::INT + 1 AS BIGINT) AS support FROM t")
def camera_support(spark, sf_dir):
    ids = F.array(*[F.when(F.col("pid") % m > 0, F.col("pid")).otherwise(F.lit(-1)) for m in (2, 3, 5)], F.col("pid"))
    return matching.camera_support(_t(spark, sf_dir).withColumn("cam_ids", ids)).select("frame", "pid", "support")


@_query("uniqueness_pairs", f"""WITH {_T} SELECT frame, pid, cam, target, conf FROM (SELECT *, row_number() OVER (PARTITION BY frame, cam, target ORDER BY conf DESC, pid) AS r FROM (
  SELECT frame, pid, CAST(0 AS BIGINT) AS cam, CAST(floor(x * 16) AS BIGINT) AS target, (pid * 13) % 64 / 64e0 AS conf FROM t)) WHERE r = 1""")
def uniqueness_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir).select("frame", "pid", F.lit(0).cast("long").alias("cam"), F.floor(F.col("x") * 16).cast("long").alias("target"), (((F.col("pid") * 13) % 64) / F.lit(64.0)).alias("conf"))
    return quality.conflicts(rows)


# --- quality of points and runs --------------------------------------------------------------------------------------------------------

_MISS = "m AS (SELECT frame, pid, (pid % 64) / 16e0 AS miss, CAST(3 + pid % 2 AS BIGINT) AS cams, (pid % 17) / 32e0 AS spread FROM t)"


def _missed(spark, sf_dir):
    p = F.col("pid")
    return _t(spark, sf_dir).select("frame", "pid", ((p % 64) / F.lit(16.0)).alias("miss"), (3 + p % 2).alias("cams"), ((p % 17) / F.lit(32.0)).alias("spread"))


def _curve_sql(ys) -> str:
    xs = geometry.GHOST_X
    steps = " ".join(f"WHEN miss <= {b}e0 THEN {p}e0 + (miss - {a}e0) * ({q}e0 - {p}e0) / ({b}e0 - {a}e0)" for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]))
    return f"CASE WHEN miss <= {xs[0]}e0 THEN {ys[0]}e0 {steps} ELSE {ys[-1]}e0 END"


@_query("ghost_probability", f"WITH {_T}, {_MISS} SELECT frame, pid, round(CASE WHEN cams >= 4 THEN {_curve_sql(geometry.GHOST_4)} ELSE {_curve_sql(geometry.GHOST_3)} END, 6) AS ghost FROM m")
def ghost_probability(spark, sf_dir):
    return _missed(spark, sf_dir).select("frame", "pid", F.round(geometry.ghost_probability(F.col("miss"), F.col("cams"), F.lit(1.0)), 6).alias("ghost"))


@_query("ghost_brightness", f"""WITH {_T}, {_MISS}, z AS (SELECT frame, pid, -1.71e0 + 2.34e0 * ln(greatest(miss, 1e-3)) + (2.5e0 + 0.57e0 * ln(spread + 0.05e0)) * (cams < 4)::INT + 1.73e0 * ln(spread + 0.05e0) AS z FROM m)
SELECT frame, pid, round(1 / (1 + exp(-z)), 6) AS ghost FROM z""")
def ghost_brightness(spark, sf_dir):
    return _missed(spark, sf_dir).select("frame", "pid", F.round(geometry.ghost_with_brightness(F.col("miss"), F.col("cams"), F.lit(1.0), F.col("spread")), 6).alias("ghost"))


@_query("search_radius", f"WITH {_E}, s AS (SELECT trajid, frame, abs(x - lag(x) {_W}) AS s FROM e) SELECT trajid, frame, CASE WHEN s > 1e-6 THEN 6e0 ELSE 8e0 END AS along, CASE WHEN s > 1e-6 THEN 2e0 ELSE 8e0 END AS across FROM s WHERE s IS NOT NULL")
def search_radius(spark, sf_dir):
    along, across = geometry.search_radius(F.abs(F.col("vx")), 8.0, 2.0, 3.0)
    return kinematics.velocity(_e(spark, sf_dir)).where("vx is not null").select("trajid", "frame", along.alias("along"), across.alias("across"))


@_query("brightness_shares", f"""WITH {_T}, b AS (SELECT frame, pid // 4 AS blob, pid AS member, (pid * 31 + frame) % 50 - 10 AS g FROM t),
f AS (SELECT frame, blob, member, coalesce(CASE WHEN g > 0 THEN g END, median(CASE WHEN g > 0 THEN g END) OVER (PARTITION BY frame, blob), 1) AS g FROM b)
SELECT frame, blob, member, round(g / sum(g) OVER (PARTITION BY frame, blob), 6) AS share FROM f""")
def brightness_shares(spark, sf_dir):
    rows = _t(spark, sf_dir).select("frame", F.expr("pid div 4").alias("blob"), F.col("pid").alias("member"), ((F.col("pid") * 31 + F.col("frame")) % 50 - 10).alias("g"))
    return quality.brightness_shares(rows)


@_query("brightness_spread", f"WITH {_T}, g AS (SELECT frame, pid AS pnr, unnest([pid % 97 + 20, pid % 89 + 25, pid % 83 + 30]) AS s FROM t) SELECT frame, pnr, round(stddev_pop(ln(s)), 6) AS spread FROM g GROUP BY frame, pnr")
def brightness_spread(spark, sf_dir):
    p = F.col("pid")
    return quality.brightness_spread(_t(spark, sf_dir).select("frame", p.alias("pnr"), F.explode(F.array(p % 97 + 20, p % 89 + 25, p % 83 + 30)).alias("sumg")))


@_query("density_class", f"WITH {_E}, s AS (SELECT trajid, max(abs(d)) / 512 AS r FROM (SELECT trajid, x - lag(x) {_W} AS d FROM e) GROUP BY trajid) SELECT trajid, CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.6 THEN 'low_to_moderate' WHEN r < 0.9 THEN 'moderate' ELSE 'high' END AS class FROM s WHERE r IS NOT NULL")
def density_class(spark, sf_dir):
    most = kinematics.velocity(_e(spark, sf_dir)).groupBy("trajid").agg((F.max(F.abs("vx")) / 512).alias("r")).where("r is not null")
    return most.select("trajid", quality.density_class(F.col("r")).alias("class"))


# --- sources and streams -----------------------------------------------------------------------------------------------------------------


@_query("text_lines", f"WITH {_D}, r AS (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY pid) - 1 AS INTEGER) AS row_id, x, y, z FROM d) SELECT frame, row_id, CAST(-1 AS INTEGER) AS prev, CAST(-2 AS INTEGER) AS next, x, y, z FROM r")
def text_lines(spark, sf_dir):
    """Points written as text of one frame each and parsed again; coordinates are multiples of 1/64, so six decimals hold them."""
    rows = binding.dropped_out(_t(spark, sf_dir)).withColumn("row_id", (F.row_number().over(Window.partitionBy("frame").orderBy("pid")) - 1))
    return text.parse(text.lines(rows.select("frame", "row_id", F.lit(-1).alias("prev"), F.lit(-2).alias("next"), *XYZ), "ptv_is"), "ptv_is")


@_query("trajectory_rows", f"WITH {_E}, i AS (SELECT trajid, min(frame) AS first, max(frame) AS last, count(*) AS length FROM e GROUP BY trajid) SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY trajid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM i")
def trajectory_rows(spark, sf_dir):
    return store.index(_e(spark, sf_dir))


@_query("newest_generation", f"WITH {_T}, g AS (SELECT frame, pid AS row_id, n AS gen, x + n AS x FROM t, unnest(range(0, 3)) AS u(n) WHERE frame % 3 >= n) SELECT frame, row_id, gen, x FROM (SELECT *, max(gen) OVER (PARTITION BY frame) AS last FROM g) WHERE gen = last")
def newest_generation(spark, sf_dir):
    rows = _t(spark, sf_dir).withColumn("gen", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).where("frame % 3 >= gen")
    return store.newest(rows.select("frame", F.col("pid").alias("row_id"), "gen", (F.col("x") + F.col("gen")).alias("x")))


@_query("stream_session_gaps", _ALL["session_gaps"][1])
def stream_session_gaps(spark, sf_dir):
    return streams.run(streams.sessions(streams.source(spark, sf_dir).select("user_id", "ts")))


@_query("stream_tumbling_chunks", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS chunk, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_tumbling_chunks(spark, sf_dir):
    return streams.run(streams.chunks(streams.source(spark, sf_dir)))
