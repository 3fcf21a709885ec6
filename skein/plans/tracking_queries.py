"""Queries on trackers, matching and metrics against the truth, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.engines import imaging
from skein.engines import tracking as engine
from skein.operators import kinematics, linking, metrics, reports, spatial, stereo, tracking, windows
from skein.plans.catalogue import query
from skein.shared import kept
from skein.sources import binding

RADIUS = 2.0
_T, _E = f"t AS ({binding.TRUTH_SQL})", f"e AS ({binding.TRACKS_SQL})"
_D2 = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)"


def rounds(n: int, source: str, name: str = "links", alone: str = "") -> str:
    """Cheapest first, each end once, as n rounds of mutual best and removal: CTEs ending in `name`."""
    parts, left = [], source
    for r in range(n):
        parts.append(f"{name}_b{r} AS MATERIALIZED (SELECT frame, i, k, cost FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY cost, i, k) AS ri, row_number() OVER (PARTITION BY frame, k ORDER BY cost, i, k) AS rk FROM {left}) WHERE ri = 1 AND rk = 1)")
        parts.append(f"{name}_l{r} AS MATERIALIZED (SELECT frame, i, k, cost FROM {left} x WHERE NOT EXISTS (SELECT 1 FROM {name}_b{r} b WHERE b.frame = x.frame AND b.i = x.i) AND NOT EXISTS (SELECT 1 FROM {name}_b{r} b WHERE b.frame = x.frame AND b.k = x.k))")
        left = f"{name}_l{r}"
    return ", ".join(parts) + f", {name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {name}_b{r}" for r in range(n)) + ")"


_EDGES = f"c AS MATERIALIZED (SELECT a.frame, a.pid AS i, b.pid AS k, {_D2} AS cost FROM t a JOIN t b ON b.frame = a.frame + 1 AND {_D2} <= 4)"
_LINKS = f"{_T}, {_EDGES}, {rounds(10, 'c')}"


def _points(spark, sf_dir):
    return binding.truth(spark, sf_dir).withColumnRenamed("pid", "id")


@query("link_nearest_l3", f"WITH {_LINKS} SELECT * FROM links")
def link_nearest_l3(spark, sf_dir):
    return tracking.link_nearest(_points(spark, sf_dir), RADIUS)


@query("greedy_selection", f"WITH {_LINKS} SELECT frame, i, k FROM links")
def greedy_selection(spark, sf_dir):
    """The same links from tables of edges, ring by ring and by distributed rounds."""
    return linking.nearest_first(_points(spark, sf_dir), RADIUS, key="id", most=0).select("frame", "i", "k")


@query("frame_stats", f"WITH {_LINKS} SELECT t.frame, count(*) AS n_points, count(l.i) AS n_links FROM t LEFT JOIN links l ON l.frame = t.frame AND l.i = t.pid GROUP BY t.frame")
def frame_stats(spark, sf_dir):
    n = link_nearest_l3(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n_links"))
    return _points(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n_points")).join(n, "frame", "left").select("frame", "n_points", F.coalesce("n_links", F.lit(0)).alias("n_links"))


# Predictions with the true links before: 2 x1 - x0 for points that have one, their neighbours' flow for the others.
_HALF = 0.75
_BOX = " AND ".join(f"abs(b.{a} - a.{a}) < {_HALF}" for a in "xyz")


def _level(source: str) -> str:
    return f"d AS MATERIALIZED (SELECT a.frame, a.pid AS i, b.pid AS k, sqrt({_D2}) AS cost, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY sqrt({_D2}), b.pid) AS r FROM {source} a JOIN t b ON b.frame = a.frame + 1 AND {_BOX}), f AS MATERIALIZED (SELECT frame, i, k, cost FROM d WHERE r <= 32)"


@query("link_predict_l1", f"WITH {_T}, p AS (SELECT b.frame, b.pid, 2 * b.x - a.x AS x, 2 * b.y - a.y AS y, 2 * b.z - a.z + (b.pid % 5) / 8e0 AS z FROM t b JOIN t a ON a.pid = b.pid AND a.frame = b.frame - 1 WHERE b.frame < 7), {_level('p')}, {rounds(8, 'f')} SELECT frame, i, k, round(cost, 6) AS cost FROM links")
def link_predict_l1(spark, sf_dir):
    t, w = binding.truth(spark, sf_dir), Window.partitionBy("pid").orderBy("frame")
    ahead = t.select("frame", F.col("pid").alias("id"), *[(2 * F.col(a) - F.lag(a).over(w) + (F.col("pid") % 5 / F.lit(8.0) if a == "z" else F.lit(0.0))).alias(a) for a in "xyz"]).where(f"x IS NOT NULL AND frame < {binding.FRAMES - 1}")
    return tracking.link_predicted(ahead, _points(spark, sf_dir), _HALF).withColumn("cost", F.round("cost", 6))


_NEW = "(a.pid + a.frame) % 4 = 0"


@query("link_neighbour_flow_l2", f"""WITH {_T}, v AS MATERIALIZED (SELECT b.frame, b.pid, b.x, b.y, b.z, b.x - a.x AS vx, b.y - a.y AS vy, b.z - a.z AS vz FROM t b JOIN t a ON a.pid = b.pid AND a.frame = b.frame - 1 WHERE NOT (b.pid + b.frame) % 4 = 0),
n AS (SELECT a.frame, a.pid, a.x, a.y, a.z, avg(vx) AS vx, avg(vy) AS vy, avg(vz) AS vz FROM t a JOIN v b ON b.frame = a.frame AND b.pid <> a.pid AND {' AND '.join(f'abs(b.{a} - a.{a}) < 2' for a in 'xyz')} WHERE {_NEW} AND a.frame BETWEEN 1 AND 6 GROUP BY ALL),
p AS (SELECT frame, pid, x + vx AS x, y + vy AS y, z + vz AS z FROM n), {_level('p')}, {rounds(8, 'f')} SELECT frame, i, k, round(cost, 6) AS cost FROM links""")
def link_neighbour_flow_l2(spark, sf_dir):
    t, w = binding.truth(spark, sf_dir), Window.partitionBy("pid").orderBy("frame")
    new = (F.col("id") + F.col("frame")) % 4 == 0
    moving = t.select("frame", F.col("pid").alias("id"), *"xyz", *[(F.col(a) - F.lag(a).over(w)).alias(f"v{a}") for a in "xyz"]).where("vx IS NOT NULL")
    some = _points(spark, sf_dir).where(new & F.col("frame").between(1, binding.FRAMES - 2))
    flow = tracking.neighbour_flow(some, moving.where(~new), 2.0)
    ahead = some.join(flow, ["frame", "id"]).select("frame", "id", *[(F.col(a) + F.col(f"v{a}")).alias(a) for a in "xyz"])
    return tracking.link_predicted(ahead, _points(spark, sf_dir), _HALF).withColumn("cost", F.round("cost", 6))


# Windows of two frames: small, so that even this short run has several whose states are carried on.
_FRAMES = 2


@query("cascade_track")
def cascade_track(spark, sf_dir):
    """All three levels over whole runs; windows are held against one sequential pass in pytest, the steps against plain loops."""
    return windows.cascade(_points(spark, sf_dir), 0.75, frames=_FRAMES)


@query("cascade_track_chunks")
def cascade_track_chunks(spark, sf_dir):
    """Chunks that overlap, with no state carried."""
    return tracking.track(_points(spark, sf_dir), lambda x: engine.cascade(x, 0.75), frames=4, overlap=2)


@query("link_4be")
def link_4be(spark, sf_dir):
    """Best estimate over four frames."""
    return windows.four_be(_points(spark, sf_dir), 0.75, frames=_FRAMES)


@query("track_back")
def track_back(spark, sf_dir):
    return windows.two_directional(_points(spark, sf_dir), 0.75, 0.5, frames=_FRAMES)


@query("nearest_assignment_track")
def nearest_assignment_track(spark, sf_dir):
    return windows.nearest_assignment(_points(spark, sf_dir), frames=_FRAMES, v_max=0.9, a_max=0.4, max_gap=1, dt=1.0)


@query("two_phase_track")
def two_phase_track(spark, sf_dir):
    return windows.two_phase(_points(spark, sf_dir), engine.TwoPhase(v_max=0.9, max_gap=2), frames=_FRAMES)


@query("two_phase_bidirectional")
def two_phase_bidirectional(spark, sf_dir):
    return windows.two_phase(_points(spark, sf_dir), engine.TwoPhase(v_max=0.9, bidirectional=True), frames=_FRAMES)


@query("hybrid_track")
def hybrid_track(spark, sf_dir):
    return windows.hybrid(_points(spark, sf_dir), 3, 0.3, 0.1, gate=0.5, frames=_FRAMES)


def _images(spark, sf_dir):
    """Detections with drop-outs, and the targets of all points in four plain cameras: those of missing detections are free."""
    from skein.plans.camera_queries import PLAIN

    n = F.col("pid")
    points = binding.dropped_out(binding.truth(spark, sf_dir)).select("frame", n.alias("id"), *"xyz", F.array(n, n, n, n).alias("cam_ids"))
    seen = stereo.project(_points(spark, sf_dir), PLAIN).select("frame", "cam", F.col("id").alias("pnr"), F.col("u").alias("x"), F.col("v").alias("y"))
    return windows.in_images(points, seen, PLAIN, imaging.Search((-0.35,) * 3, (0.35,) * 3, 0.2, 60.0), frames=_FRAMES)


@query("image_track")
def image_track(spark, sf_dir):
    """Links chosen in the images, with points added from free targets; steps are held against loops over particles in pytest, windows against one pass."""
    return _images(spark, sf_dir)[0]


@query("image_added_points")
def image_added_points(spark, sf_dir):
    """The points that the tracker added, each with the targets it claimed."""
    return _images(spark, sf_dir)[1].withColumns({a: F.round(a, 6) for a in "xyz"})


@query("mht_relink")
def mht_relink(spark, sf_dir):
    rows = windows.mht_relink(binding.linkage(spark, sf_dir, faults=False).drop("pid"), 3, 0.5)
    return rows.withColumns({"prev": F.coalesce("prev", F.lit(-1)), "next": F.coalesce("next", F.lit(-2))})


@query("shared_observations")
def shared_observations(spark, sf_dir):
    """Points that several tracks would claim, with the claimants."""
    return windows.shared_points(binding.linkage(spark, sf_dir, faults=False), 0.5, frames=_FRAMES)


@query("assignment_hungarian")
def assignment_hungarian(spark, sf_dir):
    """Held against brute force in pytest."""
    return tracking.assign(_points(spark, sf_dir), 0.8).withColumn("cost", F.round("cost", 6))


_FWD = "fw AS MATERIALIZED (SELECT frame, i, 1 AS step, k, cost FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY cost, k) AS r, row_number() OVER (PARTITION BY frame, k ORDER BY cost, i) AS q FROM c) WHERE r = 1 AND q = 1 AND i % 3 > 0)"
_BWD = "bw AS MATERIALIZED (SELECT frame, i, k, sqrt(cost) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY frame, k ORDER BY cost, i) AS r FROM c) WHERE r = 1)"


@query("merge_bidirectional", f"""WITH {_T}, {_EDGES}, {_FWD}, {_BWD}, w AS MATERIALIZED (SELECT bw.* FROM bw LEFT JOIN (SELECT frame, i, true AS taken FROM fw) p ON p.frame = bw.frame AND p.i = bw.i LEFT JOIN (SELECT frame, k, true AS taken FROM fw) q ON q.frame = bw.frame AND q.k = bw.k WHERE p.taken IS NULL AND q.taken IS NULL),
{rounds(5, 'w')} SELECT frame, i, step, k FROM fw UNION ALL SELECT frame, i, 1, k FROM links""")
def merge_bidirectional(spark, sf_dir):
    points = _points(spark, sf_dir)
    ahead, back = (kept(f) for f in linking.firsts(points, RADIUS, key="id"))
    edge = lambda rows: rows.select("frame", "i", F.lit(1).cast("long").alias("step"), "k")
    both = ahead.join(back.select("frame", "i", "k").hint("merge"), ["frame", "i", "k"], "left_semi")
    return tracking.merge_directions(edge(both.where("i % 3 > 0")), edge(back), points)


@query("layer_assignment", f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (pid * 7 + frame) % 5 DESC, pid DESC) - 1 AS r, count(*) OVER (PARTITION BY frame) AS n FROM t)
SELECT frame, pid, CASE WHEN r < floor(n * CAST(1 AS DOUBLE) / 3) THEN 0 WHEN r < floor(n * CAST(2 AS DOUBLE) / 3) THEN 1 ELSE 2 END AS layer FROM r""")
def layer_assignment(spark, sf_dir):
    rows = binding.truth(spark, sf_dir).select("frame", F.col("pid").alias("id"), ((F.col("pid") * 7 + F.col("frame")) % 5).alias("score"))
    return tracking.layers(rows, "score").select("frame", F.col("id").alias("pid"), "layer")


# --- against the truth: tracks that are cut, swapped, shifted and missing -----------------------------------------------------------------

_TT = f"t AS MATERIALIZED (SELECT pid, frame, x + 64 * (pid // 1280) AS x, y, z FROM ({binding.TRUTH_SQL}))"
_P = """p AS MATERIALIZED (SELECT CASE WHEN pid % 7 = 0 AND frame >= 4 THEN pid + 1 WHEN pid % 7 = 1 AND frame >= 4 THEN pid - 1 WHEN pid % 5 = 2 AND frame >= 3 THEN pid + 10000000 ELSE pid END AS trajid,
  frame, pid, CASE WHEN pid % 13 = 0 THEN x + 300 WHEN pid % 11 = 3 AND frame = 5 THEN x + 200 ELSE x END AS x, y, z FROM t WHERE NOT (pid % 6 = 5 AND frame = 2))"""
_M = f"m AS MATERIALIZED (SELECT p.*, a.pid AS hit FROM p LEFT JOIN t a ON a.frame = p.frame AND (a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y) + (a.z - p.z) * (a.z - p.z) <= 1e-6)"


def _true(spark, sf_dir):
    return binding.truth(spark, sf_dir).withColumn("x", F.col("x") + 64 * F.expr("pid div 1280"))


def _shift(n, f):
    """How far off a point's track has it: every 13th customer wholly, some at one frame."""
    return F.when(n % 13 == 0, 300).when((n % 11 == 3) & (f == 5), 200).otherwise(0)


def _tracks(spark, sf_dir):
    """Tracks of all customers with planted faults: some are cut, swapped or shifted, and a sixth has a gap at frame 2, which is what the metrics are to find."""
    n, f = F.col("pid"), F.col("frame")
    of = F.when((n % 7 == 0) & (f >= 4), n + 1).when((n % 7 == 1) & (f >= 4), n - 1).when((n % 5 == 2) & (f >= 3), n + 10000000).otherwise(n)
    rows = _true(spark, sf_dir).where("NOT (pid % 6 = 5 AND frame = 2)")
    return rows.select(of.alias("trajid"), "frame", (F.col("x") + _shift(n, f)).alias("x"), "y", "z")


@query("identity_metrics", f"""WITH {_TT}, {_P}, {_M}, h AS (SELECT hit, count(DISTINCT trajid) AS f, count(DISTINCT frame) AS c FROM m WHERE hit IS NOT NULL GROUP BY hit), g AS (SELECT pid, count(*) AS frames FROM t GROUP BY pid),
a AS (SELECT count(*) AS n_true, round(avg(coalesce(f, 0)), 6) AS fragmentation, round(avg(coalesce(c, 0) / frames), 6) AS completeness FROM g LEFT JOIN h ON h.hit = g.pid),
b AS (SELECT trajid, max(n) AS major, sum(n) AS matched FROM (SELECT trajid, hit, count(*) AS n FROM m WHERE hit IS NOT NULL GROUP BY trajid, hit) GROUP BY trajid), c AS (SELECT trajid, count(*) AS n FROM m GROUP BY trajid),
d AS (SELECT count(*) AS n_tracks, round(avg(major / matched), 6) AS purity, count(*) FILTER (WHERE major / n >= 2e0 / 3) AS n_correct FROM c LEFT JOIN b ON b.trajid = c.trajid),
e AS (SELECT count(*) FILTER (WHERE hit IS NULL) AS n_ghosts, count(*) AS n_points FROM m)
SELECT fragmentation, completeness, purity, round(100 * n_correct / n_tracks, 6) AS pmt, n_true, n_tracks, n_correct, round(n_ghosts / n_points, 6) AS ghost_rate, n_ghosts FROM a, d, e""")
def identity_metrics(spark, sf_dir):
    """Shifted points match nothing true; here they are the ghosts."""
    off = _true(spark, sf_dir).withColumn("_by", _shift(F.col("pid"), F.col("frame"))).where("_by > 0").select("frame", F.col("pid").alias("id"), (F.col("x") + F.col("_by")).alias("x"), "y", "z")
    return metrics.identity(_tracks(spark, sf_dir), _true(spark, sf_dir), 1e-3, off)


@query("e_track", f"""WITH {_TT}, {_P}, {_M}, q AS (SELECT trajid, count(*) AS n, count(hit) AS matched, count(DISTINCT hit) AS ids FROM m GROUP BY trajid),
h AS (SELECT hit, count(DISTINCT m.trajid) AS tracks, max(q.n) AS n, max(matched) AS matched, max(ids) AS ids FROM m JOIN q ON q.trajid = m.trajid WHERE hit IS NOT NULL GROUP BY hit), g AS (SELECT pid, count(*) AS frames FROM t GROUP BY pid),
k AS (SELECT CASE WHEN tracks IS NULL THEN 'missed' WHEN tracks > 1 THEN 'fragmented' WHEN ids > 1 OR matched < n THEN 'contaminated' WHEN n <> frames THEN 'incomplete' ELSE 'perfect' END AS kind FROM g LEFT JOIN h ON h.hit = g.pid)
SELECT round(1 - count(*) FILTER (WHERE kind = 'perfect') / count(*), 6) AS e_track, count(*) AS n_true, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ('perfect', 'fragmented', 'contaminated', 'incomplete', 'missed'))} FROM k""")
def e_track(spark, sf_dir):
    return metrics.track_errors(_tracks(spark, sf_dir), _true(spark, sf_dir), 1e-3)


@query("link_recall_precision", f"""WITH {_TT}, {_P}, {_M}, g AS (SELECT t.pid, t.frame AS f1, lead(t.frame) OVER (PARTITION BY t.pid ORDER BY t.frame) AS f2 FROM t WHERE NOT (t.pid % 4 = 1 AND t.frame = 6)),
tl AS (SELECT * FROM g WHERE f2 IS NOT NULL), l AS (SELECT * FROM (SELECT trajid, frame AS f1, lead(frame) OVER w AS f2, hit AS a, lead(hit) OVER w AS b FROM m WINDOW w AS (PARTITION BY trajid ORDER BY frame)) WHERE f2 IS NOT NULL),
r AS (SELECT DISTINCT tl.* FROM l JOIN tl ON tl.f1 = l.f1 AND tl.f2 = l.f2 AND tl.pid = l.a AND tl.pid = l.b), n AS (SELECT count(*) AS n FROM m GROUP BY trajid),
z AS (SELECT (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM tl) AS true_links, (SELECT count(*) FROM r) AS correct, (SELECT count(*) FROM tl WHERE f2 - f1 > 1) AS gaps, (SELECT count(*) FROM r WHERE f2 - f1 > 1) AS recovered)
SELECT links, true_links, correct, round(correct / true_links, 6) AS recall, round(correct / links, 6) AS precision, round(1 - correct / links, 6) AS false_rate, (SELECT count(*) FROM n) AS tracks, (SELECT round(avg(n), 6) FROM n) AS mean_length, (SELECT max(n) FROM n) AS max_length, 0e0 AS rms, round(recovered / gaps, 6) AS gap_recovery FROM z""")
def link_recall_precision(spark, sf_dir):
    return metrics.link_metrics(_tracks(spark, sf_dir), _true(spark, sf_dir).where("NOT (pid % 4 = 1 AND frame = 6)"), 1e-3)


_W = "OVER (PARTITION BY trajid ORDER BY frame)"
_GAPPY = "e AS (SELECT * FROM (%s) WHERE (trajid + frame) %% 9 <> 0)" % binding.TRACKS_SQL
_KURT = f"k AS (SELECT count(*) AS samples, round(avg(a * a * a * a) / (avg(a * a) * avg(a * a)), 6) AS kurtosis FROM (SELECT lead(x) {_W} - 2 * x + lag(x) {_W} AS a, lead(frame) {_W} - lag(frame) {_W} AS s FROM e) WHERE s = 2)"


def _gappy(spark, sf_dir):
    return binding.tracks(spark, sf_dir).where((F.col("trajid") + F.col("frame")) % 9 != 0)


@query("accel_kurtosis", f"WITH {_GAPPY}, {_KURT} SELECT * FROM k")
def accel_kurtosis(spark, sf_dir):
    return kinematics.kurtosis(_gappy(spark, sf_dir))


@query("physics_metrics", f"""WITH {_GAPPY}, {_KURT}, l AS (SELECT count(*) AS n FROM e GROUP BY trajid),
m AS (SELECT count(*) AS tracks, round(avg(n), 6) AS mean_length, round(avg(CASE WHEN n > 10 THEN 1e0 ELSE 0e0 END), 6) AS over_10, round(avg(CASE WHEN n > 30 THEN 1e0 ELSE 0e0 END), 6) AS over_30 FROM l)
SELECT *, round(mean_length - 2 * greatest(0e0, kurtosis - 3), 6) AS fluidity FROM m, k""")
def physics_metrics(spark, sf_dir):
    return kinematics.physics(_gappy(spark, sf_dir))


@query("noise_sigma", f"""WITH {_E}, s AS (SELECT trajid, frame, CASE WHEN frame - lag(frame, 2) {_W} = 2 AND count(*) OVER (PARTITION BY trajid) >= 5 THEN x - 2 * lag(x) {_W} + lag(x, 2) {_W} END AS a FROM e),
p AS (SELECT a, lag(a) {_W} AS b FROM s), g AS (SELECT * FROM p WHERE a IS NOT NULL), m AS (SELECT median(a) AS m FROM g), d AS (SELECT median(abs(a - m)) AS mad FROM g, m),
k AS (SELECT count(*) AS samples, count(*) FILTER (WHERE ok) AS pairs, avg(a * b) FILTER (WHERE ok) AS c FROM (SELECT *, b IS NOT NULL AND abs(a) <= 6 * 1.4826e0 * mad AND abs(b) <= 6 * 1.4826e0 * mad AS ok FROM g, d))
SELECT samples, pairs, round(CASE WHEN samples >= 10 AND pairs >= 10 THEN sqrt(greatest(-c / 4, 0e0)) ELSE 0e0 END, 6) AS sigma FROM k""")
def noise_sigma(spark, sf_dir):
    return kinematics.noise_sigma(binding.tracks(spark, sf_dir))


@query("fill_gaps_hermite", f"""WITH d AS ({binding.DROPPED_SQL}), n AS (SELECT pid, frame, lead(frame) OVER w AS nf, {', '.join(f'{a}, lead({a}) OVER w AS {a}1, coalesce(({a} - lag({a}) OVER w) / (frame - lag(frame) OVER w), (lead({a}) OVER w - {a}) / (lead(frame) OVER w - frame)) AS {a}v0, coalesce((lead({a}, 2) OVER w - lead({a}) OVER w) / (lead(frame, 2) OVER w - lead(frame) OVER w), (lead({a}) OVER w - {a}) / (lead(frame) OVER w - frame)) AS {a}v1' for a in 'xyz')} FROM d WINDOW w AS (PARTITION BY pid ORDER BY frame)),
k AS (SELECT *, unnest(CASE WHEN nf - frame - 1 BETWEEN 1 AND 4 THEN range(0, nf - frame) ELSE [0] END) AS k FROM n), u AS (SELECT *, k / (nf - frame) AS u, nf - frame AS s FROM k)
SELECT pid AS trajid, frame + k AS frame, {', '.join(f'CASE WHEN k = 0 THEN {a} ELSE round((2 * u * u * u - 3 * u * u + 1) * {a} + (u * u * u - 2 * u * u + u) * s * {a}v0 + (3 * u * u - 2 * u * u * u) * {a}1 + (u * u * u - u * u) * s * {a}v1, 6) END AS {a}' for a in 'xyz')}, k > 0 AS filled FROM u""")
def fill_gaps_hermite(spark, sf_dir):
    return kinematics.fill_gaps(binding.dropped_out(binding.truth(spark, sf_dir)).withColumnRenamed("pid", "trajid"), ("x", "y", "z"), cubic=True)


@query("step_statistics", f"""WITH {_T}, s AS (SELECT x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, frame - lag(frame) OVER w AS df FROM t WINDOW w AS (PARTITION BY pid ORDER BY frame)), g AS (SELECT * FROM s WHERE df = 1)
SELECT count(*) AS links, {', '.join(f'round(quantile_cont(abs(d{a}), 0.999), 6) AS p999_{a}' for a in 'xyz')}, round(median(sqrt(dx * dx + dy * dy + dz * dz)), 6) AS median_step, 0e0 AS noise_x, 0e0 AS noise_y, 0e0 AS noise_z, 0e0 AS step_noise FROM g""")
def step_statistics(spark, sf_dir):
    """Straight lines without noise: the noise is 0."""
    return kinematics.step_statistics(_true_plain(spark, sf_dir))


def _true_plain(spark, sf_dir):
    return binding.truth(spark, sf_dir).withColumnRenamed("pid", "trajid")


@query("motion_scale", f"""WITH {_T}, s AS (SELECT a.frame, a.pid, sqrt(min({_D2})) AS d FROM t a JOIN t b ON a.frame = b.frame AND a.pid <> b.pid GROUP BY a.frame, a.pid), m AS (SELECT a.frame, a.pid, sqrt(min({_D2})) AS d FROM t a JOIN t b ON b.frame = a.frame + 1 GROUP BY a.frame, a.pid),
p AS (SELECT frame, round(median(d), 6) AS spacing FROM s GROUP BY frame), q AS (SELECT frame, round(quantile_cont(d, 0.1), 6) AS displacement FROM m GROUP BY frame) SELECT p.frame, displacement, spacing, round(displacement / spacing, 4) AS ratio FROM p JOIN q ON q.frame = p.frame""")
def motion_scale(spark, sf_dir):
    return spatial.motion_scale(_points(spark, sf_dir), 1.0)
