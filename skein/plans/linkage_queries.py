"""Queries on linkages, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import linkage, reports
from skein.plans.catalogue import query
from skein.sources import binding

_L, _C = f"l AS MATERIALIZED ({binding.LINKAGE_SQL})", f"l AS MATERIALIZED ({binding.CLEAN_LINKAGE_SQL})"
_M = "m AS MATERIALIZED (SELECT a.frame, a.id AS i, b.frame - a.frame AS step, b.id AS k FROM l a JOIN l b ON b.frame BETWEEN a.frame + 1 AND a.frame + 3 AND b.id = a.next AND b.prev = a.id)"
_S = "s AS MATERIALIZED (SELECT frame, i, min(step) AS step, k FROM m GROUP BY frame, i, k)"


def _norm(a: str, b: str, c: str) -> str:
    """Kink of three positions."""
    return "sqrt(" + " + ".join(f"({c}.{x} - 2 * {b}.{x} + {a}.{x}) * ({c}.{x} - 2 * {b}.{x} + {a}.{x})" for x in "xyz") + ")"


def _marked(rows):
    """-1 for no prev and -2 for no next, as in the text files."""
    return rows.withColumns({"prev": F.coalesce("prev", F.lit(-1)), "next": F.coalesce("next", F.lit(-2))})


@query("link_steps", f"WITH {_L}, {_M}, {_S} SELECT * FROM s")
def link_steps(spark, sf_dir):
    return linkage.links(binding.linkage(spark, sf_dir))


@query("back_link_steps", f"WITH {_L}, {_M} SELECT frame + step AS frame, k, min(step) AS step, i FROM m GROUP BY frame + step, k, i")
def back_link_steps(spark, sf_dir):
    return linkage.back_links(binding.linkage(spark, sf_dir))


@query("enforce_reciprocity", f"""WITH {_L}, {_M} SELECT frame, id, pid,
  CASE WHEN frame = (SELECT min(frame) FROM l) OR EXISTS (SELECT 1 FROM m WHERE m.frame + m.step = l.frame AND m.k = l.id) THEN coalesce(prev, -1) ELSE -1 END AS prev,
  CASE WHEN frame = (SELECT max(frame) FROM l) OR EXISTS (SELECT 1 FROM m WHERE m.frame = l.frame AND m.i = l.id) THEN coalesce(next, -2) ELSE -2 END AS next, x, y, z FROM l""")
def enforce_reciprocity(spark, sf_dir):
    return _marked(linkage.enforce_reciprocity(binding.linkage(spark, sf_dir)))


_CONFIRM = f"""o AS MATERIALIZED (SELECT e.frame, e.i, e.k, max(CASE WHEN {_norm('a', 'b', 'c')} <= %s THEN 1 ELSE 0 END) AS ok FROM e JOIN e f ON f.frame = e.frame + 1 AND f.i = e.k AND e.step = 1 AND f.step = 1
  JOIN l a ON a.frame = e.frame AND a.id = e.i JOIN l b ON b.frame = e.frame + 1 AND b.id = e.k JOIN l c ON c.frame = e.frame + 2 AND c.id = f.k GROUP BY e.frame, e.i, e.k),
v AS MATERIALIZED (SELECT e.*, e.step = 1 AND e.frame + 1 < (SELECT max(frame) FROM l) AND coalesce(o.ok = 0, %s) AS severed FROM e LEFT JOIN o ON o.frame = e.frame AND o.i = e.i AND o.k = e.k)"""


@query("confirm_link_tuples", f"WITH {_L}, {_M}, {_S}, e AS (SELECT * FROM s), {_CONFIRM % ('0e0', 'true')} SELECT * FROM v")
def confirm_link_tuples(spark, sf_dir):
    rows = binding.linkage(spark, sf_dir)
    return linkage.confirm(linkage.links(rows), rows, 0.0, ends=True)


_NEXT = "e AS MATERIALIZED (SELECT l.frame, l.id AS i, 1 AS step, l.next AS k FROM l JOIN l n ON n.frame = l.frame + 1 AND n.id = l.next)"


@query("confirm_links", f"""WITH {_L}, {_NEXT}, {_CONFIRM % ('1e0', 'false')} SELECT frame, id, pid,
  CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE severed AND v.frame + 1 = l.frame AND v.k = l.id) THEN coalesce(prev, -1) ELSE -1 END AS prev,
  CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE severed AND v.frame = l.frame AND v.i = l.id) THEN coalesce(next, -2) ELSE -2 END AS next, x, y, z FROM l""")
def confirm_links(spark, sf_dir):
    return _marked(linkage.confirm_linkage(binding.linkage(spark, sf_dir), 1.0))


@query("seed_cold_start", f"""WITH {_L}, w AS (SELECT a.id AS j, 2 * a.x - b.x AS x, 2 * a.y - b.y AS y, 2 * a.z - b.z AS z FROM l a JOIN l b ON b.frame = 2 AND b.id = a.next WHERE a.frame = 1 AND a.prev IS NULL),
c AS (SELECT w.j, f.id, (f.x - w.x) * (f.x - w.x) + (f.y - w.y) * (f.y - w.y) + (f.z - w.z) * (f.z - w.z) AS d2 FROM w, l f WHERE f.frame = 0 AND f.next IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY d2, id) AS r, lead(d2) OVER (PARTITION BY j ORDER BY d2, id) AS second FROM c)
SELECT 0 AS frame, id AS i, 1 AS step, min(j) AS k FROM r WHERE r = 1 AND d2 <= 4 AND (second IS NULL OR second >= 4 * d2) GROUP BY id""")
def seed_cold_start(spark, sf_dir):
    return linkage.seed_cold_start(binding.linkage(spark, sf_dir), 4.0).select(F.col("frame"), "i", "step", "k")


def _gap_sql(step: int, source: str) -> str:
    """Edges g<step> that bridge step - 1 frames of a linkage, and the linkage l<step> with them."""
    tol = 0.5 * 1.0 * step * step / 2
    back = f"(SELECT min(a.frame - b.frame) FROM {source} b WHERE b.frame BETWEEN a.frame - 3 AND a.frame - 1 AND b.id = a.prev AND b.next = a.id)"
    return f"""h{step} AS MATERIALIZED (SELECT a.*, coalesce({back}, 1) AS back FROM {source} a WHERE next IS NULL AND prev IS NOT NULL),
p{step} AS (SELECT h.frame, h.id, h.x + (h.x - q.x) / h.back * {step} AS x, h.y + (h.y - q.y) / h.back * {step} AS y, h.z + (h.z - q.z) / h.back * {step} AS z FROM h{step} h JOIN {source} q ON q.frame = h.frame - h.back AND q.id = h.prev),
d{step} AS (SELECT a.frame, a.id AS i, b.id AS k, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM p{step} a JOIN {source} b ON b.frame = a.frame + {step} AND b.prev IS NULL AND b.next IS NOT NULL),
g{step} AS MATERIALIZED (SELECT frame, min(i) AS i, {step} AS step, k FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY d2, k) AS r FROM d{step} WHERE d2 <= {tol * tol}e0) WHERE r = 1 GROUP BY frame, k),
l{step} AS MATERIALIZED (SELECT {source}.frame, id, coalesce(f.k, next) AS next, coalesce(t.i, prev) AS prev, x, y, z FROM {source} LEFT JOIN g{step} f ON f.frame = {source}.frame AND f.i = id LEFT JOIN g{step} t ON t.frame + {step} = {source}.frame AND t.k = id)"""


_CUT = f"l AS MATERIALIZED (SELECT frame, id, pid, CASE WHEN (pid * 7 + frame) % 9 <> 0 THEN prev END AS prev, CASE WHEN (pid * 5 + frame) % 11 <> 0 THEN next END AS next, x, y, z FROM ({binding.CLEAN_LINKAGE_SQL}))"


def _cut(spark, sf_dir):
    n, f = F.col("pid"), F.col("frame")
    return binding.linkage(spark, sf_dir, faults=False).withColumns({"prev": F.when((n * 7 + f) % 9 != 0, F.col("prev")), "next": F.when((n * 5 + f) % 11 != 0, F.col("next"))})


@query("relink_gaps", f"WITH {_CUT}, {_gap_sql(2, 'l')}, {_gap_sql(3, 'l2')} SELECT * FROM g2 UNION ALL SELECT * FROM g3")
def relink_gaps(spark, sf_dir):
    return linkage.relink_gaps(_cut(spark, sf_dir), 2, 1.0)


_WALK = f"""p AS MATERIALIZED (SELECT c.frame, c.id, coalesce(max(CASE WHEN q.next = c.id THEN q.frame END), max(CASE WHEN q.frame = c.frame - 1 THEN q.frame END)) AS pf, any_value(c.prev) AS pid
  FROM l c JOIN l q ON q.id = c.prev AND q.frame BETWEEN c.frame - 3 AND c.frame - 1 GROUP BY c.frame, c.id),
o AS MATERIALIZED (SELECT frame, id, row_number() OVER (ORDER BY frame, id) - 1 AS trajid FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = l.frame AND p.id = l.id AND pf IS NOT NULL)),
w(trajid, frame, id) AS (SELECT trajid, frame, id FROM o UNION ALL SELECT w.trajid, p.frame, p.id FROM w JOIN p ON p.pf = w.frame AND p.pid = w.id)"""


@query("seal_trajectories", f"WITH RECURSIVE {_C}, {_WALK} SELECT w.trajid, w.frame, w.id, x, y, z FROM w JOIN l ON l.frame = w.frame AND l.id = w.id")
def seal_trajectories(spark, sf_dir):
    return linkage.seal(binding.linkage(spark, sf_dir, faults=False))


@query("seal_least_five", f"WITH RECURSIVE {_C}, {_WALK} SELECT trajid, min(frame) AS first, max(frame) AS last, count(*) AS length FROM w GROUP BY trajid HAVING count(*) >= 5")
def seal_least_five(spark, sf_dir):
    rows = linkage.seal(binding.linkage(spark, sf_dir, faults=False), least=5)
    return rows.groupBy("trajid").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length"))


@query("source_hash", f"WITH {_L} SELECT count(*) AS rows, 64 AS digits FROM l")
def source_hash(spark, sf_dir):
    """The digest itself is Spark's own hash; its use (equal for equal rows in any order, else not) is tested in pytest."""
    return linkage.source_hash(binding.linkage(spark, sf_dir)).select("rows", F.length("digest").alias("digits"))


@query("count_links", f"WITH {_L} SELECT count(next) AS links FROM l")
def count_links(spark, sf_dir):
    return binding.linkage(spark, sf_dir).agg(F.count("next").alias("links"))


@query("kink_statistics", f"""WITH {_C}, {_M}, {_S}, q AS (SELECT {_norm('a', 'b', 'c')} AS kink FROM s e JOIN s f ON f.frame = e.frame + 1 AND f.i = e.k AND e.step = 1 AND f.step = 1
  JOIN l a ON a.frame = e.frame AND a.id = e.i JOIN l b ON b.frame = e.frame + 1 AND b.id = e.k JOIN l c ON c.frame = e.frame + 2 AND c.id = f.k),
d AS (SELECT sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS step FROM s e JOIN l a ON a.frame = e.frame AND a.id = e.i JOIN l b ON b.frame = e.frame + 1 AND b.id = e.k WHERE e.step = 1),
n AS (SELECT a.frame, a.id, count(b.id) AS n FROM l a LEFT JOIN l b ON b.frame = a.frame AND b.id <> a.id AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 4 GROUP BY a.frame, a.id),
f AS (SELECT median(n) AS n FROM n GROUP BY frame HAVING count(*) > 10), t AS (SELECT (SELECT median(kink) FROM q) AS mk, (SELECT median(step) FROM d) AS ms)
SELECT round(mk, 6) AS median_kink, round(ms, 6) AS median_step, round(mk / ms, 6) AS ratio, round((SELECT avg(n) FROM f), 6) AS neighbours FROM t""")
def kink_statistics(spark, sf_dir):
    rows = binding.linkage(spark, sf_dir, faults=False)
    return reports.kink_statistics(linkage.links(rows), rows, 2.0)


@query("self_consistency_report", f"""WITH RECURSIVE {_L}, {_M}, {_S}, lim AS (SELECT min(frame) AS lo, max(frame) AS hi FROM l),
u AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY frame + step, k ORDER BY step) = 1),
h AS MATERIALIZED (SELECT frame, id, row_number() OVER (ORDER BY frame, id) AS t FROM l WHERE EXISTS (SELECT 1 FROM s WHERE s.frame = l.frame AND s.i = l.id) AND NOT EXISTS (SELECT 1 FROM s WHERE s.frame + s.step = l.frame AND s.k = l.id)),
w(t, frame, id) AS (SELECT t, frame, id FROM h UNION ALL SELECT w.t, w.frame + s.step, s.k FROM w JOIN u s ON s.frame = w.frame AND s.i = w.id),
n AS (SELECT count(*) AS n FROM w GROUP BY t), v AS (SELECT w.t, w.frame, {', '.join(f'({a} - lag({a}) OVER g) / (w.frame - lag(w.frame) OVER g) AS p{a}, (lead({a}) OVER g - {a}) / (lead(w.frame) OVER g - w.frame) AS q{a}' for a in 'xyz')} FROM w JOIN l ON l.frame = w.frame AND l.id = w.id WINDOW g AS (PARTITION BY w.t ORDER BY w.frame)),
j AS (SELECT sqrt(px * px + py * py + pz * pz) AS n1, sqrt(qx * qx + qy * qy + qz * qz) AS n2, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) AS d, px * qx + py * qy + pz * qz AS dot FROM v WHERE px IS NOT NULL AND qx IS NOT NULL),
r AS (SELECT avg(CASE WHEN (n1 + n2) / 2 > 1e-9 AND (d > (n1 + n2) / 2 OR dot < 0) THEN 1e0 ELSE 0e0 END) AS jump FROM j),
c AS (SELECT count(*) AS particles, count(*) FILTER (WHERE prev IS NULL AND next IS NULL) AS alone, count(*) FILTER (WHERE frame > lo AND prev IS NULL AND next IS NOT NULL) AS unlinked_starts, count(*) FILTER (WHERE frame < hi AND next IS NULL AND prev IS NOT NULL) AS unlinked_ends,
  count(*) FILTER (WHERE frame < hi AND next IS NOT NULL) AS forward, count(*) FILTER (WHERE frame > lo AND prev IS NOT NULL) AS backward, max(hi) - max(lo) + 1 AS frames FROM l, lim),
k AS (SELECT count(*) AS agreed, count(*) FILTER (WHERE step = 1) AS step_1, count(*) FILTER (WHERE step = 2) AS gap_1, count(*) FILTER (WHERE step = 3) AS gap_2 FROM s),
b AS (SELECT count(*) AS back FROM (SELECT DISTINCT frame + step, k FROM m)), q AS (SELECT median(n) AS median, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.9) AS p90, max(n) AS longest, count(*) AS tracks FROM n)
SELECT particles, round(agreed / forward, 6) AS reciprocity, tracks, median AS median_length, round(p10, 6) AS p10_length, round(p90, 6) AS p90_length, longest AS max_length, round(jump, 6) AS jump_rate, round(alone / particles, 6) AS ghost_rate,
  step_1, gap_1, gap_2, unlinked_starts, unlinked_ends, forward - agreed AS broken_forward, backward - back AS broken_backward, round(1 - least(1, abs(median - frames) / frames), 6) AS length_match,
  agreed / forward < 0.7 AS low_reciprocity, median < 4 AS short_tracks, jump > 0.1 AS many_jumps, alone / particles > 0.4 AS many_ghosts FROM c, k, b, q, r""")
def self_consistency_report(spark, sf_dir):
    return reports.consistency(binding.linkage(spark, sf_dir))


_STEP3 = "l AS MATERIALIZED (SELECT frame, pid AS id, CASE WHEN lag(frame) OVER g IS NOT NULL THEN pid END AS prev, CASE WHEN lead(frame) OVER g IS NOT NULL THEN pid END AS next, CASE WHEN (pid * 11 + frame * 5) % 23 = 0 THEN x + 3 ELSE x END AS x, y, z FROM (" + binding.DROPPED_SQL + ") WINDOW g AS (PARTITION BY pid ORDER BY frame))"


def _jumpy(spark, sf_dir):
    """Whole chains of every customer; now and then a position is off by 3."""
    w = Window.partitionBy("pid").orderBy("frame")
    n, f = F.col("pid"), F.col("frame")
    rows = binding.dropped_out(binding.truth(spark, sf_dir))
    return rows.select("frame", n.alias("id"), F.when(F.lag("frame").over(w).isNotNull(), n).alias("prev"), F.when(F.lead("frame").over(w).isNotNull(), n).alias("next"), F.when((n * 11 + f * 5) % 23 == 0, F.col("x") + 3).otherwise(F.col("x")).alias("x"), "y", "z")


_KINKS = f"""v AS (SELECT id, frame, row_number() OVER g AS n, count(*) OVER (PARTITION BY id) AS size, {', '.join(f'({a} - lag({a}) OVER g) / (frame - lag(frame) OVER g) AS p{a}, (lead({a}) OVER g - {a}) / (lead(frame) OVER g - frame) AS q{a}' for a in 'xyz')} FROM l WINDOW g AS (PARTITION BY id ORDER BY frame)),
k AS (SELECT id, frame, n, size, sqrt(px * px + py * py + pz * pz) AS n1, sqrt(qx * qx + qy * qy + qz * qz) AS n2, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) AS acc, px * qx + py * qy + pz * qz AS dot FROM v),
j AS MATERIALIZED (SELECT id, frame, n, size, coalesce(acc > 2 AND (n1 <= 1e-9 OR n2 <= 1e-9 OR dot / (n1 * n2) < cos(radians(60e0)) OR acc > 3), false) AS kink, coalesce(n1 > 1.5 * greatest(n2, 1e-9), false) AS fast FROM k),
w(id, n, before, intact, cut) AS (SELECT id, n, false, true, CAST(0 AS BIGINT) FROM j WHERE n = 1
  UNION ALL SELECT j.id, j.n, w.intact AND NOT (w.intact AND j.kink AND j.n < j.size AND NOT w.before AND j.n + 1 < j.size AND j.fast),
    NOT (w.intact AND j.kink AND j.n < j.size AND NOT (NOT w.before AND j.n + 1 < j.size AND j.fast)),
    CASE WHEN w.intact AND j.kink AND j.n < j.size THEN CASE WHEN NOT w.before AND j.n + 1 < j.size AND j.fast THEN j.n - 1 ELSE j.n END ELSE 0 END FROM w JOIN j ON j.id = w.id AND j.n = w.n + 1)"""


@query("prune_kinks", f"WITH RECURSIVE {_STEP3}, {_KINKS} SELECT a.frame, a.id AS i, b.frame - a.frame AS step, b.id AS k FROM w JOIN j a ON a.id = w.id AND a.n = w.cut JOIN j b ON b.id = w.id AND b.n = w.cut + 1 WHERE w.cut > 0")
def prune_kinks(spark, sf_dir):
    return linkage.prune_kinks(_jumpy(spark, sf_dir), 2.0, 60.0)


@query("trajectory_scores", f"""WITH {_STEP3}, v AS (SELECT id, frame, frame - lag(frame) OVER g AS step, {', '.join(f'({a} - lag({a}) OVER g) / (frame - lag(frame) OVER g) AS p{a}, (lead({a}) OVER g - {a}) / (lead(frame) OVER g - frame) AS q{a}' for a in 'xyz')} FROM l WINDOW g AS (PARTITION BY id ORDER BY frame)),
k AS (SELECT id, frame, step, sqrt(px * px + py * py + pz * pz) AS n1, sqrt(qx * qx + qy * qy + qz * qz) AS n2, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) AS d, px * qx + py * qy + pz * qz AS dot FROM v),
s AS (SELECT id, count(*) AS n, count(step) AS e, count(*) FILTER (WHERE step > 1) AS gaps, count(*) FILTER (WHERE (n1 + n2) / 2 > 1e-9 AND (d > (n1 + n2) / 2 OR dot < 0)) AS kinks FROM k GROUP BY id)
SELECT l.frame, l.id, round(CASE WHEN n < 2 THEN 0e0 ELSE least(1e0, greatest(0e0, 0.4e0 * least(1e0, e / 7e0) + 0.3e0 * e / e + 0.3e0 * CASE WHEN n < 3 THEN 0.5e0 ELSE 1 - kinks / CAST(n - 2 AS DOUBLE) END - least(0.4e0, 0.1e0 * gaps / e))) END, 6) AS score FROM l JOIN s ON s.id = l.id""")
def trajectory_scores(spark, sf_dir):
    return reports.track_scores(_jumpy(spark, sf_dir))


@query("stitch_chunks", f"""WITH {_C}, c AS (SELECT * FROM (VALUES (0, 0, 3, 0, 5), (1, 4, 7, 2, 7)) AS v(chunk, v_first, v_last, lo, hi)),
r AS (SELECT chunk, v_first, v_last, frame, id, prev, next FROM l JOIN c ON frame BETWEEN lo AND hi WHERE NOT (frame = hi AND hi < 7) OR id % 2 = 0)
SELECT o.frame, o.id, coalesce(CASE WHEN o.frame = o.v_first AND p.id IS NOT NULL THEN p.prev ELSE o.prev END, -1) AS prev, coalesce(CASE WHEN o.frame = o.v_last AND n.id IS NOT NULL THEN n.next ELSE o.next END, -2) AS next
FROM (SELECT chunk, v_first, v_last, frame, id, CASE WHEN frame = v_first THEN -9 ELSE prev END AS prev, CASE WHEN frame = v_last AND id % 3 = 0 THEN -9 ELSE next END AS next FROM r WHERE frame BETWEEN v_first AND v_last) o
LEFT JOIN (SELECT chunk + 1 AS chunk, frame, id, prev FROM r) p USING (chunk, frame, id) LEFT JOIN (SELECT chunk - 1 AS chunk, frame, id, next FROM r) n USING (chunk, frame, id)""")
def stitch_chunks(spark, sf_dir):
    rows = binding.linkage(spark, sf_dir, faults=False)
    cut = linkage.chunks(0, 7, 2, 2)
    parts = [rows.where(F.col("frame").between(lo, hi)).where(f"NOT (frame = {hi} AND {hi} < 7) OR id % 2 = 0").select(
        F.lit(n).alias("chunk"), F.lit(a).alias("v_first"), F.lit(b).alias("v_last"), "frame", "id",
        F.when(F.col("frame") == a, -9).otherwise(F.col("prev")).alias("prev") if n == 0 else F.when(F.col("frame") == a, -9).otherwise(F.col("prev")).alias("prev"),
        F.when((F.col("frame") == b) & (F.col("id") % 3 == 0), -9).otherwise(F.col("next")).alias("next")) for n, (lo, hi, a, b) in enumerate(cut)]
    return _marked(linkage.stitch_chunks(parts[0].union(parts[1])))
