"""Queries whose work must not grow with the square of the input: the quick way against the plain one, and what their plans hold."""

import itertools
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from skein.engines import assignment, cells
from skein.engines import tracking as engine
from skein.functions import optics
from skein.functions.numeric import Arrays
from skein.operators import linking, stereo, tracking
from skein.plans import camera_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_boxes_and_targets_meet_once(spark):
    rng = random.Random(3)
    at = [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(12)]
    targets = [(0, 0, n, *at[n % 12], n if n % 3 else -1) for n in range(120)]
    boxes = [(0, n, 0, *at[n % 12], 9.0, 7.0, 8.0, 6.0) for n in range(60)]
    b = spark.createDataFrame(boxes, "frame long, id long, cam long, u double, v double, left double, right double, up double, down double")
    t = spark.createDataFrame(targets, "frame long, cam long, pnr long, x double, y double, tnr long")
    for matched, most in ((True, 4), (False, 1)):
        want = []
        for _, n, _, u, v, le, ri, up, do in boxes:
            near = sorted((float(np.sqrt((x - u) ** 2 + (y - v) ** 2)), p) for _, _, p, x, y, k in targets if (k >= 0) == matched and u - le < x < u + ri and v - up < y < v + do)
            want += [(n, p, d, r + 1) for r, (d, p) in enumerate(near[:most])]
        got = stereo.pixel_candidates(b, t, matched, most)
        assert sorted(tuple(r) for r in got.select("id", "pnr", "d", "rank").collect()) == sorted(want)
    found = stereo.pixel_candidates(b, t)
    assert sorted(map(tuple, stereo.candidate_votes(b, t, 1).collect())) == sorted(map(tuple, stereo.votes(found, 1).collect()))


def test_boxes_are_not_broadcast(spark):
    """Sizes are estimated before rows are exploded, so Spark would send them through the driver."""
    found = stereo.pixel_candidates(*camera_queries._boxes(spark, SF), matched=False, most=1)
    assert "BroadcastHashJoin" not in plan(found) and "BroadcastExchange" not in plan(found)


def test_rings_choose_as_one_pass_over_all_edges(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 12, (150, 3)) / 4.0 for _ in range(2))
    i, k, d2 = cells.within(a, b, 2.0)
    won = assignment.greedy(i, k, d2)
    want = sorted(zip(i[won].tolist(), k[won].tolist(), d2[won].tolist()))
    assert sorted(zip(*(v.tolist() for v in assignment.nearest_first(a, b, linking.radii(2.0))))) == want
    rows = spark.createDataFrame([(f, n, *map(float, p)) for f, side in enumerate((a, b)) for n, p in enumerate(side)], "frame long, id long, x double, y double, z double")
    assert sorted(map(tuple, linking.nearest_first(rows, 2.0, "id", most=0).select("i", "k", "cost").collect())) == want


def test_sectors_hold_all_candidates_of_a_strip(spark):
    """The same edges as a loop over all pairs, dealt to few sectors: also from cameras that see each other, whose lines meet on the sensor."""
    rng = np.random.default_rng(7)
    points = rng.uniform(0, 20, (60, 3))
    facing = [optics.Camera(z0=300.0, cc=60.0, imx=4096, imy=4096, pix_x=0.012, pix_y=0.012), optics.Camera(x0=2.0, z0=500.0, cc=60.0, imx=4096, imy=4096, pix_x=0.012, pix_y=0.012)]
    for rig, eps in ((camera_queries.AIR, 0.02), (camera_queries.PLAIN, 0.02), (camera_queries.rig(), 0.02), (facing, 0.02)):
        flat = [optics.flat(Arrays, c, list(points.T)) for c in rig]
        rows = [(0, c, n, float(u), float(v), 9, 3, 3, 50) for c, (us, vs) in enumerate(flat) for n, (u, v) in enumerate(zip(us, vs))]
        table = spark.createDataFrame(rows, "frame long, cam long, pnr long, fx double, fy double, n int, nx int, ny int, sumg int")
        for cam, other in itertools.permutations(range(2), 2):
            xa, ya, xb, yb = (np.asarray(v) for v in optics.epipolar_segment(Arrays, rig[cam], rig[other], *flat[cam], camera_queries.VOLUME))
            m = (yb - ya) / (xb - xa)
            x, y = flat[other]
            want = set()
            for n in range(60):
                off = np.abs(y - m[n] * x - (ya[n] - m[n] * xa[n])) / np.sqrt(m[n] ** 2 + 1)
                near = (off < eps) & (x > min(xa[n], xb[n]) - eps) & (x < max(xa[n], xb[n]) + eps) & (y > min(ya[n], yb[n]) - eps) & (y < max(ya[n], yb[n]) + eps)
                want |= {(n, int(k)) for k in np.flatnonzero(near)}
            got = stereo.candidates(table, rig, cam, other, camera_queries.VOLUME, eps)
            assert {(r["p1"], r["p2"]) for r in got.select("p1", "p2").collect()} == want and got.count() == len(want)
    assert stereo._pole(facing, 0, 1) is None and stereo._pole(camera_queries.AIR, 0, 1) and stereo._pole(camera_queries.PLAIN, 0, 1)[1] == 1.0


def test_copies_are_assigned_by_places(spark):
    """The same number and total as over all edges of points, and a place of 20,000 points (400 million pairs) at once."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        on = rng.random(rng.integers(1, 7, 2)) < 0.5
        i, k = np.nonzero(on)
        if not len(i):
            continue
        cost, supply, capacity = rng.integers(0, 6, len(i)) / 2.0, rng.integers(1, 5, on.shape[0]), rng.integers(1, 5, on.shape[1])
        each = [(i[e] * 10 + a, k[e] * 10 + b, cost[e]) for e in range(len(i)) for a in range(supply[i[e]]) for b in range(capacity[k[e]])]
        wide = [np.array(v) for v in zip(*each)]
        want, got = assignment.sparse(*wide), assignment.transport(i, k, cost, supply, capacity)
        assert (np.bincount(i, got, on.shape[0]) <= supply).all() and (np.bincount(k, got, on.shape[1]) <= capacity).all()
        assert got.sum() == len(want) and (got * cost).sum() == wide[2][want].sum()
    at = F.when(F.col("id") % 2 == 0, 0.0).otherwise(5.0)
    points = spark.range(40_000).crossJoin(spark.range(2).withColumnRenamed("id", "frame")).select("frame", "id", (at + F.col("frame") * 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = tracking.assign(points, 0.8)
    assert got.agg(F.count("*"), F.sum("cost"), F.count_distinct("i"), F.count_distinct("k"), F.max(F.abs(F.col("i") - F.col("k")) % 2)).first()[:] == (40_000, 20_000.0, 40_000, 40_000, 0)


def test_large_parts_are_chosen_without_all_pairs():
    """near_best gives the pairs of best in parts of more than `most` ends and as many at the same total in others; 4,000 copies at each of two places are no 16 million pairs."""
    rng = np.random.default_rng(2)
    for t in range(60):
        n, m = rng.integers(1, 160, 2)
        a, b = (rng.integers(0, 2 + t % 12, (size, 3)) / 2.0 if t % 2 else rng.random((size, 3)) * (t % 12) / 2 for size in (n, m))
        for most in (0, 40):
            i, k, d2 = cells.within(a, b, 0.9)
            won = assignment.best(i, k, np.sqrt(d2), most)
            gi, gk = assignment.near_best(a, b, 0.9, most)
            assert len(gi) == len(won) == len(set(gi)) and np.isclose(np.sqrt(((a[gi] - b[gk]) ** 2).sum(1)).sum(), np.sqrt(d2[won]).sum())
            assert most or set(zip(gi, gk)) == {(i[e], k[e]) for e in won}
    same = np.zeros((4000, 3))
    tracemalloc.start()
    gi, gk = assignment.near_best(same, same + 0.5, 0.9, 128)
    assert (gi == gk).all() and len(gi) == 4000 and tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_copies_look_for_candidates_once():
    """The nearest by (distance, row) as from all pairs, ties across places among them; 3,000 copies at one place hold no 9 million pairs, and a step of the cascade chooses among them in order."""
    rng = np.random.default_rng(4)
    for most in (1, 3, 32):
        a, b = (rng.integers(0, 4, (70, 3)) / 4.0 for _ in range(2))
        i, k = cells.in_box(a, b, 0.6)
        d = np.sqrt(((b[k] - a[i]) ** 2).sum(-1))
        kept = cells.nearest(i, k, d, most)
        assert all((x == y).all() for x, y in zip(engine.candidates(a, b, 0.6, most), (i[kept], k[kept], d[kept])))
    same = np.zeros((3000, 3))
    tracemalloc.start()
    assert len(engine.candidates(same, same + 0.1, 0.5, 4)[0]) == 12_000
    nxt = engine.cascade_step(same, same, np.arange(3000) // 2 * 2 - (np.arange(3000) % 2) * 4000, same + 0.1, 0.5)
    assert (np.flatnonzero(nxt >= 0) < 100).all() and tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
