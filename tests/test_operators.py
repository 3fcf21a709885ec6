"""Operators on tables against plain Python: trackers in chunks and streams, seals with faults, uniqueness, curves, quantiles, advice."""

import itertools
import random

import numpy as np
import pytest

from skein.engines import assignment, curves
from skein.engines import tracking as engine
from skein.functions.optics import Camera
from skein.operators import advice, linkage, metrics, pieces, points, tracking
from skein.plans import trackers
from skein.shared import quantile
from skein.streaming import linker
from pyspark.sql import functions as F

POINTS = "frame long, id long, x double, y double, z double"


def cloud(frames=8, n=15, seed=1):
    rng = np.random.default_rng(seed)
    start, v = rng.random((n, 3)) * 12, (rng.random((n, 3)) - 0.5) * 0.8
    return [(t, 10 * i, *map(float, start[i] + t * v[i])) for t in range(frames) for i in range(n) if (t + i) % 11]


def frames_of(rows):
    out = []
    for t in range(max(r[0] for r in rows) + 1):
        mine = sorted(r for r in rows if r[0] == t)
        out.append(([r[1] for r in mine], np.array([r[2:] for r in mine]).reshape(-1, 3)))
    return out


def test_trackers_on_tables_equal_the_engines(spark):
    rows = cloud()
    df, whole = spark.createDataFrame(rows, POINTS), frames_of(rows)
    want = {(t, whole[t][0][i], 1, whole[t + 1][0][k]) for t, nxt in enumerate(engine.cascade([x for _, x in whole], 1.0)) for i, k in enumerate(nxt) if k >= 0}
    assert {tuple(r) for r in tracking.track(df, lambda x: engine.cascade(x, 1.0)).collect()} == want
    assert {tuple(r) for r in tracking.track(df, lambda x: engine.cascade(x, 1.0), frames=3, overlap=3).collect()} == want
    found = {tuple(r)[:3] + (tuple(r)[3],) for r in tracking.track_edges(df, lambda x: engine.two_phase(x, engine.TwoPhase(v_max=1.0))).collect()}
    assert found == {(a, whole[a][0][r], b - a, whole[b][0][s]) for a, r, b, s in engine.two_phase([x for _, x in whole], engine.TwoPhase(v_max=1.0))}
    assert any(e[2] == 2 for e in found)


def test_stream_equals_batch(spark):
    df = spark.createDataFrame(cloud(seed=2), POINTS)
    want = {(r.frame, r.i, r.k) for r in tracking.track(df, lambda x: engine.cascade(x, 1.0, gate=0.0)).collect()}
    assert {(r.frame, r.i, r.k) for r in linker.from_points(df, half=1.0).collect()} == want
    tool, got = linker.Linker(1.0), set()
    for t, (ids, x) in enumerate(frames_of(cloud(seed=2))):
        got |= set(tool.step(t, np.array(ids), x))
    assert got == want


def test_assignment_on_tables(spark):
    rows = cloud(3, 6, 3)
    got = {(r.frame, r.i, r.k) for r in tracking.assign(spark.createDataFrame(rows, POINTS), 2.0).collect()}
    want = set()
    for t in (0, 1):
        a, b = [r for r in rows if r[0] == t], [r for r in rows if r[0] == t + 1]
        best = (0, 0.0, ())
        for size in range(len(a) + 1):
            for left in itertools.combinations(a, size):
                for right in itertools.permutations(b, size):
                    d = [float(np.linalg.norm(np.subtract(p[2:], q[2:]))) for p, q in zip(left, right)]
                    if all(v <= 2.0 for v in d):
                        best = max(best, (size, -sum(d), tuple((t, p[1], q[1]) for p, q in zip(left, right))))
        want |= set(best[2])
    assert got == want
    edges = [(0, 1, 5, 2.0), (0, 1, 6, 1.0), (0, 2, 6, 1.5), (0, 1, 6, 9.0), (1, 4, 4, 3.0)]
    got = {tuple(r) for r in tracking.resolve(spark.createDataFrame(edges, "frame long, i long, k long, cost double")).collect()}
    assert got == {(0, 1, 5, 2.0), (0, 2, 6, 1.5), (1, 4, 4, 3.0)}


def plain_seal(rows):
    """The walk frame by frame: prevs of up to three frames back that their next returns, else of the frame before; trajectories claimed twice in a frame end."""
    by = {}
    for f, i, prev, nxt, *_ in rows:
        by.setdefault(f, {})[i] = (prev, nxt)
    label, count = {}, 0
    for f in sorted(by):
        src = {}
        for i in sorted(by[f]):
            prev = by[f][i][0]
            if prev is None:
                continue
            for s in (1, 2, 3):
                if by.get(f - s, {}).get(prev, (None, None))[1] == i:
                    src[i] = label[f - s, prev]
                    break
            else:
                if prev in by.get(f - 1, {}):
                    src[i] = label[f - 1, prev]
        twice = {v for v in src.values() if list(src.values()).count(v) > 1}
        for i in sorted(by[f]):
            if i in src and src[i] not in twice:
                label[f, i] = src[i]
            else:
                label[f, i] = count
                count += 1
    return label


def test_seal_with_faults(spark):
    rng = random.Random(4)
    for seed in range(3):
        rows = []
        for f in range(6):
            for i in range(6):
                pick = lambda p: rng.randrange(6) if rng.random() < p else None
                rows.append((f, i, None if f == 0 else i if rng.random() < 0.5 else pick(0.6), i if rng.random() < 0.5 else pick(0.6), 0.0, 0.0, 0.0))
        want = plain_seal(rows)
        got = {(r.frame, r.id): r.trajid for r in linkage.seal(spark.createDataFrame(rows, "frame long, id long, prev long, next long, x double, y double, z double")).collect()}
        # trajectories are numbered by their first point in both
        assert got == want, seed


def test_source_hash(spark):
    rows = [(f, i, None, i + 1, 1.0 * f, 2.0, 3.0) for f in range(3) for i in range(5)]
    schema = "frame long, id long, prev long, next long, x double, y double, z double"
    h = lambda r: linkage.source_hash(spark.createDataFrame(r, schema)).first()["digest"]
    assert h(rows) == h(rows[::-1]) and h(rows) != h([*rows[:-1], (2, 4, 0, 5, 2.0, 2.0, 3.0)]) and len(h(rows)) == 64


def test_unique_points_and_tracks(spark):
    rng = random.Random(5)
    rows = [(f, i, [rng.choice([-1, -1, 0, 1, 2, 3]), rng.choice([-1, 0, 1, 2, 3])], rng.randrange(64) / 64) for f in range(4) for i in range(9)]
    got = {(r.frame, r.id): r.keep for r in points.unique_points(spark.createDataFrame(rows, "frame long, id long, cam_ids array<long>, conf double"), "conf").collect()}
    for f in range(4):
        mine = [r for r in rows if r[0] == f]
        sets = [{(c, t) for c, t in enumerate(r[2]) if t >= 0} for r in mine]
        kept = [n for n, r in enumerate(mine) if got[f, r[1]]]
        assert all(not sets[a] & sets[b] for a, b in itertools.combinations(kept, 2))
        best = max(sum(mine[n][3] for n in some) for k in range(10) for some in itertools.combinations(range(9), k) if all(not sets[a] & sets[b] for a, b in itertools.combinations(some, 2)))
        assert sum(mine[n][3] for n in kept) == pytest.approx(best)
    uses = [(1, 0, 0, 5), (1, 1, 0, 5), (2, 1, 0, 5), (2, 2, 0, 6), (3, 2, 0, 6), (4, 9, 0, 1)]
    scores = [(1, 3.0), (2, 5.0), (3, 3.0), (4, 1.0)]
    got = {r.trajid: r.keep for r in points.unique_tracks(spark.createDataFrame(uses, "trajid long, frame long, cam int, target long"), spark.createDataFrame(scores, "trajid long, score double")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}
    assert points.ilp_wanted("auto", 0.2) and not points.ilp_wanted("auto", 0.1, 100) and points.ilp_wanted(True) and not points.ilp_wanted("off", 1.0)


def test_curves_on_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(t, f, *map(float, rng.random(3))) for t in range(3) for f in range(4 + 3 * t)]
    df = spark.createDataFrame(rows, "trajid long, frame long, x double, y double, z double")
    for t in range(3):
        mine = np.array([r[1:] for r in rows if r[0] == t])
        w = {r.frame: (r.weight, r.residual) for r in pieces.robust(df).where(F.col("trajid") == t).collect()}
        assert np.allclose([w[f][0] for f in range(len(mine))], curves.robust_weights(mine[:, 1:])) and w[0][1] == pytest.approx(curves.robust_residual(mine[:, 1:]))
        found = sorted(tuple(r) for r in pieces.smooth(df, 1.0, 5, 2).where(F.col("trajid") == t).select("frame", "x", "u", "ax").collect())
        if len(mine) < 5:
            assert not found
            continue
        for k, (f, x, u, a) in enumerate(found):  # a plain fit around each point
            lo = min(max(0, k - 2), len(mine) - 5)
            c = np.polyfit(mine[lo : lo + 5, 0] - f, mine[lo : lo + 5, 1], 2)
            assert (x, u, a) == pytest.approx((c[2], c[1], 2 * c[0]), abs=1e-6)


def test_quantiles_are_exact(spark):
    rng = random.Random(7)
    for values in ([rng.gauss(0, 1) for _ in range(30_000)], [1.0] * 15_000 + [2.0] * 15_000, [5.0], [float(rng.randrange(3)) for _ in range(25_000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.5, 0.999):
            assert quantile(df, F.col("v"), q) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
    assert quantile(spark.createDataFrame([(None,), (float("nan"),)], "v double"), F.col("v"), 0.5) is None


def test_fit_scale(spark):
    rng = np.random.default_rng(8)
    xyz = rng.random((300, 3)) * 20
    d = np.linalg.norm(xyz - np.median(xyz, 0), axis=1)
    rcm = 0.5 + 0.1 * d
    rows = [(0, n, *map(float, xyz[n]), [1, 2, 3, 4], float(rcm[n])) for n in range(300)]
    df = spark.createDataFrame(rows, POINTS + ", cam_ids array<long>, rcm double")
    centre, level, slope = points.fit_scale(df)
    assert np.allclose(centre, np.median(xyz, 0)) and level == pytest.approx(0.5, abs=1e-6) and slope == pytest.approx(0.1, abs=1e-6)
    _, level, slope = points.fit_scale(df.limit(50))
    assert slope == 0.0 and level == pytest.approx(np.median([r["rcm"] for r in df.limit(50).collect()]))


def test_track_errors_see_ghosts(spark):
    truth = spark.createDataFrame([(p, f, 10.0 * p, 0.0, 0.0) for p in range(4) for f in range(3)], "pid long, frame long, x double, y double, z double")
    tracks = [(0, f, 0.0, 0.0, 0.0) for f in range(3)] + [(1, 0, 10.0, 0.0, 0.0), (1, 1, 10.0, 0.0, 0.0), (1, 2, 13.0, 0.0, 0.0), (2, 0, 20.0, 0.0, 0.0), (2, 1, 20.0, 0.0, 0.0)]
    row = metrics.track_errors(spark.createDataFrame(tracks, "trajid long, frame long, x double, y double, z double"), truth, 0.5).first()
    assert (row.n_perfect, row.n_contaminated, row.n_incomplete, row.n_missed, row.n_fragmented, row.e_track) == (1, 1, 1, 1, 0, 0.75)


def test_trackers_by_name(spark, tmp_path):
    (tmp_path / "mine.py").write_text("class Tracking:\n    def do_tracking(self, points, **more):\n        return points.limit(0)\n")
    assert trackers.resolve("fast") is trackers.STRATEGIES["priority_segment_3d"] and trackers.resolve("mine", str(tmp_path))(spark.range(3)).count() == 0
    with pytest.raises(ModuleNotFoundError):
        trackers.resolve("nothing", str(tmp_path))
    track, plugins = trackers.apply_preset("full_multipass", {"dvxmax": 3.0})
    assert track == {"dvxmax": 3.0, "track_mode": 0, "flagNewParticles": True, "postprocess": True, "preset": "full_multipass"} and plugins == {"selected_tracking": "full_multipass"}
    assert trackers.apply_preset("custom_plugin", {}, None, "mine")[1] == {"selected_tracking": "mine"} and trackers.tracker("4be").speed == "fastest" and trackers.tracker("x") is None
    assert "two_phase" in trackers.tracker_text() and trackers.sources()[0] == "points" and trackers.source("linear").needs
    df = spark.createDataFrame(cloud(6, 8, 9), POINTS)
    for name in ("full_multipass", "unified"):
        edges = trackers.resolve(name)(df, **({"half": 1.0, "dacc": 0.5} if name == "full_multipass" else {"v_max": 1.0})).collect()
        assert len(edges) > 20 and sum(r.i == r.k for r in edges) >= 0.9 * len(edges)


def test_advice():
    stats = {"p999_x": 1.0, "p999_y": 0.5, "p999_z": 0.2, "noise_x": 0.01, "noise_y": 0.01, "noise_z": 0.02, "median_step": 0.1, "step_noise": 0.05}
    out = advice.trackcorr_limits(stats)
    assert out["dvx"] == pytest.approx(1.1) and out["dvz"] == pytest.approx(0.3) and out["angle"] == 270.0
    noise = np.linalg.norm(np.random.default_rng(0).normal(0, 1, (400_000, 3)) * np.sqrt(6) * [0.01, 0.01, 0.02], axis=1)
    assert abs(advice.noise_percentile(np.sqrt(6) * np.array([0.01, 0.01, 0.02]), 99.5) - np.percentile(noise, 99.5)) < 2e-3
    assert advice.z_noise([Camera(x0=100.0, z0=300.0, cc=60.0)]) > 0
    assert advice.decision({"b": 1, "a": 2}, {"x": True}) == '{"regime_flags": {"x": true}, "resolved_config": {"a": 2, "b": 1}}'


def test_parameter_search(spark):
    best, tried = advice.search(spark, {"a": [1, 2, 3], "b": [10, 20]}, lambda p: p, lambda p: -((p["a"] - 2) ** 2) - p["b"])
    assert best == {"a": 2, "b": 10} and len(tried) <= 6


def test_independent_greedy_beyond_the_limit():
    sets = [{n // 2} for n in range(60)]
    assert len(assignment.independent(sets, np.arange(60.0), most=20)) == 30


def test_tracks_are_taken_from_batches_whole(spark):
    import numpy as np

    from skein.engines import curves
    from skein.operators import pieces

    rng = np.random.default_rng(3)
    rows = [(t, f, *(float(v) for v in rng.normal(size=3))) for t, n in ((None, 5), (0, 6), (3, 1), (-4, 30), (1 << 60, 7), (8, 4), (9, 21)) for f in range(n)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[k] for k in order], "trajid long, frame long, x double, y double, z double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (4, 7, 10000):  # tracks longer than a batch, tracks that end with one, all in one
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = pieces.predict_next(df)
            assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # a group a track costs more than the track
            got = {r.trajid: (r.frame, r.x, r.u, r.residual) for r in found.collect()}
            fits = {(r.trajid, r.frame): (r.x, r.support) for r in pieces.leave_one_out(df, 5, 2).collect()}
            assert len(fits) == len(rows)
            for t in {r[0] for r in rows}:
                x = np.array([r[2:] for r in rows if r[0] == t])
                f = np.arange(len(x), dtype=float)
                at, v, residual = curves.predict(f[-6:], x[-6:], f[-1] + 1, 6, 2)
                assert got.pop(t) == (len(x), at[0], v[0], residual)
                left, support = curves.leave_one_out(f, x, np.ones(len(x)), 5, 2)
                assert all(fits[t, k] == ((None if np.isnan(left[k, 0]) else left[k, 0]), support[k]) for k in range(len(x)))
            assert not got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
