"""Trackers, assignment, curves, images and calibration against plain Python."""

import itertools
import random

import numpy as np
import pytest

from skein.engines import assignment, calibration, cells, curves, segmentation, tracking
from skein.functions import optics
from skein.functions.numeric import Arrays
from skein.functions.optics import Camera


def test_pairs_in_cells():
    rng = np.random.default_rng(1)
    a, b = rng.random((200, 3)) * 5 - 2, rng.random((250, 3)) * 5 - 2
    a[3] = np.nan
    i, k, _ = cells.within(a, b, 0.7)
    with np.errstate(all="ignore"):
        far = ((a[:, None] - b[None]) ** 2).sum(2)
    assert len(i) == len(set(zip(i, k))) and set(zip(i, k)) == set(zip(*np.nonzero(far <= 0.49)))
    i, k = cells.in_box(a, b, (0.3, 0.5, 1.0))
    assert set(zip(i, k)) == set(zip(*np.nonzero((np.abs(a[:, None] - b[None]) < (0.3, 0.5, 1.0)).all(2))))


def test_assignment_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.integers(0, 9, (n, m)).astype(float)
        r, k = assignment.hungarian(c)
        every = [sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)] if n <= m else [sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m)]
        assert c[r, k].sum() == min(every) and len(set(r)) == len(set(k)) == min(n, m)
    for _ in range(60):
        e = [(i, k) for i in range(5) for k in range(5) if rng.random() < 0.35][:11]
        if not e:
            continue
        i, k = map(np.array, zip(*e))
        w = rng.integers(1, 20, len(e)).astype(float)
        found = (0, 0.0)
        for size in range(1, min(5, len(e)) + 1):
            for some in itertools.combinations(range(len(e)), size):
                if len({e[j][0] for j in some}) == len({e[j][1] for j in some}) == size:
                    found = max(found, (size, -w[list(some)].sum()))
        won = assignment.best(i, k, w)
        assert (len(won), -w[won].sum()) == found
        used, want = set(), []
        for j in sorted(range(len(e)), key=lambda j: (w[j], *e[j])):
            if not used & {("i", e[j][0]), ("k", e[j][1])}:
                used |= {("i", e[j][0]), ("k", e[j][1])}
                want.append(j)
        assert assignment.greedy(i, k, w).tolist() == sorted(want)


def test_independent_sets_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sets, w = [set(rng.integers(0, 7, 2).tolist()) for _ in range(8)], rng.random(8)
        every = [s for n in range(9) for s in itertools.combinations(range(8), n) if all(not sets[a] & sets[b] for a, b in itertools.combinations(s, 2))]
        assert w[assignment.independent(sets, w)].sum() == pytest.approx(max(w[list(s)].sum() for s in every))
    assert assignment.independent([{1}, {1}], np.array([0.5, 0.5])) == [0] and assignment.independent([{1}, {1}], np.array([0.3, 0.9])) == [1]
    assert assignment.independent([{k, k + 1} for k in range(40)], np.ones(40), most=20) == list(range(0, 40, 2))


def _plain_cascade(x0, x1, prev, x2, half, gate):
    """The cascade by loops over all points."""
    nxt, back = [-1] * len(x1), [-1] * len(x2)
    near = lambda p, q: all(abs(a - b) < half for a, b in zip(p, q))

    def link(edges):
        for _, i, k in sorted(edges):
            if nxt[i] < 0 and back[k] < 0:
                nxt[i], back[k] = k, i

    def candidates(i, at):
        found = sorted((float(np.linalg.norm(x2[k] - at)), k) for k in range(len(x2)) if near(x2[k], at))[:32]
        return [(d, i, k) for d, k in found]

    link([e for i in range(len(x1)) if prev[i] >= 0 for e in candidates(i, 2 * x1[i] - x0[prev[i]])])
    flow = {}
    for i in range(len(x1)):
        v = [x1[j] - x0[prev[j]] for j in range(len(x1)) if j != i and prev[j] >= 0 and near(x1[j], x1[i])]
        if prev[i] < 0 and v:
            flow[i] = np.mean(v, 0)
    link([e for i in flow for e in candidates(i, x1[i] + flow[i])])
    rest = [i for i in range(len(x1)) if prev[i] < 0 and nxt[i] < 0]
    link([e for i in rest for e in candidates(i, x1[i] + (flow.get(i, 0) if gate else 0)) if not gate or e[0] <= gate])
    return nxt


def test_cascade_against_loops():
    rng = np.random.default_rng(4)
    for gate in (0.0, 0.6):
        for _ in range(15):
            x0, x1, x2 = (rng.random((n, 3)) * 3 for n in rng.integers(1, 25, 3))
            prev = np.array([rng.integers(-1, len(x0)) for _ in x1])
            seen = set()
            prev = np.array([p if p < 0 or (p not in seen and not seen.add(p)) else -1 for p in prev])
            assert tracking.cascade_step(x0, x1, prev, x2, 0.9, gate).tolist() == _plain_cascade(x0, x1, prev, x2, 0.9, gate)


def test_cascade_gates_acceleration_and_angle():
    x0, x1, x2 = np.array([[0.0, 0, 0]]), np.array([[1.0, 0, 0]]), np.array([[1.5, 0.9, 0]])
    prev = np.array([0])
    assert tracking.cascade_step(x0, x1, prev, x2, 2.0, dacc=2.0, dangle=90.0).tolist() == [0]
    assert tracking.cascade_step(x0, x1, prev, x2, 2.0, dacc=2.0, dangle=45.0).tolist() == [-1]
    assert tracking.cascade_step(x0, x1, prev, x2, 2.0, dacc=0.5).tolist() == [-1]


def test_four_best_estimate_against_loops():
    rng = np.random.default_rng(5)
    half = 0.9
    near = lambda p, q: all(abs(a - b) < half for a, b in zip(p, q))
    for _ in range(20):
        x0, x1, x2, x3 = (rng.random((n, 3)) * 3 for n in rng.integers(1, 15, 4))
        seen = set()
        prev = np.array([p if (p := int(rng.integers(-1, len(x0)))) < 0 or (p not in seen and not seen.add(p)) else -1 for _ in x1])
        best = []
        for i in range(len(x1)):
            found = []
            at = 2 * x1[i] - x0[prev[i]] if prev[i] >= 0 else x1[i]
            for k in range(len(x2)):
                if near(x2[k], at):
                    d = float(np.linalg.norm(x2[k] - at))
                    go = 2 * x2[k] - x1[i]
                    support = [float(np.linalg.norm(p - go)) for p in x3 if near(p, go)]
                    found.append((d if prev[i] < 0 else min(support) + d if support else 1e6 + d, k))
            best.append(min(found)[1] if found else -1)
        want = [k if k >= 0 and best.count(k) == 1 else -1 for k in best]
        assert tracking.four_be_step(x0, x1, prev, x2, x3, half).tolist() == want


def _runs(frames=6, n=12, seed=6):
    rng = np.random.default_rng(seed)
    start, v = rng.random((n, 3)) * 20, (rng.random((n, 3)) - 0.5) * 0.6
    return [start + t * v for t in range(frames)]


def test_trackers_follow_straight_lines():
    frames = _runs()
    assert all((x == np.arange(12)).all() for x in tracking.cascade(frames, 1.5))
    assert all((x == np.arange(12)).all() for x in tracking.four_be(frames, 1.5))
    whole = [[(t, r) for t in range(6)] for r in range(12)]
    assert sorted(tracking.nearest_assignment(frames, 1.0, 0.5, 1, 1.0)) == sorted(whole)
    assert sorted(tracking.hybrid(frames, 2, 0.8, 0.3, gate=0.5)) == sorted(whole)
    edges = sorted((t, r, t + 1, r) for t in range(5) for r in range(12))
    for both in (False, True):
        assert sorted(tracking.two_phase(frames, tracking.TwoPhase(v_max=1.0, bidirectional=both))) == edges
    prev, nxt, made, broken = tracking.mht(frames, [np.full(12, -1) for _ in frames], [np.full(12, -1) for _ in frames], 3, 1.0)
    assert made == 60 and broken == 0 and all((x == np.arange(12)).all() for x in nxt[:-1]) and all((x == np.arange(12)).all() for x in prev[1:])


def test_two_phase_bridges_gaps_and_heeds_ghosts():
    frames = _runs()
    frames[3] = np.delete(frames[3], 5, 0)
    found = tracking.two_phase(frames, tracking.TwoPhase(v_max=1.0, max_gap=2))
    assert (2, 5, 4, 5) in found
    ghost = [np.zeros(len(x)) for x in frames]
    ghost[4][:] = 0.9
    assert not any(e[2] == 4 for e in tracking.two_phase(frames, tracking.TwoPhase(v_max=1.0, q_seed=0.5, q_young=99), ghost=ghost))


def test_merged_directions_prefer_forward_links():
    frames = _runs(3, 3)
    assert tracking.merge_directions([(0, 0, 1, 1)], [(0, 1, 1, 1), (0, 2, 1, 2), (0, 0, 1, 1)], frames) == [(0, 0, 1, 1), (0, 2, 1, 2)]


def test_shared_points():
    frames = [np.array([[0.0, 0, 0], [4, 0, 0]]), np.array([[1.0, 0, 0], [3, 0, 0]]), np.array([[2.0, 0, 0]])]
    prev, nxt = [np.array([-1, -1]), np.array([0, 1]), np.array([0])], [np.array([0, 1]), np.array([0, -1]), np.array([-1])]
    assert tracking.shared_points(frames, prev, nxt, 0.5) == [(2, 0, 1, 0), (2, 0, 1, 1)]


def test_curves():
    t = np.arange(9.0)
    x = np.stack([t**2, 3 - t, 0 * t], 1)
    p, v, a = curves.smooth(t, x, np.ones(9), 10.0, 5, 2)
    assert np.allclose(p, x) and np.allclose(v[:, 0], 20 * t) and np.allclose(a[:, 0], 200)
    at, support = curves.leave_one_out(t, x, np.ones(9), 5, 2)
    assert np.allclose(at, x, atol=1e-6) and (support == 4).all()
    bad = x.copy()
    bad[4] += 5
    w = curves.robust_weights(bad)
    assert w.argmin() == 4 and curves.robust_residual(bad) > curves.robust_residual(x)
    p, v, r = curves.predict(t, np.stack([2 * t, t, t], 1), 9.0)
    assert np.allclose(p, [18, 9, 9]) and np.allclose(v, [2, 1, 1]) and r < 1e-9
    c, at, r = curves.end_fit(t, np.stack([2 * t, t, t], 1), True, 4, 1)
    assert np.allclose(c, [[16, 8, 8], [2, 1, 1]]) and at == 8 and r < 1e-9


def test_targets_in_images():
    img = np.zeros((12, 14), int)
    img[3:6, 3:6] = [[20, 60, 20], [60, 90, 60], [20, 60, 20]]
    img[7:9, 9:12] = 50
    one, two = segmentation.grow(img, 10, 100, {})
    assert one == pytest.approx((4.5, 4.5, 9, 3, 3, 410)) and two == pytest.approx((10.5, 8.0, 6, 3, 2, 300))
    assert segmentation.components(img, 10, {}) == [one, two] and segmentation.grow(img, 10, 100, {"n": (7, 20)}) == [one]
    assert segmentation.grow(img, 10, 100, {"sumg": 300}) == [one] and segmentation.grow(img, 95, 100, {}) == []
    both = np.zeros((9, 15), int)
    for c, g in ((4, 100), (9, 90)):
        both[3:6, c - 2 : c + 3] = np.maximum(both[3:6, c - 2 : c + 3], [[g - 60, g - 40, g - 30, g - 40, g - 60], [g - 40, g - 20, g, g - 20, g - 40], [g - 60, g - 40, g - 30, g - 40, g - 60]])
    assert len(segmentation.components(both, 10, {})) == 1 and len(segmentation.peaks(both, 10, {})) == 2 and len(segmentation.peaks(both, 10, {}, prominence=95)) == 1
    sky = np.random.default_rng(7).normal(0, 1, (60, 60))
    sky[20:22, 30:32] += 60
    sky[20, 34] += 60
    (x, y, n), = segmentation.bubbles(sky, 25, 7.0, 4)
    assert abs(x - 31.2) < 0.5 and abs(y - 20.4) < 0.5 and n == 5
    assert segmentation.grey_bytes(np.array([[65535, 511]], np.uint16)).tolist() == [[255, 1]] and segmentation.grey_bytes(np.array([[0.0, 5, 20]]), "range", 0, 10).tolist() == [[0, 127, 255]]
    assert segmentation.suggest_range(np.arange(1001)) == (5, 999)


def _camera(**more):
    return Camera(x0=30.0, y0=-10.0, z0=300.0, omega=0.05, phi=0.1, kappa=0.02, cc=60.0, xh=0.1, yh=-0.2, gz=50.0, **more)


def test_calibration_finds_cameras_again():
    rng = np.random.default_rng(8)
    points = rng.random((40, 3)) * 80 - 40
    true = _camera(k1=1e-4, n2=1.46, n3=1.33, d=5.0)
    px = calibration.pixels(true, points)
    rough = _camera(n2=1.46, n3=1.33, d=5.0)
    rough.x0, rough.kappa, rough.cc = 33.0, 0.03, 61.0
    found, sd, residual = calibration.orient(rough, points, px, (*calibration.EXTERIOR, *calibration.INTERIOR, "k1"))
    assert residual < 1e-3 and abs(found.x0 - 30) < 0.5 and abs(found.cc - 60) < 0.1 and len(sd) == 10
    plain = Camera(x0=30.0, y0=-10.0, z0=300.0, omega=0.05, phi=0.1, kappa=0.02, cc=60.0)
    found = calibration.direct_linear(points, calibration.pixels(plain, points))
    assert calibration.rms(calibration.pixels(found, points), calibration.pixels(plain, points)) < 1e-6 and abs(found.x0 - 30) < 1e-6
    back, good = calibration.resect(Camera(x0=25.0, y0=-8.0, z0=310.0, cc=60.0), points, calibration.pixels(plain, points))
    assert good and abs(back.z0 - 300) < 1e-3
    with pytest.raises(ValueError):
        calibration.guard(Camera(cc=-1.0))


def test_pinhole_models_and_back():
    rng = np.random.default_rng(9)
    points = rng.random((30, 3)) * 80 - 40
    c = Camera(x0=30.0, y0=-10.0, z0=300.0, omega=0.05, phi=0.1, kappa=0.02, cc=60.0, xh=0.1, yh=-0.2)
    k, rvec, tvec = calibration.to_pinhole(c)
    r = np.array(optics.from_rotation_vector(Arrays, rvec), float)
    cam = points @ r.T + tvec
    ideal = cam[:, :2] / cam[:, 2:]
    assert np.allclose(ideal @ k[:2, :2].T + k[:2, 2], calibration.pixels(c, points), atol=1e-8)
    again = calibration.from_pinhole(k, np.zeros(5), rvec, tvec, c.imx, c.imy, c.pix_x, c.pix_y)
    assert calibration.rms(calibration.pixels(again, points), calibration.pixels(c, points)) < 1e-8
    dist = np.array([-0.2, 0.05, 1e-3, -5e-4, 0.0])
    bent = calibration.from_pinhole(k, dist, rvec, tvec, c.imx, c.imy, c.pix_x, c.pix_y)
    x, y = ideal.T
    r2 = x * x + y * y
    f = 1 + dist[0] * r2 + dist[1] * r2**2
    want = np.stack([x * f + 2 * dist[2] * x * y + dist[3] * (r2 + 2 * x * x), y * f + dist[2] * (r2 + 2 * y * y) + 2 * dist[3] * x * y], 1) @ k[:2, :2].T + k[:2, 2]
    assert calibration.rms(calibration.pixels(bent, points), want) < 0.05


def test_points_and_rigs_together():
    rng = np.random.default_rng(10)
    rig = [calibration.look_at((200 * np.cos(a), 200 * np.sin(a), 250.0), (0, 0, 0), 60.0, (0.0, 0.0, 1.0), imx=4096, imy=4096) for a in (0.3, 1.7, 3.2, 4.6)]
    points = rng.random((30, 3)) * 60 - 30
    px = np.stack([calibration.pixels(c, points) for c in rig], 1)
    assert np.allclose(calibration.triangulate(rig, px), points, atol=1e-7)
    x, cov = calibration.triangulate_weighted(rig, px, np.full(px.shape[:2], 0.04), points + 0.3, 5)
    assert np.allclose(x, points, atol=1e-6) and (cov[:, 0, 0] > 0).all()
    moved = [rig[0], *[Camera(**{**{k: getattr(c, k) for k in optics.FIELDS}, "x0": c.x0 + 0.5, "omega": c.omega + 0.001}) for c in rig[1:]]]
    _, _, error = calibration.bundle(moved, points, px, hold=None, fixed=True)
    assert error < 1e-3
    clean = [(0, k, px[0, k], 0.01) for k in range(3)] + [(1, k, px[1, k], 0.01) for k in range(3)]
    shared = [([0, 1], [0.6, 0.4], 3, 0.6 * px[0, 3] + 0.4 * px[1, 3], 0.01)]
    assert np.allclose(calibration.cluster(rig, points[:2] + 0.2, clean, shared, None, 12), points[:2], atol=1e-3)
    r, t, f = calibration.similarity(points, 2.0 * points @ np.array(optics.rotation(Arrays, 0.1, 0.2, 0.3), float).T + 5, True)
    assert abs(f - 2) < 1e-9 and np.allclose(t, 5) and np.allclose(calibration.rigid(points, points + 3), points + 3)


def test_plates():
    grid = np.array([(c, r) for r in range(5) for c in range(7)])
    turn = np.array([[0.98, -0.17], [0.17, 0.98]])
    dots = grid @ turn.T * 40 + 100
    order = np.random.default_rng(11).permutation(len(grid))
    assert (calibration.label_grid(dots[order]) == grid[order]).all()
    coded = np.zeros(len(grid), bool)
    for mark in ((2, 1), (3, 1), (4, 1), (2, 2)):
        coded[(grid == mark).all(1)] = True
    labels = calibration.label_from_marks(dots, coded)
    assert labels[(grid == (2, 1)).all(1)].tolist() == [[0, 0]] and labels[(grid == (4, 1)).all(1)].tolist() == [[2, 0]]
    flat = np.c_[grid * 40.0, np.zeros(len(grid))]
    m = calibration.plane_metrics(flat + [3, 4, 5], grid, 40.0)
    assert m["planarity"] < 1e-9 and m["pitch"] == pytest.approx(40) and m["residual"] < 1e-9
    views = {"a": flat, "b": flat + 0.01, "c": flat + 5}
    assert calibration.agreeing(views, 0.1) == ["a", "b"]
    assert calibration.match_grid(dots, dots[order] + 0.5, 3.0).tolist() == np.argsort(order).tolist()
    assert calibration.best_value([1, 2, 3], lambda v: (v - 2) ** 2)[0] == 2
    rows = calibration.compare({"one": [_camera()], "two": [_camera()]}, (0, 0, 0))
    assert rows[1]["angle"] < 1e-6 and rows[1]["flags"] == ""


def test_greedy_matches_a_pass():
    rng = random.Random(12)
    i, k = np.array([rng.randrange(30) for _ in range(200)]), np.array([rng.randrange(30) for _ in range(200)])
    cost = np.array([float(rng.randrange(9)) for _ in range(200)])
    won = assignment.greedy(i, k, cost)
    assert len(set(i[won])) == len(won) == len(set(k[won]))


def test_assignment_over_edges_alone():
    """The sparse search finds as many edges at the same total as the table of costs."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        n, m = rng.integers(1, 9, 2)
        on = rng.random((n, m)) < 0.5
        i, k = np.nonzero(on)
        if not len(i):
            continue
        cost = rng.integers(-2, 6, len(i)) / 2.0
        table = np.full((n, m), 1000.0)
        table[i, k] = cost
        r, c = assignment.hungarian(table)
        want = [table[p] for p in zip(r, c) if on[p]]
        got = assignment.sparse(i, k, cost)
        assert len(got) == len(want) and cost[got].sum() == pytest.approx(sum(want))
        assert len(set(i[got])) == len(set(k[got])) == len(got)
