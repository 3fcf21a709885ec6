"""The tracker in images against loops over single particles, in windows against one pass, and what it does where a detection is missing."""

import itertools
from collections import Counter

import numpy as np
import pytest

from skein.engines import imaging
from skein.engines import tracking as engine
from skein.functions import optics
from skein.functions.numeric import Arrays
from skein.operators import stereo, windows

RIG = stereo.standard_rig(4, (0.0, 0.0, 0.0), 300.0, 80.0, 60.0, imx=1280, imy=1024, pix_x=0.012, pix_y=0.012)
SEARCH = imaging.Search((-1.5,) * 3, (1.5,) * 3, 0.9, 120.0, bounds=((-30.0,) * 3, (30.0,) * 3))


def scene(n=14, frames=7, seed=1, box=7.0, hidden=0.12, shift=0.3, noise=0.04):
    """Each frame's points (ids, positions, uses) and targets (pnr, pixels) of every camera; hidden points keep their targets, which then nobody uses."""
    rng = np.random.default_rng(seed)
    start, v = (rng.random((n, 3)) - 0.5) * box, (rng.random((n, 3)) - 0.5) * 1.6
    out = []
    for t in range(frames):
        x = start + v * t + rng.normal(0, noise, (n, 3))
        seen = imaging.pixels(RIG, x) + rng.normal(0, shift, (n, 4, 2))
        numbers = np.stack([rng.permutation(n) for _ in range(4)], 1)
        targets = [(np.sort(numbers[:, c]), seen[np.argsort(numbers[:, c]), c]) for c in range(4)]
        kept = np.flatnonzero(rng.random(n) > hidden) if t > 1 else np.arange(n)
        order = rng.permutation(kept)
        uses = np.where(rng.random((len(order), 4)) < 0.9, numbers[order], -1)
        out.append((np.arange(len(order)) * 2 + 1, x[order], uses, targets))
    return out


def frames_of(run):
    def at(t):
        if not 0 <= t < len(run):
            return np.empty(0, int), np.empty((0, 3)), {}
        ids, x, uses, targets = run[t]
        rows = [(int(i), -1, *map(float, p), list(map(int, u))) for i, p, u in zip(ids, x, uses)] + [(int(k), c, *map(float, p), 0.0, []) for c, (pnr, xy) in enumerate(targets) for k, p in zip(pnr, xy)]
        rows.sort(key=lambda r: r[0])
        uses_ = np.empty(len(rows), object)
        uses_[:] = [r[5] for r in rows]
        return np.array([r[0] for r in rows]), np.array([r[2:5] for r in rows], float), {"cam": np.array([r[1] for r in rows]), "uses": uses_}

    return at


def loops(run, s):
    """The same rules particle by particle."""
    pix = lambda p: [tuple(float(v) for v in optics.pixel(Arrays, c, [float(a) for a in p])) for c in RIG]
    points = [{int(i): (np.array(p), list(map(int, u))) for i, p, u in zip(*f[:3])} for f in run] + [{}, {}]
    spots = [[{int(k): tuple(map(float, p)) for k, p in zip(*t)} for t in f[3]] for f in run] + [[{}] * 4] * 2
    edges, added, link = [], [], {}
    step = lambda d: all(lo < a < hi for lo, a, hi in zip(s.low, d, s.high))
    inside = lambda p: all(lo < a < hi for lo, a, hi in zip(s.bounds[0], p, s.bounds[1]))
    size = lambda d: float(np.linalg.norm(d))

    def turn(a, b, c):
        u, v = b - a, c - a
        acc = size(u - v)
        if (u == v).all() or not size(u) * size(v):
            return acc, 0.0
        if (u == -v).all():
            return acc, 200.0
        return acc, 200 / np.pi * float(np.arccos(np.clip(u @ v / (size(u) * size(v)), -1, 1)))

    fine = lambda acc, angle: (acc < s.dacc and angle < s.dangle) or acc < 0.1 * s.dacc

    def owners(t):
        own = [dict() for _ in RIG]
        for i, (_, uses) in points[t].items():
            for c, k in enumerate(uses):
                if k in spots[t][c]:
                    own[c][k] = i
        return own

    def vote(t, place, images):
        own, names = owners(t), Counter()
        centre = pix(place)
        corners = [pix(place + np.array([(s.low, s.high)[b][a] for a, b in enumerate(bits)])) for bits in itertools.product((0, 1), repeat=3)]
        for c, cam in enumerate(RIG):
            us, vs = [k[c][0] for k in corners], [k[c][1] for k in corners]
            left, right, up, down = centre[c][0] - max(min(us), 0), min(max(us), cam.imx) - centre[c][0], centre[c][1] - max(min(vs), 0), min(max(vs), cam.imy) - centre[c][1]
            u, v = images[c]
            near = sorted((np.hypot(x - u, y - v), k) for k, (x, y) in spots[t][c].items() if k in own[c] and -left < x - u < right and -up < y - v < down)[:4]
            for i in {own[c][k] for _, k in near}:
                names[i] += 1
        return sorted(((i, n) for i, n in names.items() if n >= 2), key=lambda a: (-a[1], list(points[t]).index(a[0])))

    def free(t, place):
        own, rays, rows = owners(t), {}, []
        for c, (u, v) in enumerate(pix(place)):
            near = sorted((np.hypot(x - u, y - v), k) for k, (x, y) in spots[t][c].items() if k not in own[c] and abs(x - u) < 3 and abs(y - v) < 3)
            rows.append(near[0][1] if near else -1)
            if near:
                flat = optics.to_flat(Arrays, RIG[c], *optics.to_metric(Arrays, RIG[c], *spots[t][c][near[0][1]]))
                rays[c] = [np.array([float(a) for a in r]) for r in optics.ray(Arrays, RIG[c], *flat)]
        mids = [imaging.middle(*[r[None] for r in (*rays[a], *rays[b])])[0] for a, b in itertools.combinations(sorted(rays), 2)]
        return (np.mean(mids, 0) if mids else None), len(rays), rows

    def create(t, asks):
        used, last, out = set(), max([-1, *points[t]]), []
        for price, by, via, spot, rows in sorted(asks, key=lambda a: a[:3]):
            if -1 in rows or used & set(enumerate(rows)):
                continue
            used |= set(enumerate(rows))
            last += 1
            out.append((last, by, spot, rows))
        return out

    for t in range(len(run)):
        lists, asks2, asks3, names = {}, [], [], list(points[t])
        old = {i: points[t - 1][link[i]][0] for i in names if i in link}
        for h in names:
            x1, uses = points[t][h]
            ahead, still = (2 * x1 - old[h], False) if h in old else (x1, True)
            if still and s.flow:
                near = [points[t][j][0] - old[j] for j in names if j != h and j in old and step(points[t][j][0] - x1) and all(abs(a) < max(-lo, hi) for a, lo, hi in zip(points[t][j][0] - x1, s.low, s.high))]
                if near:
                    ahead, still = x1 + np.mean(near, 0), False
            images = [spots[t][c][uses[c]] if still and uses[c] in spots[t][c] else p for c, p in enumerate(pix(ahead))]
            mine = []
            for m, votes in vote(t + 1, ahead, images):
                x2 = points[t + 1][m][0]
                after = 0.5 * (5 * x2 - 4 * x1 + old[h]) if h in old else 2 * x2 - x1
                first, (acc0, angle0) = size(x1 - x2), turn(x1, ahead, x2)
                price = lambda second, acc, angle, n: ((first + second) / 2 / s.longest + acc / s.dacc + angle / s.dangle) / n  # noqa: B023, E731
                for k, more in vote(t + 2, after, pix(after)):
                    x3 = points[t + 2][k][0]
                    acc, angle = turn(x2, x3, after)
                    if h in old:
                        acc, angle = (acc + acc0) / 2, (angle + angle0) / 2
                    if step(x3 - x2) and fine(acc, angle):
                        mine.append((price(size(x3 - x2), acc, angle, votes + more), m))
                spot, cams, rows = free(t + 2, after)
                if cams >= 2 and inside(spot) and step(x2 - spot):
                    acc, angle = turn(x2, spot, after)
                    if fine(acc, angle):
                        cost = price(size(spot - x2), acc, angle, votes + cams)
                        mine.append((cost, m))
                        asks3.append((cost, h, m, spot, rows))
                if not mine and h in old and step(x2 - x1) and fine(acc0, angle0):
                    mine.append((price(size(x1 - old[h]), acc0, angle0, votes), m))
            if not mine and h in old and s.add:
                spot, cams, rows = free(t + 1, ahead)
                if cams >= 2 and inside(spot) and step(ahead - spot):
                    acc, angle = turn(x1, ahead, spot)
                    if fine(acc, angle):
                        asks2.append((((size(x1 - spot) + size(old[h] - x1)) / 2 / s.longest + acc / s.dacc + angle / s.dangle) / cams, h, h, spot, rows))
            lists[h] = sorted(mine, key=lambda a: (a[0], list(points[t + 1]).index(a[1])))
        new2, new3 = create(t + 1, asks2), create(t + 2, asks3) if s.add else []
        prev, want = {}, {h: m[0] for h, m in lists.items() if m}
        for h in sorted(want, key=lambda h: (want[h][0], names.index(h))):
            prev.setdefault(want[h][1], h)
        losers = [h for h in want if prev[want[h][1]] != h]
        for h in losers if s.retry else []:
            nxt = next((m for _, m in lists[h] if m not in prev), None)
            if nxt is not None:
                prev[nxt] = h
        link = dict(prev)
        for last, by, spot, rows in new2:
            points[t + 1][last] = (spot, rows)
            link[last] = by
            added.append((t + 1, last, spot, rows))
        for last, _, spot, rows in new3:
            points[t + 2][last] = (spot, rows)
            added.append((t + 2, last, spot, rows))
        edges += [(t, h, 1, m) for m, h in link.items()]
    return sorted(edges), added


def one_pass(run, search):
    tracker, at, edges, made = imaging.ImageTracker(RIG, search), frames_of(run), [], []
    state = tracker.blank()
    for t in range(len(run)):
        state, found, new = tracker.step(state, t, at)
        edges += [tuple(e) for e in found.tolist()]
        made += new
    return sorted(edges), made


@pytest.mark.parametrize("seed", range(6))
def test_steps_equal_loops_over_particles(seed):
    search = SEARCH if seed != 2 else imaging.Search((-1.5, -1.2, -1.4), (1.4, 1.5, 1.3), 0.9, 120.0, add=False, retry=False, flow=False)
    run = scene(seed=seed, n=16 + seed)
    edges, made = one_pass(run, search)
    want, added = loops(run, search)
    assert edges == want and len(edges) > 40
    assert [(p["frame"], p["id"], p["uses"]) for p in made] == [(f, i, rows) for f, i, _, rows in added]
    assert all(np.allclose(p["x"], x) for p, (_, _, x, _) in zip(made, added)) and (bool(made) or not search.add)


def test_missing_detections_come_back_and_no_target_is_used_twice(spark):
    run = scene(n=10, frames=8, seed=11, box=14.0, hidden=0.0, shift=0.02, noise=0.005)
    gone = {(3, 1), (4, 5), (5, 9)}
    cut = [(ids[keep], x[keep], uses[keep], targets) for t, (ids, x, uses, targets) in enumerate(run) for keep in [np.array([(t, int(i)) not in gone for i in ids])]]
    points = spark.createDataFrame([(t, int(i), *map(float, p), list(map(int, u))) for t, f in enumerate(cut) for i, p, u in zip(*f[:3])], "frame long, id long, x double, y double, z double, cam_ids array<long>")
    targets = spark.createDataFrame([(t, c, int(k), *map(float, p)) for t, f in enumerate(cut) for c, (pnr, xy) in enumerate(f[3]) for k, p in zip(pnr, xy)], "frame long, cam long, pnr long, x double, y double")
    edges, made = windows.in_images(points.repartition(3), targets.repartition(2), RIG, SEARCH, frames=2, warm=1)
    want, added = one_pass(cut, SEARCH)
    assert sorted(tuple(r) for r in edges.collect()) == want
    found = made.collect()
    assert sorted((r.frame, r.id) for r in found) == sorted((p["frame"], p["id"]) for p in added) and found
    lost = {(t, i): run[t][1][list(run[t][0]).index(i)] for t, i in gone}
    assert all(any(r.frame == t and np.linalg.norm(np.array([r.x, r.y, r.z]) - x) < 0.2 for r in found) for (t, _), x in lost.items())
    uses = Counter((t, c, k) for t, f in enumerate(cut) for u in f[2] for c, k in enumerate(u.tolist()) if k >= 0)
    uses.update((r.frame, c, k) for r in found for c, k in enumerate(r.cam_ids))
    assert max(uses.values()) == 1


def test_conflicts_go_to_the_cheapest_and_losers_retry():
    rows, cand, cost = np.array([0, 0, 1, 1, 2]), np.array([5, 6, 5, 7, 5]), np.array([0.2, 0.4, 0.1, 0.3, 0.2])
    assert imaging.settle(rows, cand, cost, False).tolist() == [2]
    assert imaging.settle(rows, cand, cost, True).tolist() == [1, 2]
    assert imaging.settle(rows[:0], cand[:0], cost[:0], True).tolist() == []
    acc, angle = imaging.turning(np.zeros(3), np.eye(3)[:1], -np.eye(3)[:1])
    assert acc.tolist() == [2.0] and angle.tolist() == [200.0]
    assert engine.NO_EDGES.shape == (0, 4)
