"""Adopted blobs, births, brightness of tracks and the corrective pass against plain versions and planted cases."""

import numpy as np
import pytest

from skein.engines import imaging
from skein.functions.optics import Volume
from skein.operators import corrective, merging
from test_imaging import RIG, frames_of, scene

BLOBS = "frame long, cam long, blob long, x double, y double, sumg double, n long, nx long, ny long"
POINTS = "frame long, id long, x double, y double, z double"
MEMBERS = "frame long, id long, cam long, blob long"
VOLUME = Volume((-30.0, 30.0), (-30.0, -30.0), (30.0, 30.0))


def _scene(n=40, seed=2, cut=0.25):
    """Points, their members (some missing) and blobs of one frame; every point has its blob in every camera."""
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 3)) - 0.5) * 20
    px = imaging.pixels(RIG, x) + rng.normal(0, 0.1, (n, 4, 2))
    blobs = [(0, c, i, float(px[i, c, 0]), float(px[i, c, 1]), 100.0 + i, 9, 3, 3) for c in range(4) for i in range(n)]
    members = [(0, i, c, i) for i in range(n) for c in range(4) if rng.random() > cut]
    return x, px, blobs, members


@pytest.mark.parametrize("alone", [True, False])
def test_adopted_blobs_against_loops(spark, alone):
    x, px, blobs, members = _scene()
    x = x + np.random.default_rng(9).normal(0, 0.15, x.shape)
    has = {}
    for _, i, c, _ in members:
        has.setdefault(i, set()).add(c)
    used = {(c, b) for _, _, c, b in members}
    at = imaging.pixels(RIG, x)
    pairs = [(float(np.hypot(*(at[i, c] - px[b, c]))), i, c, b) for i in has if len(has[i]) >= 3 for c in range(4) if c not in has[i] for b in range(len(x))]
    pairs = sorted(p for p in pairs if p[0] < 25.0 and not (alone and (p[2], p[3]) in used))
    want, ends = set(), set()
    for _, i, c, b in pairs:
        if ("p", i, c) not in ends and not (alone and ("b", b, c) in ends):
            want.add((0, i, c, b))
            ends |= {("p", i, c), ("b", b, c)}
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], POINTS)
    got = merging.extend_membership(points, spark.createDataFrame(members, MEMBERS), spark.createDataFrame(blobs, BLOBS), RIG, 25.0, 3, alone)
    rows = got.collect()
    assert {(r.frame, r.id, r.cam, r.blob) for r in rows} == want and want and len(rows) == len(want) and all(r.d < 25.0 for r in rows)


def test_births_bring_back_what_nobody_saw(spark):
    rng = np.random.default_rng(4)
    x = np.array([[a, b, c] for a in (-8, 0, 8) for b in (-8, 0, 8) for c in (-6, 6)], float) + rng.normal(0, 0.5, (18, 3))
    hidden = x[0] + [0.4, 0.3, 0.0]  # lies in the blobs of point 0 in all cameras
    px, own = imaging.pixels(RIG, x), imaging.pixels(RIG, hidden[None])[0]
    blobs, known = [], []
    for c in range(4):
        for i in range(18):
            centre, g = px[i, c], 100.0
            if i == 0:
                centre, g = (100 * px[0, c] + 80 * own[c]) / 180, 180.0
            blobs.append((0, c, i, *map(float, centre), g, 9, 3, 3))
    seen = [i for i in range(18) if i not in (5, 11)]  # two points are not found at all
    members = [(0, i, c, i) for i in seen for c in range(4)]
    known = [(0, i, c, 100.0, *map(float, px[i, c])) for i in seen for c in range(4)]
    points = spark.createDataFrame([(0, i, *map(float, x[i])) for i in seen], POINTS)
    args = spark.createDataFrame(members, MEMBERS), spark.createDataFrame(known, "frame long, id long, cam long, s double, pu double, pv double"), spark.createDataFrame(blobs, BLOBS)
    targets = merging.birth_targets(*args, shift=30.0).collect()
    assert sorted((r.cam, r.src, r.kind) for r in targets) == sorted((c, b, k) for c in range(4) for b, k in ((5, 0), (11, 0), (0, 1)))
    assert all(np.allclose((r.x, r.y, r.sumg), (*own[r.cam], 80.0)) for r in targets if r.kind)
    flat = spark.createDataFrame(targets)
    found = merging.birth_points(flat, RIG, VOLUME, 0.02).collect()
    assert len(found) == 1 and found[0].n_resid == 4 and list(found[0].blobs) == [0] * 4 and np.allclose([found[0].x, found[0].y, found[0].z], hidden, atol=0.05)
    born, who = merging.births(points, *args, RIG, VOLUME, 0.02, rounds=3)
    rows = sorted(born.collect(), key=lambda r: r.id)
    assert len(rows) == 2 and all(r.id > max(seen) and r.round == 1 for r in rows)
    assert all(min(np.linalg.norm(np.array([r.x, r.y, r.z]) - x[k]) for k in (5, 11)) < 0.05 for r in rows)
    uses = [(r.cam, r.blob) for r in who.collect()]
    assert len(uses) == 8 and len(set(uses)) == 8 and not set(uses) & {(c, i) for _, i, c, _ in members}


def test_brightness_and_gains_come_back(spark):
    rng = np.random.default_rng(7)
    own, gain, rows = rng.uniform(80, 160, 14), np.array([1.0, 1.5, 0.7]), []
    for f in range(12):
        for c in range(3):
            pairs = {i: i for i in range(14)}
            if f % 3 == 0:
                pairs[3] = pairs[4] = 4  # these two share a blob
            if c == 1:
                pairs[7] = 7
            for i in range(14):
                inside = [j for j in range(14) if pairs[j] == pairs[i]]
                g = sum(own[j] * gain[c] for j in inside) * rng.normal(1, 0.01) + (90.0 if i == 7 and c == 1 else 0.0)  # something hides beside 7 in camera 1
                rows.append((i, f, c, pairs[i], float(g)))
    same = {(f, c, b): g for _, f, c, b, g in rows}  # one brightness a blob
    df = spark.createDataFrame([(i, f, c, b, same[f, c, b]) for i, f, c, b, _ in rows], "trajid long, frame long, cam long, blob long, sumg double")
    got = {(r.trajid, r.cam): r.signature for r in merging.estimate_signatures(df).collect()}
    assert len(got) == 42 and all(abs(got[i, c] / (own[i] * gain[c]) - 1) < 0.06 for i in range(14) for c in range(3))
    plain = {(r.trajid, r.cam): r.signature for r in merging.estimate_signatures(df, cross=False).collect()}
    assert plain[7, 1] > 1.3 * own[7] * gain[1]


def test_blobs_know_their_first_user(spark):
    _, _, blobs, members = _scene(5)
    got = merging.first_user(spark.createDataFrame([*members, (0, 9, 0, 2)], MEMBERS), spark.createDataFrame(blobs, BLOBS)).collect()
    used = {(c, b): i for _, i, c, b in [(0, 9, 0, 2), *members]}
    assert {(r.cam, r.blob): r.tnr for r in got} == {(c, b): used.get((c, b), -1) for c in range(4) for b in range(5)}


def _broken(seed=21, n=12, frames=9):
    run = scene(n=n, frames=frames, seed=seed, box=16.0, hidden=0.0, shift=0.02, noise=0.003)
    gone = {(2, 3), (3, 3), (5, 7), (4, 11), (5, 11), (6, 11), (7, 11), (8, 11), (0, 15), (1, 15)}  # a hole of two, of one, an end and a beginning
    return run, gone


def test_broken_tracks_are_led_on(spark):
    run, gone = _broken()
    # tracks by place: every frame's points in order of the first frame's
    lines = [run[0][1][k] for k in range(len(run[0][0]))]
    tracks = [[int(run[0][0][k])] for k in range(len(lines))]
    for t in range(1, len(run)):
        for k, at in enumerate(lines):
            want = at if t == 1 else 2 * at - before[k]  # noqa: F821 - set below
            j = int(np.argmin(np.linalg.norm(run[t][1] - want, axis=1)))
            tracks[k].append(int(run[t][0][j]))
        now = [run[t][1][list(run[t][0]).index(tracks[k][t])] for k in range(len(lines))]
        before, lines = lines, now
    lost = {(t, tracks[k][t]) for t, i in gone for k in range(len(tracks)) if tracks[k][0] == (i if i < 2 * len(tracks) else 1)}
    prev, nxt = {}, {}
    for k, line in enumerate(tracks):
        for t in range(len(run) - 1):
            if (t, line[t]) not in lost and (t + 1, line[t + 1]) not in lost:
                nxt[t, line[t]], prev[t + 1, line[t + 1]] = line[t + 1], line[t]
    rows = [(t, int(i), prev.get((t, int(i))), nxt.get((t, int(i))), *map(float, p), list(map(int, u))) for t, f in enumerate(run) for i, p, u in zip(*f[:3]) if (t, int(i)) not in lost]
    df = spark.createDataFrame(rows, "frame long, id long, prev long, next long, x double, y double, z double, cam_ids array<long>").repartition(3)
    targets = spark.createDataFrame([(t, c, int(k), *map(float, p)) for t, f in enumerate(run) for c, (pnr, xy) in enumerate(f[3]) for k, p in zip(pnr, xy)], "frame long, cam long, pnr long, x double, y double")
    edges, made = corrective.extend_ends(df, targets, RIG, frames=3, warm=1)
    at, tool, want = frames_of_rows(rows, run), imaging.Extender(RIG), []
    state = tool.blank()
    for t in range(len(run)):
        state, found, _ = tool.step(state, t, at)
        want += [tuple(e) for e in found.tolist()]
    assert sorted(tuple(r) for r in edges.collect()) == sorted(want) and want and made.count() == len(want)
    out, facts = corrective.correct(df, targets, RIG, frames=3, accel=0.5)
    got = out.collect()
    assert facts[0]["added"] >= len(lost) and facts[-1]["after"] > facts[0]["before"]
    places = {(r.frame, r.id): np.array([r.x, r.y, r.z]) for r in got}
    for t, i in lost:
        x = run[t][1][list(run[t][0]).index(i)]
        assert any(f == t and np.linalg.norm(p - x) < 0.2 for (f, _), p in places.items())
    links = {(r.frame, r.id): r.next for r in got}
    assert all(links[k] == v for k, v in nxt.items()), "good links stay"
    uses = [(r.frame, c, k) for r in got for c, k in enumerate(r.cam_ids) if k >= 0]
    assert len(uses) == len(set(uses))


def frames_of_rows(rows, run):
    """As frames_of of the tracker's tests, with prev and next of the points."""
    links = {(t, i): (-1 if p is None else p, -1 if n is None else n) for t, i, p, n, *_ in rows}
    kept = [(np.array([r[1] for r in rows if r[0] == t]), np.array([r[4:7] for r in rows if r[0] == t]), np.array([r[7] for r in rows if r[0] == t]), f[3]) for t, f in enumerate(run)]
    plain = frames_of(kept)

    def at(t):
        ids, x, extra = plain(t)
        if not len(ids):
            return ids, x, extra
        own = [links.get((t, int(i)), (-1, -1)) if c < 0 else (-1, -1) for i, c in zip(ids, extra["cam"])]
        return ids, x, extra | {"prev": np.array([p for p, _ in own]), "next": np.array([n for _, n in own])}

    return at
