"""Trackers over the frames of one chunk: lists of arrays (n, 3) in, arrays of next rows (-1: none) or edges out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from skein.engines import assignment, cells

# Candidates kept for a particle, penalty of a candidate without support, degrees in a radian.
CANDIDATES, UNSUPPORTED = 32, 1e6
#: Positions whose candidates are looked for at once.
SOME = 20_000
NONE = -1


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def place_candidates(at: np.ndarray, points: np.ndarray, half, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """candidates() of positions that all differ: of points at one place the first `most` can matter, so places are paired, SOME positions at a time."""
    rows, start, _ = cells.places(points)
    n, there = np.minimum(np.diff(start), most), points[rows[start[:-1]]]
    parts = []
    for lo in range(0, len(at), SOME):
        i, q = cells.in_box(at[lo : lo + SOME], there, half)
        d = _norm(there[q] - at[i + lo])
        order = np.lexsort((d, i))
        i, q, d = i[order], q[order], d[order]
        if len(i):  # a place with `most` points nearer than it is out
            before = assignment.running(i, n[q])
            new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 0) | (np.diff(d) != 0)]))
            near = np.repeat(before[new], np.diff(np.append(new, len(i)))) < most
            i, q = i[near], q[near]
        of, member = cells._expand(start[q], start[q] + n[q])
        i, k = i[of] + lo, rows[member]
        d = _norm(points[k] - at[i])
        kept = cells.nearest(i, k, d, most)
        parts.append((i[kept], k[kept], d[kept]))
    return tuple(np.concatenate(v) for v in zip(*parts)) if parts else (np.empty(0, np.intp), np.empty(0, np.intp), np.empty(0))


def candidates(at: np.ndarray, points: np.ndarray, half, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, k, distance) of the nearest points strictly inside the box around each position."""
    rows, start, of = cells.places(at)
    p, k, d = place_candidates(at[rows[start[:-1]]], points, half, most)
    low, high = (np.searchsorted(p, of, side) for side in ("left", "right"))
    i, e = cells._expand(low, high)
    return i, k[e], d[e]


def neighbour_flow(x0: np.ndarray, x1: np.ndarray, prev1: np.ndarray, rows: np.ndarray, half) -> tuple[np.ndarray, np.ndarray]:
    """Mean velocity of the linked points in the box around each of the given rows, and how many there are. Where places hold two points or more on average, places are paired."""
    linked = np.flatnonzero(prev1 >= 0)
    own, at, of = cells.places(x1[rows])
    other, start, _ = cells.places(x1[linked])
    if len(rows) + len(linked) >= 2 * (len(at) + len(start) - 2) and (prev1[rows] < 0).all():
        v = (x1[linked] - x0[prev1[linked]])[other]
        n = np.diff(start)
        total = np.add.reduceat(v, start[:-1]) if len(n) else np.empty((0, 3))
        i, k = cells.in_box(x1[rows[own[at[:-1]]]], x1[linked[other[start[:-1]]]], half)
        count = np.bincount(i, n[k], len(at) - 1).astype(np.int64)
        mean = np.stack([np.bincount(i, total[k, d], len(at) - 1) for d in range(3)], 1) / np.maximum(count, 1)[:, None]
        return mean[of], count[of]
    i, k = cells.in_box(x1[rows], x1[linked], half)
    other = rows[i] != linked[k]
    i, k = i[other], linked[k[other]]
    n = np.bincount(i, minlength=len(rows))
    v = x1[k] - x0[prev1[k]]
    mean = np.stack([np.bincount(i, v[:, d], len(rows)) for d in range(3)], 1) / np.maximum(n, 1)[:, None]
    return mean, n


def cascade_step(x0, x1, prev1, x2, half, gate: float = 0.0, dacc: float = 0.0, dangle: float = 0.0, penalty=None) -> np.ndarray:
    """Next row of every point of x1 in x2 by three levels, each cheapest first among what is still free.

    1. Linked points go on at their velocity, cost the acceleration; with dacc they must stay below it (and below dangle degrees, or a tenth of dacc).
    2. Points without a link take the mean velocity of the linked points in their box.
    3. The rest take what is nearest to where they are; with a gate, to where their neighbours' flow takes them and no farther than the gate.
    penalty adds to the cost of each point of x2.
    """
    nxt, taken = np.full(len(x1), NONE), np.zeros(len(x2), bool)
    extra = np.zeros(len(x2)) if penalty is None else np.asarray(penalty, float)

    def choose(rows, at, gate_, first=False):
        # rows that are at one place, and move alike where that counts, have the same candidates
        alike, start, _ = cells.places(np.hstack([x1[rows], x0[prev1[rows]]]) if first and dacc > 0 else at)
        lead = alike[start[:-1]]
        p, k, d = place_candidates(at[lead], x2, half)
        i = lead[p]
        ok = ~taken[k] & (d <= gate_ if gate_ > 0 else True)
        if first and dacc > 0:
            v1, v2 = x1[rows[i]] - x0[prev1[rows[i]]], x2[k] - x1[rows[i]]
            if dangle > 0:
                n = _norm(v1) * _norm(v2)
                with np.errstate(all="ignore"):
                    angle = np.where((_norm(v1) > 1e-12) & (_norm(v2) > 1e-12), np.degrees(np.arccos(np.clip((v1 * v2).sum(1) / n, -1, 1))), 0.0)
                ok &= ((d < dacc) & (angle < dangle)) | (d < dacc * 0.1)
            else:
                ok &= d < dacc
        p, i, k, cost = p[ok], i[ok], k[ok], (d + extra[k])[ok]
        if len(start) - 1 == len(rows):
            won = assignment.greedy(i, k, cost)
            i, k = i[won], k[won]
        else:
            ia = [alike[lo:hi][::-1].tolist() for lo, hi in zip(start, start[1:])]
            i, k, _ = assignment.greedy_places(p, k, cost, ia, [[n] for n in range(len(x2))])
        nxt[rows[i]] = k
        taken[k] = True

    linked = np.flatnonzero(prev1 >= 0)
    choose(linked, 2 * x1[linked] - x0[prev1[linked]], 0.0, first=True)
    alone = np.flatnonzero(prev1 < 0)
    flow, n = neighbour_flow(x0, x1, prev1, alone, half)
    choose(alone[n > 0], (x1[alone] + flow)[n > 0], 0.0)
    rest = alone[nxt[alone] < 0]
    choose(rest, x1[rest] + (flow[nxt[alone] < 0] if gate > 0 else 0.0), gate)
    return nxt


def four_be_step(x0, x1, prev1, x2, x3, half, strict: bool = False, greedy: bool = False) -> np.ndarray:
    """Next row by best estimate over four frames.

    A linked point's candidates lie in the box around 2 x1 - x0; each costs its distance to that plus that of the nearest point of x3 to where the
    candidate would go on, or a penalty plus its acceleration where there is none (strict: it's no candidate). Without x3 the acceleration alone counts. Points
    without a link take the nearest point. A point claimed by several goes to none of them (greedy: cheapest first).
    """
    linked, alone = np.flatnonzero(prev1 >= 0), np.flatnonzero(prev1 < 0)
    i, k, d = candidates(2 * x1[linked] - x0[prev1[linked]], x2, half)
    i = linked[i]
    cost = d.copy()
    if len(x3) and len(i):
        at, _, near = candidates(2 * x2[k] - x1[i], x3, half, 1)
        support = np.full(len(i), np.nan)
        support[at] = near
        cost = np.where(np.isnan(support), UNSUPPORTED + d, support + d)
        if strict:
            ok = ~np.isnan(support)
            i, k, cost = i[ok], k[ok], cost[ok]
    j, m, e = candidates(x1[alone], x2, half, 1)
    i, k, cost = np.concatenate([i, alone[j]]), np.concatenate([k, m]), np.concatenate([cost, e])
    if greedy:
        won = assignment.greedy(i, k, cost)
    else:
        won = cells.nearest(i, k, cost, 1)
        won = won[np.bincount(k[won], minlength=len(x2))[k[won]] == 1]
    nxt = np.full(len(x1), NONE)
    nxt[i[won]] = k[won]
    return nxt


def _turned(nxt: np.ndarray, n: int) -> np.ndarray:
    prev = np.full(n, NONE)
    rows = np.flatnonzero(nxt >= 0)
    prev[nxt[rows]] = rows
    return prev


def march(frames: list[np.ndarray], step) -> list[np.ndarray]:
    """Next rows of all frames but the last by step(x0, x1, prev1, x2, x3), frame after frame."""
    none = np.empty((0, 3))
    out, prev, x0 = [], np.full(len(frames[0]) if frames else 0, NONE), none
    for t in range(len(frames) - 1):
        x3 = frames[t + 2] if t + 2 < len(frames) else none
        nxt = step(x0, frames[t], prev, frames[t + 1], x3)
        out.append(nxt)
        x0, prev = frames[t], _turned(nxt, len(frames[t + 1]))
    return out


def cascade(frames, half=(2.0, 2.0, 2.0), gate: float | None = None, **more) -> list[np.ndarray]:
    """The three-level cascade over a chunk."""
    return march(frames, cascade_link(half, gate, **more))


def four_be(frames, half=(2.0, 2.0, 2.0), strict: bool = False, greedy: bool = False) -> list[np.ndarray]:
    return march(frames, four_be_link(half, strict, greedy))


def back_step(x0, x1, x2, into: np.ndarray, out: np.ndarray, half, accel: float, angle: float = 0.0) -> np.ndarray:
    """Next rows of x0 (into: those it has) with the links that the points of x1 without prev but with next (out, rows of x2) take backwards:
    they go back at their velocity to the nearest free point of x0 within accel, cheapest first."""
    nxt = into.copy()
    rows = np.flatnonzero((_turned(into, len(x1)) < 0) & (out >= 0))
    free = np.flatnonzero(into < 0)
    i, k, d = candidates(2 * x1[rows] - x2[out[rows]], x0[free], half)
    v1, v2 = x1[rows[i]] - x0[free[k]], x2[out[rows[i]]] - x1[rows[i]]
    with np.errstate(all="ignore"):
        gon = np.where(_norm(v1) * _norm(v2) > 0, np.arccos(np.clip((v1 * v2).sum(1) / (_norm(v1) * _norm(v2)), -1, 1)) * 200 / np.pi, 0.0)
    ok = ((d < accel) & ((gon < angle) | (angle <= 0))) | (d < accel / 10)
    i, k, d = i[ok], k[ok], d[ok]
    won = assignment.greedy(i, k, d)
    nxt[free[k[won]]] = rows[i[won]]
    return nxt


def back(frames, forward: list[np.ndarray], half, accel: float, angle: float = 0.0) -> list[np.ndarray]:
    """Links of all frames after a pass backwards."""
    nxt = [x.copy() for x in forward]
    for t in range(len(frames) - 2, 0, -1):
        nxt[t - 1] = back_step(frames[t - 1], frames[t], frames[t + 1], nxt[t - 1], nxt[t], half, accel, angle)
    return nxt


def multi_term(distance, v, a, di, dt: float, weights) -> np.ndarray:
    """Weighted sum of distance, speed, acceleration and brightness difference; weights are normalised to 1."""
    w = np.asarray(weights, float) / np.sum(weights)
    return w[0] * distance + w[1] * v / dt + w[2] * a / (dt * dt) + w[3] * np.abs(di)


class Nearest:
    """Constant velocity and least total distance, frame by frame.

    A track of one point looks v_max around it, a longer one a_max around where its velocity takes it; after max_gap frames without a point it ends.
    Matches that turn by more than max_angle degrees are dropped after the assignment. A frame without points or without tracks ends all tracks.
    """

    behind = ahead = 0

    def __init__(self, v_max: float = 10.0, a_max: float = 50.0, max_gap: int = 2, dt: float = 0.1, max_angle: float | None = None, weights=None):
        self.v_max, self.a_max, self.max_gap, self.dt, self.max_angle, self.weights = v_max, a_max, max_gap, dt, max_angle, weights

    def blank(self) -> dict[str, np.ndarray]:
        return _open(np.empty(0, int), np.empty((0, 3)), 0) | {"gap": np.empty(0, int)}

    def step(self, state, t: int, frames):
        ids, points, _ = frames(t)
        new = lambda rows: _open(ids[rows], points[rows], t) | {"gap": np.zeros(len(rows), int)}
        n = len(state["t"])
        if not n or not len(points):
            return new(np.arange(len(points))), NO_EDGES
        x, v, seeded = state["x"], state["v"], state["n"] > 1
        at = np.where(seeded[:, None], x + v, x)
        radius = np.where(seeded, self.a_max, self.v_max)
        i, k, d2 = cells.within(at, points, float(radius.max()))
        near = np.sqrt(d2) <= radius[i]
        i, k, d = i[near], k[near], np.sqrt(d2[near])
        won = assignment.best(i, k, d if self.weights is None else multi_term(d, d, d, 0.0, self.dt, self.weights))
        i, k = i[won], k[won]
        if self.max_angle is not None and len(i):
            step = points[k] - x[i]
            a, b = _norm(step), _norm(v[i])
            with np.errstate(all="ignore"):
                angle = np.degrees(np.arccos(np.clip((step * v[i]).sum(1) / (a * b), -1, 1)))
            kept = ~(seeded[i] & (b > 1e-9) & (a > 1e-9) & (angle > self.max_angle))
            i, k = i[kept], k[kept]
        edges = np.stack([state["t"][i], state["id"][i], t - state["t"][i], ids[k]], 1)
        moved = {"t": np.full(len(i), t), "id": ids[k], "x": points[k], "v": (points[k] - x[i]) / np.maximum((t - state["t"][i]) * self.dt, 1e-6)[:, None], "n": np.full(len(i), 2), "gap": np.zeros(len(i), int)}
        stay = np.ones(n, bool)
        stay[i] = False
        stay &= state["gap"] < self.max_gap
        waiting = {c: w[stay] for c, w in state.items()}
        waiting["gap"] = waiting["gap"] + 1
        return _joined(waiting, moved, new(np.setdiff1d(np.arange(len(points)), k))), edges


NO_EDGES = np.empty((0, 4), int)


def _open(ids: np.ndarray, x: np.ndarray, t: int) -> dict[str, np.ndarray]:
    """Tracks that begin with these points."""
    return {"t": np.full(len(ids), t), "id": np.asarray(ids, int), "x": x, "v": np.zeros((len(ids), 3)), "n": np.ones(len(ids), int)}


def _joined(*parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Open tracks in order of their last point, whatever way they came to be open."""
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((whole["id"], whole["t"]))
    return {c: v[order] for c, v in whole.items()}


def run(stepper, frames: list[np.ndarray], extras: list[dict] | None = None) -> np.ndarray:
    """Edges (frame, row, step, row) of a stepper over all frames, one after the other."""
    nothing = np.empty(0, int), np.empty((0, 3)), {}

    def at(t):
        return (np.arange(len(frames[t])), frames[t], extras[t] if extras else {}) if 0 <= t < len(frames) else nothing

    state, out = stepper.blank(), [NO_EDGES]
    for t in range(len(frames)):
        state, edges = stepper.step(state, t, at)
        out.append(edges)
    return np.concatenate(out)


def chains(edges: np.ndarray) -> list[list[tuple[int, int]]]:
    """Tracks, lists of (frame, row), of edges (frame, row, step, row) each end of which is used once."""
    after = {(f, i): (f + s, k) for f, i, s, k in edges.tolist()}
    out = []
    for at in sorted(after.keys() - set(after.values())):
        track = [at]
        while (at := after.get(at)) is not None:
            track.append(at)
        out.append(track)
    return out


def nearest_assignment(frames, *a, **more) -> list[list[tuple[int, int]]]:
    """Tracks of two points or more of Nearest over all frames."""
    return chains(run(Nearest(*a, **more), frames))


def hybrid(frames, stride: int = 5, v_max: float = 10.0, a_max: float = 50.0, max_angle: float | None = None, gate: float = 0.8) -> list[list[tuple[int, int]]]:
    """Tracks over every stride-th frame, then the frames between: the unused point nearest to a cubic between two coarse points, if within gate. A frame without one splits the track."""
    n = len(frames)
    if n < 2:
        return []
    stride = max(1, min(stride, n - 1))
    coarse = sorted({*range(0, n, stride), n - 1})
    seed = (stride - 1) * v_max + 0.5 * a_max * stride**2
    found = nearest_assignment([frames[t] for t in coarse], v_max * stride, max(seed, a_max), 0, float(stride), max_angle)
    tracks, wants = [], [[] for _ in frames]  # wants: (place of the node, track, point wanted, the coarse point before) of each frame between, in order of the coarse points
    for number, track in enumerate(found):
        at = [(coarse[t], r) for t, r in track]
        x, t = np.array([frames[f][r] for f, r in at]), np.array([f for f, _ in at], float)
        v = np.diff(x, axis=0) / np.diff(t)[:, None]
        v = np.vstack([v, v[-1:]])
        nodes: list[tuple[int, int] | None] = []
        for (fa, ra), (fb, _), pa, pb, va, vb in zip(at, at[1:], x, x[1:], v, v[1:], strict=False):
            nodes.append((fa, ra))
            long = fb - fa
            for f in range(fa + 1, fb):
                s = (f - fa) / long
                a, b = va if va.any() else (pb - pa) / long, vb if vb.any() else (pb - pa) / long
                wants[f].append((len(nodes), number, (2 * s**3 - 3 * s**2 + 1) * pa + (s**3 - 2 * s**2 + s) * a * long + (3 * s**2 - 2 * s**3) * pb + (s**3 - s**2) * b * long, (fa, ra)))
                nodes.append(None)
        tracks.append([*nodes, at[-1]])
    for f, asked in enumerate(wants):
        if not asked or not len(frames[f]):
            continue
        asked.sort(key=lambda w: w[3])
        i, k, d2 = cells.within(np.array([w[2] for w in asked]), frames[f], gate)
        used, done = np.zeros(len(frames[f]), bool), np.zeros(len(asked), bool)
        for e in np.lexsort((k, d2, i)):
            if not done[i[e]] and not used[k[e]]:
                done[i[e]] = used[k[e]] = True
                place, number = asked[i[e]][:2]
                tracks[number][place] = (f, int(k[e]))
    out = []
    for nodes in tracks:
        run: list[tuple[int, int]] = []
        for node in [*nodes, None]:
            if node is not None:
                run.append(node)
                continue
            if len(run) > 1:
                out.append(run)
            run = []
    return out


@dataclass
class TwoPhase:
    """Parameters of the two-phase tracker. Points of a ghost probability above q_seed begin no track; tracks of fewer than q_young points take none of those either."""

    v_max: float = 5.0
    max_gap: int = 2
    dt: float = 1.0
    leaf_weight: float = 1.0
    use_velocity: bool = True
    q_weight: float = 0.0
    q_seed: float | None = None
    q_young: int = 0
    blob_gate: float | None = None
    most: int = 128
    bidirectional: bool = False


def two_phase_match(pred, points, pred_xy, xy, radius: float, cfg: TwoPhase, seen=None, ghost=None, young=None, logb0=None, logb1=None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, k) of predictions matched to points within radius. Cost: mean pixel distance over the cameras that see the point, times cameras / those,
    or the distance in space without cameras; raised by ghost probability; per component the least total, cheapest first in large ones."""
    if (pred_xy is None or not xy.shape[1] or cfg.leaf_weight <= 0) and ghost is None and not (cfg.blob_gate and logb0 is not None and logb1 is not None):
        return assignment.near_best(pred, points, radius, cfg.most)
    i, k, d2 = cells.within(pred, points, radius)
    if young is not None and ghost is not None:
        ok = ~young[i] | (ghost[k] <= (1.0 if cfg.q_seed is None else cfg.q_seed))
        i, k, d2 = i[ok], k[ok], d2[ok]
    cost = np.sqrt(d2)
    if pred_xy is not None and xy.shape[1] and cfg.leaf_weight > 0:
        cams = xy.shape[1]
        ok = ~np.isnan(xy[k, :, 0]) if seen is None else seen[k]
        n = ok.sum(1)
        apart = np.where(ok, _norm(np.nan_to_num(xy[k]) - pred_xy[i]), 0.0).sum(1)
        cost = np.where(n > 0, apart / np.maximum(n, 1) * (cams / np.maximum(n, 1)), 1e6) * cfg.leaf_weight
    if cfg.blob_gate and logb0 is not None and logb1 is not None and len(i):
        both = ~np.isnan(logb1[k]) & ~np.isnan(logb0[i])
        delta = np.where(both, np.abs(np.nan_to_num(logb1[k]) - np.nan_to_num(logb0[i])), 0.0).sum(1) / np.maximum(both.sum(1), 1)
        ok = ~(both.any(1) & (delta > cfg.blob_gate))
        i, k, cost = i[ok], k[ok], cost[ok]
    if ghost is not None and cfg.q_weight > 0:
        cost = cost * (1 + cfg.q_weight * ghost[k])
    won = assignment.best(i, k, cost, cfg.most)
    return i[won], k[won]


class TwoPhaseStep:
    """Tracks of constant velocity that may miss max_gap - 1 frames, matched frame by frame; a frame's extras may hold xy, ghost and logb."""

    behind = ahead = 0

    def __init__(self, cfg: TwoPhase, project=None):
        self.cfg, self.project = cfg, project

    def blank(self) -> dict[str, np.ndarray]:
        return _open(np.empty(0, int), np.empty((0, 3)), 0)

    def step(self, state, t: int, frames):
        cfg = self.cfg
        ids, points, extra = frames(t)
        ghost, logb, xy = extra.get("ghost"), extra.get("logb"), extra.get("xy")
        keep = t - state["t"] <= cfg.max_gap
        state = {c: v[keep] for c, v in state.items()}
        i = k = np.empty(0, int)
        if len(state["t"]) and len(points):
            gap = (t - state["t"]).astype(float)
            pred = state["x"] + state["v"] * gap[:, None] * cfg.dt if cfg.use_velocity else state["x"]
            young = state["n"] < cfg.q_young if ghost is not None and cfg.q_young else None
            logb0 = state.get("logb") if logb is not None and cfg.blob_gate else None
            xy = np.empty((len(points), 0, 2)) if xy is None else xy
            i, k = two_phase_match(pred, points, self.project(pred) if self.project else None, xy, cfg.v_max, cfg, ghost=ghost, young=young, logb0=logb0, logb1=logb)
        edges = np.stack([state["t"][i], state["id"][i], t - state["t"][i], ids[k]], 1)
        moved = {"t": np.full(len(i), t), "id": ids[k], "x": points[k], "v": (points[k] - state["x"][i]) / ((t - state["t"][i]) * cfg.dt)[:, None], "n": np.minimum(state["n"][i] + 1, max(cfg.q_young, 2))}
        fresh = np.setdiff1d(np.arange(len(points)), k)
        if ghost is not None and cfg.q_seed is not None:
            fresh = fresh[ghost[fresh] <= cfg.q_seed]
        began = _open(ids[fresh], points[fresh], t)
        if logb is not None:
            moved, began = moved | {"logb": logb[k]}, began | {"logb": logb[fresh]}
            state.setdefault("logb", np.empty((0, logb.shape[1])))
        waits = np.ones(len(state["t"]), bool)
        waits[i] = False
        return _joined({c: v[waits] for c, v in state.items()}, moved, began), edges


def two_phase(frames, cfg: TwoPhase, xy=None, project=None, ghost=None, logb=None) -> list[tuple[int, int, int, int]]:
    """Edges (frame, row, frame, row) of TwoPhaseStep over all frames, with bidirectional both ways."""
    if cfg.bidirectional:
        turn = lambda v: None if v is None else v[::-1]
        one = TwoPhase(**{**cfg.__dict__, "bidirectional": False})
        last = len(frames) - 1
        backward = [(last - b, s, last - a, r) for a, r, b, s in two_phase(frames[::-1], one, turn(xy), project, turn(ghost), turn(logb))]
        return merge_directions(two_phase(frames, one, xy, project, ghost, logb), backward, frames)
    named = {"xy": xy, "ghost": ghost, "logb": logb}
    extras = [{c: v[t] for c, v in named.items() if v is not None} for t in range(len(frames))]
    return [(f, i, f + s, k) for f, i, s, k in run(TwoPhaseStep(cfg, project), frames, extras).tolist()]


class March:
    """A tracker of pairs of frames (cascade_step, four_be_step) as steps: the state is what links into the frame."""

    behind, ahead = 1, 2

    def __init__(self, link):
        self.link = link  # (x0, x1, prev1, x2, x3) -> next rows

    def blank(self) -> dict[str, np.ndarray]:
        return {"id": np.empty(0, int), "prev": np.empty(0, int)}

    def step(self, state, t: int, frames):
        (ids0, x0, _), (ids1, x1, _), (ids2, x2, _), (_, x3, _) = (frames(t + d) for d in (-1, 0, 1, 2))
        prev = np.full(len(ids1), NONE)
        prev[np.searchsorted(ids1, state["id"])] = np.searchsorted(ids0, state["prev"])
        nxt = self.link(x0, x1, prev, x2, x3) if len(ids2) else np.full(len(ids1), NONE)
        i = np.flatnonzero(nxt >= 0)
        k = nxt[i]
        edges = np.stack([np.full(len(i), t), ids1[i], np.ones(len(i), int), ids2[k]], 1) if len(i) else NO_EDGES
        order = np.argsort(k)
        return {"id": ids2[k[order]].astype(int), "prev": ids1[i[order]].astype(int)}, edges


def cascade_link(half=(2.0, 2.0, 2.0), gate: float | None = None, **more):
    """The step of the cascade; unless given, the gate of level 3 is 1 in frames of 50 points or more and off in others."""
    return lambda x0, x1, prev, x2, x3: cascade_step(x0, x1, prev, x2, half, (1.0 if len(x1) >= 50 else 0.0) if gate is None else gate, **more)


def four_be_link(half=(2.0, 2.0, 2.0), strict: bool = False, greedy: bool = False):
    return lambda x0, x1, prev, x2, x3: four_be_step(x0, x1, prev, x2, x3, half, strict, greedy)


class Back:
    """The pass backwards as steps over turned time (frame -t stands for t): the state is the links out of the frame, extras hold the forward next as ids (-1: none)."""

    behind = ahead = 1

    def __init__(self, half, accel: float, angle: float = 0.0):
        self.half, self.accel, self.angle = half, accel, angle

    def blank(self) -> dict[str, np.ndarray]:
        return {"id": np.empty(0, int), "next": np.empty(0, int)}

    def step(self, state, t: int, frames):
        (ids2, x2, _), (ids1, x1, _), (ids0, x0, extra) = (frames(t + d) for d in (-1, 0, 1))
        forward = np.asarray(extra.get("next", np.empty(0, int)), int)
        into = np.full(len(ids0), NONE)
        linked = np.flatnonzero(forward >= 0)
        into[linked] = np.searchsorted(ids1, forward[linked])
        out = np.full(len(ids1), NONE)
        out[np.searchsorted(ids1, state["id"])] = np.searchsorted(ids2, state["next"])
        nxt = back_step(x0, x1, x2, into, out, self.half, self.accel, self.angle)
        i = np.flatnonzero(nxt >= 0)
        edges = np.stack([np.full(len(i), -t - 1), ids0[i], np.ones(len(i), int), ids1[nxt[i]]], 1) if len(i) else NO_EDGES
        return {"id": ids0[i].astype(int), "next": ids1[nxt[i]].astype(int)}, edges


def merge_directions(forward, backward, frames) -> list[tuple[int, int, int, int]]:
    """All forward edges, then the backward ones whose ends are both free, shortest first."""
    out, starts, ends = set(forward), {e[:2] for e in forward}, {e[2:] for e in forward}
    new = [e for e in set(backward) if e not in out]
    for e in sorted(new, key=lambda e: (float(_norm(frames[e[2]][e[3]] - frames[e[0]][e[1]])), e)):
        if e[:2] not in starts and e[2:] not in ends:
            out.add(e)
            starts.add(e[:2])
            ends.add(e[2:])
    return sorted(out)


def mht(frames, prev: list[np.ndarray], nxt: list[np.ndarray], window: int = 3, tol: float = 2.0) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
    """Links made anew in overlapping windows: least total of distance to the prediction + 0.3 of the step, within twice tol and, for linked
    points, turning to no less than cosine 0.3. Returns prev, next, links made and links broken."""
    prev, nxt = [x.copy() for x in prev], [x.copy() for x in nxt]
    made = broken = 0
    for start in range(0, len(frames), max(1, window - 1)):
        stop = min(len(frames) - 1, start + window - 1)
        for t in range(start, stop):
            a, b = frames[t], frames[t + 1]
            if not len(a) or not len(b):
                continue
            v = np.zeros((len(a), 3))
            known = np.zeros(len(a), bool)
            if t > start:
                known = (prev[t] >= 0) & (prev[t] < len(frames[t - 1]))
                v[known] = a[known] - frames[t - 1][prev[t][known]]
            # rows of one place and velocity have the same choices, so places are matched by how many rows each holds
            ra, sa, _ = cells.places(np.column_stack([a, v, known]))
            rb, sb, _ = cells.places(b)
            if len(sa) > len(a) and len(sb) > len(b):
                ra, rb = np.arange(len(a)), np.arange(len(b))
            pa, pb = ra[sa[:-1]], rb[sb[:-1]]
            p, q, d2 = cells.within((a + v)[pa], b[pb], 2 * tol)
            step = b[pb[q]] - a[pa[p]]
            n = _norm(step)
            with np.errstate(all="ignore"):
                cosine = (v[pa[p]] * step).sum(1) / (_norm(v[pa[p]]) * n + 1e-12)
            ok = ~(known[pa[p]] & (n > 1e-9) & (cosine < 0.3))
            p, q, cost = p[ok], q[ok], (np.sqrt(d2) + 0.3 * n)[ok]
            if len(pa) == len(a) and len(pb) == len(b):
                won = assignment.best(p, q, cost)
                i, k = ra[p[won]], rb[q[won]]
            else:
                i, k = assignment.told_off(p, q, assignment.transport(p, q, cost, np.diff(sa), np.diff(sb)), (ra, sa), (rb, sb))
            new_next, new_prev = np.full(len(a), NONE), prev[t + 1].copy()
            new_next[i] = k
            lost = (nxt[t] >= 0) & (new_next < 0)
            made += int(((new_next >= 0) & (new_next != nxt[t])).sum())
            broken += int(lost.sum())
            stale = np.flatnonzero(new_prev >= 0)
            stale = stale[new_next[np.minimum(new_prev[stale], len(a) - 1)] != stale]
            new_prev[stale] = NONE
            new_prev[k] = i
            nxt[t], prev[t + 1] = new_next, new_prev
    return prev, nxt, made, broken


def shared_points(frames, prev, nxt, tol: float, most: int = 2) -> list[tuple[int, int, int, int]]:
    """(frame, row, claimant's frame, claimant's row): points to which two tracks or more would go on within tol though one at most did, up to most + 1 nearest."""
    out = []
    for t in range(1, len(frames) - 1):
        rows = np.flatnonzero((prev[t] >= 0) & (prev[t] < len(frames[t - 1])))
        i, k, d2 = cells.within(2 * frames[t][rows] - frames[t - 1][prev[t][rows]], frames[t + 1], tol)
        near = d2 < tol * tol
        i, k, d2 = rows[i[near]], k[near], d2[near]
        claims = np.bincount(k, minlength=len(frames[t + 1]))
        linked = np.bincount(nxt[t][nxt[t] >= 0], minlength=len(frames[t + 1]))[: len(frames[t + 1])]
        ok = (claims[k] >= 2) & (linked[k] <= 1)
        kept = cells.nearest(k[ok], i[ok], d2[ok], most + 1)
        out += [(t + 1, int(r), t, int(s)) for r, s in zip(k[ok][kept], i[ok][kept])]
    return out
