"""One-to-one matching of one frame's edges: cheapest first, or of least total cost."""

from __future__ import annotations

import heapq

import numpy as np

#: Cells of a table of costs above which only the edges are held.
DENSE = 4096


def greedy(i: np.ndarray, k: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Edges that a pass over all by (cost, i, k) takes if both ends are still free; by rounds of edges that come first at both their ends."""
    order = np.lexsort((k, i, cost))
    i, k = np.unique(i, return_inverse=True)[1][order], np.unique(k, return_inverse=True)[1][order]
    left, chosen = np.arange(len(order)), []
    while len(left):
        first_i, first_k = np.full(i.max() + 1, -1), np.full(k.max() + 1, -1)
        first_i[i[left[::-1]]] = left[::-1]
        first_k[k[left[::-1]]] = left[::-1]
        best = left[(first_i[i[left]] == left) & (first_k[k[left]] == left)]
        chosen.append(best)
        used_i, used_k = np.zeros(len(first_i), bool), np.zeros(len(first_k), bool)
        used_i[i[best]] = used_k[k[best]] = True
        left = left[~(used_i[i[left]] | used_k[k[left]])]
    return np.sort(order[np.concatenate(chosen)]) if chosen else np.empty(0, np.intp)


def nearest_first(a: np.ndarray, b: np.ndarray, radii: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, k, d2): greedy's choice of all pairs within the last of growing radii, ring by ring among the points still free, so few pairs are held at once."""
    from skein.engines import cells

    fa, fb, out = np.arange(len(a)), np.arange(len(b)), []
    for r in radii:
        i, k, d2 = cells.within(a[fa], b[fb], r)
        won = greedy(i, k, d2)
        out.append((fa[i[won]], fb[k[won]], d2[won]))
        fa, fb = np.delete(fa, i[won]), np.delete(fb, k[won])
    return tuple(np.concatenate(v) for v in zip(*out))


def places_nearest_first(a: np.ndarray, ia: list[np.ndarray], b: np.ndarray, kb: list[np.ndarray], radii: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest_first for different places a and b that hold the points ia and kb, in rising order: (i, k, d2) of points; pairs of places are held, not of copies."""
    from skein.engines import cells

    ia, kb = ([list(reversed(v)) for v in side] for side in (ia, kb))
    fa, fb, out = np.arange(len(a)), np.arange(len(b)), []
    for r in radii:
        i, k, d2 = cells.within(a[fa], b[fb], r)
        won = greedy_places(fa[i], fb[k], d2, ia, kb)
        out.append((*won[:2], d2[won[2]]))
        fa, fb = (np.array([p for p in f.tolist() if left[p]], np.intp) for f, left in ((fa, ia), (fb, kb)))
    return tuple(np.concatenate(v) for v in zip(*out))


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of least total cost, min(shape) of them, by shortest augmenting paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        c, r = hungarian(cost.T)
        order = np.argsort(r)
        return r[order], c[order]
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    of, via = np.full(m + 1, n), np.zeros(m + 1, int)  # row of each column (n: none); column m is the root of a search
    padded = np.vstack([cost, np.zeros(m)])
    for row in range(n):
        of[m], at = row, m
        least, done = np.full(m, np.inf), np.zeros(m + 1, bool)
        while of[at] < n:
            done[at] = True
            slack = padded[of[at]] - u[of[at]] - v[:m]
            better = ~done[:m] & (slack < least)
            least[better], via[:m][better] = slack[better], at
            open_ = np.where(done[:m], np.inf, least)
            to = int(open_.argmin())
            far = open_[to]
            u[of[done]] += far
            v[done] -= far
            least[~done[:m]] -= far
            at = to
        while at != m:
            of[at] = of[via[at]]
            at = via[at]
    columns = np.flatnonzero(of[:m] < n)
    order = np.argsort(of[columns])
    return of[columns][order], columns[order]


def sparse(i: np.ndarray, k: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Edges of a matching with as many edges as can be and, of those, the least total cost: shortest augmenting paths over the edges alone, whose memory is theirs.

    Every row may also stay without a partner, at a price above all costs together.
    """
    ri, a = np.unique(i, return_inverse=True)
    rk, b = np.unique(k, return_inverse=True)
    none = float(cost.clip(min=0).sum() + 1.0)
    out: list[list[tuple[int, float, int]]] = [[] for _ in ri]
    for r, c, w, e in zip(a.tolist(), b.tolist(), cost.tolist(), range(len(cost))):
        out[r].append((c, w, e))
    u, v = [min(w for _, w, _ in edges) for edges in out], [0.0] * len(rk)
    row_of, col_of, edge_of = [-1] * len(rk), [-1] * len(ri), [-1] * len(ri)
    for start in range(len(ri)):
        dist: dict[int, float] = {}
        via: dict[int, tuple[int, int]] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        seen, row, far = [], start, 0.0
        alone, quits = np.inf, start
        while True:
            seen.append((row, far))
            for c, w, e in out[row]:
                if c not in done and (d := far + w - u[row] - v[c]) < dist.get(c, np.inf):
                    dist[c], via[c] = d, (row, e)
                    heapq.heappush(heap, (d, c))
            if far + none - u[row] < alone:
                alone, quits = far + none - u[row], row
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                end, far = -1, alone
                break
            far, end = heapq.heappop(heap)
            if row_of[end] < 0:
                break
            done.add(end)
            row = row_of[end]
        for r, d in seen:
            u[r] += far - d
        for c in done:
            v[c] -= far - dist[c]
        if end < 0:
            end, col_of[quits], edge_of[quits] = col_of[quits], -1, -1
        while end >= 0:  # each column of the path goes to the row it was reached from
            r, e = via[end]
            row_of[end], before = r, col_of[r]
            col_of[r], edge_of[r] = end, e
            end = before if r != start else -1
    return np.array(sorted(e for e in edge_of if e >= 0), dtype=np.intp)


def transport(i: np.ndarray, k: np.ndarray, cost: np.ndarray, supply: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """How many times each edge is taken where row i stands for supply[i] equal ends and column k for capacity[k]: as many as can be in all and, of those, at the least total cost.

    sparse() for places that hold several points: a path carries as many units as it can, so neither memory nor work grows with the copies. Edges do not repeat.
    """
    flow = np.zeros(len(i), np.int64)
    if not len(i):
        return flow
    order = np.lexsort((k, cost, i))
    begin = np.searchsorted(i[order], np.arange(len(supply) + 1)).tolist()
    col, price, edge = k[order].tolist(), cost[order].tolist(), order.tolist()
    none = float((cost.clip(min=0) * np.minimum(supply[i], capacity[k])).sum() + 1.0)
    left, free = supply.tolist(), capacity.tolist()
    u, v = [price[b] if b < e else 0.0 for b, e in zip(begin, begin[1:])], [0.0] * len(free)
    into: list[dict[int, list[int]]] = [{} for _ in free]  # of a column: row -> [units, edge]
    for start in range(len(left)):
        while left[start] and begin[start] < begin[start + 1]:
            dist: dict[int, float] = {}
            via: dict[int, tuple[int, int]] = {}
            by: dict[int, int] = {}  # column over which a row was reached
            done: set[int] = set()
            seen, at, far = [(start, 0.0)], [start], 0.0
            heap: list[tuple[float, int]] = []
            bound, quits, end = np.inf, start, -1  # the nearest end known: a column with room, or a row that stays without a partner
            reached = {start}
            while True:
                for row in at:
                    if far + none - u[row] < bound:
                        bound, quits, end = far + none - u[row], row, -1
                    base = far - u[row]
                    for n in range(begin[row], begin[row + 1]):
                        d = base + price[n]
                        if d >= bound:  # prices rise and no v is positive
                            break
                        c = col[n]
                        d -= v[c]
                        if d < bound and c not in done and d < dist.get(c, np.inf):
                            dist[c], via[c] = d, (row, edge[n])
                            if free[c]:
                                bound, end = d, c
                            else:
                                heapq.heappush(heap, (d, c))
                while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= bound:
                    far = bound
                    break
                far, c = heapq.heappop(heap)
                done.add(c)
                at = [r for r in into[c] if r not in reached]
                for r in at:
                    reached.add(r)
                    by[r] = c
                    seen.append((r, far))
            for r, d in seen:
                u[r] += far - d
            for c in done:
                v[c] -= far - dist[c]
            # the path from its end back to the start, and the units it carries
            steps: list[tuple[int, int, int]] = []
            units, row = left[start], quits
            if end >= 0:
                units, (row, e) = min(units, free[end]), via[end]
                steps.append((end, row, e))
            lost: list[tuple[int, int]] = []
            while row != start:
                c = by[row]
                units = min(units, into[c][row][0])
                lost.append((c, row))
                row, e = via[c]
                steps.append((c, row, e))
            for c, r in lost:
                held = into[c][r]
                held[0] -= units
                if not held[0]:
                    del into[c][r]
            for c, r, e in steps:
                into[c].setdefault(r, [0, e])[0] += units
            if end >= 0:
                free[end] -= units
            left[start] -= units
    for rows in into:
        for n, e in rows.values():
            flow[e] += n
    return flow


def running(of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry, the sum of n over the entries before it with the same `of`."""
    order = np.argsort(of, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    first = np.concatenate([[True], np.diff(of[order]) != 0]) if len(of) else np.empty(0, bool)
    out = np.empty(len(of), np.int64)
    out[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(of))))
    return out


def components(i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A component number for each edge of the bipartite graph."""
    i, k = np.unique(i, return_inverse=True)[1], np.unique(k, return_inverse=True)[1]
    if not len(i):
        return np.empty(0, np.intp)
    label = np.arange(i.max() + 1 + k.max() + 1)
    k = k + i.max() + 1
    while True:
        low = np.minimum(label[i], label[k])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, k, low)
        new = new[new]
        if (new == label).all():
            return label[i]
        label = new


def best(i: np.ndarray, k: np.ndarray, cost: np.ndarray, most: int | None = None) -> np.ndarray:
    """Edges of a matching with as many edges as can be and, of those, the least total cost; per component, cheapest first in those of more than `most` ends."""
    if not len(i):
        return np.empty(0, np.intp)
    of = components(i, k)
    order = np.argsort(of, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(part) == 1:
            out.append(part)
            continue
        ri, a = np.unique(i[part], return_inverse=True)
        rk, b = np.unique(k[part], return_inverse=True)
        if most is not None and len(ri) + len(rk) > most:
            out.append(part[greedy(i[part], k[part], cost[part])])
            continue
        if len(ri) * len(rk) > DENSE:
            out.append(part[sparse(i[part], k[part], cost[part])])
            continue
        none = cost[part].clip(min=0).sum() + 1.0
        table, edge = np.full((len(ri), len(rk)), none), np.full((len(ri), len(rk)), -1)
        n = np.argsort(-cost[part], kind="stable")  # of repeated edges the cheapest stays
        table[a[n], b[n]], edge[a[n], b[n]] = cost[part[n]], part[n]
        r, c = hungarian(table)
        found = edge[r, c]
        out.append(found[found >= 0])
    return np.sort(np.concatenate(out))


def told_off(p: np.ndarray, q: np.ndarray, n: np.ndarray, rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, k): the members of places that take the edges (p, q) n times each, in their order; rows and columns are members place by place and where each place's begin."""
    on = np.flatnonzero(n)
    on = on[np.lexsort((q[on], p[on]))]
    p, q, n = p[on], q[on], n[on]
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    (ra, sa), (rb, sb) = rows, columns
    return ra[np.repeat(sa[p] + running(p, n), n) + each], rb[np.repeat(sb[q] + running(q, n), n) + each]


def greedy_places(p: np.ndarray, q: np.ndarray, cost: np.ndarray, ia: list[list[int]], kb: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, k, edge): greedy's choice for the points ia[p] and kb[q] that places hold, by edges of places; what it takes leaves the lists, which are in falling order.

    Of one cost, an edge apart from all others joins its points in their order; where places share edges, points of ia go one by one.
    """
    import itertools

    order = np.argsort(cost, kind="stable")
    ps, qs, es = p[order].tolist(), q[order].tolist(), order.tolist()
    cut = np.append(np.concatenate([[0], np.flatnonzero(np.diff(cost[order])) + 1]), len(order)).tolist() if len(order) else [0]
    out_i, out_k, out_e = [], [], []
    for lo, hi in itertools.pairwise(cut):
        group = [n for n in range(lo, hi) if ia[ps[n]] and kb[qs[n]]]
        shared = len(group) > 1 and (len({ps[n] for n in group}) < len(group) or len({qs[n] for n in group}) < len(group))
        if not shared:
            for n in group:
                a, b = ia[ps[n]], kb[qs[n]]
                m = min(len(a), len(b))
                out_i += a[: -m - 1 : -1]
                out_k += b[: -m - 1 : -1]
                out_e += [es[n]] * m
                del a[len(a) - m :], b[len(b) - m :]
            continue
        of: dict[int, list[int]] = {}
        for n in group:
            of.setdefault(ps[n], []).append(n)
        heap = [(ia[a][-1], a) for a in of]
        heapq.heapify(heap)
        while heap:
            i, a = heapq.heappop(heap)
            open_ = [n for n in of[a] if kb[qs[n]]]
            if not open_:
                continue
            n = min(open_, key=lambda n: kb[qs[n]][-1])
            of[a] = open_
            out_i.append(ia[a].pop())
            out_k.append(kb[qs[n]].pop())
            out_e.append(es[n])
            if ia[a]:
                heapq.heappush(heap, (ia[a][-1], a))
    return np.array(out_i, np.intp), np.array(out_k, np.intp), np.array(out_e, np.intp)


def near_best(a: np.ndarray, b: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, k): best(.., most) of all pairs within radius by distance, without holding them: points at one place count as one, and what has come to lie in a part of more than `most`
    ends within a smaller radius is not asked again. Large parts go cheapest first, ring by ring."""
    from skein.engines import cells

    ra, sa, _ = cells.places(a)
    rb, sb, _ = cells.places(b)
    na, nb = np.diff(sa), np.diff(sb)
    pa, pb = a[ra[sa[:-1]]], b[rb[sb[:-1]]]
    large, size = np.zeros(len(na) + len(nb), bool), np.concatenate([na, nb])
    links = [(np.empty(0, np.intp), np.empty(0, np.intp))]
    for part in (16, 8, 4, 2, 1):
        fa, fb = np.flatnonzero(~large[: len(na)]), np.flatnonzero(~large[len(na) :])
        i, k, _ = cells.within(pa[fa], pb, radius / part)
        links.append((fa[i], k))
        held = np.flatnonzero(large[: len(na)])
        i, k, _ = cells.within(pa[held], pb[fb], radius / part)
        links.append((held[i], fb[k]))
        links = [tuple(np.concatenate(v) for v in zip(*links))]
        i, k = links[0]
        if not len(i):
            continue
        of = components(i, k)
        ends, first = np.unique(np.concatenate([i, k + len(na)]), return_index=True)
        of = np.concatenate([of, of])[first]
        large[ends] = np.bincount(of, size[ends])[of] > most
    fa, fb = np.flatnonzero(~large[: len(na)]), np.flatnonzero(~large[len(na) :])
    ta, tb = (np.concatenate([r[s[n] : s[n + 1]] for n in f]) if len(f) else np.empty(0, np.intp) for r, s, f in ((ra, sa, fa), (rb, sb, fb)))
    i, k, d2 = cells.within(a[ta], b[tb], radius)
    won = best(i, k, np.sqrt(d2))
    out = [(ta[i[won]], tb[k[won]])]
    ha, hb = np.flatnonzero(large[: len(na)]), np.flatnonzero(large[len(na) :])
    alone = (na[ha] == 1).all() and (nb[hb] == 1).all()
    if not alone:
        ia, kb = ([r[lo:hi][::-1].tolist() for lo, hi in zip(s, s[1:])] for r, s in ((ra, sa), (rb, sb)))
    for n in range(8, -1, -1):
        r = radius * 2 ** (-n / 2)
        i, k, d2 = cells.within(pa[ha], pb[hb], r * (1 + 1e-9) if n else radius)
        cost = np.sqrt(d2)
        inner = cost <= (r if n else np.inf)
        i, k, cost = ha[i[inner]], hb[k[inner]], cost[inner]
        if alone:
            i, k = ra[sa[i]], rb[sb[k]]
            won = greedy(i, k, cost)
            out.append((i[won], k[won]))
            ha, hb = ha[~np.isin(ra[sa[ha]], i[won])], hb[~np.isin(rb[sb[hb]], k[won])]
            continue
        out.append(greedy_places(i, k, cost, ia, kb)[:2])
        ha, hb = np.array([p for p in ha.tolist() if ia[p]], np.intp), np.array([q for q in hb.tolist() if kb[q]], np.intp)
    i, k = (np.concatenate(v) for v in zip(*out))
    order = np.lexsort((k, i))
    return i[order], k[order]


def independent(sets: list[set], weight: np.ndarray, most: int = 20) -> list[int]:
    """Members of the heaviest choice of sets that share nothing: exact by branch and bound up to `most` sets, else heaviest first (ties by position).

    Among equal totals the choice that takes earlier sets wins.
    """
    order = sorted(range(len(sets)), key=lambda n: (-weight[n], n))
    taken, used = [], set()
    for n in order:
        if not sets[n] & used:
            taken.append(n)
            used |= sets[n]
    if len(sets) > most:
        return sorted(taken)
    order = [n for n in order if weight[n] > 0]
    rest = np.append(np.cumsum([weight[n] for n in order][::-1])[::-1], 0.0)
    found = [sum(weight[n] for n in taken if weight[n] > 0), [n for n in taken if weight[n] > 0]]

    def search(at: int, total: float, chosen: list[int], used: set) -> None:
        if total > found[0] + 1e-12:
            found[:] = [total, list(chosen)]
        if at == len(order) or total + rest[at] <= found[0] + 1e-12:
            return
        n = order[at]
        if not sets[n] & used:
            search(at + 1, total + weight[n], [*chosen, n], used | sets[n])
        search(at + 1, total, chosen, used)

    search(0, 0.0, [], set())
    return sorted(found[1]) or taken[:1]
