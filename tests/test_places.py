"""Copies at one place: the same rows as brute force over all points, from pairs of places alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.engines import assignment, cells
from skein.engines import tracking as engine
from skein.operators import linking, pieces, spatial, tracking
from skein.plans import quality_queries, tracking_queries

AXES = "xyz"


@pytest.fixture
def cloud():
    """300 points of two frames at 12 places a frame."""
    rng = random.Random(7)
    at = {f: [tuple(rng.randrange(12) / 4.0 for _ in AXES) for _ in range(12)] for f in (0, 1)}
    return [(f, n * 3 % 151, *at[f][n * 7 % 12]) for f in (0, 1) for n in range(150)]


def table(spark, cloud):
    return spark.createDataFrame(cloud, "frame long, pid long, x double, y double, z double")


def d2(p, q):
    return (q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2 + (q[4] - p[4]) ** 2


@pytest.fixture
def paired(monkeypatch):
    """Rows that box_join was given, side by side."""
    seen, plain = [], spatial.box_join

    def counted(left, right, width):
        seen.append((left.count(), right.count()))
        return plain(left, right, width)

    monkeypatch.setattr(spatial, "box_join", counted)
    return seen


@pytest.mark.parametrize("n", [1, 4, 40])
def test_nearest_pairs_places(spark, cloud, paired, n):
    t, want = table(spark, cloud), []
    for p in cloud:
        near = sorted((d2(p, q), q[1]) for q in cloud if q[0] == p[0] and d2(p, q) <= 1.0)
        want += [(p[0], p[1], k, d, r + 1) for r, (d, k) in enumerate(near[:n])]
    got = spatial.nearest(spatial.side(t, "i"), spatial.side(t, "k"), 1.0, n)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert all(a <= 24 and b <= 24 for a, b in paired)


@pytest.mark.parametrize("n", [3, 32])
def test_box_candidates_pair_places(spark, cloud, paired, n):
    t, half, want = table(spark, cloud), (1.5, 1.0, 2.0), []
    for p in cloud:
        near = sorted((d2(p, q), q[1]) for q in cloud if q[0] == p[0] + 1 and all(abs(q[2 + a] - p[2 + a]) < h for a, h in enumerate(half)))
        want += [(p[0], p[1], k, d, r + 1) for r, (d, k) in enumerate(near[:n])]
    got = spatial.box_candidates(spatial.side(t, "i"), spatial.side(t, "k", shift=-1), half, n)
    assert sorted(map(tuple, got.select("frame", "i", "k", "d2", "rank").collect())) == sorted(want)
    assert all(a <= 24 and b <= 24 for a, b in paired)


def test_first_links_pair_places(spark, cloud, paired):
    every = [(p[0], p[1], q[1], d2(p, q)) for p in cloud for q in cloud if q[0] == p[0] + 1 and d2(p, q) <= 4.0]
    ahead, back = linking.firsts(table(spark, cloud), 2.0)
    assert sorted(map(tuple, ahead.collect())) == sorted(min((e for e in every if e[1] == i), key=lambda e: (e[3], e[2])) for i in {e[1] for e in every})
    assert sorted(map(tuple, back.collect())) == sorted(min((e for e in every if e[2] == k), key=lambda e: (e[3], e[1])) for k in {e[2] for e in every})
    assert all(a <= 24 and b <= 24 for a, b in paired)


def test_merged_directions_pair_places(spark, tmp_path, paired):
    """40 customers at each of few places: the query pairs places."""
    spark.createDataFrame([(1280 * 33 * (n % 40) + n // 40,) for n in range(400)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = tracking_queries.merge_bidirectional(spark, str(tmp_path)).collect()
    assert len({(r["frame"], r["i"]) for r in got}) == len({(r["frame"], r["k"]) for r in got}) == len(got) > 0
    assert paired and all(a <= 80 and b <= 80 for a, b in paired)


def test_frames_of_many_copies_are_linked_by_places(spark, cloud, monkeypatch):
    """A frame of more points than FRAME_POINTS but fewer places is one task, and links as one pass over all its edges does."""
    monkeypatch.setattr(tracking, "FRAME_POINTS", 30)
    monkeypatch.setattr(linking, "nearest_first", None)
    used, want = set(), []
    for d, i, k in sorted((d2(p, q), p[1], q[1]) for p in cloud for q in cloud if p[0] == 0 and q[0] == 1 and d2(p, q) <= 4.0):
        if (0, i) not in used and (1, k) not in used:
            used |= {(0, i), (1, k)}
            want.append((0, i, k, d))
    got = tracking.link_nearest(table(spark, cloud).withColumnRenamed("pid", "id"), 2.0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_components_are_resolved_by_places(spark, tmp_path, paired):
    """The same number of links and the same total as from all edges, which are not made."""
    spark.createDataFrame([(1280 * 33 * (n % 5) + n // 5 % 7 * 1280 + n % 3,) for n in range(60)], "c_custkey long").distinct().write.parquet(f"{tmp_path}/customer.parquet")
    got = quality_queries.resolve_components(spark, str(tmp_path)).collect()
    assert not paired
    t = quality_queries._t(spark, str(tmp_path))
    near = spatial.radius_join(spatial.side(t, "i", "id"), spatial.side(t, "k", "id", -1), 0.8)
    want = tracking.resolve(near.select("frame", "i", "k", F.sqrt("d2").alias("cost"))).collect()
    for f in range(7):
        a, b = ([r["cost"] for r in rows if r["frame"] == f] for rows in (got, want))
        assert len(a) == len(b) > 0 and sum(a) == pytest.approx(sum(b), abs=1e-4)


def test_fragments_meet_by_cells(spark):
    """Ends of slow and fast tracks meet the starts within their reach, by an equi-join of cells."""
    rng, rows = random.Random(11), []
    for n in range(60):
        v = (0.0, 0.125, 0.5, 4.0)[n % 4]
        at, turn = [rng.randrange(-40, 40) / 8.0 + 64 * (n % 8) * (a == 0) + 64 * (n // 8 + 1) * (a == 1) for a in range(3)], rng.choice((-1, 1))
        rows += [(2 * n + (f > 3), f, at[0] + turn * v * f, at[1] + v * f / 2, at[2]) for f in range(8) if f != 3]
    rows += [(500, 0, 1.0, 1.0, 1.0), (501, 1, 1.5, 1.0, 1.0), (502, 1, float("nan"), 1.0, 1.0)]
    t = spark.createDataFrame(rows, "trajid long, frame long, x double, y double, z double")
    seen, kept = [], pieces.kept
    pieces.kept = lambda df: seen.append(df) or kept(df)
    try:
        got = {tuple(r) for r in pieces.stitch(t, 2, 1.0).collect()}
    finally:
        pieces.kept = kept
    assert got == {(2 * n, 2 * n + 1, 2) for n in range(60)} | {(500, 501, 1)}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert any("_l#" in p and "SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p or "Cartesian" in p for p in plans)


def test_hypotheses_match_copies_by_places(monkeypatch):
    """As many links of the same total as from all pairs of rows, which are not held."""
    rng = np.random.default_rng(2)
    at = [rng.integers(0, 4, (8, 3)) / 4.0 for _ in range(2)]
    frames = [x[np.arange(120) % 8] for x in at]
    i, k, d2 = cells.within(*frames, 0.8)
    won = assignment.best(i, k, np.sqrt(d2))
    pairs, plain = [], cells.within

    def within(a, b, radius):
        pairs.append(len(a) * len(b))
        return plain(a, b, radius)

    monkeypatch.setattr(cells, "within", within)
    none = [np.full(120, -1) for _ in range(2)]
    _, nxt, _, _ = engine.mht(frames, none, none, 2, 0.4)
    i = np.flatnonzero(nxt[0] >= 0)
    assert len(i) == len(won) and len(set(nxt[0][i])) == len(i)
    assert np.linalg.norm(frames[1][nxt[0][i]] - frames[0][i], axis=1).sum() == pytest.approx(np.sqrt(d2[won]).sum())
    assert max(pairs) <= 64
