"""What one task holds must not grow with the table: the divided way against the whole one."""

import numpy as np
from pyspark.sql import functions as F

from skein.engines import curves
from skein.operators import pieces, tracking
from skein.sources import binding

SF = "/root/testdata/sf0.001"


def test_points_of_customers_are_made_by_several_tasks(spark, monkeypatch):
    """One small file of customers became one task that shuffled all their points."""
    whole = sorted(map(tuple, binding.truth(spark, SF).collect()))
    monkeypatch.setattr(binding, "TASK_KEYS", 40)
    found = binding.truth(spark, SF)
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < len(whole) / 2
    assert sorted(map(tuple, found.collect())) == whole


def _cloud(spark, rng, n, spread):
    rows = [(f, i, *(float(v) for v in rng.integers(0, spread, 3) / 8.0)) for f in range(2) for i in range(n)]
    return spark.createDataFrame(rows, "frame long, id long, x double, y double, z double")


def test_matches_of_bundles_are_those_of_whole_frames(spark, monkeypatch):
    rng = np.random.default_rng(3)
    left, right = _cloud(spark, rng, 150, 80), _cloud(spark, rng, 150, 80)
    for radius in (0.1, 0.125, 0.3):
        monkeypatch.setattr(tracking, "BUNDLE", 100_000)
        whole = sorted(map(tuple, tracking.match(left, right, radius).collect()))
        monkeypatch.setattr(tracking, "BUNDLE", 20)
        assert sorted(map(tuple, tracking.match(left, right, radius).collect())) == whole
    assert tracking.bundled(left, 0.1).select("frame", "bundle").distinct().count() > 8


def test_tracks_of_equal_length_are_fitted_together(spark):
    """The same numbers as a loop over tracks, whatever their lengths and gaps, and as Spark's batches cut them."""
    rng = np.random.default_rng(11)
    tracks = {}
    for n in range(60):
        t = np.cumsum(rng.integers(1, 3, rng.integers(1, 13))).astype(float)
        tracks[n] = t, rng.normal(size=3) * t[:, None] + rng.normal(0, 0.1, (len(t), 3))
    rows = [(n, int(f), *map(float, p)) for n, (t, x) in tracks.items() for f, p in zip(t, x)]
    table = spark.createDataFrame(rows, "trajid long, frame long, x double, y double, z double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        ahead = {r["trajid"]: r for r in pieces.predict_next(table).collect()}
        ends = {r["trajid"]: r for r in pieces.ends(table).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(ahead) == 60 and set(ends) == {n for n, (t, _) in tracks.items() if len(t) >= 4}
    for n, (t, x) in tracks.items():
        at, v, r = curves.predict(t[-6:], x[-6:], t[-1] + 1, 6, 2)
        assert np.allclose([ahead[n][c] for c in (*"xyzuvw", "residual")], [*at, *v, r], rtol=1e-9, atol=1e-9) and ahead[n]["frame"] == t[-1] + 1
        if n in ends:
            for tail, c, s in ((False, "c0", "s0"), (True, "c1", "s1")):
                want, _, residual = curves.end_fit(t, x, tail)
                assert np.allclose(ends[n][c], want.ravel()) and np.isclose(ends[n][s], residual)
    same = [x for t, x in tracks.values() if len(t) >= 6]
    many = curves.robust_weights_all(np.stack([x[:6] for x in same]))
    assert np.allclose(many, [curves.robust_weights(x[:6]) for x in same])


def test_ends_meet_starts_over_boundaries_of_cells(spark):
    """Joins of noisy straight tracks are those of a loop over all pairs, wherever cells end."""
    rng = np.random.default_rng(2)
    rows = []
    for n in range(40):
        at, v = rng.uniform(-3, 3, 3), rng.normal(0, 0.2, 3)
        for piece, span in ((0, range(0, 6)), (1, range(7 + n % 3, 14))):
            rows += [(2 * n + piece, f, *map(float, at + f * v + rng.normal(0, 0.02, 3))) for f in span]
    table = spark.createDataFrame(rows, "trajid long, frame long, x double, y double, z double")
    e = pieces.ends(table).collect()
    noise, edges = max(float(np.median([r[k] for r in e for k in ("s0", "s1")])), 1e-6), []
    for a in e:
        for b in e:
            gap = b["f0"] - a["f1"]
            if a["trajid"] != b["trajid"] and 1 <= gap <= 4:
                tol = 4.0 * noise * (1 + 0.5 * (gap - 1))
                ca, cb = np.reshape(a["c1"], (2, 3)), np.reshape(b["c0"], (2, 3))
                e1, e2 = np.linalg.norm(ca[0] + gap * ca[1] - b["p0"]), np.linalg.norm(cb[0] - gap * cb[1] - a["p1"])
                if e1 < tol and e2 < tol:
                    edges.append(((e1 + e2) / tol, a["trajid"], b["trajid"]))
    want, used = [], set()
    for _, a, b in sorted(edges):
        if (0, a) not in used and (1, b) not in used:
            used |= {(0, a), (1, b)}
            want.append((a, b))
    assert len(want) > 20 and sorted(map(tuple, pieces.reconnect(table).collect())) == sorted(want)


def test_spark_sees_how_many_points_customers_make(spark):
    """Its estimate stayed that of the customers' file, so it sent all points through the driver where they were joined."""
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    keys = size(spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey"))
    points = binding.truth(spark, SF)
    assert size(points) >= binding.FRAMES * keys
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 2 * keys)  # as small to the points as 10 MB is to a large run's
    try:
        joined = binding.linkage(spark, SF).join(points.withColumnRenamed("pid", "id").select("frame", "id"), ["frame", "id"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
