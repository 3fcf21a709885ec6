"""Sums of normal equations over tasks against the engine on all rows at once, and the joint fit of cameras and points."""

from dataclasses import replace

import numpy as np
import pytest

from skein.engines import calibration
from skein.operators import bundle, calibrate, stereo

RIG = stereo.standard_rig(3, (0.0, 0.0, 0.0), 300.0, 80.0, 60.0, imx=1280, imy=1024, pix_x=0.012, pix_y=0.012)
NAMES = calibration.EXTERIOR


def _rough():
    return [replace(c, x0=c.x0 + 3, y0=c.y0 - 2, z0=c.z0 + 4, omega=c.omega + 0.01, phi=c.phi - 0.008, kappa=c.kappa + 0.01) for c in RIG]


def _known(spark, noise=0.3, n=60):
    rng = np.random.default_rng(5)
    x = (rng.random((n, 3)) - 0.5) * 30
    px = np.stack([calibration.pixels(c, x) + rng.normal(0, noise, (n, 2)) for c in RIG], 1)
    rows = [(k, *map(float, p), *map(float, px[i, k])) for k in range(3) for i, p in enumerate(x) if (i + k) % 7]
    return x, px, spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 5.0, 5.0)], "cam long, x double, y double, z double, u double, v double").repartition(4)


def test_sums_over_tasks_equal_one_fit(spark):
    x, px, df = _known(spark)
    found = bundle.orient(df, dict(enumerate(_rough())))
    bare, linear = bundle.resect(df, dict(enumerate(_rough()))), bundle.direct_linear(df, dict(enumerate(RIG)))
    for k in range(3):
        at = np.array([i for i in range(len(x)) if (i + k) % 7])
        for got, want in ((found[k], calibration.orient(_rough()[k], x[at], px[at, k])[0]), (bare[k], calibration.resect(_rough()[k], x[at], px[at, k])[0]), (linear[k], calibration.direct_linear(x[at], px[at, k], RIG[k]))):
            assert [getattr(got, n) for n in (*NAMES, "cc")] == pytest.approx([getattr(want, n) for n in (*NAMES, "cc")], abs=2e-3, rel=1e-5)
    rows = calibrate.calibrate(df, _rough()).collect()
    assert [r.points for r in rows] == [sum((i + k) % 7 > 0 for i in range(60)) for k in range(3)] and all(0.1 < r.rms < 0.6 for r in rows)


def test_shared_focal_length_and_views(spark):
    _, _, df = _known(spark, 0.02)
    best, rig, tried = bundle.shared_focal(df, dict(enumerate(RIG)), [58.0, 60.0, 63.0])
    assert best == 60.0 and len(tried) == 3 and rig[0].cc == 60.0
    views = spark.createDataFrame([(v, c, p, 1.0, 2.0) for v in range(3) for c in range(2) for p in range(5 if (v, c) != (1, 1) else 2)] + [(2, 0, None, 1.0, 1.0)], "view long, cam long, point long, u double, v double")
    assert sorted({(r.view, r.cam) for r in bundle.usable_views(views, 4).collect()}) == [(0, 0), (0, 1), (2, 0), (2, 1)]


def _dense(rig, x, home, px, weight):
    """The same problem as one dense system: residuals of all pixels and of all points' places."""

    def residuals(values):
        cams = [replace(c, **dict(zip(NAMES, map(float, values[6 * k : 6 * k + 6])))) for k, c in enumerate(rig)]
        at = values[6 * len(rig) :].reshape(-1, 3)
        out = []
        for k, c in enumerate(cams):
            ok = np.isfinite(px[:, k]).all(1)
            out.append((bundle._metric(c, px[ok, k, 0], px[ok, k, 1]) - calibration.images(c, at[ok])).ravel())
        return np.concatenate([*out, np.sqrt(weight) * (home - at).ravel()])

    values = np.concatenate([[getattr(c, n) for c in rig for n in NAMES], x.ravel()])
    damp = 1e-6
    for _ in range(30):
        r = residuals(values)
        j = np.stack([(residuals(values + h * e) - r) / h for e in np.eye(len(values)) for h in [1e-6]], 1)
        a = j.T @ j
        new = values - np.linalg.solve(a + damp * np.diag(np.diag(a)), j.T @ r)
        better = residuals(new)
        if better @ better < r @ r:
            values, damp = new, damp / 4
        else:
            damp *= 16
    r = residuals(values)
    return float(r @ r)


def test_joint_fit_recovers_cameras_and_equals_the_dense_system(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((24, 3)) - 0.5) * 30
    home = x + rng.normal(0, 0.2, x.shape)
    px = np.stack([calibration.pixels(c, x) + rng.normal(0, 0.05, (24, 2)) for c in RIG], 1)
    px[3, 0] = px[4, 1] = np.nan
    px[5, 1:] = np.nan  # one camera alone: doesn't count
    seen = spark.createDataFrame([(i, k, float(px[i, k, 0]), float(px[i, k, 1])) for i in range(24) for k in range(3) if np.isfinite(px[i, k, 0])], "point long, cam long, u double, v double").repartition(3)
    nominal = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(home)], "point long, x double, y double, z double")
    rig, points, facts = bundle.joint(seen, nominal, _rough(), 1e-4, rounds=40)
    kept = [i for i in range(24) if i != 5]
    assert facts["points"] == 23 and facts["after"] < 1e-3 * facts["before"]
    assert facts["after"] == pytest.approx(_dense(_rough(), home[kept], home[kept], px[kept], 1e-4), rel=1e-3)
    assert all(abs(a.x0 - b.x0) < 3 and abs(a.omega - b.omega) < 0.01 for a, b in zip(rig, RIG))
    assert points.count() == 23
    same, _, skipped = bundle.joint(seen.where("point < 3"), nominal, _rough(), 1.0)
    assert "skipped" in skipped and same == _rough()
    with pytest.raises(ValueError, match="held"):
        bundle.joint(seen, nominal, RIG, 0.0)
