"""Queries against their DuckDB twins, and the linking operators against plain Python."""

import glob
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import linking, spatial
from skein.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "none" if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else repr(getattr(x, "item", lambda: x)())
    return list(frame.columns), sorted(tuple(show(x) for x in row) for row in frame.astype(object).itertuples(index=False, name=None))


#: A twin of every family; the driver holds all queries against theirs.
TWINS = """traj_accel_residual velocity_jump_rate turning_angle trim_ends fill_gaps_hermite session_gaps knn_join link_nearest_l3 greedy_selection link_predict_l1 link_neighbour_flow_l2 enforce_reciprocity confirm_link_tuples confirm_links relink_gaps seal_trajectories self_consistency_report prune_kinks trajectory_scores stitch_chunks merge_bidirectional identity_metrics e_track link_recall_precision accel_kurtosis noise_sigma motion_scale match_cascade match_two_cameras cliques4 epipolar_band triangulate_lsq ray_roundtrip lens_roundtrip pixel_candidates lut_bilinear conflict_components split_blobs normalize_rcm reconnect_pieces stitch_fragments dataset_stats tracker_recommendation box_blur lowpass_3 target_components store_seal store_blocks calibrate_full calibrate_linear ghost_probability brightness_shares text_lines trajectory_rows threshold stream_session_gaps stream_sliding membership_extended births signatures_estimated calibrate_jointly volume_bounds made_flows""".split()


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, duck, name):
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(duck.execute(registry.oracle_sql()[name]).df())


#: Queries that SQL can't express; what they are held against is in the tests named.
PLAIN = {
    "cascade_track", "cascade_track_chunks", "link_4be", "track_back", "nearest_assignment_track", "two_phase_track", "two_phase_bidirectional", "hybrid_track", "mht_relink", "shared_observations",
    "assignment_hungarian", "fit_scale", "uniqueness_ilp", "unique_tracks", "weighted_savgol", "irls_smooth", "resolve_components", "targ_rec", "peak_fit", "detect_bubbles", "stream_linker", "made_scenario",
    "image_track", "image_added_points", "signatures_across_cameras", "corrective_pass", "shaken_points",
}


def test_which_queries_have_no_twin():
    assert set(registry.queries()) - set(registry.oracle_sql()) == PLAIN


def test_greedy_equals_a_sequential_pass(spark):
    rng = random.Random(4)
    edges = [(f, i, k, float(rng.randrange(12))) for f in range(3) for i in range(9) for k in range(9) if rng.random() < 0.5]
    used, want = set(), []
    for f, i, k, c in sorted(edges, key=lambda e: (e[0], e[3], e[1], e[2])):
        if (f, 0, i) not in used and (f, 1, k) not in used:
            used |= {(f, 0, i), (f, 1, k)}
            want.append((f, i, k, c))
    for most in (0, 20, 10**6):  # by rounds, by both ways, in tasks
        got = linking.greedy(spark.createDataFrame(edges, "frame long, i long, k long, cost double"), most).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spacing_counts_isolated_points(spark, duck):
    assert plain(registry.queries()["nn_spacing"](spark, SF).toPandas()) == plain(duck.execute(registry.oracle_sql()["nn_spacing"]).df())
    rng = random.Random(9)
    cloud = [(f, i, *(rng.randrange(200) / 64 for _ in "xyz")) for f in range(2) for i in range(40)] + [(0, 50, 90.0, -400.0, 7.0), (0, 51, 3000.0, 0.0, 0.0), (1, 60, 9.0, 9.0, 9.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 0.0, 0.0, 0.0), (3, 1, 500.0, 0.0, 0.0), (3, 2, float("nan"), 0.0, 0.0)]
    want = {}
    for f, i, *p in cloud:
        near = [sum((a - b) ** 2 for a, b in zip(p, q)) for g, k, *q in cloud if f == g and i != k]
        near = [x for x in near if x == x]
        if near:
            want[f, i] = min(near)
    got = spatial.nearest_distances(spark.createDataFrame(cloud, "frame long, pid long, x double, y double, z double"), 0.25).collect()
    assert {(r.frame, r.i): r.d2 for r in got} == want and len(got) == len(want)
    assert spatial.spacing_unbounded(spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0)], "frame long, pid long, x double, y double, z double"), 2.0).count() == 0


@pytest.mark.parametrize("name", ["camera_targets", "epipolar_candidates", "cliques3", "pairs_unique", "skew_midpoint"])
def test_camera_queries_over_every_frame(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert set(got["frame"]) == set(range(8))
    assert plain(got) == plain(duck.execute(registry.oracle_sql()[name]).df())


def test_copies_of_a_point_are_not_paired(spark):
    rng = random.Random(5)
    cloud = [(f, f * 1000 + i, *(rng.randrange(4) / 2 for _ in "xyz")) for f in range(2) for i in range(90)] + [(0, 500, 7.0, -0.0, 7.0), (0, 501, 7.0, 0.0, 7.0), (0, 502, float("nan"), 1.0, 1.0), (0, 503, float("nan"), 1.0, 1.0), (0, 504, None, 1.0, 1.0)]
    df = spark.createDataFrame(cloud, "frame long, pid long, x double, y double, z double")
    d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q)) if None not in (*p, *q) else float("nan")
    want = {(f, i): sum(f == g and i != k and d2(p, q) <= 1 for g, k, *q in cloud) for f, i, *p in cloud}
    got = spatial.neighbour_counts(df, 1.0).collect()
    assert {(r.frame, r.pid): r.neighbours for r in got} == want and len(got) == len(want)
    ahead = {(f, i): min(d2(p, q) for g, k, *q in cloud if g == 1) for f, i, *p in cloud if f == 0 and i < 502}
    got = spatial.nearest_in_next(df.where("pid NOT IN (502, 503, 504)"), 0.25, "pid").collect()
    assert {(r.frame, r.i): r.d2 for r in got} == ahead and len(got) == len(ahead)
    one = spark.range(3000).select(F.lit(0).cast("long").alias("frame"), F.col("id").alias("pid"), *[F.lit(1.0).alias(a) for a in "xyz"])
    near = spatial.neighbour_counts(one, 1.0)
    assert [tuple(r) for r in near.groupBy("neighbours").count().collect()] == [(2999, 3000)]
    assert spatial.places(one, "pid").count() == 1  # nine million pairs of points, one of places


@pytest.mark.parametrize("name", ["brown_correct", "lens_roundtrip", "layer_shift", "sight_rays", "lut_project"])
def test_iterated_formulas_run_over_arrays(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan
    assert name == "lut_project" or "lambda" not in plan  # rounds of columns are interpreted row by row; the look-up table alone, of a few thousand rows, is made so
    assert plain(found.toPandas()) == plain(duck.execute(registry.oracle_sql()[name]).df())


def test_search_boxes_need_no_shuffle(spark):
    from skein.operators import stereo
    from skein.plans.camera_queries import PLAIN

    points = spark.range(50).selectExpr("0L AS frame", "id", "id / 5D AS x", "id / 7D AS y", "id / 9D AS z")
    found = stereo.search_box(points, PLAIN, (0.5, 0.5, 0.5))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # nine images a camera in one task's arrays, not in groups
    got = found.collect()
    assert len(got) == 200 and all(min(r.left, r.right, r.up, r.down) > 0 for r in got)
