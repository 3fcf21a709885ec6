"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "traj_accel_residual", "velocity_jump_rate", "turning_angle", "trim_ends", "fill_gaps", "savgol_interior", "session_gaps", "camera_targets", "uniqueness_pairs", "box_blur",
    "radius_join", "knn_join", "neighbour_count", "nn_spacing", "link_nearest_l3", "seal_trajectories", "confirm_links", "cascade_track_chunks", "two_phase_track",
    "hybrid_track", "match_cascade", "triangulate_lsq", "conflict_components", "trajectory_scores", "stitch_chunks",
    "image_track", "membership_extended",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from skein.plans import registry

    found = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
