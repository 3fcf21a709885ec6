"""Command line: python -m skein.cli <command> ... over run stores and made runs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("skein").getOrCreate()


def track(args) -> None:
    """Track a store's points and write the links as a stream."""
    from skein.operators import tracking
    from skein.plans import trackers
    from skein.sources.store import Store

    store = Store.open(_session(), args.run)
    points = store.read("correspondences").select(F.col("frame").cast("long").alias("frame"), "id", "x", "y", "z")
    edges = trackers.resolve(args.tracker, args.plugins)(points)
    store.write_linkage(tracking.linkage_of(points, edges), args.name)
    print(f"{edges.count()} links")


def report(args) -> None:
    """How a stream of links fares by itself."""
    from skein.operators import reports
    from skein.sources.store import Store

    print(reports.text(reports.consistency(Store.open(_session(), args.run).linkage(args.name).withColumn("frame", F.col("frame").cast("long"))).first()))


def seal(args) -> None:
    from skein.sources.store import Store

    print(Store.open(_session(), args.run).seal(args.name, args.force, args.least))


def inspect(args) -> None:
    from skein.sources.store import Store

    found = Store.find(_session(), args.run)
    print("no store" if found is None else "\n".join(f"{r['entity']:16} {r['rows']:>12} rows  frames {r['first']} .. {r['last']}" for r in found.inventory().collect()))


def list_trackers(args) -> None:
    from skein.plans import trackers

    print(trackers.tracker_text())


def recommend(args) -> None:
    """The tracker for a store's points."""
    from skein.operators import advice
    from skein.plans import trackers
    from skein.sources.store import Store

    spark = _session()
    points = Store.open(spark, args.run).read("correspondences").withColumn("frame", F.col("frame").cast("long"))
    print(advice.recommend(advice.dataset(points, args.radius), trackers.trackers(spark), args.priority).first().asDict())


def dataset(args) -> None:
    """Make a run by arithmetic and write its store."""
    from skein.operators import stereo
    from skein.sources import synthetic
    from skein.sources.store import Store

    spark = _session()
    _, found = synthetic.scenario(spark, args.particles, args.frames, args.velocity)
    rig = stereo.standard_rig(4, (50.0, 50.0, 50.0), 400.0, 120.0, 60.0, imx=4096, imy=4096)
    synthetic.write_experiment(Store.open(spark, args.run), found, rig)
    print(f"{found.count()} points")


def compare(args) -> None:
    """All given trackers on one made run, a line each."""
    from skein.operators import linkage, metrics, tracking
    from skein.plans import trackers
    from skein.sources import synthetic

    spark = _session()
    truth, found = synthetic.scenario(spark, args.particles, args.frames, args.velocity)
    points = found.select("frame", "id", "x", "y", "z")
    for name in args.trackers or ("priority_segment_3d", "4be", "two_phase", "hybrid_deltat_3d", "unified"):
        tracks = linkage.seal(tracking.linkage_of(points, trackers.resolve(name)(points)), 2).select("trajid", "frame", "x", "y", "z")
        print(name, metrics.link_metrics(tracks, truth, 0.05).first().asDict())


def sweep(args) -> None:
    """One parameter of a tracker over many values, a line each."""
    from skein.operators import linkage, metrics, tracking
    from skein.plans import trackers
    from skein.sources import synthetic

    truth, found = synthetic.scenario(_session(), args.particles, args.frames, args.velocity)
    points = found.select("frame", "id", "x", "y", "z")
    for value in args.values:
        edges = trackers.resolve(args.tracker)(points, **{args.param: value})
        tracks = linkage.seal(tracking.linkage_of(points, edges), 2).select("trajid", "frame", "x", "y", "z")
        print(args.param, value, metrics.link_metrics(tracks, truth, 0.05).first().asDict())


def warmup(args) -> None:
    """Grow the search box until forward and backward links agree as well as they will."""
    from skein.operators import advice
    from skein.plans import trackers
    from skein.sources.store import Store

    spark = _session()
    points = Store.open(spark, args.run).read("correspondences").select(F.col("frame").cast("long").alias("frame"), "id", "x", "y", "z")
    frames = [r["frame"] for r in points.select("frame").distinct().orderBy("frame").limit(args.frames).collect()]
    points = points.where(F.col("frame").isin(frames))

    def agree(found):
        half, edges = found
        back = trackers.resolve("priority_segment_3d")(points.withColumn("frame", -F.col("frame")), half=half)
        turned = back.select((-F.col("frame") - 1).alias("frame"), F.col("k").alias("i"), F.col("i").alias("k"))
        both, n = edges.join(turned, ["frame", "i", "k"]).count(), edges.count()
        return both * both / n if n else 0.0

    def run(p):
        return p["half"], trackers.resolve("priority_segment_3d")(points, **p)

    best, tried = advice.search(spark, {"half": [args.start * 1.5**k for k in range(8)]}, run, agree)
    print(best, f"of {len(tried)} tried")


def self_check(args) -> None:
    """What the session offers, and whether a small round trip through geometry and tracking comes out right."""
    import numpy as np

    from skein.engines import tracking as engine
    from skein.functions import optics
    from skein.functions.numeric import Arrays

    spark = _session()
    print("Spark", spark.version, "shared folder", spark.conf.get("spark.checkpoint.dir", "not named"))
    c = optics.Camera(z0=300.0, n2=1.46, n3=1.33, gz=50.0, d=5.0)
    p = np.array([[3.0], [4.0], [5.0]])
    x, y = optics.flat(Arrays, c, p, rounds=200, limit=1e-10)
    q = optics.at_height(Arrays, *optics.ray(Arrays, c, x, y), p[2])
    good = bool(abs(q[0] - 3).max() < 1e-8 and engine.cascade([p.T, p.T + 0.1, p.T + 0.2], 1.0)[1][0] == 0)
    print("geometry and tracking", "right" if good else "WRONG")
    if not good:
        raise SystemExit(1)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="skein", description=__doc__)
    sub = top.add_subparsers(required=True)

    def add(f, name: str, *options):
        p = sub.add_parser(name, help=f.__doc__)
        for flags, more in options:
            p.add_argument(*flags, **more)
        p.set_defaults(run_=f)

    run = (("run",), {"help": "folder of the run"})
    name = (("--name",), {"default": "ptv_is", "help": "stream of links"})
    made = [(("--particles",), {"type": int, "default": 60}), (("--frames",), {"type": int, "default": 40}), (("--velocity",), {"type": float, "default": 1.0})]
    tracker = (("--tracker",), {"default": "priority_segment_3d"})
    add(track, "track", run, name, tracker, (("--plugins",), {"default": None, "help": "folder of trackers"}))
    add(report, "report", run, name)
    add(report, "validate", run, name)
    add(seal, "seal", run, name, (("--force",), {"action": "store_true"}), (("--least",), {"type": int, "default": 1}))
    add(inspect, "inspect", run)
    add(inspect, "peek", run)
    add(list_trackers, "list-trackers")
    add(recommend, "recommend", run, (("--radius",), {"type": float, "default": 1.0}), (("--priority",), {"default": "default"}))
    add(dataset, "dataset", run, *made)
    add(compare, "compare", (("--trackers",), {"nargs": "*"}), *made)
    add(compare, "benchmark", (("--trackers",), {"nargs": "*"}), *made)
    add(sweep, "sweep", tracker, (("--param",), {"default": "half"}), (("--values",), {"nargs": "+", "type": float, "default": [0.5, 1.0, 2.0]}), *made)
    add(warmup, "warmup", run, (("--frames",), {"type": int, "default": 20}), (("--start",), {"type": float, "default": 0.2}))
    add(self_check, "self-check")
    args = top.parse_args(argv)
    args.run_(args)


if __name__ == "__main__":
    main(sys.argv[1:])
