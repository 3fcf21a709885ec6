"""Particle tables bound to the driver's tables: tracks from events, truth and cameras from customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = 8
#: Customers whose points one task makes.
TASK_KEYS = 10_000
#: (multiplier, velocity multiplier) of each axis; coordinates lie on a grid of 1/64, so that sums are exact.
AXES = {"x": (7919, 31), "y": (104729, 37), "z": (1299709, 41)}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trajid, frame, x): a user's events in order, the value on a grid of 1/64."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").alias("trajid"), frame.alias("frame"), (F.floor(F.col("value") * 64).cast("double") / F.lit(64.0)).alias("x"))


TRACKS_SQL = """SELECT user_id AS trajid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
  CAST(floor(value * 64) AS DOUBLE) / 64e0 AS x FROM events"""


def truth(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """(pid, frame, x, y, z): a customer moves on a straight line through a cube of 20 units."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    # the file is small, what is made of it is not: one task would shuffle it all
    keys = keys.repartition(keys.count() // TASK_KEYS + 1, F.xxhash64("c_custkey"))
    # a join, no explode: Spark's estimate of sizes sees the frames, else it broadcasts all points where they are joined
    rows = keys.select(F.col("c_custkey").alias("pid")).crossJoin(F.broadcast(spark.range(frames).select(F.col("id").alias("frame"))))
    axis = lambda a, v: ((F.col("pid") * a) % 1280).cast("double") / 64.0 + ((F.col("pid") * v) % 33 - 16).cast("double") / 64.0 * F.col("frame")
    return rows.select("pid", "frame", *[axis(*m).alias(k) for k, m in AXES.items()])


def _axis_sql(a: int, v: int) -> str:
    return f"CAST((c_custkey * {a}) % 1280 AS DOUBLE) / 64e0 + CAST((c_custkey * {v}) % 33 - 16 AS DOUBLE) / 64e0 * f"


TRUTH_SQL = f"SELECT c_custkey AS pid, f AS frame, {', '.join(f'{_axis_sql(*m)} AS {k}' for k, m in AXES.items())} FROM customer, unnest(range(0, {FRAMES})) AS t(f)"


def dropped_out(points: DataFrame) -> DataFrame:
    """Detections with every twentieth (pid, frame) missing."""
    return points.where((F.col("pid") * 13 + F.col("frame") * 7) % 20 != 0)


DROPPED_SQL = f"SELECT * FROM ({TRUTH_SQL}) WHERE (pid * 13 + frame * 7) % 20 <> 0"


def linkage(spark: SparkSession, sf_dir: str, faults: bool = True) -> DataFrame:
    """(frame, id, pid, prev, next, x, y, z): detections with drop-outs, linked along each customer over gaps of one frame.

    Some nexts are missing; with faults some prevs are missing too and some name a neighbour, and ids are numbers within the frame instead of pids.
    """
    by_frame, track = Window.partitionBy("frame").orderBy("pid"), Window.partitionBy("pid").orderBy("frame")
    rows = dropped_out(truth(spark, sf_dir)).withColumn("id", (F.row_number().over(by_frame) - 1).cast("long") if faults else F.col("pid"))
    p, q, n, f = F.lag("id").over(track), F.lead("id").over(track), F.col("pid"), F.col("frame")
    prev = F.when((n * 3 + f) % 13 == 0, F.lit(None)).when((n + f) % 17 == 0, p + 1).otherwise(p) if faults else p
    return rows.select("frame", "id", "pid", prev.cast("long").alias("prev"), F.when((n * 5 + f) % 11 != 0, q).alias("next"), "x", "y", "z")


def _linkage_sql(faults: bool) -> str:
    prev = "CASE WHEN (pid * 3 + frame) % 13 = 0 THEN NULL WHEN (pid + frame) % 17 = 0 THEN p + 1 ELSE p END" if faults else "p"
    return f"""SELECT frame, id, pid, {prev} AS prev, CASE WHEN (pid * 5 + frame) % 11 <> 0 THEN q END AS next, x, y, z FROM (
  SELECT *, lag(id) OVER (PARTITION BY pid ORDER BY frame) AS p, lead(id) OVER (PARTITION BY pid ORDER BY frame) AS q FROM (
  SELECT *, {"row_number() OVER (PARTITION BY frame ORDER BY pid) - 1" if faults else "pid"} AS id FROM ({DROPPED_SQL})))"""


LINKAGE_SQL, CLEAN_LINKAGE_SQL = _linkage_sql(True), _linkage_sql(False)
