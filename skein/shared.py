"""The cluster's shared folder, tables and checkpoints in it that go with the application, and exact quantiles."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of one pass of the quantile search, and values that the driver may hold to end it.
BINS, FEW = 1024, 10_000


_OURS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _OURS:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; the folder is the cluster's to clean
            return


atexit.register(_clean)


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that is set already; a folder of this machine only where Spark runs on it alone."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
    if not current.isDefined():
        sc.setCheckpointDir(found)
        _OURS.append((spark, sc._jsc.sc().getCheckpointDir().get()))  # a folder of this application's own below
    return found.rstrip("/")


def place(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder, for tables, stores and streams; what lies there goes when the application ends."""
    path = f"{folder(spark)}/skein-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    _OURS.append((spark, path))
    return path


def table(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = place(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_skein_path", None)
        if path:
            _OURS[:] = [m for m in _OURS if m[1] != path]
            _delete(df.sparkSession, path)


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """Exact quantile with linear interpolation between the two middle values; None without values (nulls and NaN don't count).

    Histograms of the range that still holds the wanted rank are summed map-side and narrowed, so no task and no driver holds the values;
    the last few, or one repeated value, end it.
    """
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = q * (n - 1)
    found = [_ranked(v, r, n, low, high) for r in sorted({int(at), min(int(at) + 1, n - 1)})]
    return found[0] + (found[-1] - found[0]) * (at - int(at))


def _ranked(v: DataFrame, rank: int, n: int, low: float, high: float) -> float:
    """The value of this rank (from 0) among n values within [low, high]."""
    while True:
        if low == high:
            return low
        part = v.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        if n <= FEW:
            return sorted(r[0] for r in part.collect())[rank]
        width = (high - low) / BINS
        of = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = part.groupBy(of.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for b in bins:
            if rank < b["n"]:
                n, low, high = b["n"], b["lo"], b["hi"]
                break
            rank -= b["n"]
        if len(bins) == 1 and width <= 0:
            return low
