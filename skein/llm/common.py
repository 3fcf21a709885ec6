"""Helpers shared by the corpus operators: shared-folder tables, bounded batches, hashing and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import shared

#: Word pattern of all contracts: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of one Arrow batch; bounds what a Python worker holds at once, whatever the texts' lengths (a longer text is a batch of its own).
BATCH_BYTES = 2_000_000

_MINE: list[tuple[object, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget_all() -> None:
    for spark, path in _MINE:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; the folder is the cluster's to clean
            return


atexit.register(_forget_all)


def table(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Tables lie in a folder named after the application, so that what a killed driver leaves behind can be found.
    """
    spark = df.sparkSession
    path = f"{shared.folder(spark)}/skein-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MINE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_skein_path", None)
        if path:
            _MINE[:] = [m for m in _MINE if m[1] != path]
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def tables_of(*kept: DataFrame):
    """Delete all tables written inside the block at its end, but for those added to the list it gives and those kept."""
    before = {path for _, path in _MINE}
    stay: list[DataFrame] = list(kept)
    yield stay
    names = {getattr(df, "_skein_path", None) for df in stay}
    for spark, path in [m for m in _MINE if m[1] not in before and m[1] not in names]:
        _MINE[:] = [m for m in _MINE if m[1] != path]
        _delete(spark, path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, which keeps partitions and their row order."""
    return shared.kept(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes. Every operator sets the same bound, so frames that run later find it as it was when they were built."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Hand memory that is free back to the system."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def lean(run):
    """A function of batches that leaves its Python worker small when its task ends: idle workers stay beside those at work."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


_STORES: dict[str, dict] = {}


def store(owner: str) -> dict:
    """What an operator keeps in its Python worker (word hashes, models). Workers are used again by other operators; the first call of one drops the others' stores."""
    if owner not in _STORES:
        _STORES.clear()
        _STORES[owner] = {}
        trim()
    return _STORES[owner]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind value once inside an expression; body gets it as a lambda variable and so never repeats its work."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b long): rows (node, comp) for each node that has an edge, comp = smallest node.

    Each task first reduces its own edges to a forest; then rounds of hash-min with pointer jumping, each
    round written to the shared folder. Nothing but a count comes to the driver. Self loops are allowed; nulls are dropped.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")

    def forest(batches):
        import pandas as pd

        parent: dict[int, int] = {}

        def find(x):
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000:  # hand on what there is, so that memory stays bounded
                yield pd.DataFrame({"a": list(parent), "b": [find(x) for x in parent]})
                parent.clear()
        if parent:
            yield pd.DataFrame({"a": list(parent), "b": [find(x) for x in parent]})

    small_batches(spark)
    pairs = table(edges.mapInPandas(lean(forest), "a long, b long").where("a <> b"))
    both = table(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    forget(pairs)
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("comp").alias("c"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hop = labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("c2"))
        new = table(hop.join(up, "comp", "left").select("node", "was", F.least("comp", "c2").alias("comp")))
        moved = new.where("comp <> was").limit(1).count()
        forget(labels)
        labels = new.select("node", "comp")
        labels._skein_path = new._skein_path
        if not moved:
            forget(both)
            return labels
