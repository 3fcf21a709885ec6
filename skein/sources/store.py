"""A run's tables as Parquet, one folder an entity, partitioned by frame: pruned reads, frame-wise overwrite, generations with a commit pointer, seals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import linkage as ln

#: Columns by which an entity is laid out in folders.
LAYOUT = {
    "targets": ["cam", "frame"], "correspondences": ["frame"], "linkage": ["name", "frame"], "trajectories": [], "traj": [], "stats": ["frame"],
    "quality": ["frame"], "rcm": ["frame"], "observations": ["frame"], "sigma": ["frame"], "trajids": ["name", "frame"], "mmlut": ["cam"], "plates": ["view"], "blocks": ["name", "gen"],
}
ENTITIES = tuple(LAYOUT)
#: Entities whose change makes sealed trajectories stale.
SOURCES = ("targets", "correspondences", "linkage", "blocks")
# Folder of the store in a run, frames of a block, millimetres in a metre.
FOLDER, BLOCK_FRAMES, MILLI = "res/run", 256, 1000.0


def store_path(root: str) -> str:
    """Where a run's store lies."""
    root = root.rstrip("/")
    return root if root.endswith(FOLDER) else f"{root}/{FOLDER}"


class Store:
    """Reads name the partitions they want, so that other frames' files are never opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """The store of a run, made if need be."""
        out = cls(spark, store_path(root))
        fs, at = out._fs(out.path)
        fs.mkdirs(at)
        return out

    @classmethod
    def find(cls, spark: SparkSession, root: str) -> Store | None:
        """The store of a run, in the folder itself or in its usual place; None if there is none."""
        for path in (store_path(root), root):
            found = cls(spark, path)
            if any(found.has(e) for e in ENTITIES):
                return found
        return None

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _at(self, entity: str) -> str:
        if entity not in LAYOUT:
            raise ValueError(f"no entity {entity}")
        return f"{self.path}/{entity}"

    def has(self, entity: str, **where) -> bool:
        """Whether an entity, or a folder of leading partition values, exists."""
        by = LAYOUT[entity][: len(where)]
        fs, at = self._fs("/".join([self._at(entity), *(f"{c}={where[c]}" for c in by)]))
        return fs.exists(at)

    # small facts about the run: a JSON file that one writer replaces at a time

    def facts(self) -> dict:
        fs, at = self._fs(f"{self.path}/facts.json")
        return json.loads(self.spark.read.text(at.toString(), wholetext=True).first()[0]) if fs.exists(at) else {}

    def _known(self) -> dict:
        if getattr(self, "_facts", None) is None:
            self._facts = self.facts()
        return self._facts

    def _set(self, **facts) -> None:
        self._known().update(facts)
        fs, at = self._fs(f"{self.path}/facts.json")
        out = fs.create(at, True)
        out.writeBytes(json.dumps(self._facts))
        out.close()

    @property
    def sealed(self) -> bool:
        return bool(self._known().get("sealed"))

    # entities

    def write(self, entity: str, rows: DataFrame) -> None:
        """Frames in rows replace those in the store, others stay; unpartitioned entities are replaced whole, in order of trajid. Sources unseal the run."""
        by = LAYOUT[entity]
        if by:
            rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._at(entity))
        else:
            order = [c for c in ("trajid", "time", "frame") if c in rows.columns]
            rows.repartitionByRange("trajid").sortWithinPartitions(*order).write.mode("overwrite").parquet(self._at(entity))
        if entity in SOURCES and self.sealed:
            self._set(sealed=False)

    def read(self, entity: str, **where) -> DataFrame:
        """All rows, or those of the given partition values, or of one trajid."""
        rows = self.spark.read.parquet(self._at(entity))
        for name, value in where.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    def frames(self, *entities: str) -> DataFrame:
        """Distinct frames of the entities, from folder names where these hold the frame."""
        found = [self.read(e).select(F.col("frame").cast("long")) for e in entities or ENTITIES if "frame" in LAYOUT[e] and self.has(e)]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out.distinct()

    def linkage_frames(self, name: str) -> DataFrame:
        return self.read("linkage", name=name).select(F.col("frame").cast("long")).distinct()

    def cameras(self) -> DataFrame:
        """Distinct cameras of the targets, from folder names."""
        return self.read("targets").select(F.col("cam").cast("long")).distinct()

    def names(self) -> DataFrame:
        """Distinct linkage streams."""
        return self.read("linkage").select("name").distinct()

    def clear(self, entity: str, **where) -> None:
        """Delete a whole entity or the folder of leading partition values."""
        by = LAYOUT[entity][: len(where)]
        if set(by) != set(where):
            raise ValueError(f"{entity} is laid out by {LAYOUT[entity]}")
        fs, at = self._fs("/".join([self._at(entity), *(f"{c}={where[c]}" for c in by)]))
        fs.delete(at, True)

    def write_linkage(self, rows: DataFrame, name: str) -> None:
        """Linkage (frame, id, prev, next, x, y, z[, prio]) of a stream. Every id counts from 0 in its frame without gaps, or nothing is written."""
        bad = rows.groupBy("frame").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n <> d OR lo <> 0 OR hi <> n - 1")
        if not bad.isEmpty():
            raise ValueError(f"frame {bad.first()['frame']}: ids don't count its rows")
        self.write("linkage", rows.withColumn("name", F.lit(name)))

    def prio(self, name: str) -> DataFrame | None:
        """(frame, id, prio) of a stream, None if it has none."""
        rows = self.read("linkage", name=name)
        return rows.select("frame", "id", "prio") if "prio" in rows.columns else None

    def write_point_column(self, entity: str, rows: DataFrame) -> None:
        """Row-aligned values of points: quality (ghost), rcm, sigma, or observations; points without one have null when they are read."""
        self.write(entity, rows)

    def points(self) -> DataFrame:
        """Correspondences with all row-aligned values there are."""
        out = self.read("correspondences")
        for entity in ("quality", "rcm", "sigma", "observations"):
            if self.has(entity):
                out = out.join(self.read(entity), ["frame", "id"], "left")
        return out

    def set_trajids(self, name: str, rows: DataFrame) -> None:
        """Trajectory labels (frame, id, trajid) of a stream's points."""
        self.write("trajids", rows.select("frame", "id", "trajid").withColumn("name", F.lit(name)))

    # sealing

    def needs_seal(self, name: str) -> bool:
        """Whether the linkage differs from what was sealed last."""
        if not self.sealed:
            return True
        return ln.source_hash(self.read("linkage", name=name)).first()["digest"] != self._known().get("digest")

    def seal(self, name: str, force: bool = False, least: int = 1) -> dict:
        """Trajectories of a stream, in metres, with their index and labels; skipped if nothing has changed since the last seal."""
        if not force and not self.needs_seal(name):
            return {"skipped": True}
        rows = self.read("linkage", name=name)
        digest = ln.source_hash(rows).first()["digest"]
        tracks = ln.seal(rows, least)
        self.write("trajectories", tracks.select("trajid", F.col("frame").alias("time"), *[(F.col(a) / MILLI).alias(a) for a in ln.AXES], *[F.lit(0.0).alias(c) for c in ("vx", "vy", "vz", "ax", "ay", "az")]))
        found = self.read("trajectories")
        self.write("traj", index(found.withColumnRenamed("time", "frame")))
        self.set_trajids(name, tracks)
        self._set(sealed=True, digest=digest, name=name)
        return {"skipped": False, "trajectories": self.read("traj").count(), "rows": found.count()}

    def trajectory(self, trajid: int) -> DataFrame:
        """One trajectory in order of time; Parquet's statistics leave other files' row groups unread."""
        return self.read("trajectories").where(F.col("trajid") == trajid).orderBy("time")

    def tracks(self, first: int | None = None, last: int | None = None, least: int = 2) -> DataFrame:
        """A row a trajectory of `least` points or more within the frames: trajid and its points as an array in order of time."""
        rows = self.read("trajectories")
        rows = rows if first is None else rows.where(F.col("time") >= first)
        rows = rows if last is None else rows.where(F.col("time") <= last)
        each = rows.groupBy("trajid").agg(F.sort_array(F.collect_list(F.struct("time", *ln.AXES, "vx", "vy", "vz", "ax", "ay", "az"))).alias("points"))
        return each.where(F.size("points") >= least)

    def linkage_rows(self, name: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """(trajid, time, x, y, z in metres) straight from a stream's linkage, blocks before frames."""
        rows = self.linkage(name)
        rows = rows if first is None else rows.where(F.col("frame") >= first)
        rows = rows if last is None else rows.where(F.col("frame") <= last)
        return ln.seal(rows).select("trajid", F.col("frame").alias("time"), *[(F.col(a) / MILLI).alias(a) for a in ln.AXES])

    # blocks: many frames written at once under a new generation, visible once it is committed

    def write_blocks(self, rows: DataFrame, name: str, frames: int = BLOCK_FRAMES) -> int:
        """Linkage of many frames as one generation of files of up to `frames` frames each; readers see it when the pointer moves, at the end."""
        gen = int(self._known().get(f"gen:{name}", -1)) + 1
        out = rows.withColumns({"name": F.lit(name), "gen": F.lit(gen)})
        out.repartition(F.floor(F.col("frame") / frames)).sortWithinPartitions("frame", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "gen").parquet(self._at("blocks"))
        self._set(**{f"gen:{name}": gen, "sealed": False})
        return gen

    def read_blocks(self, name: str, **where) -> DataFrame:
        """Each frame's rows of its newest committed generation."""
        rows = self.read("blocks", name=name).where(F.col("gen") <= int(self._known().get(f"gen:{name}", -1)))
        for c, value in where.items():
            rows = rows.where(F.col(c) == F.lit(value))
        return newest(rows).drop("gen", "name")

    def discard_uncommitted(self, name: str) -> int:
        """Delete generations above the pointer, which a writer has left; how many."""
        done = int(self._known().get(f"gen:{name}", -1))
        stale = [r["gen"] for r in self.read("blocks", name=name).select("gen").distinct().where(F.col("gen") > done).collect()]  # a row a generation
        for gen in stale:
            self.clear("blocks", name=name, gen=gen)
        return len(stale)

    def linkage(self, name: str) -> DataFrame:
        """All frames of a stream: blocks where a frame has one, else its own rows."""
        if not self.has("blocks", name=name):
            return self.read("linkage", name=name).drop("name")
        block = self.read_blocks(name)
        if not self.has("linkage", name=name):
            return block
        alone = self.read("linkage", name=name).drop("name").join(block.select("frame").distinct(), "frame", "left_anti")
        return block.unionByName(alone, allowMissingColumns=True)

    def inventory(self) -> DataFrame:
        """(entity, rows, first, last): what the store holds."""
        out = None
        for e in ENTITIES:
            if self.has(e):
                rows = self.read(e)
                frame = F.col("frame") if "frame" in rows.columns else F.col("time") if "time" in rows.columns else F.lit(None)
                one = rows.agg(F.lit(e).alias("entity"), F.count("*").alias("rows"), F.min(frame.cast("long")).alias("first"), F.max(frame.cast("long")).alias("last"))
                out = one if out is None else out.union(one)
        return out


def stats(targets: DataFrame, points: DataFrame, linkage: DataFrame) -> DataFrame:
    """(frame, n_targets, n_quads, n_trips, n_pairs, n_points, n_links): counters of every frame that has targets or points."""
    seen = F.size(F.filter("cam_ids", lambda c: c >= 0))
    p = points.groupBy("frame").agg(F.count("*").alias("n_points"), *[F.count_if(seen == k).alias(n) for k, n in ((4, "n_quads"), (3, "n_trips"), (2, "n_pairs"))])
    out = targets.groupBy("frame").agg(F.count("*").alias("n_targets")).join(p, "frame", "full").join(linkage.groupBy("frame").agg(F.count("next").alias("n_links")), "frame", "left")
    return out.select("frame", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_targets", "n_quads", "n_trips", "n_pairs", "n_points", "n_links")])


def newest(rows: DataFrame, keys: tuple[str, ...] = ("frame", "row_id"), generation: str = "gen") -> DataFrame:
    """Of rows written in generations, those of each frame's newest generation."""
    last = rows.groupBy(keys[0]).agg(F.max(generation).alias("_last"))
    return rows.join(last, keys[0]).where(F.col(generation) == F.col("_last")).drop("_last")


def index(trajectories: DataFrame) -> DataFrame:
    """(trajid, first, last, length, first_row): where each trajectory starts in the cache sorted by (trajid, frame).

    first_row needs running lengths; these are summed within ranges of trajid that Spark cuts into even parts, so neither dense nor sparse ids gather in one task.
    """
    from skein.shared import kept

    each = trajectories.groupBy("trajid").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length"))
    ranged = kept(each.repartitionByRange("trajid").withColumn("_b", F.spark_partition_id()))
    before = ranged.groupBy("_b").agg(F.sum("length").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("_b").orderBy("trajid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(before, "_b").select("trajid", "first", "last", "length", (F.col("_before") + inside).alias("first_row"))
