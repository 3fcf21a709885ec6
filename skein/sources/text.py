"""Line-based particle files: one file a frame (and camera), a count first, then one row a line in fixed field order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of each format in their order in a line.
FORMATS = {
    "targets": (("pnr", "int"), ("x", "double"), ("y", "double"), ("n", "int"), ("nx", "int"), ("ny", "int"), ("sumg", "int"), ("tnr", "int")),
    "rt_is": (("nr", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("id1", "int"), ("id2", "int"), ("id3", "int"), ("id4", "int")),
    "ptv_is": (("prev", "int"), ("next", "int"), ("x", "double"), ("y", "double"), ("z", "double")),
    "added": (("prev", "int"), ("next", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("prio", "int")),
    "calblock": (("id", "int"), ("x", "double"), ("y", "double"), ("z", "double")),
}
#: Frame (and camera) in a file's name: name.FRAME, camC.FRAME_targets.
FRAME = r"\.(\d+)(?:_targets)?$"
CAMERA = r"cam(\d+)\.\d+_targets$"


def read(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Rows of all files: frame long, cam int (targets), row_id int (from 0, in line order), then the format's fields.

    Lines that don't have the format's number of fields (the count, blank lines) give no row. A file stays in one task,
    because line order counts; files are spread over tasks.
    """
    fields = FORMATS[kind]
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.split("value", r"\r?\n").alias("lines"))
    cells = F.transform("lines", lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "))
    rows = files.select("p", F.posexplode(F.filter(cells, lambda x: F.size(x) == len(fields))).alias("row_id", "c"))
    place = [F.regexp_extract("p", FRAME, 1).try_cast("long").alias("frame"), *([F.regexp_extract("p", CAMERA, 1).try_cast("int").alias("cam")] if kind == "targets" else [])]
    return rows.select(*place, "row_id", *[F.col("c")[k].try_cast(t).alias(n) for k, (n, t) in enumerate(fields)])


def lines(rows: DataFrame, kind: str) -> DataFrame:
    """(frame, value): a frame's file content, count first, rows by row_id; whole numbers plain, others with six decimals."""
    cells = [F.col(n).cast("string") if t == "int" else F.format_string("%.6f", F.col(n)) for n, t in FORMATS[kind]]
    each = rows.select("frame", F.struct("row_id", F.concat_ws(" ", *cells).alias("line")).alias("r"))
    whole = each.groupBy("frame").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return whole.select("frame", F.concat_ws("\n", F.size("rs").cast("string"), F.array_join(F.col("rs.line"), "\n")).alias("value"))


def parse(content: DataFrame, kind: str) -> DataFrame:
    """Rows of (frame, value) file contents, the inverse of lines."""
    fields = FORMATS[kind]
    cells = F.filter(F.transform(F.split("value", "\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda x: F.size(x) == len(fields))
    rows = content.select("frame", F.posexplode(cells).alias("row_id", "c"))
    return rows.select("frame", "row_id", *[F.col("c")[k].try_cast(t).alias(n) for k, (n, t) in enumerate(fields)])


def write(rows: DataFrame, path: str, kind: str) -> None:
    """One folder a frame (frame=N) with one text file each."""
    lines(rows, kind).repartition("frame").write.mode("overwrite").partitionBy("frame").text(path)


# --- calibration files -------------------------------------------------------------------------------------------------------------------


def manual_points(calblock: str, manual: str, cam: int, of: int = 4) -> list[tuple[int, float, float, float]]:
    """The points of a calibration block that a file of manual orientation names for a camera: `of` numbers a camera, camera after camera."""
    known = {}
    for line in calblock.splitlines():
        cells = line.split()
        if len(cells) == 4:
            known[int(cells[0])] = tuple(float(c) for c in cells[1:])
    numbers = [int(x) for x in manual.split()]
    return [(n, *known[n]) for n in numbers[cam * of : (cam + 1) * of] if n in known]


def sortgrid_radius(content: str) -> int:
    """Search radius in pixels, the first number of its file."""
    return int(float(content.split()[0]))


def image_object_points(spark: SparkSession, paths) -> DataFrame:
    """(x, y, X, Y, Z as ox, oy, oz) of files of five columns, separated by blanks, tabs, commas or semicolons; other lines give no row."""
    cells = F.filter(F.split(F.trim("value"), r"[\s,;]+"), lambda c: c != "")
    rows = spark.read.text(paths).select(F.transform(cells, lambda c: c.try_cast("double")).alias("c"))
    whole = rows.where((F.size("c") == 5) & ~F.exists("c", lambda c: c.isNull()))
    return whole.select(*[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("x", "y", "ox", "oy", "oz"))])


def pinhole_numbers(content: str) -> dict:
    """A pinhole calibration of 15 numbers: focal lengths, centre, five distortion values, rotation vector and translation."""
    v = [float(x) for x in content.replace(",", " ").split()]
    if len(v) != 15:
        raise ValueError(f"15 numbers, not {len(v)}")
    return {"k": [[v[0], 0.0, v[2]], [0.0, v[1], v[3]], [0.0, 0.0, 1.0]], "dist": v[4:9], "rvec": v[9:12], "tvec": v[12:15]}


def orientation(content: str, added: str | None = None) -> dict:
    """Values of an orientation file (place, angles, matrix, principal point, distance, glass) and of its lens file, by the names of optics.Camera."""
    v = [float(x) for x in content.split()]
    out = dict(zip(("x0", "y0", "z0", "omega", "phi", "kappa"), v[:6])) | dict(zip(("xh", "yh", "cc", "gx", "gy", "gz"), v[15:21]))
    if added:
        out |= dict(zip(("k1", "k2", "k3", "p1", "p2", "scx", "she"), (float(x) for x in added.split())))
    return out


def orientation_lines(camera) -> tuple[str, str]:
    """The two files of a camera, the inverse of orientation()."""
    from skein.functions.numeric import Arrays

    m = camera.turned(Arrays)
    rows = [(camera.x0, camera.y0, camera.z0), (camera.omega, camera.phi, camera.kappa), *m, (camera.xh, camera.yh), (camera.cc,), (camera.gx, camera.gy, camera.gz)]
    lens = (camera.k1, camera.k2, camera.k3, camera.p1, camera.p2, camera.scx, camera.she)
    text = lambda row: " ".join(repr(float(x)) for x in row)
    return "\n".join(map(text, rows)) + "\n", text(lens) + "\n"
