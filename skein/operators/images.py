"""Images as pixel tables (img, r, c, g): kernels as windows over rows and columns, and targets by one task an image.

Rows of an image are arrays for the blur (a sensor's width bounds them), so a kernel of any span shuffles each pixel twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.engines import segmentation
from skein.shared import quantile


def _ramp(pixels: DataFrame, along: str, across: str, span: int) -> DataFrame:
    """(img, across, along, s, m, i, n): sums over the window of up to span pixels to either side, as many as fit on both; m pixels, i the place in its line of n."""
    line = pixels.groupBy("img", across).agg(F.sort_array(F.collect_list(F.struct(along, "g"))).alias("line"))
    sums = F.aggregate("line", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["g"])))
    rows = line.select("img", across, F.size("line").alias("n"), "line", sums.alias("p"))

    def cell(x: Column, i: Column) -> Column:
        w = F.least(F.lit(span), i, F.col("n") - 1 - i)
        return F.struct(x[along].alias(along), (F.get("p", i + w + 1) - F.get("p", i - w)).alias("s"), (2 * w + 1).alias("m"), i.alias("i"))

    return rows.select("img", across, "n", F.explode(F.transform("line", cell)).alias("x")).select("img", across, "n", "x.*")


def box_blur(pixels: DataFrame, span: int = 1) -> DataFrame:
    """Mean over the box of span pixels to every side with the rounding of whole numbers; near an edge the box shrinks evenly on both sides."""
    n = 2 * span + 1
    rows = _ramp(pixels, "c", "r", span).select("img", "r", "c", F.expr(f"s * {n} div m").alias("g"))
    both = _ramp(rows, "r", "c", span)
    return both.select("img", "r", "c", F.expr(f"(s * {n}) div {n * n} div m").alias("g"))


def high_pass(pixels: DataFrame, span: int = 1) -> DataFrame:
    """Image minus its box blur, clipped at zero."""
    low = box_blur(pixels, span).withColumnRenamed("g", "low")
    return pixels.join(low, ["img", "r", "c"]).select("img", "r", "c", F.greatest(F.col("g") - F.col("low"), F.lit(0)).alias("g"))


def _neighbours(pixels: DataFrame) -> tuple[DataFrame, dict]:
    """Pixels with the eight around them as columns g<dr><dc>; null beyond the image."""
    across, down = Window.partitionBy("img", "r").orderBy("c"), Window.partitionBy("img", "c").orderBy("r")
    wide = pixels.select("*", F.lag("g").over(across).alias("a0"), F.col("g").alias("a1"), F.lead("g").over(across).alias("a2"))
    names = {(dr, dc): f"g{dr + 1}{dc + 1}" for dr in (-1, 0, 1) for dc in (-1, 0, 1)}
    cols = [(F.lag(f"a{dc + 1}").over(down) if dr < 0 else F.lead(f"a{dc + 1}").over(down) if dr > 0 else F.col(f"a{dc + 1}")).alias(n) for (dr, dc), n in names.items()]
    return wide.select("img", "r", "c", "g", *cols), names


def filter_3(pixels: DataFrame, kernel, least: int = 8) -> DataFrame:
    """Weighted mean over the 3 x 3 box cut to whole numbers, within least .. 255; 0 on the image's edge."""
    weights = [float(k) for row in kernel for k in row]
    rows, names = _neighbours(pixels)
    total = sum((F.col(n) * w for n, w in zip(names.values(), weights)), F.lit(0.0)) / sum(weights)
    value = F.greatest(F.lit(least), F.least(F.lit(255), F.when(total >= 0, F.floor(total)).otherwise(F.ceil(total))))
    return rows.select("img", "r", "c", F.coalesce(F.when(total.isNotNull(), value), F.lit(0)).cast("long").alias("g"))


def lowpass_3(pixels: DataFrame) -> DataFrame:
    """Mean over the 3 x 3 box, whole numbers; 0 on the image's edge."""
    rows, names = _neighbours(pixels)
    total = " + ".join(names.values())
    return rows.select("img", "r", "c", F.expr(f"coalesce(({total}) div 9, 0)").alias("g"))


def deinterlace(pixels: DataFrame, half: int) -> DataFrame:
    """Odd (1) or even (2) lines in the upper half of the image, the lower filled with 2; 0 leaves the image as it is."""
    if half == 0:
        return pixels
    height = F.broadcast(pixels.groupBy("img").agg((F.max("r") + 1).alias("h")))  # a row an image
    rows = pixels.join(height, "img")
    kept = rows.where((F.col("r") % 2 == (1 if half == 1 else 0)) & (F.floor(F.col("r") / 2) < F.floor(F.col("h") / 2))).select("img", F.expr("r div 2").alias("r"), "c", "g")
    fill = rows.where(F.col("r") >= F.floor(F.col("h") / 2)).select("img", "r", "c", F.lit(2).cast("long").alias("g"))
    return kept.union(fill)


def split_views(pixels: DataFrame, order=(0, 1, 3, 2)) -> DataFrame:
    """The four quarters of an image as views of their own: (img, view, r, c, g), quarters counted by rows and named in the given order."""
    size = F.broadcast(pixels.groupBy("img").agg(F.expr("(max(r) + 1) div 2").alias("h"), F.expr("(max(c) + 1) div 2").alias("w")))  # a row an image
    rows = pixels.join(size, "img")
    part = F.when(F.col("r") >= F.col("h"), 2).otherwise(0) + F.when(F.col("c") >= F.col("w"), 1).otherwise(0)
    view = F.element_at(F.array(*[F.lit(order.index(k)) for k in range(4)]), part + 1).cast("long")
    inside = (F.col("r") < 2 * F.col("h")) & (F.col("c") < 2 * F.col("w"))
    return rows.where(inside).select("img", view.alias("view"), (F.col("r") % F.col("h")).alias("r"), (F.col("c") % F.col("w")).alias("c"), "g")


def negative(pixels: DataFrame) -> DataFrame:
    return pixels.select("img", "r", "c", (255 - F.col("g")).alias("g"))


def subtract(pixels: DataFrame, other: DataFrame) -> DataFrame:
    """Image minus another of the same numbers, clipped at zero."""
    return pixels.join(other.withColumnRenamed("g", "o"), ["img", "r", "c"]).select("img", "r", "c", F.greatest(F.col("g") - F.col("o"), F.lit(0)).alias("g"))


def subtract_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Image that is 0 where the mask (r, c, m) is."""
    return pixels.join(mask, ["r", "c"], "left").select("img", "r", "c", F.when(F.coalesce("m", F.lit(1)) == 0, 0).otherwise(F.col("g")).alias("g"))


def background(pixels: DataFrame, median: bool = True, factor: float = 3.0, bright: bool = True) -> DataFrame:
    """(r, c, g, unstable): median or mean of every pixel over time; pixels whose deviation exceeds factor times the median one of all take the smallest value
    instead (the largest where bubbles are dark)."""
    middle = F.expr("percentile(g, 0.5)") if median else F.avg("g")
    each = pixels.groupBy("r", "c").agg(middle.cast("double").alias("m"), F.stddev_pop("g").alias("s"), (F.min("g") if bright else F.max("g")).cast("double").alias("end"))
    cutoff = (quantile(each, F.col("s"), 0.5) or 0.0) * factor
    unstable = F.col("s") > cutoff
    return each.select("r", "c", F.when(unstable, F.col("end")).otherwise(F.col("m")).alias("g"), unstable.alias("unstable"))


def subtract_background(pixels: DataFrame, low: DataFrame, bright: bool = True) -> DataFrame:
    """Image less background, or background less image where bubbles are dark, clipped at zero."""
    joined = pixels.join(low.select("r", "c", F.col("g").alias("low")), ["r", "c"])
    gap = F.col("g") - F.col("low") if bright else F.col("low") - F.col("g")
    return joined.select("img", "r", "c", F.greatest(gap, F.lit(0.0)).alias("g"))


def threshold_centroid(pixels: DataFrame, above: int) -> DataFrame:
    """Of the pixels brighter than a threshold in each image: how many, their sum and the grey-weighted centre (x along c, y along r)."""
    bright, g = pixels.where(F.col("g") > above), F.col("g")
    centre = lambda c: F.round(F.sum(F.col(c) * g) / F.sum(g), 6)
    return bright.groupBy("img").agg(F.count("*").alias("pixels"), F.sum(g).alias("sumg"), centre("c").alias("x"), centre("r").alias("y"))


def scale_bytes(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Grey values of a range as bytes, clipped and cut to whole numbers."""
    return pixels.select("img", "r", "c", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("g") - low) / (high - low) * 255.0))).cast("long").alias("g"))


def suggest_range(pixels: DataFrame, percentiles=(0.5, 99.9)) -> DataFrame:
    """(img, low, high): a range of grey for each image. An image's percentiles are one group, which the sensor bounds."""
    low, high = (F.expr(f"percentile(g, {p / 100})") for p in percentiles)
    return pixels.groupBy("img").agg(F.floor(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high"))


def _array(rows) -> np.ndarray:
    out = np.zeros((int(rows["r"].max()) + 1, int(rows["c"].max()) + 1), dtype=rows["g"].dtype)
    out[rows["r"].to_numpy(), rows["c"].to_numpy()] = rows["g"].to_numpy()
    return out


def targets(pixels: DataFrame, threshold: int, discontinuity: int = 10_000, limits: dict | None = None, how: str = "grow") -> DataFrame:
    """(img, pnr, x, y, n, nx, ny, sumg, tnr): targets of every image, one task each; how: grow, components or peaks (segmentation)."""

    def run(rows):
        import pandas as pd

        img = _array(rows)
        found = segmentation.grow(img, threshold, discontinuity, limits or {}) if how == "grow" else getattr(segmentation, how)(img, threshold, limits or {})
        out = pd.DataFrame(found, columns=list(segmentation.COLUMNS))
        return out.assign(img=rows["img"].iloc[0], pnr=range(len(out)), tnr=-1)[["img", "pnr", *segmentation.COLUMNS, "tnr"]]

    return pixels.groupBy("img").applyInPandas(run, "img long, pnr long, x double, y double, n long, nx long, ny long, sumg long, tnr long")


def bubbles(pixels: DataFrame, **more) -> DataFrame:
    """(img, x, y, n): bubbles of every image by local contrast."""

    def run(rows):
        import pandas as pd

        return pd.DataFrame(segmentation.bubbles(_array(rows), **more), columns=["x", "y", "n"]).assign(img=rows["img"].iloc[0])[["img", "x", "y", "n"]]

    return pixels.groupBy("img").applyInPandas(run, "img long, x double, y double, n long")


def plate_targets(pixels: DataFrame, threshold: int, limits: dict | None = None, coded: float = 4.0) -> DataFrame:
    """Targets of a calibration plate with coded: whether a dot's area exceeds `coded` times the median one of its image."""
    rows = targets(pixels, threshold, limits=limits, how="components")
    middle = F.percentile("n", F.lit(0.5)).over(Window.partitionBy("img"))
    return rows.withColumn("coded", F.col("n") > coded * middle)


def read_images(spark, paths) -> DataFrame:
    """Pixel table of binary portable graymaps (P5, 8 or 16 bits): img counts files by path."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                head, at = [], 0
                while len(head) < 4:
                    end = raw.index(b"\n", at)
                    line = raw[at:end].split(b"#")[0]
                    head += line.split()
                    at = end + 1
                w, h, most = (int(v) for v in head[1:4])
                img = np.frombuffer(raw, ">u2" if most > 255 else "u1", w * h, at).reshape(h, w)
                r, c = np.divmod(np.arange(w * h), w)
                yield pd.DataFrame({"path": path, "r": r, "c": c, "g": img.ravel().astype("int64")})

    files = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, r long, c long, g long")
    names = files.select("path").distinct().withColumn("img", F.row_number().over(Window.orderBy("path")).cast("long") - 1)  # a row a file
    return files.join(F.broadcast(names), "path").select("img", "r", "c", "g")
