"""Queries on pixel tables, each beside its DuckDB twin. An image is a customer's block of 16 rows of 32 columns, in eight frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import images
from skein.plans.catalogue import query

FRAMES, WIDTH, HEIGHT = 8, 32, 16
_PX = f"""px AS MATERIALIZED (SELECT (c_custkey // {WIDTH * HEIGHT}) * {FRAMES} + f AS img, (c_custkey // {WIDTH}) % {HEIGHT} AS r, c_custkey % {WIDTH} AS c, (c_custkey * 7919 + f * 31) % 256 AS g FROM customer, unnest(range(0, {FRAMES})) AS t(f)
  WHERE c_custkey // {WIDTH} < (SELECT max(c_custkey) + 1 FROM customer) // {WIDTH})"""


def _pixels(spark, sf_dir):
    """Whole rows only: the customers after the last full row have no pixel."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    full = F.broadcast(rows.agg(F.expr(f"(max(k) + 1) div {WIDTH}").alias("full")))  # one row
    rows = rows.crossJoin(full).where(F.expr(f"k div {WIDTH}") < F.col("full")).withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long"))))
    return rows.select(F.expr(f"(k div {WIDTH * HEIGHT}) * {FRAMES} + f").alias("img"), F.expr(f"(k div {WIDTH}) % {HEIGHT}").alias("r"), (F.col("k") % WIDTH).alias("c"), ((F.col("k") * 7919 + F.col("f") * 31) % 256).alias("g"))


_SIZE = "z AS (SELECT img, max(r) AS mr, max(c) AS mc FROM px GROUP BY img)"


def _blur_sql(n: int) -> str:
    """The box that shrinks evenly at the edges, in two passes of whole numbers."""
    k = 2 * n + 1
    return f"""{_SIZE}, a AS (SELECT px.*, least({n}, c, mc - c) AS w, least({n}, r, mr - r) AS h FROM px JOIN z ON z.img = px.img),
b AS MATERIALIZED (SELECT a.img, a.r, a.c, any_value(a.h) AS h, CAST(sum(p.g) AS BIGINT) * {k} // (2 * any_value(a.w) + 1) AS s FROM a JOIN px p ON p.img = a.img AND p.r = a.r AND p.c BETWEEN a.c - a.w AND a.c + a.w GROUP BY a.img, a.r, a.c),
bl AS MATERIALIZED (SELECT b.img, b.r, b.c, (CAST(sum(q.s) AS BIGINT) * {k}) // {k * k} // (2 * any_value(b.h) + 1) AS g FROM b JOIN b q ON q.img = b.img AND q.c = b.c AND q.r BETWEEN b.r - b.h AND b.r + b.h GROUP BY b.img, b.r, b.c)"""


@query("box_blur", f"WITH {_PX}, {_blur_sql(2)} SELECT * FROM bl")
def box_blur(spark, sf_dir):
    return images.box_blur(_pixels(spark, sf_dir), 2)


@query("high_pass", f"WITH {_PX}, {_blur_sql(3)} SELECT px.img, px.r, px.c, greatest(px.g - bl.g, 0) AS g FROM px JOIN bl ON bl.img = px.img AND bl.r = px.r AND bl.c = px.c")
def high_pass(spark, sf_dir):
    return images.high_pass(_pixels(spark, sf_dir), 3)


_NINE = "n AS (SELECT a.img, a.r, a.c, count(*) AS n, sum(b.g) AS s, sum(b.g * CASE WHEN b.r = a.r AND b.c = a.c THEN 4 WHEN b.r = a.r OR b.c = a.c THEN 2 ELSE 1 END) AS w FROM px a JOIN px b ON b.img = a.img AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY a.img, a.r, a.c)"


@query("lowpass_3", f"WITH {_PX}, {_NINE} SELECT img, r, c, CASE WHEN n = 9 THEN CAST(s AS BIGINT) // 9 ELSE 0 END AS g FROM n")
def lowpass_3(spark, sf_dir):
    return images.lowpass_3(_pixels(spark, sf_dir))


@query("filter_3", f"WITH {_PX}, {_NINE} SELECT img, r, c, CASE WHEN n = 9 THEN greatest(8, least(255, CAST(w AS BIGINT) // 16)) ELSE 0 END AS g FROM n")
def filter_3(spark, sf_dir):
    return images.filter_3(_pixels(spark, sf_dir), ((1, 2, 1), (2, 4, 2), (1, 2, 1)))


@query("deinterlace", f"WITH {_PX}, {_SIZE} SELECT px.img, r // 2 AS r, c, g FROM px JOIN z ON z.img = px.img WHERE r % 2 = 1 AND r // 2 < (mr + 1) // 2 UNION ALL SELECT px.img, r, c, 2 FROM px JOIN z ON z.img = px.img WHERE r >= (mr + 1) // 2")
def deinterlace(spark, sf_dir):
    return images.deinterlace(_pixels(spark, sf_dir), 1)


@query("split_views", f"WITH {_PX}, {_SIZE}, h AS (SELECT px.*, (mr + 1) // 2 AS h, (mc + 1) // 2 AS w FROM px JOIN z ON z.img = px.img) SELECT img, CASE WHEN r < h AND c < w THEN 0 WHEN r < h THEN 1 WHEN c < w THEN 3 ELSE 2 END AS view, r % h AS r, c % w AS c, g FROM h WHERE r < 2 * h AND c < 2 * w")
def split_views(spark, sf_dir):
    return images.split_views(_pixels(spark, sf_dir))


@query("negative", f"WITH {_PX} SELECT img, r, c, 255 - g AS g FROM px")
def negative(spark, sf_dir):
    return images.negative(_pixels(spark, sf_dir))


@query("subtract_mask", f"WITH {_PX} SELECT img, r, c, CASE WHEN (r + c) % 3 = 0 THEN 0 ELSE g END AS g FROM px")
def subtract_mask(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    return images.subtract_mask(rows, rows.select("r", "c").distinct().withColumn("m", ((F.col("r") + F.col("c")) % 3 != 0).cast("int")))


@query("subtract_image", f"WITH {_PX} SELECT a.img, a.r, a.c, greatest(a.g - b.g, 0) AS g FROM px a JOIN px b ON b.img = a.img + 1 AND b.r = a.r AND b.c = a.c")
def subtract_image(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    return images.subtract(rows, rows.withColumn("img", F.col("img") - 1))


_BG = "e AS (SELECT r, c, CAST(median(g) AS DOUBLE) AS m, stddev_pop(g) AS s, CAST(min(g) AS DOUBLE) AS low FROM px GROUP BY r, c), k AS (SELECT median(s) * 1.05e0 AS cut FROM e), bg AS (SELECT r, c, CASE WHEN s > cut THEN low ELSE m END AS g, s > cut AS unstable FROM e, k)"


@query("estimate_background", f"WITH {_PX}, {_BG} SELECT * FROM bg")
def estimate_background(spark, sf_dir):
    return images.background(_pixels(spark, sf_dir), factor=1.05)


@query("subtract_background", f"WITH {_PX}, {_BG} SELECT px.img, px.r, px.c, greatest(px.g - bg.g, 0e0) AS g FROM px JOIN bg ON bg.r = px.r AND bg.c = px.c")
def subtract_background(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    return images.subtract_background(rows, images.background(rows, factor=1.05))


@query("threshold", f"WITH {_PX} SELECT img, count(*) AS pixels, CAST(sum(g) AS BIGINT) AS sumg, round(sum(c * g) / sum(g), 6) AS x, round(sum(r * g) / sum(g), 6) AS y FROM px WHERE g > 200 GROUP BY img")
def threshold(spark, sf_dir):
    return images.threshold_centroid(_pixels(spark, sf_dir), 200)


@query("scale_bytes", f"WITH {_PX} SELECT img, r, c, CAST(floor(least(255e0, greatest(0e0, (g - 20e0) / 200e0 * 255))) AS BIGINT) AS g FROM px")
def scale_bytes(spark, sf_dir):
    return images.scale_bytes(_pixels(spark, sf_dir), 20.0, 220.0)


@query("suggest_range", f"WITH {_PX} SELECT img, CAST(floor(quantile_cont(g, 0.005)) AS BIGINT) AS low, CAST(floor(quantile_cont(g, 0.999)) AS BIGINT) AS high FROM px GROUP BY img")
def suggest_range(spark, sf_dir):
    return images.suggest_range(_pixels(spark, sf_dir))


_COMP = """b AS MATERIALIZED (SELECT img, r, c, g FROM px WHERE g > 150), w(img, r, c, lead) AS (SELECT img, r, c, r * 1000 + c FROM b UNION SELECT n.img, n.r, n.c, w.lead FROM w JOIN b n ON n.img = w.img AND abs(n.r - w.r) + abs(n.c - w.c) = 1),
l AS (SELECT img, r, c, min(lead) AS lead FROM w GROUP BY img, r, c), t AS (SELECT l.img, lead, count(*) AS n, max(l.c) - min(l.c) + 1 AS nx, max(l.r) - min(l.r) + 1 AS ny, CAST(sum(g) AS BIGINT) AS sumg, sum(l.c * (g - 150)) / sum(g - 150) + 0.5e0 AS x, sum(l.r * (g - 150)) / sum(g - 150) + 0.5e0 AS y FROM l JOIN b USING (img, r, c) GROUP BY l.img, lead)"""


@query("target_components", f"WITH RECURSIVE {_PX}, {_COMP} SELECT img, row_number() OVER (PARTITION BY img ORDER BY lead) - 1 AS pnr, round(x, 6) AS x, round(y, 6) AS y, n, nx, ny, sumg, -1 AS tnr FROM t")
def target_components(spark, sf_dir):
    return images.targets(_pixels(spark, sf_dir), 150, how="components").withColumns({c: F.round(c, 6) for c in "xy"})


@query("plate_targets", f"WITH RECURSIVE {_PX}, {_COMP} SELECT img, round(x, 6) AS x, round(y, 6) AS y, n, n > 4 * median(n) OVER (PARTITION BY img) AS coded FROM t")
def plate_targets(spark, sf_dir):
    return images.plate_targets(_pixels(spark, sf_dir), 150).select("img", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", "coded")


@query("targ_rec")
def targ_rec(spark, sf_dir):
    """Targets grown from maxima; held against plain cases in pytest."""
    return images.targets(_pixels(spark, sf_dir), 100, 20, {"n": (1, 200)}).withColumns({c: F.round(c, 6) for c in "xy"})


@query("peak_fit")
def peak_fit(spark, sf_dir):
    return images.targets(_pixels(spark, sf_dir), 100, limits={"n": (2, 400)}, how="peaks").withColumns({c: F.round(c, 6) for c in "xy"})


@query("detect_bubbles")
def detect_bubbles(spark, sf_dir):
    return images.bubbles(_pixels(spark, sf_dir), window=7, contrast=1.5, reach=1).withColumns({c: F.round(c, 6) for c in "xy"})
