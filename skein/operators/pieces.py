"""Whole tracks as groups: smoothing, robust fits, and joining the pieces of broken tracks. A track is one group, bounded by the frames of a run.

Tracks are rows (trajid, frame, x, y, z[, weight]).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.engines import curves
from skein.operators import linking
from skein.operators.linkage import AXES
from skein.operators.points import components
from skein.shared import kept, quantile

XYZ = list(AXES)


def _weighted(tracks: DataFrame) -> DataFrame:
    return tracks.select("trajid", "frame", *AXES, F.col("weight") if "weight" in tracks.columns else F.lit(1.0).alias("weight"))


def over_tracks(tracks: DataFrame, run, schema: str, together: bool = False) -> DataFrame:
    """run(trajid, frames, positions, weights) of each whole track, its points in order of frame: a dict of arrays or lists as `schema` names them, or None for no rows.

    together: run takes all tracks of a batch that have equally many points at once, a list of trajids and arrays with an axis of tracks in front.

    Tracks lie together in sorted partitions and are taken from batches of Arrow; one whose rows go on in the next batch waits for them. So a short track costs
    its own arithmetic alone, and a task holds a batch and one track.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(schema)

    def task(batches):
        import pyarrow as pa

        kinds = to_arrow_schema(fields)

        def keys(b):
            return b.column("trajid").fill_null(0).to_numpy(zero_copy_only=False), b.column("trajid").is_null().to_numpy(zero_copy_only=False)

        def done(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            if not rows.num_rows:
                return
            rows = rows.to_batches()[0]
            ids, none = keys(rows)
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))
            t, w = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("frame", "weight"))
            x = np.stack([rows.column(a).to_numpy(zero_copy_only=False).astype(float) for a in AXES], 1)
            out = {k: [] for k in kinds.names}
            size = np.diff(np.append(first, len(ids)))
            name = lambda i: None if none[i] else int(ids[i])
            if together:
                equal = [(first[size == n], first[size == n][:, None] + np.arange(n)) for n in np.unique(size)]
                results = (run([name(i) for i in at.tolist()], t[of], x[of], w[of]) for at, of in equal)
            else:
                results = (run(name(i), t[i : i + n], x[i : i + n], w[i : i + n]) for i, n in zip(first.tolist(), size.tolist()))
            for found in results:
                if found is not None:
                    for k, v in found.items():
                        out[k] += v.tolist() if isinstance(v, np.ndarray) else v
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

        parts, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ids, none = keys(b)
            change = np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1
            if len(change) or (parts and (ids[0], none[0]) != last):
                cut = int(change[-1]) if len(change) else 0
                yield from done([*parts, b.slice(0, cut)])
                parts = [b.slice(cut)]
            else:
                parts.append(b)
            last = (ids[-1], none[-1])
        if parts:
            yield from done(parts)

    rows = _weighted(tracks).select(F.col("trajid").cast("long"), F.col("frame").cast("long"), *[F.col(c).cast("double") for c in (*AXES, "weight")])
    return rows.repartition("trajid").sortWithinPartitions("trajid", F.col("frame").asc_nulls_last()).mapInArrow(task, fields)


def _named(trajid: int | None, t: np.ndarray) -> dict:
    return {"trajid": [trajid] * len(t), "frame": [int(v) if v == v else None for v in t.tolist()]}


def smooth(tracks: DataFrame, fps: float = 1.0, window: int = 9, order: int = 3, least: int = 5) -> DataFrame:
    """Positions, velocities and accelerations by weighted local polynomials in windows that shift inward at a track's ends; shorter tracks than `least` are left out."""

    def run(trajid, t, x, weight):
        found = curves.smooth(t, x, weight, fps, window, order, least)
        if found is None:
            return None
        return _named(trajid, t) | {c: v[:, k] for v, names in zip(found, (XYZ, "uvw", ("ax", "ay", "az"))) for k, c in enumerate(names)}

    return over_tracks(tracks, run, "trajid long, frame long, x double, y double, z double, u double, v double, w double, ax double, ay double, az double")


def leave_one_out(tracks: DataFrame, window: int = 9, order: int = 2, least: int = 5) -> DataFrame:
    """(trajid, frame, x, y, z, support): where a point's neighbours in its track say that it is; null in tracks of fewer than `least` points."""

    def run(trajid, t, x, weight):
        at, support = curves.leave_one_out(t, x, weight, window, order, least)
        return _named(trajid, t) | {a: at[:, k] for k, a in enumerate(AXES)} | {"support": support}

    out = over_tracks(tracks, run, "trajid long, frame long, x double, y double, z double, support double")
    return out.withColumns({a: F.when(~F.isnan(a), F.col(a)) for a in AXES})


def robust(tracks: DataFrame, rounds: int = 3) -> DataFrame:
    """(trajid, frame, weight, residual): each point's weight in its track's robust cubic, and the track's residual."""

    def run(trajid, t, x, _):
        weight = curves.robust_weights(x, rounds)
        return _named(trajid, t) | {"weight": weight, "residual": [curves.robust_residual(x, rounds, weight)] * len(t)}

    return over_tracks(tracks.drop("weight"), run, "trajid long, frame long, weight double, residual double")


def predict_next(tracks: DataFrame, window: int = 6, degree: int = 2) -> DataFrame:
    """(trajid, frame, x, y, z, u, v, w, residual): where each track would be in the frame after its last, and how fast."""

    def run(ids, t, x, _):
        at, v, r = curves.predict_all(t[:, -window:], x[:, -window:], t[:, -1] + 1, window, degree)
        return {"trajid": ids, "frame": [int(n) + 1 for n in t[:, -1]], "residual": r} | {c: n for c, n in zip((*XYZ, *"uvw"), (*at.T, *v.T), strict=True)}

    return over_tracks(tracks.drop("weight"), run, "trajid long, frame long, x double, y double, z double, u double, v double, w double, residual double", together=True)


def ends(tracks: DataFrame, n: int = 10, degree: int = 1, least: int = 4) -> DataFrame:
    """A row a track of `least` points or more: first and last frame and point, coefficients of the polynomials through both ends, and their residuals."""

    def run(ids, t, x, _):
        if t.shape[1] < least:
            return None
        (c0, _, s0), (c1, _, s1) = curves.end_fits(t, x, False, n, degree), curves.end_fits(t, x, True, n, degree)
        flat = lambda c: c.reshape(len(c), -1).tolist()
        return {"trajid": ids, "f0": [int(v) for v in t[:, 0]], "f1": [int(v) for v in t[:, -1]], "p0": flat(x[:, 0]), "p1": flat(x[:, -1]), "c0": flat(c0), "c1": flat(c1), "s0": s0, "s1": s1}

    return over_tracks(tracks.drop("weight"), run, "trajid long, f0 long, f1 long, p0 array<double>, p1 array<double>, c0 array<double>, c1 array<double>, s0 double, s1 double", together=True)


def _at(coefficients: str, dt, degree: int) -> list:
    """Position of a polynomial, its coefficients flat by power."""
    return [sum((F.get(coefficients, F.lit(3 * p + a)) * (dt**p if p else 1.0) for p in range(degree + 1)), F.lit(0.0)) for a in range(3)]


def _apart(a: list, point: str):
    d = [x - F.get(point, F.lit(k)) for k, x in enumerate(a)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def relabel(joins: DataFrame) -> DataFrame:
    """(trajid, head): the first track of each chain of joins (a, b), in which each track is joined at most once at either end."""
    return components(joins).select(F.col("node").alias("trajid"), F.col("comp").alias("head"))


def reconnect(tracks: DataFrame, max_gap: int = 4, sigmas: float = 4.0, n: int = 10, degree: int = 1, least: int = 4) -> DataFrame:
    """(a, b): ends of tracks joined to later starts up to max_gap frames on.

    A curve through the end, drawn forward, and one through the start, drawn back, must both land within sigmas * noise * (1 + (gap - 1) / 2); best first by
    the sum of both misses over that, each end and start once. The noise is the median residual of all ends. Starts meet ends by the frames between, an equi-join.
    """
    found = kept(ends(tracks, n, degree, least))
    noise = quantile(found.select(F.col("s0").alias("s")).union(found.select("s1")), F.col("s"), 0.5)
    noise = max(noise or 0.0, 1e-6)
    near = found.withColumn("gap", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max_gap).cast("long")))).select(F.col("trajid").alias("a"), "f1", "p1", "c1", "gap", (F.col("f1") + F.col("gap")).alias("f0"))
    # place: the cells that the end's reach touches when it is drawn to the start's frame; they are wider than the reach, so mostly one or two an axis
    reach = sigmas * noise * (1 + 0.5 * (max_gap - 1)) * 1.001
    cell = lambda x: F.floor(x / (4 * reach)).cast("long")
    there = _at("c1", F.col("f0") - F.col("f1"), degree)
    near = near.select("*", *[x.alias(f"e{k}") for k, x in enumerate(there)]).where(" AND ".join(f"abs(e{k}) < double('infinity')" for k in range(3)))
    for k in range(3):
        near = near.withColumn(f"q{k}", F.explode(F.sequence(cell(F.col(f"e{k}") - reach), cell(F.col(f"e{k}") + reach))))
    starts = found.select(F.col("trajid").alias("b"), "f0", "p0", "c0", *[cell(F.get("p0", F.lit(k))).alias(f"q{k}") for k in range(3)])
    pairs = near.join(starts.hint("merge"), ["f0", "q0", "q1", "q2"]).where("a <> b")
    e1 = _apart([F.col(f"e{k}") for k in range(3)], "p0")
    e2 = _apart(_at("c0", F.col("f1") - F.col("f0"), degree), "p1")
    tol = sigmas * noise * (1 + 0.5 * (F.col("gap") - 1))
    good = pairs.select("a", "b", e1.alias("e1"), e2.alias("e2"), tol.alias("tol")).where("e1 < tol AND e2 < tol")
    edges = good.select(F.lit(0).cast("long").alias("frame"), F.struct(F.col("a").alias("t")).alias("i"), F.struct(F.col("b").alias("t")).alias("k"), ((F.col("e1") + F.col("e2")) / F.col("tol")).alias("cost"))
    return linking.greedy(edges).select(F.col("i.t").alias("a"), F.col("k.t").alias("b"))


def reconnected(tracks: DataFrame, joins: DataFrame) -> DataFrame:
    """Tracks with the trajid of the first piece of their chain."""
    return tracks.join(relabel(joins), "trajid", "left").withColumn("trajid", F.coalesce("head", "trajid")).drop("head")


def stitch(tracks: DataFrame, max_gap: int = 2, tol: float = 5.0, cosine: float = 0.8, residual: float = 2.0) -> DataFrame:
    """(a, b, gap): fragments joined where the end of one and the start of another up to max_gap frames later lie within tol + speed * gap, their mean velocities
    agree (cosine, where both move), and the acceleration residual of both together stays within `residual`; cheapest first by distance + residual, each end once."""
    w = Window.partitionBy("trajid").orderBy("frame")
    rows = tracks.select("trajid", "frame", *AXES, *[(F.lead(a).over(w) - 2 * F.col(a) + F.lag(a).over(w)).alias(f"a{a}") for a in AXES])
    square = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")
    at = lambda f, n: f(F.struct("frame", *AXES)).alias(n)
    order = F.sort_array(F.collect_list(F.struct("frame", *AXES)))
    info = rows.groupBy("trajid").agg(F.count("*").alias("n"), at(F.min, "p"), at(F.max, "q"), F.coalesce(F.sum(square), F.lit(0.0)).alias("ss"), order.alias("_all"))
    info = info.select("trajid", "n", "p", "q", "ss", F.get("_all", F.lit(1)).alias("p2"), F.get("_all", F.size("_all") - 2).alias("q2"))
    span = F.col("q.frame") - F.col("p.frame")
    info = kept(info.select("*", *[F.when(span > 0, (F.col(f"q.{a}") - F.col(f"p.{a}")) / span).alias(f"v{a}") for a in AXES]))
    one = lambda s: info.select(F.col("trajid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in info.columns if c != "trajid"])
    left = one("a").withColumn("gap", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max_gap).cast("long")))).withColumn("f", F.col("a_q.frame") + F.col("gap"))
    vec = lambda s: [F.col(f"{s}_v{x}") for x in AXES]
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    reach = tol + F.coalesce(size(vec("a")), F.lit(1.0)) * F.col("gap")
    # place: an end is dealt to the cells that its reach touches, twice as wide as that up to a power of two, a start to its own cell of each such width
    left = left.withColumn("_r", reach * 1.001).where(" AND ".join(["abs(_r) < double('infinity')", *[f"abs(a_q.{x}) < double('infinity')" for x in AXES]]))
    left = kept(left.withColumn("_l", F.ceil(F.log2(F.greatest("_r", F.lit(1e-9)))).cast("int")))
    levels = [r["_l"] for r in left.select("_l").distinct().collect()]  # as many as powers of two between the slowest and the fastest reach
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_l") + 1)).cast("long")
    for x in AXES:
        left = left.withColumn(f"_{x}", F.explode(F.sequence(cell(F.col(f"a_q.{x}") - F.col("_r")), cell(F.col(f"a_q.{x}") + F.col("_r")))))
    starts = one("b").withColumn("f", F.col("b_p.frame")).withColumn("_l", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    starts = starts.withColumns({f"_{x}": cell(F.col(f"b_p.{x}")) for x in AXES})
    pairs = left.join(starts.hint("merge"), ["f", "_l", *[f"_{x}" for x in AXES]]).where("a <> b")
    d = [F.col(f"b_p.{x}") - F.col(f"a_q.{x}") for x in AXES]
    dot = sum((u * v for u, v in zip(vec("a"), vec("b"))), F.lit(0.0))
    moving = F.coalesce((size(vec("a")) > 1e-9) & (size(vec("b")) > 1e-9), F.lit(False))
    agree = ~moving | (dot >= cosine * size(vec("a")) * size(vec("b")))
    # second differences across the join
    over = F.lit(0.0)
    count = F.greatest(F.col("a_n") + F.col("b_n") - 2, F.lit(0))
    for x in AXES:
        first = F.when(F.col("a_n") > 1, F.col(f"b_p.{x}") - 2 * F.col(f"a_q.{x}") + F.col(f"a_q2.{x}"))
        second = F.when(F.col("b_n") > 1, F.col(f"b_p2.{x}") - 2 * F.col(f"b_p.{x}") + F.col(f"a_q.{x}"))
        over = over + F.coalesce(first * first, F.lit(0.0)) + F.coalesce(second * second, F.lit(0.0))
    rms = F.when(count > 0, F.sqrt((F.col("a_ss") + F.col("b_ss") + over) / (3 * count))).otherwise(0.0)
    good = pairs.select("a", "b", "gap", size(d).alias("d"), reach.alias("reach"), agree.alias("agree"), rms.alias("rms")).where((F.col("d") <= F.col("reach")) & F.col("agree") & (F.col("rms") <= residual))
    good = kept(good)
    edges = good.select(F.lit(0).cast("long").alias("frame"), F.struct(F.col("a").alias("t")).alias("i"), F.struct(F.col("b").alias("t")).alias("k"), (F.col("d") + F.col("rms")).alias("cost"))
    won = linking.greedy(edges).select(F.col("i.t").alias("a"), F.col("k.t").alias("b"))
    return good.join(won, ["a", "b"]).select("a", "b", "gap")


def kinks(tracks: DataFrame, angle: float = 120.0) -> DataFrame:
    """(trajid, frame): points at which a track turns by more than angle degrees, both steps longer than 1e-9; there it is to be split."""
    w = Window.partitionBy("trajid").orderBy("frame")
    p = [(F.col(a) - F.lag(a).over(w)).alias(f"p{a}") for a in AXES]
    q = [(F.lead(a).over(w) - F.col(a)).alias(f"q{a}") for a in AXES]
    rows = tracks.select("trajid", "frame", *p, *q)
    size = lambda k: F.sqrt(sum((F.col(f"{k}{a}") * F.col(f"{k}{a}") for a in AXES), F.lit(0.0)))
    dot = sum((F.col(f"p{a}") * F.col(f"q{a}") for a in AXES), F.lit(0.0))
    bad = (size("p") >= 1e-9) & (size("q") >= 1e-9) & (dot < F.lit(float(np.cos(np.radians(angle)))) * size("p") * size("q"))
    return rows.where(bad).select("trajid", "frame")


def split_at(tracks: DataFrame, at: DataFrame) -> DataFrame:
    """Tracks with piece: 0, and one more after each of the points `at`."""
    w = Window.partitionBy("trajid").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    rows = tracks.join(at.withColumn("_cut", F.lit(1)), ["trajid", "frame"], "left")
    return rows.withColumn("piece", F.coalesce(F.sum(F.coalesce("_cut", F.lit(0))).over(w), F.lit(0)).cast("long")).drop("_cut")


def stitch_robust(tracks: DataFrame, pos_tol: float = 1.0, vel_tol: float = 1.0, window: int = 6) -> DataFrame:
    """(a, b): ends of tracks of two points or more joined to starts of the next frame: the robust prediction from the last points must lie within pos_tol of the start and, where
    the start has a velocity, the velocities within vel_tol; nearest first, each end once."""
    several = tracks.groupBy("trajid").agg(F.count("*").alias("n")).where("n > 1").select("trajid")
    ahead = kept(predict_next(tracks.join(several, "trajid", "left_semi"), window))
    w = Window.partitionBy("trajid").orderBy("frame")
    step = [((F.lead(a).over(w) - F.col(a)) / (F.lead("frame").over(w) - F.col("frame"))).alias(f"s{a}") for a in AXES]
    starts = kept(tracks.select("trajid", "frame", *AXES, *step, F.row_number().over(w).alias("r")).where("r = 1").drop("r"))
    from skein.operators import spatial

    left, right = spatial.side(ahead, "i", "trajid"), spatial.side(starts, "k", "trajid")
    near = spatial.radius_join(left, right, pos_tol).where("i <> k")
    near = near.join(ahead.select(F.col("trajid").alias("i"), "u", "v", "w").hint("merge"), "i").join(starts.select(F.col("trajid").alias("k"), "sx", "sy", "sz").hint("merge"), "k")
    apart = F.sqrt((F.col("u") - F.col("sx")) * (F.col("u") - F.col("sx")) + (F.col("v") - F.col("sy")) * (F.col("v") - F.col("sy")) + (F.col("w") - F.col("sz")) * (F.col("w") - F.col("sz")))
    good = near.where(F.col("sx").isNull() | (apart <= vel_tol))
    edges = good.select(F.lit(0).cast("long").alias("frame"), F.struct(F.col("i").alias("t")).alias("i"), F.struct(F.col("k").alias("t")).alias("k"), F.sqrt("d2").alias("cost"))
    return linking.greedy(edges).select(F.col("i.t").alias("a"), F.col("k.t").alias("b"))
