"""A run's linkage: rows (frame, id, prev, next, x, y, z). prev is the id of a point up to STEPS frames before, next one after; null where there is none.

Links are edges (frame, i, step, k): i of frame goes to k of frame + step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import spatial
from skein.shared import kept, quantile

STEPS = 3
AXES = spatial.AXES


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def _at(points: DataFrame, name: str, shift: int = 0) -> DataFrame:
    """Positions under names of one end of a link, at (frame - shift, name)."""
    return points.select((F.col("frame") - shift).alias("frame"), F.col("id").alias(name), *[F.col(a).alias(f"{name}{a}") for a in AXES])


def mutual(linkage: DataFrame, steps: int = STEPS) -> DataFrame:
    """Edges on which both ends agree: next of (frame, i) is k and prev of (frame + step, k) is i. One equi-join over steps copies of the nexts."""
    out = linkage.where("next IS NOT NULL").select("frame", F.col("id").alias("i"), F.col("next").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))).alias("step"))
    back = linkage.where("prev IS NOT NULL").select(F.col("frame").alias("to"), F.col("id").alias("k"), F.col("prev").alias("i"))
    return out.withColumn("to", F.col("frame") + F.col("step")).join(back, ["to", "i", "k"]).select("frame", "i", "step", "k")


def links(linkage: DataFrame, steps: int = STEPS) -> DataFrame:
    """Step of every next that is reciprocated, the smallest where several are."""
    return mutual(linkage, steps).groupBy("frame", "i", "k").agg(F.min("step").alias("step")).select("frame", "i", "step", "k")


def back_links(linkage: DataFrame, steps: int = STEPS) -> DataFrame:
    """The same seen from prev: (frame, k, step, i), frame that of k."""
    return mutual(linkage, steps).groupBy((F.col("frame") + F.col("step")).alias("frame"), "k", "i").agg(F.min("step").alias("step")).select("frame", "k", "step", "i")


def _span(linkage: DataFrame) -> DataFrame:
    return F.broadcast(linkage.agg(F.min("frame").alias("_first"), F.max("frame").alias("_last")))  # one row


def enforce_reciprocity(linkage: DataFrame, steps: int = STEPS) -> DataFrame:
    """Sever nexts and prevs that the other end does not return within steps; those that lead out of the run at its ends stay."""
    pairs = kept(mutual(linkage, steps))
    ahead = pairs.select("frame", F.col("i").alias("id")).distinct().withColumn("_a", F.lit(True))
    behind = pairs.select((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id")).distinct().withColumn("_b", F.lit(True))
    rows = linkage.join(ahead, ["frame", "id"], "left").join(behind, ["frame", "id"], "left").crossJoin(_span(linkage))
    good = {"next": (F.col("frame") == F.col("_last")) | F.col("_a"), "prev": (F.col("frame") == F.col("_first")) | F.col("_b")}
    return rows.withColumns({c: F.when(F.coalesce(ok, F.lit(False)), F.col(c)) for c, ok in good.items()}).select(linkage.columns)


def to_linkage(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Points with prev and next of edges of one step; an end that several edges claim takes the largest id."""
    step1 = edges.where("step = 1")
    ahead = step1.groupBy("frame", F.col("i").alias("id")).agg(F.max("k").alias("next"))
    behind = step1.groupBy((F.col("frame") + 1).alias("frame"), F.col("k").alias("id")).agg(F.max("i").alias("prev"))
    return points.join(ahead, ["frame", "id"], "left").join(behind, ["frame", "id"], "left")


def onward(edges: DataFrame, points: DataFrame, also: list[str] = ()) -> DataFrame:
    """Pairs of consecutive edges of one step i -> k -> l with kink = norm(x_l - 2 x_k + x_i) and the columns `also` of the three points."""
    one = edges.where("step = 1")
    two = one.select("frame", "i", "k").join(one.select((F.col("frame") - 1).alias("frame"), F.col("i").alias("k"), F.col("k").alias("l")), ["frame", "k"])
    for shift, name in enumerate("ikl"):
        ends = points.select((F.col("frame") - shift).alias("frame"), F.col("id").alias(name), *[F.col(c).alias(f"{name}{c}") for c in (*AXES, *also)])
        two = two.join(ends, ["frame", name])
    kink = _norm([F.col(f"l{a}") - 2 * F.col(f"k{a}") + F.col(f"i{a}") for a in AXES])
    return two.select("frame", "i", "k", "l", kink.alias("kink"), *[f"{n}{c}" for n in "ikl" for c in also])


def confirm(edges: DataFrame, points: DataFrame, tol: float, ends: bool = False, sigma: str | None = None) -> DataFrame:
    """Edges with severed: an edge of one step goes unless an onward edge of one step continues it within the kink tol.

    Edges into the last frame and those of several steps can't be judged and stay, as do dead ends unless `ends`. With the column sigma
    of points (its noise), the tolerance widens by sqrt((s_i^2 + 4 s_k^2 + s_l^2) / (6 s^2)) where that is above 1, s the median sigma; a missing sigma counts as the median.
    """
    last = points.agg(F.max("frame").alias("_last"))  # one row
    two = onward(edges, points, [sigma] if sigma else [])
    limit = F.lit(float(tol))
    if sigma:
        typical = quantile(points.where(F.col(sigma) > 0), F.col(sigma), 0.5)
        if typical:
            s = {n: F.when(F.coalesce(F.col(f"{n}{sigma}") > 0, F.lit(False)) & ~F.isnan(f"{n}{sigma}"), F.col(f"{n}{sigma}")).otherwise(F.lit(typical)) for n in "ikl"}
            limit = limit * F.greatest(F.lit(1.0), F.sqrt((s["i"] * s["i"] + 4 * s["k"] * s["k"] + s["l"] * s["l"]) / (6 * typical * typical)))
    judged = two.groupBy("frame", "i", "k").agg(F.max((F.col("kink") <= limit).cast("int")).alias("_ok"))
    rows = edges.join(judged, ["frame", "i", "k"], "left").crossJoin(F.broadcast(last))
    bad = (F.col("step") == 1) & (F.col("frame") + 1 < F.col("_last")) & F.coalesce(F.col("_ok") == 0, F.lit(ends))
    return rows.select(*edges.columns, bad.alias("severed"))


def confirm_linkage(linkage: DataFrame, tol: float, ends: bool = False) -> DataFrame:
    """Linkage without the nexts to the following frame that confirm() severs, and without the prevs they point at."""
    points = linkage.select("frame", "id", *AXES)
    there = points.select((F.col("frame") - 1).alias("frame"), F.col("id").alias("next"))
    edges = linkage.where("next IS NOT NULL").join(there, ["frame", "next"], "left_semi").select("frame", F.col("id").alias("i"), F.lit(1).cast("long").alias("step"), F.col("next").alias("k"))
    cut = kept(confirm(edges, points, tol, ends).where("severed"))
    ahead = cut.select("frame", F.col("i").alias("id")).withColumn("_a", F.lit(True))
    behind = cut.select((F.col("frame") + 1).alias("frame"), F.col("k").alias("id")).distinct().withColumn("_b", F.lit(True))
    rows = linkage.join(ahead, ["frame", "id"], "left").join(behind, ["frame", "id"], "left")
    return rows.withColumns({"next": F.when(F.col("_a").isNull(), F.col("next")), "prev": F.when(F.col("_b").isNull(), F.col("prev"))}).select(linkage.columns)


def seed_cold_start(linkage: DataFrame, dv_max: float, share: float = 0.5, ratio: float = 2.0) -> DataFrame:
    """New edges of the run's first frame, found backwards: a point of the second frame with a next but no prev is predicted at x - v; the free
    point of the first frame nearest to that is its source if it lies within share * dv_max and the second nearest is not closer than
    ratio times as far. Of several that name one source, the lowest id has it."""
    tol = share * dv_max
    first = linkage.agg(F.min("frame").alias("_f"))  # one row
    rows = linkage.crossJoin(F.broadcast(first))
    free = rows.where("frame = _f AND next IS NULL").select("frame", "id", *AXES)
    known = rows.where("frame = _f + 1 AND prev IS NULL AND next IS NOT NULL").select("frame", "id", "next", *AXES)
    after = _at(rows.where("frame = _f + 2").select("frame", "id", *AXES), "next", 1)
    wanted = known.join(after, ["frame", "next"]).select((F.col("frame") - 1).alias("frame"), F.col("id").alias("i"), *[(2 * F.col(a) - F.col(f"next{a}")).alias(f"i{a}") for a in AXES])
    near = spatial.radius_join(wanted, spatial.side(free, "k", "id"), tol * ratio)
    by = Window.partitionBy("frame", "i").orderBy("d2", "k")
    best = near.withColumn("r", F.row_number().over(by)).withColumn("d2b", F.lead("d2").over(by)).where((F.col("r") == 1) & (F.col("d2") <= tol * tol) & (F.col("d2b").isNull() | (F.col("d2b") >= ratio * ratio * F.col("d2"))))
    return best.groupBy("frame", F.col("k").alias("i")).agg(F.min("i").alias("k")).select("frame", "i", F.lit(1).cast("long").alias("step"), "k")


def with_edges(linkage: DataFrame, edges: DataFrame) -> DataFrame:
    """Linkage with next and prev of new edges set."""
    ahead = edges.select("frame", F.col("i").alias("id"), F.col("k").alias("_n"))
    behind = edges.select((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id"), F.col("i").alias("_p"))
    rows = linkage.join(ahead, ["frame", "id"], "left").join(behind, ["frame", "id"], "left")
    return rows.withColumns({"next": F.coalesce("_n", "next"), "prev": F.coalesce("_p", "prev")}).select(linkage.columns)


def relink_gaps(linkage: DataFrame, max_gap: int = 2, accel: float = 5.0, unique: float = 0.0) -> DataFrame:
    """New edges of step 2 .. max_gap + 1 that bridge missing frames.

    Gap by gap: an end (prev but no next) goes on at its velocity over its last edge, whatever that edge's step; the nearest start (next but no
    prev) gap + 1 frames on is taken if within 0.5 * accel * (gap + 1)^2 / 2, and with unique > 1 only if the second nearest is not closer
    than unique times that. Of several ends that name one start, the lowest id has it. What one gap links, the next leaves alone.
    """
    found = None
    for step in range(2, max_gap + 2):
        tol = 0.5 * accel * step * step / 2
        ends = linkage.where("next IS NULL AND prev IS NOT NULL").select("frame", F.col("id").alias("i"), F.col("prev"), *AXES)
        back = back_links(linkage).select("frame", F.col("k").alias("i"), F.col("i").alias("prev"), F.col("step").alias("_back"))
        ends = ends.join(back, ["frame", "i", "prev"], "left").withColumn("_back", F.coalesce("_back", F.lit(1))).withColumn("_pf", F.col("frame") - F.col("_back"))
        past = linkage.select(F.col("frame").alias("_pf"), F.col("id").alias("prev"), *[F.col(a).alias(f"p{a}") for a in AXES])
        ahead = ends.join(past, ["_pf", "prev"]).select((F.col("frame") + step).alias("frame"), "i", *[(F.col(a) + (F.col(a) - F.col(f"p{a}")) / F.col("_back") * step).alias(f"i{a}") for a in AXES])
        starts = linkage.where("prev IS NULL AND next IS NOT NULL").select("frame", "id", *AXES)
        near = spatial.radius_join(ahead, spatial.side(starts, "k", "id"), tol * max(1.0, unique))
        by = Window.partitionBy("frame", "i").orderBy("d2", "k")
        best = near.withColumn("r", F.row_number().over(by)).withColumn("d2b", F.lead("d2").over(by)).where((F.col("r") == 1) & (F.col("d2") <= tol * tol))
        if unique > 1:
            best = best.where(F.col("d2b").isNull() | (F.sqrt("d2b") >= unique * F.greatest(F.sqrt("d2"), F.lit(1e-9))))
        new = kept(best.groupBy("frame", "k").agg(F.min("i").alias("i")).select((F.col("frame") - step).alias("frame"), "i", F.lit(step).cast("long").alias("step"), "k"))
        found = new if found is None else found.union(new)
        linkage = kept(with_edges(linkage, new))
    return found


def chain(linkage: DataFrame) -> DataFrame:
    """Each point's parent (pf, pid): the point up to STEPS frames before that its prev names and whose next names it, the nearest frame first;
    failing that, its prev in the frame before. Points without parent are left out."""
    both = back_links(linkage).groupBy("frame", "k", "i").agg(F.min("step").alias("step")).select("frame", F.col("k").alias("id"), (F.col("frame") - F.col("step")).alias("pf"), F.col("i").alias("pid"))
    there = linkage.select((F.col("frame") + 1).alias("frame"), F.col("id").alias("prev"))
    lone = linkage.where("prev IS NOT NULL").join(there, ["frame", "prev"], "left_semi").select("frame", "id", (F.col("frame") - 1).alias("pf"), F.col("prev").alias("pid"))
    return both.union(lone.join(both, ["frame", "id"], "left_anti"))


def heads(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The head (hf, hid) of every point's chain, by pointer doubling: a chain of n points takes log2(n) joins."""
    to = F.struct(F.col("pf").alias("frame"), F.col("pid").alias("id"))
    me = F.struct("frame", "id")
    at = kept(nodes.select("frame", "id").join(parents, ["frame", "id"], "left").select(me.alias("node"), F.when(F.col("pf").isNull(), me).otherwise(to).alias("to")))
    while True:
        up = at.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = kept(at.join(up, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        at = new.select("node", "to")
        if new.where("moved").isEmpty():
            return at.select("node.frame", "node.id", F.col("to.frame").alias("hf"), F.col("to.id").alias("hid"))


def seal(linkage: DataFrame, least: int = 1) -> DataFrame:
    """Trajectory of every point: (trajid, frame, id, x, y, z), by chain(); trajectories of fewer than `least` points are left out.

    Where several points of a frame would continue one trajectory, none does; they begin new ones. Trajectories are numbered from 0 by their first
    point's frame and id.
    """
    parents = chain(linkage)
    while True:
        found = kept(heads(linkage, parents))
        clash = found.groupBy("hf", "hid", "frame").agg(F.count("*").alias("n")).where("n > 1").groupBy("hf", "hid").agg(F.min("frame").alias("frame"))
        bad = kept(found.join(clash, ["hf", "hid", "frame"]).select("frame", "id"))
        if bad.isEmpty():
            break
        parents = kept(parents.join(bad, ["frame", "id"], "left_anti"))
    return _numbered(found, linkage, least)


def _numbered(found: DataFrame, points: DataFrame, least: int) -> DataFrame:
    own = found.where("frame = hf AND id = hid").select("hf", "hid")
    before = own.groupBy("hf").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("hf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("hf", "before")  # a row a frame
    numbers = own.withColumn("r", F.row_number().over(Window.partitionBy("hf").orderBy("hid")) - 1).join(before, "hf").select("hf", "hid", (F.col("before") + F.col("r")).cast("long").alias("trajid"))
    rows = found.join(numbers, ["hf", "hid"]).select("trajid", "frame", "id")
    if least > 1:
        rows = rows.join(rows.groupBy("trajid").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("trajid"), "trajid")
    return rows.join(points.select("frame", "id", *AXES), ["frame", "id"]).select("trajid", "frame", "id", *AXES)


def source_hash(linkage: DataFrame) -> DataFrame:
    """One row (rows, digest): a hash of all rows whatever their order; sums of row hashes add up map-side."""
    each = F.xxhash64("frame", "id", F.coalesce("prev", F.lit(-1)), F.coalesce("next", F.lit(-2)), *AXES)
    parts = [F.sum(F.shiftrightunsigned(each, s).bitwiseAND(F.lit(0xFFFF))).alias(f"s{s}") for s in (0, 16, 32, 48)]
    return linkage.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws(",", *[f"s{s}" for s in (0, 16, 32, 48)], "rows"), 256).alias("digest"))


def prune_kinks(linkage: DataFrame, max_accel: float, max_angle: float = 0.0) -> DataFrame:
    """Edges (frame, i, step, k) to break at velocity jumps, walking each chain of mutual edges from its head.

    At a point with both edges intact the velocities differ by acc. It is a kink if acc > max_accel and the angle is above max_angle degrees (always bad where
    max_angle is 0 or a speed vanishes) or acc > 1.5 max_accel. Its onward edge breaks; the edge before breaks instead if its first point has no edge
    before it, the onward edge's end has one after it, and the speed before is above 1.5 times that after. A point whose edge before is broken isn't judged.
    A chain is one row's array, so its length is bounded by the frames of a run.
    """
    one = kept(links(linkage))
    nodes = linkage.select("frame", "id", *AXES)
    parents = one.select((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id"), F.col("frame").alias("pf"), F.col("i").alias("pid"))
    rows = heads(nodes, parents).join(nodes, ["frame", "id"])
    track = Window.partitionBy("hf", "hid").orderBy("frame")
    dt1, dt2 = F.col("frame") - F.lag("frame").over(track), F.lead("frame").over(track) - F.col("frame")
    v1 = [(F.col(a) - F.lag(a).over(track)) / dt1 for a in AXES]
    v2 = [(F.lead(a).over(track) - F.col(a)) / dt2 for a in AXES]
    steps = rows.select("hf", "hid", "frame", "id", *[c.alias(f"p{a}") for c, a in zip(v1, AXES)], *[c.alias(f"q{a}") for c, a in zip(v2, AXES)])
    p, q = [F.col(f"p{a}") for a in AXES], [F.col(f"q{a}") for a in AXES]
    n1, n2, acc = _norm(p), _norm(q), _norm([y - x for x, y in zip(p, q)])
    cosine = (p[0] * q[0] + p[1] * q[1] + p[2] * q[2]) / (n1 * n2)
    turned = F.when((n1 > 1e-9) & (n2 > 1e-9) & F.lit(max_angle > 0), cosine < F.cos(F.radians(F.lit(float(max_angle))))).otherwise(True)
    kink = F.coalesce((acc > max_accel) & (turned | (acc > 1.5 * max_accel)), F.lit(False))
    fast = F.coalesce(n1 > 1.5 * F.greatest(n2, F.lit(1e-9)), F.lit(False))
    raw = linkage.select("frame", "id", F.col("prev").isNotNull().alias("from"), F.col("next").isNotNull().alias("on"))
    flags = steps.join(raw, ["frame", "id"]).select("hf", "hid", F.struct("frame", "id", kink.alias("kink"), fast.alias("fast"), "from", "on").alias("r"))
    whole = flags.groupBy("hf", "hid").agg(F.sort_array(F.collect_list("r")).alias("rs")).where("exists(rs, r -> r.kink)")
    size = F.size("rs")

    def walk(state: Column, n: Column) -> Column:
        # state: has the point before an edge before it, is the edge to this point intact, is this point's edge broken here
        here, came = F.get("rs", n), state["intact"]
        judged = (n > 0) & (n < size - 1) & came & here["kink"]
        leading = judged & ~state["before"] & F.get("rs", n + 1)["on"] & here["fast"]
        return F.struct(F.when(n == 0, here["from"]).otherwise(came & ~leading).alias("before"), (~(judged & ~leading)).alias("intact"), F.concat(state["cut"], F.when(leading, F.array(n - 1)).when(judged, F.array(n)).otherwise(F.array().cast("array<int>"))).alias("cut"))

    start = F.struct(F.lit(False).alias("before"), F.lit(False).alias("intact"), F.array().cast("array<int>").alias("cut"))
    cut = F.aggregate(F.sequence(F.lit(0), size - 1), start, walk, lambda s: s["cut"])
    broken = whole.select(F.explode(cut).alias("n"), "rs").select(F.get("rs", F.col("n")).alias("a"), F.get("rs", F.col("n") + 1).alias("b"))
    return broken.select("a.frame", F.col("a.id").alias("i"), (F.col("b.frame") - F.col("a.frame")).alias("step"), F.col("b.id").alias("k"))


def without_edges(linkage: DataFrame, edges: DataFrame) -> DataFrame:
    """Linkage with the next and prev of these edges cleared."""
    ahead = edges.select("frame", F.col("i").alias("id")).distinct().withColumn("_a", F.lit(True))
    behind = edges.select((F.col("frame") + F.col("step")).alias("frame"), F.col("k").alias("id")).distinct().withColumn("_b", F.lit(True))
    rows = linkage.join(ahead, ["frame", "id"], "left").join(behind, ["frame", "id"], "left")
    return rows.withColumns({"next": F.when(F.col("_a").isNull(), F.col("next")), "prev": F.when(F.col("_b").isNull(), F.col("prev"))}).select(linkage.columns)


def stitch_chunks(results: DataFrame) -> DataFrame:
    """One linkage of chunks tracked apart: rows (chunk, v_first, v_last, frame, id, prev, next) with overlaps beyond each valid range.

    Rows of the valid range count; at its first frame prev comes from the chunk before, at its last next from the chunk after, if these hold the frame.
    """
    own = results.where("frame BETWEEN v_first AND v_last")
    left = results.select((F.col("chunk") + 1).alias("chunk"), "frame", "id", F.col("prev").alias("_prev"), F.lit(True).alias("_l"))
    right = results.select((F.col("chunk") - 1).alias("chunk"), "frame", "id", F.col("next").alias("_next"), F.lit(True).alias("_r"))
    rows = own.join(left, ["chunk", "frame", "id"], "left").join(right, ["chunk", "frame", "id"], "left")
    prev = F.when((F.col("frame") == F.col("v_first")) & F.col("_l"), F.col("_prev")).otherwise(F.col("prev"))
    next_ = F.when((F.col("frame") == F.col("v_last")) & F.col("_r"), F.col("_next")).otherwise(F.col("next"))
    return rows.select("frame", "id", prev.alias("prev"), next_.alias("next"))


def chunks(first: int, last: int, parts: int, overlap: int = 4) -> list[tuple[int, int, int, int]]:
    """(begin, end, valid first, valid last) of near equal chunks of frames with overlaps; one chunk where the run is too short to cut."""
    total = last - first + 1
    if total <= 0:
        return []
    parts = min(parts, max(1, total // (overlap + 2)))
    if parts <= 1 or total <= overlap + 2:
        return [(first, last, first, last)]
    cuts = [first + round(n * total / parts) for n in range(parts + 1)]
    return [(max(first, a - overlap), min(last, b - 1 + overlap), a, b - 1) for a, b in zip(cuts, cuts[1:])]
