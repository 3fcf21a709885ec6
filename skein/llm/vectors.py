"""Operator 2, embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import components, documents, forget, lean, small_batches, table

THRESHOLD = 0.95
#: Blocks of the rotated space.
BLOCKS = 4
#: Vectors that a leaf of a block's tree should hold, and on one side of a tile; leaves of more are cut into chunks of about as many.
TILE = 16_384
#: Vectors on which the trees' planes are fitted; they decide how even the leaves are, never which pairs are found.
SAMPLE = 20_000
SEED = 11

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def pack(x: np.ndarray) -> bytes:
    """A vector's bytes, in single precision where that is exact; the first byte tells the width. Equal vectors give equal bytes."""
    short = x.astype("<f4")
    return b"4" + short.tobytes() if (short == x).all() else b"8" + x.astype("<f8").tobytes()


def width(raw: bytes) -> int:
    """Components of a packed vector."""
    return (len(raw) - 1) // int(raw[:1])


def unpack(raw, dim: int) -> np.ndarray:
    """Packed vectors of dim components as rows in double precision."""
    out = np.empty((len(raw), dim))
    for n, r in enumerate(raw):
        out[n] = np.frombuffer(r, "<f4" if r[:1] == b"4" else "<f8", offset=1)
    return out


def _bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = [dim * k // min(blocks, dim) for k in range(min(blocks, dim) + 1)]
    return list(itertools.pairwise(edges))


class Tree:
    """Planes of a k-d tree over one block: medians of a sample, level by level, along the dimension of the largest spread. Nodes are numbered as in a heap."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth if len(sample) else 0
        self.dim, self.cut = np.zeros(2**self.depth, int), np.zeros(2**self.depth)
        node = np.ones(len(sample), int)
        for level in range(self.depth):
            for n in range(2**level, 2 ** (level + 1)):
                part = sample[node == n]
                if len(part):
                    self.dim[n] = int(part.var(0).argmax())
                    self.cut[n] = np.median(part[:, self.dim[n]])
            node = 2 * node + (sample[np.arange(len(sample)), self.dim[node]] >= self.cut[node])

    def leaf(self, y: np.ndarray) -> np.ndarray:
        node = np.ones(len(y), int)
        for _ in range(self.depth):
            node = 2 * node + (y[np.arange(len(y)), self.dim[node]] >= self.cut[node])
        return node

    def reached(self, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box lies within radius: along each dimension the largest step to the box counts, and their squares add up."""
        row, node, gap = np.arange(len(y)), np.ones(len(y), int), np.zeros((len(y), y.shape[1]))
        for _ in range(self.depth):
            d = self.dim[node]
            off = y[row, d] - self.cut[node]
            right = off >= 0
            far = gap.copy()
            far[np.arange(len(row)), d] = np.maximum(far[np.arange(len(row)), d], np.abs(off))
            ok = (far * far).sum(1) <= radius * radius * (1 + 1e-9)
            row, gap, node = np.concatenate([row, row[ok]]), np.concatenate([gap, far[ok]]), np.concatenate([2 * node + right, (2 * node + ~right)[ok]])
        return row, node


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; label points to each set's smallest member."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Links of cosine >= threshold between vectors and their components.

    Unit vectors of cosine c lie at squared distance 2 - 2c. After a random rotation, the space is cut into blocks; a close pair
    is, in one block at least, within that block's share of the squared distance, proportional to its dimensions. In every
    block a range join finds such pairs: the leaves of a k-d tree hold every vector once, and a vector also goes to each later leaf whose box lies within
    the radius; leaves and visitors are cut into tiles of bounded size, block distances come from matrix products. Candidates are verified by cosine in
    double precision. A pair belongs to the first block that finds it, so tiles return counts and spanning edges instead of pairs.
    Equal vectors are one class, aggregated first. The trees' depth follows the number of vectors; on isotropic vectors of few millions most leaves are
    still within reach of each other, so pruning sets in only with size.

    Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    of null vec_id (component null, kept); vectors link only with those of as many components; each row counts, repeated ones too; an
    empty table gives no rows; extra columns are ignored. Returns vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def clean(batches):
        import pandas as pd

        for b in batches:
            raw = []
            for v in b["embedding"]:
                x = None if v is None or len(v) == 0 else np.array([np.nan if c is None else c for c in v], dtype="<f8")
                raw.append(pack(x) if x is not None and np.isfinite(x).all() and x.any() and np.isfinite((x * x).sum()) and (x * x).sum() > 0 else None)
            yield pd.DataFrame({"vec_id": b["vec_id"], "raw": raw})

    ids = table(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInPandas(lean(clean), "vec_id long, raw binary"))
    classes = table(ids.where("raw is not null and vec_id is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")))

    n = classes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / tile))))
    share = min(1.0, sample / max(1, n))
    chosen = classes.where(F.pmod(F.xxhash64("raw"), F.lit(1_000_000)) < int(share * 1_000_000)).select("raw").limit(2 * sample).collect() if depth else []  # bounded by sample
    by_dim: dict[int, list[bytes]] = {}
    for r in chosen:
        by_dim.setdefault(width(bytes(r["raw"])), []).append(bytes(r["raw"]))

    def turned(raw, dim: int) -> np.ndarray:
        x = unpack(list(raw), dim)
        return x / np.sqrt((x * x).sum(1))[:, None] @ rotation(dim)

    trees = {}
    for dim, raw in by_dim.items():
        y = turned(raw, dim)
        trees[dim] = [Tree(y[:, lo:hi], depth) for lo, hi in _bounds(dim, blocks)]

    def cells(batches):
        import pandas as pd

        for b in batches:
            for dim, part in b.groupby(b["raw"].map(width)):
                dim = int(dim)
                y = turned(part["raw"], dim)
                for k, (lo, hi) in enumerate(_bounds(dim, blocks)):
                    tree = trees[dim][k] if dim in trees else Tree(y[:0, lo:hi], 0)
                    own = tree.leaf(y[:, lo:hi])
                    row, leaf = tree.reached(y[:, lo:hi], np.sqrt((2 - 2 * threshold) * (hi - lo) / dim))
                    ok = leaf >= own[row]
                    row, leaf = row[ok], leaf[ok]
                    for at in range(0, len(row), 20_000):
                        r, to = row[at : at + 20_000], leaf[at : at + 20_000]
                        yield pd.DataFrame({"dim": dim, "k": k, "leaf": to, "guest": (to != own[r]), "rep": part["rep"].to_numpy()[r], "members": part["members"].to_numpy()[r], "raw": part["raw"].to_numpy()[r]})

    placed = table(classes.mapInPandas(lean(cells), "dim int, k int, leaf long, guest boolean, rep long, members long, raw binary"))
    place = ["dim", "k", "leaf", "guest"]
    counted = table(placed.groupBy(*place).agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")))
    home = counted.where("not guest").select("dim", "k", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"))
    other = counted.select(*place, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    tiles = home.join(other, ["dim", "k", "leaf"]).where(F.col("guest") | (F.col("i") <= F.col("j"))).withColumn("own", ~F.col("guest") & (F.col("i") == F.col("j")))
    tiles = table(tiles.withColumn("tile", F.xxhash64("dim", "k", "leaf", "i", "guest", "j")))
    chunked = placed.join(counted, place).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).drop("chunks")
    left = tiles.select("dim", "k", "leaf", F.lit(False).alias("guest"), F.col("i").alias("chunk"), "tile", F.lit(0).alias("side"))
    right = tiles.where("not own").select(*place, F.col("j").alias("chunk"), "tile", F.lit(1).alias("side"))
    dealt = chunked.join(left.union(right), [*place, "chunk"]).select("tile", "side", "dim", "k", "rep", "members", "raw")

    def compare(part):
        import pandas as pd

        dim, k = int(part["dim"].iloc[0]), int(part["k"].iloc[0])
        bounds, limit = _bounds(dim, blocks), 2 - 2 * threshold
        part = part.sort_values(["side", "rep"], kind="stable")
        n_a = int((part["side"] == 0).sum())
        x = unpack(part["raw"].tolist(), dim)
        rep, weight = part["rep"].to_numpy(), part["members"].to_numpy()
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        turn = rotation(dim)
        lo, hi = bounds[k]
        y = (unit @ turn[:, lo:hi]).astype("float32")
        squares = (y * y).sum(1)
        own = n_a == len(x)
        other = slice(0, n_a) if own else slice(n_a, len(x))
        first = other.start
        label, links = np.arange(len(x)), np.zeros(len(x), np.int64)
        most = np.float32(limit * (hi - lo) / dim + 1e-5)
        for at in range(0, n_a, 512):
            rows = slice(at, min(at + 512, n_a))
            near = squares[rows, None] + squares[None, other] - 2 * (y[rows] @ y[other].T) <= most
            i, j = np.nonzero(near)
            i, j = i + at, j + first
            if own:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), 65536):
                p, q = i[cut : cut + 65536], j[cut : cut + 65536]
                ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[ok], q[ok]
                gap = ((unit[p] - unit[q]) @ turn) ** 2  # the first block within its budget owns the pair
                share = np.stack([gap[:, u:v].sum(1) * dim / (v - u) for u, v in bounds], 1) if len(p) else np.empty((0, len(bounds)))
                within = share <= limit + 1e-9
                mine = within.argmax(1) == k if len(p) else np.empty(0, bool)
                p, q = p[mine], q[mine]
                links += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
                label = _union(label, p, q)
        some = links > 0
        return pd.DataFrame({"a": rep[some], "b": rep[label[some]], "n": links[some]})

    found = table(dealt.groupBy("tile").applyInPandas(compare, "a long, b long, n long"))
    forget(placed, counted, tiles)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.select("a", "b")).select(F.col("node").alias("rep"), "comp")
    per_class = classes.join(counts, "rep", "left").join(labels, "rep", "left").select(
        "raw", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("comp")
    )
    # null raw and null vec_id keep out of the join; a hot class meets one row of its own
    joined = ids.alias("v").join(per_class.alias("c"), (F.col("v.raw") == F.col("c.raw")) & F.col("v.vec_id").isNotNull(), "left")
    component = F.coalesce("c.comp", "v.vec_id")
    return joined.select("v.vec_id", F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("v.vec_id").eqNullSafe(component).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embeddings": op2_embeddings}
SQL = {
    "op2_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
r(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.comp),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.comp AS component_id, vec_id = c.comp AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
