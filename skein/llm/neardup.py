"""Operator 7, MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import components, documents, forget, lean, mix, small_batches, store, table, utf8

WORDS = 5
PERCENT = 75
#: Bands and rows of each: a pair of similarity 0.75 shares no band with probability (1 - 0.75**5)**50 = 1.3e-6.
BANDS, ROWS = 50, 5
#: How often a star whose hub belongs to another star joins that one.
HOPS = 2
#: Members of a star that one copy of its hub's set is held against; hubs of more are copied.
SHARE = 512
STORE = 100_000

_U = np.uint64
_MULT = mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; a text of fewer words is one shingle; none for no words."""
    import xxhash

    known = store("shingles")
    if len(known) > STORE:
        known.clear()
    ids = []
    for w in text.lower().split():  # bytes: A-Z only are lowered, ASCII white space only separates
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    if not ids:
        return np.empty(0, _U)
    h = np.array(ids, dtype=_U)
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, _U(len(h) if len(h) < n else n), _U)
    for k in range(size):
        total += h[k : len(h) - size + 1 + k] * _MULT[k]
    return np.unique(mix(total))


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: in round i < size, each item falls into a hashed bin; in round size + j, into bin j.

    A bin keeps the smallest (round, hash), so that later rounds only matter for bins still empty, and all bins are full after
    2 * size rounds. Rounds run in blocks; one block more than needed changes nothing.
    """
    best = np.full(size, np.iinfo(np.uint64).max, _U)
    at, block = 0, max(1, min(size, math.ceil(1.3 * size * math.log(size) / len(items))))
    while at < 2 * size:
        rounds = np.arange(at, min(at + block, 2 * size), dtype=_U)
        h = mix(items[None, :] + (rounds[:, None] + _U(1)) * _U(0x9E3779B97F4A7C15))
        bins = np.where(rounds[:, None] < size, (h & _U(0xFFFFFFFF)) % _U(size), rounds[:, None] % _U(size))
        value = (rounds[:, None] << _U(48)) | (h >> _U(16))
        np.minimum.at(best, bins.ravel().astype(np.intp), value.ravel())
        at += block
        if best.max() >> _U(48) < at:  # no bin is empty
            break
    return best


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of the sketch."""
    s = mix(sketch(items, bands * rows)).reshape(bands, rows)
    total = np.arange(bands, dtype=_U) * _U(0xD6E8FEB86659FD93)
    for k in range(rows):
        total = mix(total + s[:, k] * _MULT[k])
    return total


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (fingerprint of the set), keys (one a band; null for an empty set)."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            size, f1, f2, keys = [], [], [], []
            for x in utf8(b.column("text")):
                s = shingles(x, n)
                size.append(len(s))
                f1.append(int(s.sum(dtype=_U).astype(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(mix(s ^ _U(0x5851F42D4C957F2D)), initial=_U(0)).astype(np.int64)))
                keys.append(band_keys(s, bands, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n long, f1 long, f2 long, keys array<long>")


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Hold pairs (a, b) against each other: adds ok, i (size of the intersection) and rest (elements of b that a lacks).

    Whole shingle sets are built again from the texts of the documents in question.
    """
    import pyarrow as pa

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def squeeze(batches):
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([tool.compress(x) for x in utf8(b.column("text"))], pa.binary())], ["doc_id", "z"])

    def build(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingles(tool.decompress(x), n).tobytes() for x in b.column("z").to_pylist()], pa.binary())], ["doc_id", "s"])

    # texts travel compressed, and by the same join at every size
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL").mapInArrow(lean(squeeze), "doc_id long, z binary")
    sets = table(texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(lean(build), "doc_id long, s binary"))

    def hold(batches):
        for x in batches:
            ok, inside, rest = [], [], []
            for p, q in zip(*(c.to_pylist() for c in (x.column("s1"), x.column("s2")))):
                p, q = np.frombuffer(p, _U), np.frombuffer(q, _U)
                has = p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q
                i = int(has.sum())
                inside.append(i)
                ok.append(100 * i >= percent * (len(p) + len(q) - i))
                rest.append(q[~has].view(np.int64))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(ok, pa.bool_()), pa.array(inside, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "ok", "i", "rest"])

    # a hub with many members is no hot key: its set is copied, a copy for each SHARE members
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("n"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "n").cast("int")).drop("n")
    hubs = parts.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s1")), "a").select("a", "s1", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s2")), "b").join(hubs, ["a", "part"])
    return both.select("a", "b", "s1", "s2").mapInArrow(lean(hold), "a long, b long, ok boolean, i long, rest array<long>")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, hops: int = HOPS) -> DataFrame:
    """Components of documents whose sets of n-word shingles have Jaccard similarity of percent or more. Shingles are compared by 64-bit hashes.

    1. Every whole text gives its set's fingerprint and the band keys of a fast similarity sketch.
    2. Documents of equal sets form a class, aggregated before anything is shuffled by key; only its smallest doc_id goes on.
    3. Representatives that share a band key are candidates. Buckets are not expanded into pairs. Each proposes its
       best-connected member as hub; members gather in stars around the hub that most of their buckets propose and are held
       against it only. Two members of a star that are not both linked to its hub can only be similar if they share enough
       elements beyond the hub's (found by a prefix-filtered join on these elements) or if what each shares with
       the hub is enough by itself; both bounds are exact. Members of different stars are compared where they share a bucket.
    4. Links are confirmed on full sets; components come from distributed label propagation.

    Defined results: null, empty and word-free texts have n_shingles 0 and link with nothing; a null doc_id links with
    nothing, has a null component and is kept; rows of one doc_id are one node; repeated rows are all returned; an
    empty table gives no rows; extra columns are ignored. Returns doc_id, n_shingles, component_id, kept.
    """
    spark = docs.sparkSession
    signed = table(_signatures(docs, n, bands, rows))
    able = signed.where("n > 0 and doc_id is not null")
    classes = table(able.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    same = able.where("keys is not null").select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "f1", "f2")
    entries = able.join(reps, ["doc_id", "n", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "n", "f1", "f2"]).select("doc_id", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = table(entries.join(shared, "key").select("key", F.col("doc_id").alias("x"), "n"))

    # stars: of the members of a bucket, the one that meets most others is its hub; a member goes to the hub of most of its buckets
    sizes = members.groupBy("key").agg(F.count("*").alias("c"))
    degree = members.join(sizes, "key").groupBy("x").agg(F.sum("c").alias("degree"))
    ranked = table(members.join(degree, "x"))
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "x")).alias("hub")).select("key", F.col("hub.x").alias("a"), F.col("hub.degree").alias("ad"))
    met = ranked.join(hubs, "key").groupBy("x", "n", "a", "ad").agg(F.count("*").alias("c"))
    stars = table(met.groupBy("x", "n").agg(F.max_by("a", F.struct("c", "ad", "a")).alias("a")))
    for _ in range(hops):
        up = stars.select(F.col("x").alias("a"), F.col("a").alias("a2"))
        stars = table(stars.join(up, "a").select("x", "n", F.col("a2").alias("a")))

    held = table(_verify(stars.where("x <> a").select("a", F.col("x").alias("b")), docs, n, percent))
    links = held.where("ok").select("a", "b")
    comps = components(links).select(F.col("node").alias("x"), "comp")
    judged = held.select(F.col("a").alias("ha"), F.col("b").alias("hb"), "ok", "i", "rest")
    of = (F.col("a") == F.col("ha")) & (F.col("x") == F.col("hb"))
    star = stars.join(judged, of, "left").join(comps, "x", "left").select("x", "n", "a", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("i", "n").alias("i"), F.coalesce("comp", "x").alias("comp"), "rest")
    star = table(star)
    y = lambda frame, *also: frame.select(*[F.col(c).alias(f"y_{c}") for c in ("x", "n", "i", "comp")], *also)
    apart = (F.col("x") != F.col("y_x")) & (F.col("comp") != F.col("y_comp")) & (F.least("n", "y_n") * 100 >= F.greatest("n", "y_n") * percent)

    # same star, not both linked to the hub: what two members share beyond the hub, or a bound on what they share within it
    open_ = star.where("not ok").select("a").distinct()
    spread = table(star.join(open_, "a").select("a", "x", "n", "i", "ok", "comp", F.size("rest").alias("m"), F.explode("rest").alias("e")))
    often = spread.groupBy("a", "e").agg(F.count("*").alias("c")).where("c > 1")
    must = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("i"))  # elements beyond the hub that a partner shares at least
    nth = F.row_number().over(Window.partitionBy("x").orderBy("c", "e"))
    # elements that none else has come first in the order, so a prefix of m - must + 1 leaves so many fewer places
    alone = spread.where("not ok").join(often, ["a", "e"]).withColumn("nth", nth)
    shared_by = alone.groupBy("x").agg(F.count("*").alias("common")).withColumnRenamed("x", "sx")
    prefix = alone.join(shared_by, F.col("x") == F.col("sx")).where(F.col("nth") <= F.col("common") - must + 1).select("a", "e", "x", "n", "i", "comp")
    beyond = prefix.join(y(spread, "a", "e"), ["a", "e"]).where(apart).select("x", "y_x").distinct()
    least = star.groupBy("a").agg(F.min("n").alias("least"))
    enough = lambda i, k, l: F.col(i) * (100 + percent) >= (F.col(k) + F.col(l)) * percent
    tight = star.where("not ok").join(least, "a").where(enough("i", "n", "least")).select("a", "x", "n", "i", "comp")
    # partners' sizes differ by a quarter at most, so they lie in the same or neighbouring classes of size
    size = lambda n: F.floor(F.log(F.col(n)) / F.lit(math.log(100 / percent))).cast("long")
    near = F.explode(F.array(*[size("n") + d for d in (-1, 0, 1)]))
    within = tight.withColumn("z", near).join(y(star, "a", size("n").alias("z")), ["a", "z"]).where(apart & enough("i", "n", "y_n") & enough("y_i", "n", "y_n")).select("x", "y_x")

    # different stars that share a bucket
    starred = members.join(star.select("x", "a", "i", "comp"), "x")
    mixed = table(starred.join(starred.groupBy("key").agg(F.min("a").alias("a1"), F.max("a").alias("a2")).where("a1 <> a2").select("key"), "key"))
    across = mixed.withColumn("z", near).join(y(mixed, "key", F.col("a").alias("y_a"), size("n").alias("z")), ["key", "z"]).where(apart & (F.col("a") != F.col("y_a")) & (F.col("x") < F.col("y_x"))).select("x", "y_x")

    pairs = beyond.union(within).union(across).select(F.least("x", "y_x").alias("a"), F.greatest("x", "y_x").alias("b")).distinct()
    more = _verify(table(pairs), docs, n, percent).where("ok").select("a", "b")
    edges = same.union(links).union(table(more))
    labels = components(edges).select(F.col("node").alias("doc_id"), F.col("comp"))
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("comp", "doc_id")).alias("kept")
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op7_near_dedup": op7_near_dedup}
SQL: dict[str, str] = {}
