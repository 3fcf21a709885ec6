"""Operator 4, mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, lean, small_batches, table, utf8

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 32
SHARD_BLOCKS = 1024
MAX_SHARDS = 4096


def water_fill(weights, sizes, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets proportional to weights that sum to share of all sizes; none above most times its size, excess reshared.

    Each round fills one source at least, so the work is quadratic in the number of sources: fine for thousands of them, not for a source a host.
    """
    left = share * float(sum(sizes))
    targets, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        total = float(sum(weights[i] for i in free))
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = most * float(sizes[i])
        left -= sum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return targets


def sainte_lague(votes, seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), ties to the earlier party.

    Works by bisecting the common divisor, so the seats may be many; the last seats go one by one.
    """
    v = np.asarray(votes, dtype=float)
    if seats <= 0 or not len(v) or v.sum() <= 0:
        return [0] * len(v)
    low, high = 0.0, 2.0 * v.sum() / seats + 2.0 * v.max()
    for _ in range(200):  # the smallest divisor that gives no more than the seats there are
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        if np.floor(v / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    won = np.floor(v / high + 0.5).astype(np.int64)
    while (rest := seats - int(won.sum())) > 0:
        best = np.lexsort((np.arange(len(v)), -(v / (2 * won + 1))))[:1]
        won[best] += min(1, rest)
    return [int(x) for x in won]


def _affine(n: int, seed: int) -> tuple[int, int]:
    """Seeded a, c so that j -> (a j + c) mod n permutes 0 .. n-1."""
    rng = np.random.default_rng(seed)
    c = int(rng.integers(0, n))
    a = int(rng.integers(1, n + 1)) if n > 1 else 1
    while math.gcd(a, n) != 1:
        a += 1
    return a, c


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of each whole text (null: none)."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def count(batches):
        for b in batches:
            n = [len(x.split()) for x in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "size"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return cols.mapInArrow(lean(count), "doc_id long, source string, size long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 7, ranges: bool = False) -> DataFrame:
    """Words to take of every document so that the sources meet their target weights.

    The driver gets one row a source and apportions the mix's blocks of block_words words among sources by
    Sainte-Lague. A source is dealt by a hash of doc_id into shards of about SHARD_BLOCKS blocks (MAX_SHARDS at
    most, so that shards grow beyond that); a second apportionment gives each shard its integer quota.
    Within a shard, documents in seeded order make a stream of words cut into blocks; whole passes take all
    blocks, and the rest takes the blocks that a seeded permutation puts first. A block may begin within a document.

    block_words shrinks to a 50th of the smallest positive target, so that small sources also come near theirs.
    Defined results: null text has size 0 and takes 0; null source is a source of its own, last; sources without
    words have target 0; rows that are repeated count each and share the seeded order's ties by size; an empty table gives no
    rows. Returns doc_id, source, size, source_size, target, taken. With ranges also which words these are: whole copies, and begins
    and ends of the chosen ranges of words (adjacent blocks are one range; a range that covers the document counts as a copy).
    """
    spark = docs.sparkSession
    sizes = table(word_sizes(docs))
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    totals = [int(r["size"]) for r in found]
    targets = water_fill([weights[i % len(weights)] for i in range(len(found))], totals, share, most)
    least = min((t for t in targets if t > 0), default=1.0)
    block = int(max(1, min(block_words, least // 50)))
    quotas = sainte_lague(targets, round(sum(targets) / block))
    schema = "source string, source_size long, target double, quota long, shards int"
    plan = [(r["source"], n, t, q, int(max(1, min(MAX_SHARDS, n // (SHARD_BLOCKS * block))))) for r, n, t, q in zip(found, totals, targets, quotas)]
    sources = spark.createDataFrame(plan, schema)
    marked = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "d.source", "size", "source_size", "target", "quota", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "shards").cast("int").alias("shard"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("turn")
    )
    shard_sizes = marked.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))

    def deal(batch):
        import pandas as pd

        batch = batch.sort_values("shard").reset_index(drop=True)
        blocks = -(-batch["shard_size"] // block)
        won = sainte_lague(batch["shard_size"].tolist(), int(batch["quota"].iloc[0]))
        rows = []
        for shard, n, q in zip(batch["shard"], blocks, won):
            n, q = int(n), int(min(q, int(most * n)))
            a, c = _affine(max(n, 1), seed + 1000 * int(shard))
            rows.append((batch["source"].iloc[0], int(shard), n, q, a, c))
        return pd.DataFrame(rows, columns=["source", "shard", "blocks", "won", "mul", "add"])

    dealt = shard_sizes.groupBy("source").applyInPandas(deal, "source string, shard int, blocks long, won long, mul long, add long")

    from pyspark.sql import Window

    key = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("stop", F.sum("size").over(key)).alias("d").join(
        dealt.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))
    ).select("doc_id", "d.source", "size", "source_size", "target", "stop", "blocks", "won", "mul", "add")

    def take(batches):
        for b in batches:
            size, stop = b["size"].to_numpy(), b["stop"].to_numpy()
            start, n, q = stop - size, np.maximum(b["blocks"].to_numpy(), 1), b["won"].to_numpy()
            taken = q // n * size
            first, last = start // block, np.where(size > 0, (stop - 1) // block, start // block - 1)
            many = np.maximum(last - first + 1, 0)
            doc = np.repeat(np.arange(len(b)), many)
            j = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
            # mul * j stays below 2^62: a shard has fewer than 2^31 blocks
            chosen = (b["mul"].to_numpy()[doc] * j + b["add"].to_numpy()[doc]) % n[doc] < (q % n)[doc]
            part = np.minimum((j + 1) * block, stop[doc]) - np.maximum(j * block, start[doc])
            taken = taken + np.bincount(doc, part * chosen, len(b)).astype(np.int64)
            out = b[["doc_id", "source", "size", "source_size", "target"]].assign(taken=taken)
            if ranges:
                at = np.flatnonzero(chosen)
                new = np.flatnonzero(np.diff(doc[at], prepend=-1).astype(bool) | (np.diff(j[at], prepend=-2) != 1))
                of, last = doc[at[new]], at[np.append(new[1:], len(at))[: len(new)] - 1]
                begin = np.maximum(j[at[new]] * block, start[of]) - start[of]
                end = np.minimum((j[last] + 1) * block, stop[of]) - start[of]
                part = (begin > 0) | (end < size[of])
                whole = q // n + np.bincount(of[~part], minlength=len(b))
                cut = np.searchsorted(of[part], np.arange(1, len(b)))
                out = out.assign(whole=whole, begins=np.split(begin[part], cut), ends=np.split(end[part], cut))
            yield out

    schema = "doc_id long, source string, size long, source_size long, target double, taken long" + ", whole long, begins array<long>, ends array<long>" * ranges
    return placed.mapInPandas(lean(take), schema)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
