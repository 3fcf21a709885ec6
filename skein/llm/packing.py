"""Operator 1, best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import json
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.llm.common import documents, lean, small_batches, table, utf8

CAPACITY = 2048
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 6, 3, 4, 2
#: Parts into which the pieces of one length are dealt, so that a frequent length is ranked by many tasks.
SALTS = 1024
SEED = 5

#: A packing: (lengths of a bin, longest first) -> how many such bins.
Packing = dict[tuple[int, ...], int]


class _Stock:
    """How many pieces of each length are left; finds the largest length that fits."""

    def __init__(self, counts):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def largest(self, room: int, used: Counter | None = None) -> int:
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0 and used and self.n[self.lengths[at]] <= used[self.lengths[at]]:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))


def best_fit(packing: Packing, counts, capacity: int, rng: random.Random | None = None) -> Packing:
    """Add pieces to a packing: first into the fullest open bins that take them, longest first, then into new bins.

    Bins are patterns with a count, so the work follows the number of lengths and not that of pieces. A new bin takes the largest
    piece that fits what is left of it; rng lets it now and then begin with another length.
    """
    out = dict(packing)
    stock = _Stock(counts)
    if stock.lengths and out:
        gaps = sorted((capacity - sum(p), p) for p in out if capacity - sum(p) >= stock.lengths[0])
        for length in reversed(list(stock.lengths)):
            at = bisect.bisect_left(gaps, (length,))
            while at < len(gaps) and stock.n.get(length):
                room, pattern = gaps[at]
                n = min(stock.n[length], out[pattern])
                filled = tuple(sorted((*pattern, length), reverse=True))
                stock.take(length, n)
                out[filled] = out.get(filled, 0) + n
                out[pattern] -= n
                if not out[pattern]:
                    del out[pattern]
                    gaps.pop(at)
                else:
                    at += 1
                if room - length >= (stock.lengths[0] if stock.lengths else capacity) and (room - length, filled) not in gaps:
                    bisect.insort(gaps, (room - length, filled))
                    at += 0 if n else 1
    while stock.lengths:
        first = stock.lengths[-1]
        if rng and rng.random() < 0.1:
            first = rng.choice(stock.lengths)
        used, room, bin_ = Counter([first]), capacity - first, [first]
        while room and (fit := stock.largest(room, used)):
            if rng and rng.random() < 0.15 and (other := stock.largest(max(0, fit - 1), used)) and other * 2 > fit:
                fit = other
            used[fit] += 1
            bin_.append(fit)
            room -= fit
        n = min(stock.n[k] // u for k, u in used.items())
        for k, u in used.items():
            stock.take(k, n * u)
        pattern = tuple(sorted(bin_, reverse=True))
        out[pattern] = out.get(pattern, 0) + n
    return out


def crossover(a: Packing, b: Packing, counts, capacity: int, rng: random.Random) -> Packing:
    """Inject whole well-filled bins of b into a, remove bins of a that hold pieces twice, best-fit the displaced pieces."""
    full = [p for p in b if sum(p) >= capacity - max(1, capacity // 256)] or list(b)
    chosen = {p: max(1, int(b[p] * rng.random())) for p in full if rng.random() < 0.5}
    left = Counter(counts)
    for p, n in chosen.items():
        for length in p:
            left[length] -= n
    child = dict(chosen)
    for p in sorted(a, key=lambda p: (-sum(p), p)):  # a's fullest bins stay as long as their pieces are not in injected ones
        need = Counter(p)
        n = min(a[p], min(left[k] // u for k, u in need.items()))
        if n > 0 and (sum(p) == capacity or rng.random() < 0.95):
            child[p] = child.get(p, 0) + n
            for k, u in need.items():
                left[k] -= n * u
    return best_fit(child, left, capacity, rng)


def mutate(a: Packing, counts, capacity: int, rng: random.Random) -> Packing:
    """Open the worst-filled bins and some others, and best-fit their pieces anew."""
    kept: Packing = {}
    left: Counter = Counter()
    for p in sorted(a):
        fill = sum(p) / capacity
        if fill < 1 and rng.random() < 0.3 + 0.7 * (1 - fill) or rng.random() < 0.03:
            for length in p:
                left[length] += a[p]
        else:
            kept[p] = a[p]
    return best_fit(kept, left, capacity, rng)


def fitness(a: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones (sum of squared fill); smaller is better."""
    return sum(a.values()), -sum(n * (sum(p) / capacity) ** 2 for p, n in a.items())


def evolve(counts, population: list[Packing], generations: int, capacity: int, seed: int, size: int = POPULATION) -> list[Packing]:
    """One island's epoch: parents by rank, crossover, mutation, survival of the best."""
    rng = random.Random(seed)
    best = lambda x: (fitness(x, capacity), sorted(x.items()))
    population = list(population) or [best_fit({}, counts, capacity)]
    while len(population) < size:
        population.append(best_fit({}, counts, capacity, rng))
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    for _ in range(generations):
        population.sort(key=best)
        if fitness(population[0], capacity)[0] <= least:
            break
        a, b = population[0], population[rng.randrange(len(population))]
        population.append(crossover(a, b, counts, capacity, rng))
        population.append(mutate(population[rng.randrange(size)], counts, capacity, rng))
        population = sorted(population, key=best)[:size]
    return sorted(population, key=best)


def _written(a: Packing) -> str:
    return json.dumps([[list(p), n] for p, n in sorted(a.items())])


def _read(text: str) -> Packing:
    return {tuple(p): n for p, n in json.loads(text)}


def pack_lengths(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, seed: int = SEED) -> Packing:
    """A packing of counts[length] pieces of each length. Islands are tasks; after each epoch an island's best goes to the next one."""
    if not counts:
        return {}
    elites: dict[int, list[Packing]] = {i: [] for i in range(islands)}
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    for epoch in range(epochs):
        rows = [(i, [_written(x) for x in elites[i]]) for i in range(islands)]
        start = spark.createDataFrame(rows, "island int, packings array<string>").repartition(islands, "island")

        def run(batches, epoch=epoch):
            import pandas as pd

            for b in batches:
                for island, packings in zip(b["island"], b["packings"]):
                    best = evolve(counts, [_read(x) for x in packings], generations, capacity, seed + 101 * int(island) + 10007 * epoch)[0]
                    yield pd.DataFrame({"island": [island], "packing": [_written(best)]})

        found = {r["island"]: _read(r["packing"]) for r in start.mapInPandas(lean(run), "island int, packing string").collect()}
        best = min(found.values(), key=lambda x: (fitness(x, capacity), sorted(x.items())))
        if fitness(best, capacity)[0] <= least:
            return best
        elites = {i: [found[i], found[(i - 1) % islands]] for i in range(islands)}
    return best


def pieces(docs: DataFrame, capacity: int = CAPACITY, file: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids (null text: empty) followed by id 0: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        from skein.llm.tokens import encoder

        tool = encoder(file)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = [x.decode("utf-8", "replace") for x in utf8(b.column("text"))]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tool.encode(texts)):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    raw = ids[at : at + capacity]
                    for column, v in zip(out, (doc_id, k, at, len(raw), zlib.crc32(raw.tobytes()), raw.tobytes() if keep_ids else None)):
                        column.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)][: 5 + keep_ids], names[: 5 + keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def _slots(packing: Packing) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a bin, first sequence, offset in the bin), by first rank."""
    out: dict[int, list] = {}
    given: Counter = Counter()
    sequence = 0
    for pattern, n in sorted(packing.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for length, u in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((given[length], u, sequence, offset))
            given[length] += n * u
            offset += u * length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, file: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most capacity tokens as the algorithm finds.

    Pieces of one length are interchangeable, so a packing is decided on the table of lengths: capacity rows at most however
    large the corpus, which bounds the driver's and every island's work. Bins are patterns of lengths with a count. Islands
    evolve packings of the whole corpus by group crossover and mutation and pass on their elites. Then each piece is ranked
    among those of its length, salted by a hash so that a frequent length is many tasks' work, and looks up its place.

    Defined results: null and empty texts are the one id 0; longer documents than capacity are cut; null doc_id is carried; repeated rows are packed
    each, ties of rank going by doc_id, piece and crc; an empty table gives no rows; extra columns are ignored.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = table(pieces(docs, capacity, file, keep_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")))
    counted = table(rows.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(pack_lengths(spark, counts, capacity))
    before = counted.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "base")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("rank", rank - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    small_batches(spark)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]

    def place(batches):
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            for size in np.unique(length):
                at, table_ = np.flatnonzero(length == size), slots[int(size)]
                row = table_[np.searchsorted(table_[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * size
            yield b.assign(sequence_id=sequence, offset=offset)[names]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInPandas(lean(place), schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
