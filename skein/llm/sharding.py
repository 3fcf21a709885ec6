"""Operator 9, sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import checkpoint, documents, lean, partitions, table

#: Fixed overhead of a stored document in bytes.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Cut documents, in order of doc_id, into n_shards contiguous shards of near equal bytes.

    Only (doc_id, size, crc) move: they are range-partitioned and sorted once, each partition's count and
    bytes come to the driver (a row a partition), and every task adds its offset to its own running sums. A
    document goes to the shard in which the middle of its byte range falls, so a shard is off its
    target by half a document at each end at most.

    Defined results: null text has no bytes (size 8, crc 0); null doc_id sorts first; repeated rows are rows of
    their own, ties ordered by crc then size; a document larger than a target may leave a shard empty; an empty
    table gives no rows. Columns other than doc_id and text are ignored. Equal texts get no special treatment.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")))
    # rows that are equal in all three are told apart by where they lie, so that even they spread over ranges; which of them comes first changes nothing
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ("doc_id", "text_crc32", "size", "tie")
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("tie")
    dealt = checkpoint(dealt.withColumn("pid", F.spark_partition_id()))
    totals = sorted(tuple(r) for r in dealt.groupBy("pid").agg(F.count("*"), F.sum("size")).collect())
    first, rank0, byte0 = {}, 0, 0
    for pid, n, size in totals:
        first[pid] = (rank0, byte0)
        rank0, byte0 = rank0 + n, byte0 + size
    total = max(byte0, 1)

    def place(batches):
        at: dict[int, tuple[int, int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            pid = int(batch["pid"].iloc[0])
            rank, before = at.get(pid, first[pid])
            size = batch["size"].to_numpy()
            start = before + np.cumsum(size) - size
            shard = np.minimum((2 * start + size) * n_shards // (2 * total), n_shards - 1)
            at[pid] = (rank + len(batch), before + int(size.sum()))
            yield batch.drop(columns="pid").assign(rank=rank + np.arange(len(batch)), shard=shard.astype("int32"))

    placed = dealt.mapInPandas(lean(place), "doc_id long, size long, text_crc32 long, rank long, shard int")
    starts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("rank")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]), F.col("shard")) if starts else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))


#: Order of doc_id, ties by crc and size, as in the operator (DuckDB has no crc32 of text, so doc_id alone orders; it is unique).
QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
