"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing. Each stage works on all that the one before it kept.

All stages: an empty table gives no rows; other columns than those of documents are ignored; null doc_id, lang and source are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import language, lines, mixing, neardup, packing
from skein.llm.common import documents, forget, let, table, tables_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null and empty texts, no letter) go. Repeated rows fare alike; ties of language don't matter here."""
    found = language.identify(docs, language.fit(docs))
    return _rows(found.where(F.col("lang_pred") != language.UNKNOWN))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; documents that are left without a word go too.

    Rows of one doc_id and text count as one document and fare alike; null and empty texts that lose nothing stay; null doc_id comes first in the order.
    """
    found = lines.dedup_lines(docs)
    return _rows(found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id; of repeated rows one.

    Rows of one doc_id are one document, for which the row of the smallest hash of its text stands. Rows of null doc_id all stay, as do texts without words.
    """
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(*COLUMNS)
    # rows of one doc_id are one node, so the smallest of them by a hash of the text stands for it; only ids and hashes are grouped
    by = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.xxhash64("text")).alias("_h"), F.count("*").alias("_n"))
    chosen = table(by.join(kept, "_id"))
    alone = rows.join(chosen.where("_n = 1"), F.col("doc_id") == F.col("_id"), "left_semi")
    repeated = table(chosen.where("_n > 1"))  # a table of its own, so that Spark knows its size: it's small unless doc_ids repeat
    many = rows.join(repeated, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))).select(*COLUMNS).dropDuplicates(["doc_id"])
    return _rows(alone.union(many).union(rows.where("doc_id is null")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's words as often as the mix takes them: whole copies, and one row of the blocks of words it chose, in the document's order.

    A document from which nothing is taken goes (null and empty texts too); copies keep their doc_id. Blocks keep the white space behind their words. Of rows
    of equal doc_id, size and source each has one entry of the mix.
    """
    key = lambda size: F.struct("doc_id", F.col(size).alias("size"), "source")  # noqa: E731 - equal also where its parts are null
    took = mixing.mix_sources(docs, ranges=True).where("taken > 0").select(key("size").alias("_key"), F.struct("whole", "begins", "ends").alias("_t"))
    took = took.groupBy("_key").agg(F.sort_array(F.collect_list("_t")).alias("_all"))
    sized = docs.withColumn("_n", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).withColumn("_key", key("_n"))
    # rows of one key are numbered, so that each has one entry of the mix
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("text")))
    joined = sized.join(took.hint("merge"), "_key").withColumn("_nth", nth).withColumn("_t", F.get("_all", F.col("_nth") - 1)).where("_t is not null")
    rest = F.when(F.size("_t.begins") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    parts = joined.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("_t.whole").cast("int")), rest)))
    head = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    words = F.split(F.substr(F.col("text"), F.length(head) + 1), r"(?<=[\x20\x09-\x0D])(?![\x20\x09-\x0D])")
    taken = lambda w: F.array_join(F.flatten(F.zip_with("_t.begins", "_t.ends", lambda a, b: F.slice(w, (a + 1).cast("int"), (b - a).cast("int")))), "")
    return _rows(parts.withColumn("text", F.when(F.col("_part"), F.rtrim(let(words, taken))).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens, with their ids. A null or empty text is the one id 0; repeated rows are packed each."""
    return packing.pack(docs, keep_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each stage's rows written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with tables_of() as stay:  # a stage's own tables go once its rows are written
            found = table(stage(spark, docs, sf_dir))
            stay.append(found)
        forget(docs)
        docs = found
    return STAGES[-1][1](spark, docs, sf_dir)


#: Seeded block selection and the genetic algorithm are not SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
