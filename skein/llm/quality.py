"""Operator 5, quality rules as a short-circuit cascade. Native DataFrame code only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SPACE, WORD, documents, forget, let, table

#: Rows of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 2000
SYMBOLS = r"[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first included."""

    def from_hashes(hs: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hs) - 3), lambda i: F.xxhash64(F.get(hs, i), F.get(hs, i + 1), F.get(hs, i + 2)))
        return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(covered(ws)))

    def covered(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return let(ordered, lambda s: F.aggregate(places(s), start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n")), lambda a: a["n"]))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def _stats() -> Column:
    """All base counts of column text, in one struct; each part is computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda ws: let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                (F.length(text) - F.regexp_count(text, F.lit(SPACE[:-1]))).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(ws).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
            ),
        ),
    )


def rules() -> dict[str, Column]:
    """Name -> condition under which a document is rejected, over columns text and s (the base counts).

    None looks at the length of a clean document; texts of any size and language are kept if they are prose.
    """
    text, s = F.coalesce(F.col("text"), F.lit("")), F.col("s")
    return {
        "symbols": 100 * s["n_symbols"] > 10 * s["n_words"],
        "duplicate_lines": 100 * s["n_dup_lines"] > 40 * s["n_lines"],
        "repetition": 100 * s["n_repeat_words"] > 30 * s["n_words"],
        "word_length": (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 12 * s["n_words"]),
        "capitals": 100 * F.regexp_count(text, F.lit(r"\p{Lu}")) > 30 * s["word_chars"],
        "no_letters": 100 * F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")) < 70 * s["n_words"],
        "ellipsis_lines": 100 * F.regexp_count(text, F.lit(r"(?m)(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*$")) > 30 * s["n_lines"],
        "bullet_lines": 100 * F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*[•\-*][\x20\x09]")) > 90 * s["n_lines"],
    }


def base_failed() -> Column:
    s = F.col("s")
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def order_rules(docs: DataFrame, found: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second on a sample of the documents that base_failed leaves; the order moves speed, never the verdict.

    The sample is the rows of a hash below a bound that the scan's row count sets (Parquet footers hold it). A rule's time is the least of several
    warm runs over the sample, repeated until it weighs against a job's own, less that of an empty rule.
    """
    n = docs.select(F.lit(1)).count()
    share = 1.0 if n <= sample_rows else sample_rows / n
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + (share >= 1)).select("text", _stats().alias("s")).where(~base_failed())
    sample = table(chosen)
    size = max(1, sample.count())
    rejected = sample.agg(*[F.avg(F.coalesce(rule, F.lit(False)).cast("int")).alias(name) for name, rule in found.items()]).first()
    rows = sample.coalesce(1).withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(20, 4 * sample_rows // size))))))

    def seconds(rule: Column) -> float:
        took = []
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            rows.agg(F.count_if(rule)).collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    empty = seconds(F.col("s.n_words") < 0)
    rank = {name: (rejected[name] or 0.0) / max(1e-4, seconds(rule) - empty) for name, rule in found.items()}
    forget(sample)
    return sorted(found, key=lambda name: (-rank[name], name))


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts of every whole text and the cascade's verdict.

    kept is false where base_failed or any rule rejects; rules run in the order that the sample suggests and stop at the
    first rejection (CASE evaluates lazily), so their order never changes the verdict.

    Defined results: null and empty texts have no words, base_failed and are not kept; null doc_id is carried;
    repeated rows fare alike; extra columns are ignored; an empty table gives no rows.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    """
    found = rules()
    names = order_rules(docs.select("doc_id", "text"), found, sample_rows)
    verdict = F.when(base_failed(), F.lit(False))
    for name in names:
        verdict = verdict.when(found[name], F.lit(False))
    rows = docs.select("doc_id", "text", _stats().alias("s"))
    return rows.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", base_failed().alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


SQL = {
    "op5_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, i, list_slice(ws, i + 1, i + 3) AS w FROM (
        SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM a WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM t),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
b AS (SELECT a.doc_id, text, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
            OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 100 * len(regexp_extract_all(text, '\p{Lu}')) > 30 * word_chars
            OR 100 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 70 * n_words
            OR 100 * len(regexp_extract_all(text, '(?m)(?:\.\.\.|\x{2026})[\x20\x09\x0B-\x0D]*$')) > 30 * n_lines
            OR 100 * len(regexp_extract_all(text, '(?m)^[\x20\x09]*[\x{2022}\-*][\x20\x09]')) > 90 * n_lines) AS kept
FROM v
""",
}
QUERIES = {"op5_quality": op5_quality}
