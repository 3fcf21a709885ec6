"""Operator 3, line dedup: overlapping windows of three lines, repeated anywhere in the corpus. Native DataFrame code only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import WORD, documents, let, table

WINDOW = 3
#: Stands for a null doc_id in keys, so that keys join without null checks.
NO_ID = -(2**63)


def _keyed(docs: DataFrame, also=()) -> DataFrame:
    """Two key columns name a document: doc_id and a hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k1"), F.xxhash64("text").alias("_k2"), *also)


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_k1, _k2, at): array of the first lines (from 0) of windows that occur earlier in the corpus, by (doc_id, text hash, line)."""
    hashes = let(
        F.split(F.col("text"), "\n"),
        lambda lines: F.when(
            F.size(lines) >= window,
            let(
                F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.rlike(x, F.lit(WORD)).alias("w"))),
                lambda hs: F.transform(
                    F.sequence(F.lit(0), F.size(hs) - window),
                    lambda i: F.when(
                        F.exists(F.slice(hs, i + 1, window), lambda x: x["w"]),
                        F.xxhash64(*[F.get(hs, i + k)["h"] for k in range(window)]),
                    ),
                ),
            ),
        ),
    )
    rows = _keyed(docs.where("text is not null"), [hashes.alias("hs")]).where("hs is not null").select("_k1", "_k2", F.posexplode("hs").alias("i", "h")).where("h is not null")
    rows = table(rows)
    place = F.struct("_k1", "_k2", "i")
    again = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    return rows.join(again, "h").where(place != F.col("first")).groupBy("_k1", "_k2").agg(F.collect_set("i").alias("at"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove later occurrences of repeated windows of consecutive lines.

    A window is `window` consecutive lines (text split at \\n, windows compared by 64-bit hashes) of which one at least has a word. Of windows
    with equal lines, the first by (doc_id, hash of text, line number) stays; every line covered by a later
    one goes, the covered ranges of a document merging where windows overlap. What remains is joined by \\n.

    Defined results: null text stays null (no lines); texts of fewer lines than a window stay; an empty text has one empty line;
    null doc_id sorts first; repeated rows (same doc_id and text) count as one document and fare alike. All columns of docs
    stay, with text replaced; n_lines, n_removed (long) are added and replace columns of these names.
    """
    found = removed_windows(docs, window).select(F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"), "at")
    kept_names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    rows = _keyed(docs, [F.struct(*kept_names, "text").alias("_row")])
    joined = rows.join(found, (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")), "left").select(F.col("_row"), F.col("at"))
    covered = F.flatten(F.transform("at", lambda i: F.sequence(i, i + window - 1)))
    result = F.when(
        F.col("at").isNotNull(),
        let(
            F.split("_row.text", "\n"),
            lambda lines: let(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered),
                lambda keep: F.struct(
                    F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n").alias("text"),
                    F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(keep)).cast("long").alias("n_removed"),
                ),
            ),
        ),
    ).otherwise(
        F.struct(F.col("_row.text").alias("text"), F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(F.split("_row.text", "\n"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    )
    done = joined.select("_row", result.alias("_out"))
    old = [F.col(f"_out.{c}" if c == "text" else f"_row.{c}").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*old, "_out.n_lines", "_out.n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


SQL = {
    "op3_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, list_slice(lines, i + 1, i + 3) AS win FROM (
        SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM d WHERE len(lines) >= 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, i) AS nth FROM w
      WHERE len(list_filter(win, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 0),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM o WHERE nth > 1),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM d),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept, count(*) AS n FROM l
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.i = l.i) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
}
QUERIES = {"op3_line_dedup": op3_line_dedup}
