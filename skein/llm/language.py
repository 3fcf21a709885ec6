"""Operator 10, language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, lean, small_batches, store, utf8

#: Characters of labelled text that each language's automaton is fitted on at most, and of one document in it.
SAMPLE_CHARS = 40_000
DOC_CHARS = 1_000
#: Words whose phrase counts a Python worker keeps.
STORE = 100_000
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start. Walking it matches exactly text's substrings."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:  # split the state: its longer strings end elsewhere than its shorter ones
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
        last = new
    return step


def phrases(step: list[dict[str, int]], text: str) -> int:
    """Phrases of the greedy longest-match parse of text by an automaton; a character it lacks is a phrase."""
    n, i, end = 0, 0, len(text)
    while i < end:
        state, j = step[0], i
        while j < end and (to := state.get(text[j])) is not None:
            state, j = step[to], j + 1
        n, i = n + 1, max(j, i + 1)
    return n


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Model:
    """Automata of the languages. Words are parsed one by one, each with a blank before and after it, so a word that repeats in the labelled text adds no match and is taken once."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.automata = [suffix_automaton(" " + " ".join(dict.fromkeys(words(texts[x]))) + " ") for x in self.langs]
        self.known: dict[str, tuple[int, ...]] = {}

    def predict(self, text: str) -> tuple[str, float]:
        """Language of the fewest phrases, ties to the first by name, and 1 - fewest / second fewest."""
        counts = Counter(words(text))
        if not self.langs or not any(c.isalpha() for w in counts for c in w):
            return UNKNOWN, 0.0
        total = [0] * len(self.langs)
        for word, n in counts.items():
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= STORE:
                    self.known.clear()
                padded = f" {word} "
                found = tuple(phrases(x, padded) for x in self.automata)
                if len(word) <= 40:
                    self.known[word] = found
            for k, x in enumerate(found):
                total[k] += n * x
        ranked = sorted(range(len(total)), key=lambda k: (total[k], k))
        score = 1.0 if len(ranked) == 1 else 1.0 - total[ranked[0]] / total[ranked[1]]
        return self.langs[ranked[0]], score


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, doc_chars: int = DOC_CHARS) -> dict[str, str]:
    """Text to learn each language from: labelled documents that are not held out, by order of a hash, bounded by sample_chars a language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(
        "lang", F.xxhash64("doc_id").alias("turn"), "doc_id", F.substring("text", 1, doc_chars).alias("text")
    ).where(F.length("text") > 0)
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not there:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, 3.0 * sample_chars / n))]), F.col("lang"))
    texts: dict[str, list[str]] = {k: [] for k in there}
    held = dict.fromkeys(there, 0)
    chosen = rows.where(F.pmod("turn", F.lit(10**12)) < share * 1e12).distinct()  # rows that repeat are learnt once
    for r in sorted(chosen.collect(), key=lambda r: (r["turn"], r["doc_id"], r["text"])):
        room = sample_chars - held[r["lang"]]
        if room > 0:
            texts[r["lang"]].append(r["text"][:room])
            held[r["lang"]] += len(texts[r["lang"]][-1])
    return {k: "\n".join(v) for k, v in texts.items() if v}


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """All columns of docs with lang_pred and score added (columns of these names are replaced). Every whole text is parsed."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    key = zlib.crc32(repr(sorted(texts.items())).encode())
    base = docs.drop("lang_pred", "score")
    names = base.columns

    def run(batches):
        known = store("language")
        model = known.get(key) or known.setdefault(key, Model(texts))
        for b in batches:
            found = [model.predict(x.decode("utf-8", "replace")) for x in utf8(b.column("text"))]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(lean(run), schema)


def language_id(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Predicted language of every document.

    Each language's suffix automaton is fitted on a bounded sample (SAMPLE_CHARS, DOC_CHARS) of its labelled documents with
    crc32(doc_id) mod 4 other than 2; a text's words are cut into longest matches by every automaton, and the language
    that needs fewest phrases over the same characters wins.

    Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing is labelled; ties go to
    the first language by name; null doc_id is never learnt from nor held out; rows that repeat are learnt once and fare alike;
    an empty table gives no rows; clashing columns lang_pred and score are replaced. Returns doc_id, held_out, lang_pred, score.
    """
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, fit(docs, sample_chars)).select("doc_id", "held_out", "lang_pred", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


QUERIES = {"op10_language": op10_language}
SQL: dict[str, str] = {}
