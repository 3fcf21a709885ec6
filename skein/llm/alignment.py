"""Operator 13, alignment of two tokenizers: where their tokens end together, which tokens overlap, how often each pair does.

A text is cut into units at single blanks between words. Neither tokenizer can join anything over such a blank: A's pattern starts a token there, and no
piece of B holds a blank behind another character (checked when the model is read). So a unit has the same tokens wherever it stands, and a Python worker
aligns each distinct unit once. Blocks of documents are written with their units; pairs are counted by Spark, and the counts of a block's own pairs join it again.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, lean, small_batches, store, table, trim
from skein.llm.tokens import path

#: UTF-8 bytes of the texts of one block (a longer text is a block of its own), and units a Python worker keeps when it begins a block.
BLOCK_BYTES, STORE = 4_000_000, 100_000
#: UTF-8 bytes of texts that are cut into units at once; of a block's texts before them only numbers are held.
CUT_BYTES = 500_000
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ids of B are below this; a pair is A's id times it plus B's.
RADIX = 1 << 31
# Fixed value: the pattern by which byte-level vocabularies split text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that are aligned as one text.
TOGETHER = 5000
#: Units that may meet a neighbour's blank or are changed by B: alone.
_ODD = re.compile(r"^\s|^$| $|▁")
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = (
    "block long, doc_id array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
    "n_units long, n_used long, all_links long, units binary, per_doc binary, links binary, per_unit binary, pairs array<long>, counts array<long>"
)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}


def merge(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two pointers over the token ends of one text, as searches in sorted arrays: for each link the place where it ends and its two tokens' numbers, and which links end a group.

    Between two neighbouring ends lies one token of each side, so every end of either side is the end of exactly one link.
    """
    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    ends = np.union1d(ends_a, ends_b)
    i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, i, j, (ends_a[np.minimum(i, len(a) - 1)] == ends) & (ends_b[np.minimum(j, len(b) - 1)] == ends)


class Aligner:
    """Both tokenizers and the aligned units of a Python worker."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        byte = byte_level()
        with open(a_file, encoding="utf-8") as f:
            found = json.load(f)
        self.a_file, self.library = a_file, None
        vocab = found["model"]["vocab"] | {x["content"]: x["id"] for x in found["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        special = {x["id"] for x in found["added_tokens"]}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        same = found["normalizer"] is None and all((found["pre_tokenizer"] or {}).get(k) == v for k, v in plain.items())
        ranks = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in names], "<i8") for names in (self.a_bytes, self.b_bytes))
        self.names = [str(n) for n in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.links: list[bytes] = []  # pairs as 64-bit numbers
        self.sizes = np.zeros((0, 4), "<i8")  # all 0: the bytes of one side are not those of the text

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return self.encode_by_library(text)

    def encode_by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.a_file)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for a blank and a text; None where the bytes of a side are others."""
        a, b, raw = self.encode_a(" " + text), self.b.encode(text, num_threads=1), (" " + text).encode()
        return (a, b) if b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw else None

    def units(self, text: str) -> list[str]:
        """Units of a text, each without the blank before it; the first one's blank is the one that both sides add."""
        return _CUT.split(text) if self.cuts else [text]

    def learn(self, units: list[str]) -> None:
        """Align new units: many together, as one text, those that could meet their neighbours in it alone."""
        odd = [u for u in units if not self.cuts or _ODD.search(u)]
        if odd:
            alone = set(odd)
            units = [u for u in units if u not in alone]
        for at in range(0, len(units), TOGETHER):
            some = units[at : at + TOGETHER]
            found = self.tokens(" ".join(some))
            if found is None:  # whichever unit it is
                odd += some
            else:
                self._add(some, *found)
        for unit in odd:
            found = self.tokens(unit)
            if found is None:
                self.known[unit] = len(self.groups)
                self.groups.append(b"")
                self.links.append(b"")
                self.sizes = np.concatenate([self.sizes, np.zeros((1, 4), "<i8")])
            else:
                self._add([unit], *found)

    def _add(self, units: list[str], a: list[int], b: list[int]) -> None:
        ids_a, ids_b = np.array(a, "<i8"), np.array(b, "<i8")
        ends, i, j, closes = merge(ids_a, ids_b, self.a_size, self.b_size)
        stops = np.cumsum([1 + len(u.encode()) for u in units])
        last = np.searchsorted(ends, stops) + 1  # links up to the end of each unit
        group = np.flatnonzero(closes)
        last_group = np.searchsorted(group, last)
        until_a, until_b = (i[group] + 1).tolist(), (j[group] + 1).tolist()
        names_a, names_b = [self.names[k] for k in a], [self.names[k] for k in b]
        texts = [f"{','.join(names_a[p:q])}|{','.join(names_b[r:s])}" for p, q, r, s in zip([0, *until_a[:-1]], until_a, [0, *until_b[:-1]], until_b, strict=True)]
        raw = (ids_a[i] * RADIX + ids_b[j]).astype("<i8").tobytes()
        sides = np.stack([i[last - 1] + 1, j[last - 1] + 1, last_group, last], 1)
        self.sizes = np.concatenate([self.sizes, np.diff(sides, axis=0, prepend=np.zeros((1, 4), "<i8"))])
        first = first_group = 0
        for unit, n, g in zip(units, last.tolist(), last_group.tolist(), strict=True):
            self.known[unit] = len(self.groups)
            self.groups.append(";".join(texts[first_group:g]).encode())
            self.links.append(raw[8 * first : 8 * n])
            first, first_group = n, g


def _aligner(a_file: str, b_file: str) -> Aligner:
    known = store("alignment")
    if (a_file, b_file) not in known:
        known[a_file, b_file] = Aligner(a_file, b_file)
    return known[a_file, b_file]


def _small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as bytes of the narrowest kind that holds them all; _numbers reads them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype("<i8") if n else np.zeros(0, "<i8")


class _Block:
    """A block of documents under way: of each document its own figures and its units' numbers, of the texts nothing."""

    def __init__(self, own: Aligner):
        if len(own.known) > STORE:
            own.reset()
        self.own, self.ids, self.sha, self.codes, self.totals, self.per_doc = own, [], [], [], [], []

    def add(self, ids: list, texts: list) -> None:
        own = self.own
        cut = [own.units(x) if x else [] for x in texts]
        own.learn([u for u in {u for units in cut for u in units} if u not in own.known])
        codes = [[own.known[u] for u in units] for units in cut]
        del cut
        bad = set(np.flatnonzero(own.sizes[:, 0] == 0).tolist())
        for n, units in enumerate(codes):
            if bad and not bad.isdisjoint(units):  # a side changes this text's bytes: it has no tokens, unless what its units change adds up to the same
                whole = texts[n]
                if whole not in own.known:
                    own.learn([whole])
                codes[n] = [own.known[whole]] if own.sizes[own.known[whole], 0] else []
        per_doc = np.array([len(units) for units in codes], "<i8")
        flat = np.array([c for units in codes for c in units], "<i4")
        ends = np.concatenate([[0], np.cumsum(per_doc)])
        sums = np.concatenate([np.zeros((1, 4), "<i8"), np.cumsum(own.sizes[flat], 0)])
        self.ids += ids
        self.sha += [hashlib.sha256(b";".join([own.groups[c] for c in units])).hexdigest() if units else "" for units in codes]
        self.codes.append(flat)
        self.per_doc.append(per_doc)
        self.totals.append(sums[ends[1:]] - sums[ends[:-1]])

    def row(self, number: int) -> dict:
        """One row for the block: what each of its documents has alone, and units and links for what needs the corpus's counts."""
        own, flat, per_doc, totals = self.own, np.concatenate(self.codes), np.concatenate(self.per_doc), np.concatenate(self.totals)
        uses = np.bincount(flat, minlength=len(own.known))
        used = np.flatnonzero(uses)
        place = np.zeros(len(uses), "<i4")
        place[used] = np.arange(len(used))
        per_unit = own.sizes[used, 3]
        links = np.frombuffer(b"".join([own.links[c] for c in used.tolist()]), "<i8")
        pairs, link = np.unique(links, return_inverse=True)
        counts = np.zeros(len(pairs), "<i8")
        np.add.at(counts, link, np.repeat(uses[used], per_unit))
        row = {"block": number, "doc_id": self.ids, "sha": self.sha, "units": _small(place[flat]), "per_doc": per_doc.astype("<i4").tobytes()}
        row |= {name: totals[:, k] for k, name in enumerate(_COLUMNS)}
        return row | {"n_units": len(flat), "n_used": len(used), "all_links": len(link), "links": _small(link), "per_unit": _small(per_unit), "pairs": pairs, "counts": counts}


def blocks(docs: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents as _BLOCKS says; the places of pairs in a block are those of its own list. A block's number is its task's and its own in the task."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        own, number = _aligner(a_file, b_file), TaskContext.get().partitionId() << 32
        block, size, ids, texts, cut = None, 0, [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                block = block or _Block(own)
                ids.append(i)
                texts.append(text)
                n = len(text.encode()) if text else 0
                size, cut = size + n, cut + n
                if cut >= CUT_BYTES or size >= block_bytes:
                    block.add(ids, texts)
                    ids, texts, cut = [], [], 0
                if size >= block_bytes:
                    yield pd.DataFrame([block.row(number)])
                    block, size, number = None, 0, number + 1
        if block:
            if ids:
                block.add(ids, texts)
            yield pd.DataFrame([block.row(number)])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string")).mapInPandas(lean(run), _BLOCKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold the pair; best: none with its B id has more. Blocks count their own pairs first."""
    pairs = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    pairs = table(pairs.withColumn("b_id", F.pmod("pair", F.lit(RADIX))))
    most = pairs.groupBy("b_id").agg(F.max("n").alias("most"))
    return pairs.join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Alignment of each whole text under A (byte-level BPE, tokenizers file) and B (sentencepiece model).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 (string).

    Defined results: null and empty texts, and those whose bytes a side changes (B's own mark of a blank in the text), have zeros and ''. Strings of special
    tokens are plain text. Null doc_id is carried; repeated rows are counted each; other columns are ignored; an empty table gives no rows. A link is
    best if no pair with its B id has more links, so ties are all best.
    """
    found = table(blocks(docs, a_file or path(A_FILE), b_file or path(B_FILE), block_bytes))
    own = found.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    counted = own.join(pair_counts(found), "pair").select("of", "at", "n", "best")

    def finish(left, right):
        import pandas as pd

        row = left.iloc[0]
        order = np.argsort(right["at"].to_numpy(), kind="stable")
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype("i8")
        after = lambda x: np.concatenate([np.zeros(1, "i8"), np.cumsum(x)])
        links, units = _numbers(row["links"], row["all_links"]), _numbers(row["units"], row["n_units"])
        unit_ends, doc_ends = after(_numbers(row["per_unit"], row["n_used"])), after(np.frombuffer(row["per_doc"], "<i4"))

        def each(values):  # sums wrap, differences of sums don't unless a document's own sum does
            by_unit = np.diff(after(values[links])[unit_ends])
            return np.diff(after(by_unit[units])[doc_ends])

        ids = pd.array([None if x is None else int(x) for x in row["doc_id"]], dtype="Int64")
        trim()
        out = {"doc_id": ids} | {name: row[name] for name in _COLUMNS}
        return pd.DataFrame(out | {"n_best": each(best), "count_sum": each(n), "groups_sha256": row["sha"]})

    small_batches(docs.sparkSession)
    kinds = ", ".join(f"{x} long" for x in ("doc_id", *_COLUMNS, "n_best", "count_sum"))
    return found.groupBy("block").cogroup(counted.groupBy("of")).applyInPandas(finish, kinds + ", groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


#: Tokenizers are not SQL; tests/llm holds the operator against the libraries on whole texts and a plain merge.
SQL: dict[str, str] = {}
QUERIES = {"op13_alignment": op13_alignment}
