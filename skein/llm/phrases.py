"""Operator 12, phrase collocations: candidates in minimal perfect hashes, counted as numpy arrays that are summed in a tree, cuts read by slot.

Phrases are known by 64-bit keys of their words' 64-bit hashes (which hold the language). Level by level, as Apriori says, only phrases whose first and last
part are frequent become candidates: mappers look the parts up in the perfect hash of the level before, stored keys compared. What a mapper counts goes as arrays, cut
by key, to the task that owns that part of the keys, where a perfect hash of its candidates gives the slots to add to. (An array over all candidates in every mapper, the
plainer form, would grow with the corpus.) Nothing but one hash of frequent phrases and its counts (some 40 MB) is ever on the driver or broadcast.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import documents, forget, lean, mix, small_batches, store, table

#: Keys of one perfect hash that is broadcast, occurrences of one part's arrays, tasks whose arrays one node of the tree sums.
SHARD, PART, FAN = 1 << 21, 1 << 19, 256
#: Words a Python worker keeps, words of a mapper's table and entries of its arrays before they are handed on.
STORE, WORDS, HELD = 150_000, 100_000, 500_000
LEAST, LONGEST, TOP, SWALLOWED = 30, 4, 2000, 80
_BREAK = b"\xff"  # never a byte of UTF-8
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
_BELOW = np.array([[bin(b & ((1 << k) - 1)).count("1") for k in range(8)] for b in range(256)], "<i8")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: each level sets the bits that one key alone falls on, the others go to the next level; a key's slot
    is the rank of its bit. Keys are stored by slot, so a key that is not one of them is told."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, taken = keys.astype("<u8"), 0
        while len(left):
            size = 2 * len(left) + 8 & ~7
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(alone, bitorder="little")
            ones = np.array([_BELOW[b, 7] + (b >> 7) for b in range(256)], "<i8")[packed]
            self.levels.append((size, packed, taken + np.concatenate([[0], np.cumsum(ones)[:-1]])))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros(taken, "<u8")
        self.keys[self._ranks(keys.astype("<u8"))] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64(int(_STEP) * (level + 1) % (1 << 64))
        return (mix(keys + seed) % np.uint64(size)).astype("<i8")

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, "<i8"), np.arange(len(keys))
        for level, (size, packed, before) in enumerate(self.levels):
            at = self._place(keys[todo], level, size)
            byte = packed[at >> 3]
            hit = (byte >> (at & 7).astype("u1")) & 1 == 1
            out[todo[hit]] = before[at[hit] >> 3] + _BELOW[byte[hit], at[hit] & 7]
            todo = todo[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not stored."""
        out = self._ranks(keys)
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1
        return out


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase from that of its first words and its last word."""
    return mix(key * _STEP + word)


def keys_of(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n words at each place, and whether no break lies among them."""
    size = max(0, len(words) - n + 1)
    key, valid = words[:size].copy(), words[:size] != 0
    for k in range(1, n):
        key, valid = longer(key, words[k : k + size]), valid & (words[k : k + size] != 0)
    return key, valid


def _words(batch) -> list[tuple[str, list[bytes]]]:
    """Words of a batch by language, pieces and texts with breaks between them."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch["lang"], batch["text"], strict=True):
        if text:
            texts.setdefault(lang, []).append(text.encode())
    return [(lang, b"\n".join(found).translate(_FOLD).replace(_BREAK, b" \xff ").split()) for lang, found in texts.items()]


class _Words(dict):
    """64-bit hashes of words of a language, each computed once; 0 for breaks."""

    def __init__(self, lang: str):
        import xxhash

        super().__init__({_BREAK: 0})
        self.hash, self.seed = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.hash(word, seed=self.seed) or 1
        return found


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word of a language, 0 for breaks."""
    known = store("phrases")
    if sum(map(len, known.values())) > STORE:
        known.clear()
    if lang not in known:
        known[lang] = _Words(lang)
    return np.fromiter(map(known[lang].__getitem__, words), "<u8", len(words))


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Codes without those that stand alone between zeros, and one zero between runs: what no phrase needs goes."""
    there = codes != 0
    near = np.zeros(len(codes), bool)
    near[1:] |= there[:-1]
    near[:-1] |= there[1:]
    at = np.flatnonzero(there & near)
    return np.insert(codes[at], np.flatnonzero(np.diff(at) > 1) + 1, np.uint64(0))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """key, lang, word, n of the words that occur often enough, and a row of null word with the number of all words of a language."""

    def run(batches):
        import pandas as pd

        def rows(held):
            found = []
            for lang, counts in held.items():
                words = list(counts)
                key = _hashes(lang, words).view("<i8")
                found.append(pd.DataFrame({"key": key, "lang": lang, "word": [None if w == _BREAK else w.decode() for w in words], "n": list(counts.values())}))
            return pd.concat(found)

        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, words in _words(batch):
                counts = held.setdefault(lang, Counter())
                counts.update(words)
                counts[_BREAK] = 0
                counts[_BREAK] = sum(counts.values())  # all words of this language, in the row without a word
            if sum(map(len, held.values())) > WORDS:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    counted = _texts(docs).mapInPandas(_forgetful(run), "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
    return table(counted.where((F.col("n") >= least) | F.col("word").isNull()))


class Level:
    """Frequent phrases of one length in perfect hashes of some SHARD keys each, with the counts by slot; a key's shard is its remainder."""

    def __init__(self, found: DataFrame):
        """found: distinct key, n, tag (of a row of the coded texts that holds the phrase)."""
        self.spark = found.sparkSession
        size, self.total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.shards = max(1, -(-size // SHARD))

        def build(rows):
            import pandas as pd

            key = rows["key"].to_numpy().astype("<i8").view("<u8")
            made = PerfectHash(key)
            n, tag, slots = np.zeros(len(made.keys), "<i8"), np.zeros(len(made.keys), "<u4"), made.slots(key)
            n[slots], tag[slots] = rows["n"], rows["tag"]
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "made": [pickle.dumps((made, n, tag))]})

        shard = F.pmod("key", F.lit(self.shards)).cast("int").alias("shard")
        self.hashes = table(found.select(shard, "key", "n", "tag").groupBy("shard").applyInPandas(build, "shard int, made binary"))

    @contextlib.contextmanager
    def loaded(self, shard: int):
        """One shard's hash and counts, as a broadcast value."""
        row = self.hashes.where(F.col("shard") == shard).first()
        sent = self.spark.sparkContext.broadcast(pickle.loads(row["made"]) if row else (PerfectHash(np.zeros(0, "<u8")), np.zeros(0, "<i8"), np.zeros(0, "<u4")))
        yield sent
        sent.unpersist()


def _folded(keys: list[np.ndarray], counts: list[np.ndarray], tags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts and the first of their tags."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first), np.concatenate(tags)[order][first]


def _give_back() -> None:
    """Free memory goes back to the system, as groups are many and a worker waits beside others."""
    with contextlib.suppress(OSError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _forgetful(run):
    """A function of batches whose words are forgotten when its task ends."""

    def task(batches):
        yield from run(batches)
        store("phrases").clear()

    return lean(task)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], tags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums and one tag each: the keys get a minimal perfect hash, and every block adds to the slots of one array."""
    made = PerfectHash(np.unique(np.concatenate(keys)) if keys else np.zeros(0, "<u8"))
    total, tag = np.zeros(len(made.keys), "<i8"), np.zeros(len(made.keys), "<u4")
    for key, n, t in zip(keys, counts, tags, strict=True):
        slots = made.slots(key)
        total[slots] += n  # a block holds a key once
        tag[slots] = t
    return made.keys, total, tag


def coded(docs: DataFrame, words: Level, least: int) -> DataFrame:
    """lang, codes: the texts as 64-bit hashes of their frequent words, zeros for all others and for breaks; a row for each batch of texts."""

    def first(sent, shard, shards):
        def run(batches):
            import pandas as pd

            for batch in batches:
                rows = [(lang, _known(_hashes(lang, words), sent.value, shard, shards, least)) for lang, words in _words(batch)]
                if not rows:
                    continue
                yield pd.DataFrame({"lang": [g for g, _ in rows], "codes": [c.tobytes() for _, c in rows]})

        return run

    def more(sent, shard, shards):
        def run(batches):
            for rows in batches:
                yield rows.assign(codes=[_known(np.frombuffer(c, "<u8"), sent.value, shard, shards, least).tobytes() for c in rows["codes"]])

        return run

    kind = "lang string, codes binary"
    with words.loaded(0) as sent:
        out = table(_texts(docs).mapInPandas(_forgetful(first(sent, 0, words.shards)), kind))
    for shard in range(1, words.shards):
        before = out
        with words.loaded(shard) as sent:
            out = table(before.mapInPandas(lean(more(sent, shard, words.shards)), kind))
        forget(before)
    return out


def _known(codes: np.ndarray, level: tuple[PerfectHash, np.ndarray, np.ndarray], shard: int, shards: int, least: int) -> np.ndarray:
    """Codes without the words of a shard that aren't frequent."""
    made, often, _ = level
    if not len(codes):
        return codes
    mine = np.flatnonzero((codes != 0) & (np.mod(codes.view("<i8"), shards) == shard))
    slots = made.slots(codes[mine])
    bad = slots < 0
    bad[~bad] = often[slots[~bad]] < least
    codes = codes.copy()
    codes[mine[bad]] = 0
    return squeezed(codes)


def _rows(batch):
    """lang, codes and tag of each row; equal rows have one tag."""
    import xxhash

    for lang, codes in zip(batch["lang"], batch["codes"], strict=True):
        yield lang, np.frombuffer(codes, "<u8"), xxhash.xxh3_64_intdigest(codes) & 0xFFFFFFFF


def count(texts: DataFrame, n: int, under: Level | None, total: int, least: int) -> DataFrame:
    """key, n of the phrases of n words that occur often enough in coded texts. Only phrases whose first and last n - 1 words are frequent are counted (under; None for words).

    Mappers count what they hold in arrays, cut by key into parts; arrays of a part are summed in a tree, of two levels where there are more than FAN tasks. Parts are as many as keep an array small,
    however many phrases there are (total: occurrences of the level before).
    """
    spark = texts.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))

    def counting(sent, shard, shards):
        def run(batches):
            import pandas as pd
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0

            def parts():
                keys, counts, tags = _folded(*map(list, zip(*held, strict=True)))
                part = (keys % np.uint64(wide)).astype("<i8")
                order = np.argsort(part, kind="stable")
                keys, counts, tags, part = keys[order], counts[order], tags[order], part[order]
                cut = np.flatnonzero(np.diff(part)) + 1
                blocks = zip(part[np.concatenate([[0], cut])].tolist(), np.split(keys, cut), np.split(counts.astype("<u4"), cut), np.split(tags, cut), strict=True)
                return pd.DataFrame([(p, task // FAN, k.tobytes(), c.tobytes(), t.tobytes()) for p, k, c, t in blocks], columns=["part", "node", "keys", "counts", "tags"])

            for batch in batches:
                for _, codes, tag in _rows(batch):
                    key, whole = keys_of(codes, n)
                    if sent is not None:
                        short, valid = keys_of(codes, n - 1)
                        made, often, _ = sent.value
                        mine = valid if shards == 1 else valid & (np.mod(short.view("<i8"), shards) == shard)
                        at = np.flatnonzero(mine)
                        slots = made.slots(short[at])
                        hit = slots >= 0
                        hit[hit] = often[slots[hit]] >= least
                        good = np.zeros(len(short), bool)
                        good[at[hit]] = True
                        whole = whole & good[: len(key)] & (good[1 : len(key) + 1] | ~mine[1 : len(key) + 1])  # a last part of another shard can't be told here
                    found, times = np.unique(key[whole], return_counts=True)
                    if len(found):
                        held.append((found, times, np.full(len(found), tag, "<u4")))
                        size += len(found)
                if size > HELD:
                    yield parts()
                    held, size = [], 0
            if held:
                yield parts()

        return run

    def merged(rows, last):
        import pandas as pd

        parts = [(np.frombuffer(k, "<u8"), np.frombuffer(c, "<u4" if 2 * len(c) == len(k) else "<i8").astype("<i8"), np.frombuffer(t, "<u4")) for k, c, t in zip(rows["keys"], rows["counts"], rows["tags"], strict=True)]
        keys, counts, tags = (_summed if last else _folded)(*map(list, zip(*parts, strict=True)))
        _give_back()
        if last:
            often = counts >= least
            return pd.DataFrame({"key": keys[often].view("<i8"), "n": counts[often], "tag": tags[often].astype("<i8")})
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "node": [rows["node"].iloc[0]], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "tags": [tags.tobytes()]})

    kind, found = "part long, node int, keys binary, counts binary, tags binary", []
    deep = texts.rdd.getNumPartitions() > FAN
    small_batches(spark)
    for shard in range(under.shards if under else 1):
        with under.loaded(shard) if under else contextlib.nullcontext() as sent:
            arrays = texts.mapInPandas(lean(counting(sent, shard, under.shards if under else 1)), kind)
            if deep:
                arrays = arrays.groupBy("part", "node").applyInPandas(lambda rows: merged(rows, False), kind)
            found.append(table(arrays.groupBy("part").applyInPandas(lambda rows: merged(rows, True), "key long, n long, tag long")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def spelt(texts: DataFrame, level: Level, n: int) -> DataFrame:
    """key, lang, words (hashes) and a of every phrase of a level, told by the row of the coded texts whose tag the phrase has."""

    def telling(sent, shard, shards):
        def run(batches):
            import pandas as pd

            made, often, tags = sent.value
            for batch in batches:
                for lang, words, tag in _rows(batch):
                    key, valid = keys_of(words, n)
                    at = np.flatnonzero(valid)
                    slots = made.slots(key[at])
                    fresh = slots >= 0
                    fresh[fresh] = tags[slots[fresh]] == tag
                    new, first = np.unique(slots[fresh], return_index=True)
                    if len(new):
                        at = at[fresh][first]
                        yield pd.DataFrame({"key": key[at].view("<i8"), "lang": lang, "a": often[new], **{f"w{k}": words[at + k].view("<i8") if k < n else 0 for k in range(4)}})

        return run

    each = ", ".join(f"w{k} long" for k in range(4))
    parts = []
    for shard in range(level.shards):
        with level.loaded(shard) as sent:
            found = texts.mapInPandas(lean(telling(sent, shard, level.shards)), f"key long, lang string, a long, {each}").dropDuplicates(["key"])
            parts.append(table(found.select("key", "lang", F.array(*[f"w{k}" for k in range(n)]).alias("words"), "a")))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


_PARTS = "key long, lang string, words array<long>, a long, c1 array<long>, c2 array<long>, c3 array<long>, c4 array<long>"


def _mapped(frame: DataFrame, level: Level, make, schema: str) -> DataFrame:
    """frame through make(hash, counts, shard, shards), once for each of the level's hashes, written each time so that one hash alone is held."""
    for shard in range(level.shards):
        before = frame
        with level.loaded(shard) as sent:
            frame = table(before.mapInPandas(lean(make(sent, shard, level.shards)), schema))
        forget(before)
    return frame


def _by_length(rows):
    """(positions, words as a matrix) of the phrases of each length."""
    size = rows["words"].map(len).to_numpy()
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.array(rows["words"].iloc[at].tolist(), "<i8").view("<u8").reshape(len(at), n)


def _part_keys(words: np.ndarray, at: int, size: int) -> np.ndarray:
    """Keys of the parts of size words that begin at a place."""
    key = words[:, at].copy()
    for k in range(at + 1, at + size):
        key = longer(key, words[:, k])
    return key


def parts(found: DataFrame, level: Level, n: int) -> DataFrame:
    """Column c<n>: the counts of the parts of n words of each phrase, by the place where they begin, read by slot."""

    def make(sent, shard, shards):
        def run(batches):
            made, counts, _ = sent.value
            for rows in batches:
                out = rows[f"c{n}"].tolist()
                for at, words in _by_length(rows):
                    if words.shape[1] <= n:
                        continue
                    value = np.zeros((len(at), words.shape[1] - n + 1), "<i8")
                    for k in range(value.shape[1]):
                        key = _part_keys(words, k, n)
                        slots = made.slots(key)
                        mine = (np.mod(key.view("<i8"), shards) == shard) & (slots >= 0)
                        value[mine, k] = counts[slots[mine]]
                    for i, v in zip(at.tolist(), value, strict=True):
                        out[i] = out[i] + v if len(out[i]) else v
                rows[f"c{n}"] = out
                yield rows

        return run

    return _mapped(found, level, make, _PARTS)


def scores(found: DataFrame, swallowed: int) -> DataFrame:
    """Lowest cut of each phrase (l, r, score by exact whole numbers) and the keys of the parts that the phrase swallows."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for at, words in _by_length(rows):
                n, part = words.shape[1], rows.iloc[at]
                a = part["a"].to_numpy().astype(object)  # Python's whole numbers: products may pass 64 bits
                of = {size: np.array(part[f"c{size}"].tolist(), "<i8").reshape(len(at), n - size + 1).astype(object) for size in range(1, n)}
                cuts = np.stack([2_000_000 * a // (of[k][:, 0] + of[n - k][:, k]) for k in range(1, n)], 1)
                k = np.argmin(cuts, 1) + 1
                pick = lambda values: np.select([k == j for j in range(1, n)], values).astype("<i8")  # noqa: E731, B023
                keys = [(_part_keys(words, i, size).view("<i8"), 100 * a >= swallowed * of[size][:, i]) for size in range(2, n) for i in range(n - size + 1)]
                gone = [[int(key[r]) for key, holds in keys if holds[r]] for r in range(len(at))]
                made = {"l": pick([of[j][:, 0].astype("<i8") for j in range(1, n)]), "r": pick([of[n - j][:, j].astype("<i8") for j in range(1, n)]), "score": cuts.min(1).astype("<i8"), "gone": gone}
                out.append(part[["key", "lang", "words", "a"]].assign(**made))
            if out:
                yield pd.concat(out)

    return found.mapInPandas(run, "key long, lang string, words array<long>, a long, l long, r long, score long, gone array<long>")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, swallowed: int = SWALLOWED) -> DataFrame:
    """Phrases of 2 to longest (at most 4) words of each language that occur at least least times, by how seldom their parts stand alone.

    A phrase's score is floor(2000000 a / (l + r)) at its lowest cut; phrases inside a longer one with at least swallowed hundredths of their count go.
    Returns lang, rank, phrase, a, l, r, n, score: each language's first top rows by score and a descending, phrase ascending by bytes.

    Defined results: null text has no words; null lang is `und`; a repeated row counts each time; other columns are ignored; an empty table, and a language
    without a frequent phrase, gives no rows; ties of score and a go by phrase. Words are told apart by 64-bit hashes.
    """
    if longest > 4:
        raise ValueError("phrases have at most 4 words")
    docs = docs.select("lang", "text")
    words = word_counts(docs, least)
    levels = [Level(words.where("word is not null").select("key", "n", F.lit(0).cast("long").alias("tag")))]
    texts, phrases = coded(docs, levels[0], least), None
    for n in range(2, longest + 1):
        found = count(texts, n, levels[-1] if n > 2 else None, levels[-1].total, least)
        levels.append(Level(found))
        forget(found)
        told = spelt(texts, levels[-1], n)
        phrases = told if phrases is None else phrases.union(told)
    forget(texts)
    empty = F.array().cast("array<long>")
    read = phrases.select("key", "lang", "words", "a", *[empty.alias(f"c{n}") for n in range(1, 5)])
    for n, level in enumerate(levels[:-1], 1):
        read = parts(read, level, n)
    scored = table(scores(read, swallowed))
    kept = scored.join(scored.select(F.explode("gone").alias("key")).distinct(), "key", "left_anti")
    by = Window.partitionBy("lang")
    first = kept.withColumn("_at", F.rank().over(by.orderBy(F.desc("score"), F.desc("a")))).where(F.col("_at") <= top)
    names = first.select("key", F.posexplode("words").alias("_at", "_word")).join(words.select(F.col("key").alias("_word"), "word"), "_word")
    names = names.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.drop("_at").join(names, "key").withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    totals = words.where("word is null").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = {
    "op12_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS p
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k))),
f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY lang, k, p HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
x AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k > 1),
c AS (SELECT x.lang, x.k, x.p, x.a, x.ws, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.a // (l.f + r.f) AS BIGINT) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.p = array_to_string(list_slice(x.ws, 1, j), ' ')
             JOIN f AS r ON r.lang = x.lang AND r.p = array_to_string(list_slice(x.ws, j + 1, x.k), ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
s AS (SELECT lang, a, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS part
      FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM b, (VALUES (2), (3)) AS t(m) WHERE m < k)),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = b.lang AND s.part = b.p AND 100::HUGEINT * s.a >= 80::HUGEINT * b.a)),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, score FROM o)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON q.lang = n.lang WHERE rank <= 2000
""",
}
QUERIES = {"op12_phrases": op12_phrases}
