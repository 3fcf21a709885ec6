"""Operator 8, suffix-array dedup: bytes covered by long strings that occur elsewhere."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, lean, mix, partitions, small_batches, table, utf8

LENGTH = 400
#: Bytes of the leading gram by which suffixes are sampled and dealt.
GRAM = 64
#: Bytes of a text that are hashed at a time.
SEGMENT = 1_000_000
#: Suffixes of one leading gram that one task compares; of more, every window's hash is counted instead.
RUN = 1024
NO_ID = -(2**63)

_U = np.uint64
_BYTE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, _U(x)))]) for x in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; the hash of raw[i:j] is (s[j] - s[i]) * base^-i."""
    power, _ = _powers(len(raw) + 1)
    s = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=s[1:])
    return s


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (gram hash, context hash, at, low, high) of the sampled suffixes of a text.

    Every window of `length` bytes samples the suffix at its smallest gram hash (the first of equal ones), so that equal windows
    sample at equal offsets. A suffix at `at` stands for the windows that begin at at - high .. at - low; the context hash
    is that of all their bytes.
    """
    out = []
    width = length - gram + 1
    for base in range(0, max(0, len(text) - length + 1), SEGMENT):
        raw = np.frombuffer(text, np.uint8)[base : base + SEGMENT + length - 1]
        s, (_, inverse) = _sums(raw), _powers(len(raw) + 1)
        n = len(raw) - gram + 1
        h = mix((s[gram:] - s[:n]) * inverse[:n])
        v = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U)
        v[:n] = (h & ~_U(0xFFFFF)) | np.arange(n, dtype=_U)
        rows = v.reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        least = (np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & _U(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        last = np.append(first[1:], windows) - 1
        at = least[first]
        context = mix((s[last + length] - s[first]) * inverse[first] + ((at - first).astype(_U) << _U(10)) + (at - last).astype(_U))
        out.append((h[at].view(np.int64), context.view(np.int64), at + base, at - last, at - first))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Row order of a matrix of words by multikey quicksort: three-way partition by one word, equal rows go on with the next."""
    order: list[np.ndarray] = []
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            order.append(rows)
            continue
        v = words[rows, depth]
        pivot = v[len(v) // 2]
        stack += [(rows[v > pivot], depth), (rows[v == pivot], depth + 1), (rows[v < pivot], depth)]
    return np.concatenate(order) if order else np.empty(0, np.int64)


def _classes(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of strings and each one's common prefix with the one before it, among strings padded to size."""
    room = -(-size // 8) * 8
    raw = np.frombuffer(b"".join(x[:size].ljust(room, b"\0") for x in strings), np.uint8).reshape(len(strings), room)
    order = multikey_order(raw.view(">u8"))
    sizes = np.array([min(len(x), size) for x in strings])
    same = raw[order[1:]] == raw[order[:-1]]
    common = np.where(same.all(1), room, same.argmin(1)) if len(order) > 1 else np.empty(0, np.int64)
    return order, np.concatenate([[0], np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))]).astype(np.int64)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def repeated_offsets(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of one leading gram: smallest and largest offset d at which a suffix's window also occurs at another (-1: none).

    left: bytes before the suffix, reversed; right: bytes from it on. The window at d has d bytes of left and length - d of right.
    """
    m = len(left)
    least, most = np.full(m, -1), np.full(m, -1)
    if m <= 12:
        for i in range(m):
            for j in range(i):
                lo = max(length - _common(right[i], right[j]), int(low[i]), int(low[j]), 0)
                hi = min(int(high[i]), int(high[j]))
                if lo <= hi:
                    hi = min(hi, _common(left[i], left[j]))
                if lo <= hi:
                    for k in (i, j):
                        least[k] = lo if least[k] < 0 else min(least[k], lo)
                        most[k] = max(most[k], hi)
        return least, most
    by_left, common_left = _classes(left, length)
    by_right, common_right = _classes(right, length)
    class_left, class_right = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        class_left[by_left] = np.cumsum(common_left < d)
        class_right[by_right] = np.cumsum(common_right < length - d)
        able = np.flatnonzero((low <= d) & (d <= high))
        if len(able) < 2:
            continue
        _, of, count = np.unique(class_left[able] * (m + 1) + class_right[able], return_inverse=True, return_counts=True)
        hit = able[count[of] > 1]
        least[hit] = np.where(least[hit] < 0, d, least[hit])
        most[hit] = d
    return least, most


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """(k0, k1, spans array<struct<lo,hi>>): byte ranges to remove of each document, by doc_id and text hash."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k0"), F.xxhash64("text").alias("k1"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)

    # whole copies
    texts = table(keyed.select("k0", "k1", F.md5("text").alias("md5"), F.octet_length("text").alias("n")))
    copied = texts.groupBy("md5", "n").agg(F.count("*").alias("c")).where("c > 1").select("md5", "n")
    whole = texts.join(copied, ["md5", "n"]).select("k0", "k1", F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi")).distinct()

    # sampled suffixes, a copy's only once
    def sample(batches):
        for b in batches:
            for k0, k1, x in zip(b.column("k0").to_pylist(), b.column("k1").to_pylist(), utf8(b.column("text"))):
                h, f, at, low, high = anchors(x, length, gram)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k0)), pa.array(np.full(n, k1)), pa.array(h), pa.array(f), pa.array(at), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["k0", "k1", "h", "f", "at", "low", "high"])

    rows = keyed.mapInArrow(lean(sample), "k0 long, k1 long, h long, f long, at long, low int, high int")
    rows = table(rows.groupBy("k1", "at", "h", "f", "low", "high").agg(F.min("k0").alias("k0")))
    contexts = table(rows.groupBy("h", "f").agg(F.count("*").alias("c"), F.min(F.struct("k0", "k1", "at", "low", "high")).alias("r")))
    span = [(F.col("at") - F.col("high")).alias("lo"), (F.col("at") - F.col("low") + length).alias("hi")]
    full = rows.join(contexts.where("c > 1").select("h", "f"), ["h", "f"]).select("k0", "k1", *span)

    # suffixes that share the leading gram but not the whole context: one of each context is compared with the others
    grams = contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    open_ = table(contexts.join(grams, "h").select("h", "f", "m", (F.col("c") == 1).alias("alone"), "r.*"))
    wanted = open_.groupBy("k0", "k1").agg(F.collect_list(F.struct("h", "f", "m", "alone", "at", "low", "high")).alias("s"))

    def cut(batches):
        for b in batches:
            out = []
            for x, s in zip(utf8(b.column("text")), b.column("s").to_pylist()):
                for r in s:
                    at = r["at"]
                    out.append((r["h"], r["f"], r["m"], r["alone"], r["low"], r["high"], x[at - r["high"] : at][::-1], x[at : at - r["low"] + length], x[at : at + 16]))
                    if len(out) >= 2000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    fields = [("h", pa.int64()), ("f", pa.int64()), ("m", pa.int64()), ("alone", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("lead", pa.binary())]

    def _batch(rows_):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows_), fields)], [n for n, _ in fields])

    suffixes = keyed.join(wanted, ["k0", "k1"]).select("text", "s").mapInArrow(lean(cut), "h long, f long, m long, alone boolean, low int, high int, left binary, right binary, lead binary")
    suffixes = table(suffixes)

    # Range partitions by the leading bytes: Spark samples the splitters, and equal leads never straddle a boundary.
    dealt = suffixes.where(F.col("m") <= run).repartitionByRange(partitions(spark), "lead", "h").sortWithinPartitions("lead", "h", "f")

    def compare(batches):
        import pandas as pd

        def judge(part):
            part = part.drop_duplicates("f")
            low, high = part["low"].to_numpy(), part["high"].to_numpy()
            least, most = repeated_offsets(list(part["left"]), list(part["right"]), low, high, length)
            hit = (most >= 0) & part["alone"].to_numpy()
            return pd.DataFrame({"h": part["h"][hit], "f": part["f"][hit], "least": least[hit], "most": most[hit]})

        kept, out = None, []
        for b in batches:
            b = b if kept is None else pd.concat([kept, b])
            last = b["h"].iloc[-1]
            kept = b[b["h"] == last]
            done = [judge(x) for _, x in b[b["h"] != last].groupby("h", sort=False) if len(x) > 1]
            out = [x for x in done if len(x)]
            if out:
                yield pd.concat(out)
        if kept is not None and len(kept) > 1:
            yield judge(kept)

    small_batches(spark)
    found = table(dealt.mapInPandas(lean(compare), "h long, f long, least int, most int"))

    # frequent leading grams: the exact way without comparing members, by counting every window's hash
    def windows(batches):
        for b in batches:
            for h, f, alone, low, high, left, right in zip(*(b.column(c).to_pylist() for c in ("h", "f", "alone", "low", "high", "left", "right"))):
                raw = np.frombuffer(left[::-1] + right, np.uint8)
                s, (_, inverse) = _sums(raw), _powers(len(raw) + 1)
                d = np.arange(low, high + 1)
                start = high - d
                w = mix((s[start + length] - s[start]) * inverse[start])
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, f)), pa.array(np.full(n, alone)), pa.array(d.astype(np.int32)), pa.array(w.view(np.int64))], ["h", "f", "alone", "d", "w"])

    hot = suffixes.where(F.col("m") > run).dropDuplicates(["h", "f"])
    each = table(hot.mapInArrow(lean(windows), "h long, f long, alone boolean, d int, w long"))
    twice = each.groupBy("h", "d", "w").agg(F.count("*").alias("c")).where("c > 1").select("h", "d", "w")
    hot_found = each.where("alone").join(twice, ["h", "d", "w"]).groupBy("h", "f").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    partly = found.union(hot_found).join(open_.where("alone").select("h", "f", "k0", "k1", "at"), ["h", "f"]).select(
        "k0", "k1", (F.col("at") - F.col("most")).alias("lo"), (F.col("at") - F.col("least") + length).alias("hi")
    )
    return whole.union(full).union(partly).groupBy("k0", "k1").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN, texts: bool = False) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts elsewhere in the corpus.

    Suffixes are sampled by content: each window of `length` bytes names one suffix, at its smallest gram hash, so equal windows
    name suffixes that begin alike at the same offset. Suffixes whose whole context repeats are settled by an aggregate. The
    others are range-partitioned by sampled splitters on their leading bytes, sorted within runs of one gram by multikey
    quicksort (their left contexts too), and common prefixes of neighbours tell which windows occur twice. As all windows
    of a suffix contain it, its covered bytes are one range. Runs above `run` suffixes are settled by counting window hashes.

    Defined results: null text is empty; texts shorter than `length` lose nothing; copies of a whole text (repeated rows too) lose all of
    it; null doc_id is carried; an empty table gives no rows; extra columns are ignored.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if texts.
    """
    import pyarrow as pa

    spans = table(covered(docs, length, gram, run))
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k0"), F.xxhash64("text").alias("k1"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(spans, ["k0", "k1"], "left").select(F.col("doc_id").cast("long"), "text", "spans")

    def remove(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for x, s in zip(utf8(b.column("text")), b.column("spans").to_pylist()):
                s = merge([(r["lo"], r["hi"]) for r in s or ()])
                kept, at = [], 0
                for lo, hi in s:
                    kept.append(x[at:lo])
                    at = hi
                rest = b"".join([*kept, x[at:]])
                for c, v in zip(out, (len(x), len(x) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            columns = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[4], pa.binary())] if texts else columns, [*names, "kept"] if texts else names)

    return joined.mapInArrow(lean(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


QUERIES = {"op8_substrings": op8_substrings}
SQL: dict[str, str] = {}
