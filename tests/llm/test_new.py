"""Operators 11 to 13 against plain Python and the tokenizers' own libraries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import alignment, phrases, urls
from skein.llm.tokens import path

DOCS = "doc_id long, text string, lang string, key string, word string, n long, block string, pairs string"


# ---- operator 11


def plain_judge(url, found):
    head, mark, tail = (url or "").partition("://")
    host = re.match(r"[^/?#]*", tail).group() if mark else ""
    lower = lambda x: x.translate({c: c + 32 for c in range(65, 91)})
    path_of = re.match(r"[^?#]*", tail[len(host) :], re.S).group() if mark else ""
    host = lower(host)
    fits = [r for r in found if r.kind == "place" and re.match(r.regex, host + path_of)] if mark else []
    if fits:
        best = max(fits, key=lambda r: (len(r.rule), r.rule))
        return host, path_of, best.rule, best.verdict
    hit = {r.verdict for r in found if mark and r.kind == "pattern" and re.search(r.regex, lower(tail))}
    return host, path_of, None, "block" if hit == {"block"} else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.com/x", "http://notcom/", "http://example.com/en/1", "http://EXAMPLE.com/EN/1", "http://www.example.com/en/",
    "http://m.www.example.com/en/2?x=http://net/es/", "http://badexample.com/en/", "ftp://net/es/a", "http://a.b.net/fr/?q", "http://net/fr", "http://net?/es/", "http://x.com:80/en/",
    "http://ads.site.org/x", "http://loads.site.org/x", "http://spam-farm.example.org/en/1#top", "http://site.org/banner/ads/x.gif", "http://site.org/affiliate", "http://site.org/affiliates",
    "http://adult-education.site.org/1", "http://site.org/wp-login.php?x", "http://site.org/a-wp-login.php", "http://site.org/login?redirect=http://a", "http://é.org/ü\nx", "x://y://z.com/a", "http://user@ads.org/",
]


@pytest.mark.parametrize("size", [urls.BROADCAST_BYTES, 0])
def test_urls_match_all_rules_against_all(spark, monkeypatch, size):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", size)
    monkeypatch.setattr(urls, "HOT_ROWS", 3)  # most tokens are hot, so that rules are copied
    found = urls.rules() + [urls.pattern_rule("*"), urls.pattern_rule("@@||ads.site.org^"), urls.pattern_rule("site*banner")][1:]
    rows = [(k, u, "html", "t") for k, u in enumerate([*URLS, *URLS[10:20]])] + [(None, "http://ads.org/", None, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, token string"), found).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((r[0], *plain_judge(r[1], found))) for r in rows)


def test_rules_without_tokens_meet_every_url(spark):
    found = [urls.pattern_rule("-bets"), urls.pattern_rule("x*y")]
    assert all(r.tokens == () for r in found)
    rows = [(1, "http://a.org/my-betsy"), (2, "http://a.org/xaby"), (3, "http://a.org/yx")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), found)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "allow"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), found).count() == 0
    assert {r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), []).collect()} == {"allow"}


def test_index_takes_the_rarest_token(spark):
    found = spark.createDataFrame([(r.rule, r.kind, r.verdict, r.regex, list(r.tokens)) for r in urls.rules(patterns=("||ads.example.org^",))], urls.RULES)
    seen = spark.createDataFrame([(f"a{k}.example.com/en/{k}",) for k in range(9)] + [("x.example.org/ads",)], "tail string")
    rarest, _ = urls.index(seen, found, 0)
    assert {r.rule: r.token for r in rarest.collect()}["||ads.example.org^"] in ("ads", "org")
    assert {r.rule: r.token for r in rarest.collect()}["www.example.com/en/"] == "www"


# ---- operator 12


def plain_phrases(rows, least, top, swallowed=80):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    count[lang, tuple(words[i : i + n])] += 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, count[lang, p[:k]], count[lang, p[k:]], score)
    gone = {(g, p[i : i + m]) for (g, p), v in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * v[0] >= swallowed * count[g, p[i : i + m]]}
    out = []
    for lang in {g for g, _ in found}:
        mine = sorted(((-v[3], -v[0], " ".join(p).encode()), " ".join(p), v) for (g, p), v in found.items() if g == lang and (g, p) not in gone)
        out += [(lang, rank, p, v[0], v[1], v[2], total[lang], v[3]) for rank, (_, p, v) in enumerate(mine[:top], 1)]
    return sorted(out)


def talk(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "new", "york", "x\x00y", "\x85"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", new york city "]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text, ["en", None, "de", "und"][i % 4]))
    return rows + [(None, None, "en"), (None, "", None), (3, "solo", "fr"), (3, "solo", "fr")]


@pytest.mark.parametrize("shard,part,fan,top", [(phrases.SHARD, phrases.PART, phrases.FAN, 2000), (150, 100, 1, 5)])
def test_phrases_match_plain_counts(spark, monkeypatch, shard, part, fan, top):
    for name, value in (("SHARD", shard), ("PART", part), ("FAN", fan), ("HELD", part)):
        monkeypatch.setattr(phrases, name, value)
    rows = talk(60, 5)
    df = spark.createDataFrame([(*r, "k", "w", 1, "b", "p") for r in rows], DOCS).repartition(3)
    got = phrases.collocations(df, least=6, top=top).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 6, top)


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOCS)).count() == 0


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    made = phrases.PerfectHash(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), keys)
    assert (made.slots(other) == -1).all() and len(phrases.PerfectHash(keys[:0]).slots(other[:3])) == 3


def test_scores_beyond_64_bits(spark):
    big = 1 << 61
    row = [(1, "en", [5, 6], big, [big + 3, big + 9], [], [], [])]
    got = phrases.scores(spark.createDataFrame(row, phrases._PARTS), 80).first()
    assert got.score == 2_000_000 * big // (2 * big + 12) and (got.l, got.r) == (big + 3, big + 9)


# ---- operator 13


def plain_alignment(rows):
    own = alignment.Aligner(path(alignment.A_FILE), path(alignment.B_FILE))
    count, found = Counter(), {}
    for i, text in rows:
        tokens = own.tokens(text) if text else None
        assert not text or own.encode_by_library(" " + text) == own.encode_a(" " + text)
        if tokens is None:
            found[i] = None
            continue
        spans, ends = [], []
        for ids, names in zip(tokens, (own.a_bytes, own.b_bytes)):
            stops = np.cumsum([len(names[t]) for t in ids]).tolist()
            spans.append(list(zip([0, *stops[:-1]], stops)))
            ends.append(set(stops))
        both = sorted(ends[0] & ends[1])
        part = lambda side, lo, hi: ",".join(str(t) for t, (b, e) in zip(tokens[side], spans[side]) if lo <= b < hi)  # noqa: B023, E731
        groups = [f"{part(0, lo, hi)}|{part(1, lo, hi)}" for lo, hi in zip([0, *both[:-1]], both)]
        links = [(a, b) for a, (x0, x1) in zip(tokens[0], spans[0]) for b, (y0, y1) in zip(tokens[1], spans[1]) if x0 < y1 and y0 < x1]
        count.update(links)
        found[i] = (len(tokens[0]), len(tokens[1]), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, *x[:3], len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for i, x in found.items())


TEXTS = [
    None, "", " ", "a", "  a  b\tc\n d ", "new york, New York's 1234 56", "x▁y z", "plain <|endoftext|> and <s> </s> <unk> <0x41>", "\n\nfoo \n bar\r\n baz", "a\x00b \x1c c \x85 d\u3000e \u2028f",
    "naïve é́ ﬁ 漢字かな 😀👍🏽 עברית", "word " * 300, "'s 't'll we'll  're", "\x7f\x80 \ufeff x", "....  !!", "tab\t\tx \t y", "trailing ", "x" * 5000, "C:\\dir\\file.txt {\r\n  a: 1;\r\n}",
]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 50])
def test_alignment_matches_whole_texts(spark, block_bytes):
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "".join(rng.choice("ab é\n.▁,'1  ") for _ in range(40))) for k in range(60)]
    df = spark.createDataFrame([(*r, "en", "k", "w", 1, "b", "p") for r in rows], DOCS).repartition(3)
    got = alignment.align(df, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_alignment(rows)


def test_alignment_of_repeated_rows_and_nulls(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), ((1 << 60) + 1, "a b"), (None, None)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 2, None: 2, (1 << 60) + 1: 1})
    full = [r for r in got if r.n_a]
    assert len(full) == 4 and all(r.count_sum == 4 * r.n_links and r.n_best == r.n_links for r in full)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_units_are_cut_only_where_both_sides_agree():
    own = alignment.Aligner(path(alignment.A_FILE), path(alignment.B_FILE))
    assert own.cuts
    for text in filter(None, TEXTS):
        parts, whole = [own.tokens(u) for u in own.units(text)], own.tokens(text)
        if whole is not None:
            assert [sum((p[side] for p in parts), []) for side in (0, 1)] == list(whole)


def test_merge_gives_groups_and_links():
    a, b = np.array([1, 2, 3]), np.array([1, 2, 3])
    ends, i, j, closes = alignment.merge(a, b, np.array([0, 2, 1, 2]), np.array([0, 1, 2, 2]))  # ab c de, a bc de
    assert ends.tolist() == [1, 2, 3, 5] and list(zip(a[i].tolist(), b[j].tolist())) == [(1, 1), (1, 2), (2, 2), (3, 3)]
    assert closes.tolist() == [False, False, True, True]


def test_units_learnt_together_and_alone_are_the_same():
    own, other = (alignment.Aligner(path(alignment.A_FILE), path(alignment.B_FILE)) for _ in range(2))
    units = list(dict.fromkeys(u for text in TEXTS if text for u in own.units(text)))
    own.learn(units)
    for u in units:
        other.learn([u])
    of = lambda x, u: (x.groups[x.known[u]], x.links[x.known[u]], x.sizes[x.known[u]].tolist())
    assert all(of(own, u) == of(other, u) for u in units) and any("▁" in u for u in units)


def test_alignment_block_holds_numbers_not_texts():
    import tracemalloc

    own = alignment.Aligner(path(alignment.A_FILE), path(alignment.B_FILE))
    texts = ["the quick brown fox jumps over the lazy dog " * 40] * 500  # 0.9 MB in 180,000 units of 9 words
    block = alignment._Block(own)
    block.add([1], texts[:1])
    tracemalloc.start()
    for n in range(0, len(texts), 10):
        block.add(list(range(10)), texts[n : n + 10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    row = block.row(7)
    assert peak < 4_000_000  # units as strings alone would take 9 MB
    assert row["block"] == 7 and row["n_units"] == 501 * 360 and row["n_used"] < 256 and len(row["units"]) == row["n_units"]
    for values in ([], [0], [0, 255], [3, 256, 65535], [1 << 20]):
        assert alignment._numbers(alignment._small(np.array(values, "<i8")), len(values)).tolist() == values
