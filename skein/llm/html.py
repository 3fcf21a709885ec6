"""Operator 6, HTML extraction by equivalence-class template deduction over the pages of a host."""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import documents, forget, lean, small_batches, table

#: Share of a host's pages that a class must occur on to be part of its template, and pages a host must have for text to count as template.
SUPPORT, LEAST_PAGES = 0.5, 4
#: Share of the text outside of boilerplate that the content slot's element must hold.
MASS = 0.5

# HTML's void, raw-text and block-level elements, and elements and name parts that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option optgroup p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside button dialog embed footer form head header iframe input menu nav noscript object script search select style svg template textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "header masthead menu menus modal nav navbar navigation newsletter notice notices alert pager pagination popup promo promoted promotion related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_DIGIT = re.compile(r"\d")
#: Elements that hold one paragraph's or item's text and are no content slot.
LEAFY = frozenset("p li h1 h2 h3 h4 h5 h6 tr td dd dt pre blockquote".split())


def _marked(tag: str, attrs: str, inside_article: bool) -> bool:
    """Whether an element is boilerplate by its kind or name. An article's own header stays."""
    if tag in DROPPED and not (tag == "header" and inside_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for key, *value in _ATTR.findall(attrs):
        parts = _PART.split("".join(value).lower())
        if key.lower() == "role":
            if ROLES.intersection(parts):
                return True
        elif NAMES.intersection(parts) and not (inside_article and "header" in parts and tag == "header"):
            return True
    return False


class Page:
    """A page's block elements and texts, in page order.

    Of each element (0 is the page): parent, key of its path (names of the elements down to it, with their first class or id), depth, whether it lies in a
    paragraph-like element, the article or main element around it (-1: none) and whether it or one around it is boilerplate by kind or name. texts:
    (element, text, marked), text with one blank for any white space; marked as its element, or by an inline element around it. order: elements (as they
    open) and texts as they come, (False, element) or (True, place in texts). Linear in the page, however deep.
    """

    __slots__ = ("depth", "key", "landmark", "leafy", "marked", "order", "parent", "texts")

    def __init__(self, html: str):
        self.parent, self.key, self.depth, self.leafy, self.landmark, self.marked = [-1], [0], [0], [False], [-1], [False]
        self.texts: list[tuple[int, str, bool]] = []
        self.order: list[tuple[bool, int]] = []
        self._read(html)

    def _element(self, parent: int, tag: str, attrs: str, marked: bool) -> int:
        found = _ATTR.search(attrs) if attrs else None
        name = "".join(found.groups("")[1:]).split()[:1] if found and found[1].lower() != "role" else []
        step = tag + "".join("." + x for x in name if not _DIGIT.search(x))
        self.parent.append(parent)
        self.key.append(_hash(f"{self.key[parent]}/{step}"))
        self.depth.append(self.depth[parent] + 1)
        self.leafy.append(self.leafy[parent] or tag in LEAFY)
        here = len(self.key) - 1
        self.order.append((False, here))
        self.landmark.append(self.landmark[parent] if self.landmark[parent] >= 0 else here if tag in ("article", "main") else -1)
        self.marked.append(marked)
        return here

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, block element, marked
        open_: dict[str, int] = {}
        parts: list[str] = []
        marks: list[bool] = []

        def cut(at: int) -> None:
            for x in stack[at:]:
                open_[x[0]] -= 1
            del stack[at:]

        def flush() -> None:
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.order.append((True, len(self.texts)))
                    self.texts.append((stack[-1][1], text, all(marks)))
                parts.clear()
                marks.clear()

        pos, end = 0, len(html)
        while pos < end:
            m = _TOKEN.match(html, pos)
            if m is None:
                break
            pos = m.end()
            text = m["text"]
            if text is not None:
                if stack[-1][2] and not self.marked[stack[-1][1]]:
                    continue  # inside a marked inline element of a block that isn't marked
                parts.append(text)
                marks.append(stack[-1][2])
                continue
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, closing, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
            block = tag in BLOCK
            if block or tag == "br":
                flush()
            if closing:
                if open_.get(tag):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                    if block or not any(x[0] in BLOCK for x in stack[k:]):  # an inline end tag doesn't close blocks
                        cut(k)
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                pos = found.end() if found else end
                continue
            if block:
                if stack[-1][0] == "head" and tag not in ("noscript", "template"):
                    cut(len(stack) - 1)
                for k in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block begins, an item where the next one does
                    if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                        cut(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            elif attrs == "" and tag not in DROPPED:
                continue  # plain inline markup
            if attrs.rstrip().endswith("/") and not block:
                continue
            _, at, marked = stack[-1]
            marked = marked or _marked(tag, attrs, self.landmark[at] >= 0)
            stack.append((tag, self._element(at, tag, attrs, marked) if block else at, marked))
            open_[tag] = open_.get(tag, 0) + 1
        flush()

    def tokens(self) -> tuple[list[int], list[int]]:
        """A token for each element and each text: its path (and words), and how many times they have come before on the page."""
        seen: dict[int, int] = {}
        tags, words = [0] * len(self.key), [0] * len(self.texts)
        for is_text, n in self.order:
            key = _hash(f"{self.key[self.texts[n][0]]}\n{self.texts[n][1]}") if is_text else _hash(f"<{self.key[n]}")
            turn = seen[key] = seen.get(key, 0) + 1
            (words if is_text else tags)[n] = key if turn == 1 else _hash(f"{key}#{turn}")
        return tags, words

    def roles(self) -> list[int]:
        """Tokens of texts and of elements that aren't paragraph-like, as they come."""
        tags, words = self.tokens()
        return [(words if is_text else tags)[n] for is_text, n in self.order if is_text or not self.leafy[n]]

    def lengths(self) -> list[int]:
        """Characters of each token's text, 0 for tags."""
        return [len(self.texts[n][1]) if is_text else 0 for is_text, n in self.order if is_text or not self.leafy[n]]

    def regions(self, tags: list[int]) -> list[tuple[int, int, int, int, bool]]:
        """Of each element that has text which isn't marked: its token, characters below it, depth, token of the article or main element around it (0: none), and whether it is paragraph-like."""
        chars = [0] * len(self.key)
        for at, text, marked in self.texts:
            if not marked:
                chars[at] += len(text)
        for k in range(len(chars) - 1, 0, -1):  # children come after their parents
            chars[self.parent[k]] += chars[k]
        return [(tags[k], chars[k], self.depth[k], tags[self.landmark[k]] if self.landmark[k] >= 0 else 0, self.leafy[k]) for k in range(1, len(chars)) if chars[k]]

    def below(self, tags: list[int], token: int) -> list[bool]:
        """Of each element, whether it is or lies below the element of this token."""
        out = [False] * len(self.key)
        for k in range(1, len(out)):
            out[k] = out[self.parent[k]] or tags[k] == token
        return out


def host(url: str | None) -> str:
    """Host of a URL in lower case without port and user; empty if there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#\\]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw)


def classes_in_order(rows: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Positions of each class on a page, of (class, position) pairs."""
    out: dict[int, list[int]] = {}
    for c, at in sorted(rows, key=lambda r: r[1]):
        out.setdefault(c, []).append(at)
    return out


def signatures(roles: list[int], of: dict[int, int]) -> list[tuple[int, int, int]]:
    """(class, role, signature) of a page's roles that belong to a class. Classes are numbered from the most frequent.

    The signature holds the role's place in the order of its own class and, for every more frequent class that the page has, the gap of that class that it
    lies in. Where it is the same on all pages of the class, the class is ordered and the role nests in one slot of each larger class.
    """
    places = classes_in_order([(of[r], at) for at, r in enumerate(roles) if r in of])
    out = []
    for at, r in enumerate(roles):
        if r in of:
            own = of[r]
            gaps = [bisect.bisect(places[c], at) for c in sorted(places) if c < own]
            out.append((own, r, _hash(f"{bisect.bisect(places[own], at)}|{gaps}")))
    return out


def template_classes(classes: list[tuple[int, float, float, list[int]]]) -> list[int]:
    """Keys of the template among classes (pages, characters a page of the class, characters a page of all text there, keys).

    From the most frequent class down. A class that holds more than MASS of what the template so far leaves of its pages is the running text
    of copies or near copies of one article, not a template.
    """
    out: list[int] = []
    known = 0.0
    for _, own, whole, keys in sorted(classes, key=lambda c: (-c[0], c[1], c[3])):
        if own <= MASS * (whole - known):
            known += own
            out += keys
    return out


def templates(pages: DataFrame) -> DataFrame:
    """A row a host: its template (tokens) and its content slot (the token of an element).

    1. Every page gives its tokens in order, elements as they open and texts, and the characters below each element; the sequences are kept as a table of numbers.
    2. A token's occurrence vector over the host's pages is a sum of page hashes, which adds up map-side however many pages a host has. Tokens of equal vectors
       form an equivalence class, elements and texts apart; those on SUPPORT of the pages are frequent. (Equal sums and sums of squares are taken as equal vectors.)
    3. The sequences are read again: a frequent class is valid if its tokens come in one order on all its pages and each nests in one slot of every more frequent class.
    4. Valid classes make the template, but for the running text of copies (template_classes). What lies between its tokens are slots. The template's elements nest; the content slot
       is the deepest of them, paragraphs and the like aside, between whose tokens lies MASS of the host's text (texts of boilerplate names aside), widened to the article or
       main element around it. A host none of whose elements is in a valid class takes the deepest frequent one instead.
    """
    def read(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for page, url, html in zip(b["page_id"], b["url"], b["html"]):
                found = Page(html or "")
                mass = found.regions(found.tokens()[0])
                lengths = found.lengths()
                rows.append((host(url), _hash(f"{page}|{url}") % 1_000_003 + 1, found.roles(), lengths, sum(lengths), [v[0] for v in mass], [v[1] for v in mass], [v[2] - 100 * v[4] for v in mass], [v[3] for v in mass]))
            yield pd.DataFrame(rows, columns=["host", "turn", "roles", "lengths", "total", "paths", "chars", "depths", "marks"])

    small_batches(pages.sparkSession)
    parts = pages.select("page_id", "url", F.col("html").cast("string"))
    seqs = table(parts.mapInPandas(lean(read), "host string, turn long, roles array<long>, lengths array<int>, total long, paths array<long>, chars array<long>, depths array<int>, marks array<long>"))
    counted = table(seqs.groupBy("host").agg(F.count("*").alias("all_pages")))
    each = seqs.select("host", "turn", "total", F.explode(F.arrays_zip("roles", "lengths")).alias("r")).select("host", "turn", "total", F.col("r.roles").alias("key"), F.col("r.lengths").alias("length"))
    summed = each.groupBy("host", "key").agg(F.count("*").alias("pages"), F.sum("turn").alias("vector"), F.sum(F.col("turn") * F.col("turn")).alias("vector2"), F.sum("length").alias("chars"), F.sum("total").alias("total"))
    often = summed.where(F.col("pages") >= LEAST_PAGES * SUPPORT).join(counted.hint("merge"), "host").where((F.col("pages") >= F.col("all_pages") * SUPPORT) & (F.col("all_pages") >= LEAST_PAGES))
    frequent = table(often.select("host", "key", "pages", "vector", "vector2", "chars", "total"))
    rank = F.dense_rank().over(Window.partitionBy("host").orderBy(F.col("pages").desc(), "vector", "vector2", F.col("chars") > 0))  # of equal vectors elements come first, texts nest in them
    known = table(frequent.withColumn("class", rank).groupBy("host").agg(F.collect_list(F.struct("key", "class")).alias("known")))

    def check(batches):
        import pandas as pd

        for b in batches:
            out = []
            for name, roles, members in zip(b["host"], b["roles"], b["known"]):
                of = {int(m["key"]): int(m["class"]) for m in members}
                out += [(name, c, r, v) for c, r, v in signatures([int(r) for r in roles], of)]
            yield pd.DataFrame(out, columns=["host", "class", "key", "sign"])

    signed = seqs.select("host", "roles").join(known.hint("merge"), "host").mapInPandas(lean(check), "host string, class int, key long, sign long")
    order = signed.groupBy("host", "class", "key").agg((F.min("sign") == F.max("sign")).alias("same"))
    valid = table(order.groupBy("host", "class").agg(F.every("same").alias("valid"), F.collect_list("key").alias("keys")).where("valid").select("host", "class", F.explode("keys").alias("key")))

    def choose(batch):
        import pandas as pd

        classes = [(int(g["pages"].iloc[0]), g["chars"].sum() / g["pages"].iloc[0], g["total"].iloc[0] / g["pages"].iloc[0], sorted(g["key"].tolist())) for _, g in batch.groupby("class")]
        return pd.DataFrame({"host": [batch["host"].iloc[0]], "template": [template_classes(classes)]})

    template = frequent.join(valid, ["host", "key"]).groupBy("host").applyInPandas(choose, "host string, template array<long>")
    paths = seqs.select("host", F.explode(F.arrays_zip("paths", "chars", "depths", "marks")).alias("p")).select("host", "p.*")
    on = paths.groupBy("host", F.col("paths").alias("path")).agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.max("depths").alias("depth"), F.max("marks").alias("mark"))
    wide = on.join(counted.hint("merge"), "host").where(F.col("pages") >= F.col("all_pages") * SUPPORT)
    mass = wide.groupBy("host").agg(F.max("chars").alias("mass"))
    sure = valid.select("host", F.col("key").alias("path"), F.lit(True).alias("sure"))
    deep = wide.join(mass, "host").where(F.col("chars") >= F.col("mass") * MASS).join(sure, ["host", "path"], "left")
    deep = deep.groupBy("host").agg(F.max(F.struct(F.coalesce("sure", F.lit(False)).alias("sure"), "depth", "chars", "path", "mark")).alias("m"))
    slots = deep.select("host", F.when(F.col("m.mark") != 0, F.col("m.mark")).otherwise(F.col("m.path")).alias("slot"))
    found = table(counted.join(template, "host", "left").join(slots, "host", "left").select("host", "template", "slot"))
    forget(seqs, counted, frequent, known, valid)
    return found


def main_text(html: str, template: frozenset[int] | set[int] = frozenset(), slot: int | None = None) -> str:
    """Text of the host's content slot without the template's texts, nor those that names mark.

    A slot that holds less than MASS of the page's text outside of the template is not this page's: then its article and main elements are
    taken if they hold that much, else all text. If the template would leave nothing (pages that are copies of each other), its texts stay.
    """
    page = Page(html)
    tags, words = page.tokens()
    plain = [(at, text, word) for (at, text, marked), word in zip(page.texts, words) if not marked]
    fresh = [x for x in plain if x[2] not in template] or plain
    least = MASS * sum(len(text) for _, text, _ in fresh)
    inside = page.below(tags, slot) if slot else None
    for own in ([x for x in fresh if inside and inside[x[0]]], [x for x in fresh if page.landmark[x[0]] >= 0]):
        if own and sum(len(text) for _, text, _ in own) >= least:
            return "\n".join(text for _, text, _ in own)
    return "\n".join(text for _, text, _ in fresh)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page from its whole html.

    Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ''; null page_id is carried; repeated
    rows are all returned and count as pages; hosts of fewer than LEAST_PAGES pages have no template, so names and slots alone decide there; an empty table gives no rows; extra columns are ignored; markup that isn't closed ends
    with the page. Returns page_id, url, text, n_chars.
    """
    found = templates(pages)
    hosted = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#\\]*)", 1), r"^.*@|:.*$", ""))
    joined = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), hosted.alias("host")).join(found.hint("merge"), "host", "left").select("page_id", "url", "html", "template", "slot")

    def run(batches):
        import pandas as pd

        for b in batches:
            known: dict[bytes, frozenset[int]] = {}
            texts = []
            for html, template, slot in zip(b["html"], b["template"], b["slot"]):
                keys = frozenset()
                if template is not None and len(template):
                    keys = known.setdefault(template.tobytes(), None) or known.setdefault(template.tobytes() + b"!", frozenset(template.tolist()))
                texts.append(main_text(html or "", keys, None if slot is None or slot != slot else int(slot)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    small_batches(pages.sparkSession)
    return joined.mapInPandas(lean(run), "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))


QUERIES = {"op6_html": op6_html}
SQL: dict[str, str] = {}
