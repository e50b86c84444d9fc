"""Main text of HTML pages, with the removal of site templates.

A page is scanned once into blocks of text. Every block-level element is a
template candidate: the hash of its subtree (tags, attributes and text) is
counted over the pages of its host, in Spark, and what recurs in at least
``MANY_PAGES`` pages and ``MANY_SHARE`` of all pages of a host is deleted with
all its text, inside an article as well. Pages with the same text count as one,
so that copies of an article are no evidence of a template.
Scripts, forms, navigation, notices, adverts and comments go by their tags,
roles and class names, for hosts with too few pages to count. A class name or id
counts if all its parts are words of page furniture or of layout, one at least of
furniture (site-footer, but not menu-planning); headings and paragraphs of a
marked article do not go by their names. Where a page marks its article (article,
main, role=main), the text is what lies in it, unless that is under ``MAIN_SHARE``
of what is no furniture, as a teaser is. Pages without a host are not counted.

What the scan finds is written and read back: the page itself is read once. The
scan takes time in proportion to the page, however deep or broken it is.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import lean
from scholium.session import materialise

MANY_PAGES = 5
MANY_SHARE = 0.5
MAIN_SHARE = 0.25

# fixed values: element names and class words
RAW = {"script", "style", "textarea", "title"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "select", "noscript", "template", "iframe"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"nav", "header", "footer", "aside", "div", "section", "ul", "ol", "dl", "table", "form", "menu", "p", "figure", "details"}
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead comment comments disqus share sharing social related recommended widget toolbar pagination skip".split()
)
LAYOUT_WORDS = set("site page main top bottom left right global primary secondary header box bar block slot unit area container wrapper wrap inner outer content section list item items link links group panel row column col post article user reader js the".split())
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
TAG_STOP = re.compile(r"[>\"']")
PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
#: Start tags that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"button", "iframe", "noscript", "object", "select", "template", "ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "td", "th", "blockquote", "aside", "nav", "form", "header", "footer", "menu"}


class Element:
    __slots__ = ("candidate", "chrome", "digest", "inner", "links", "main", "tag", "wraps")

    def __init__(self, tag: str, attributes: str, chrome: bool, main: bool):
        self.tag, self.chrome, self.main = tag, chrome, main
        self.candidate, self.wraps, self.links, self.inner = -1, False, 0, 0
        self.digest = xxhash.xxh3_64(f"<{tag} {' '.join(attributes.split())}>".encode("utf-8", "surrogatepass"))


def _furniture(names: str) -> bool:
    """Whether a class attribute or an id names page furniture."""
    for name in names.split():
        parts = [x.lower().rstrip("0123456789") for x in PARTS.split(name)]
        if any(x in CHROME_WORDS for x in parts) and all(not x or x in CHROME_WORDS or x in LAYOUT_WORDS for x in parts):
            return True
    return False


def _marks(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture, and whether it is the main content."""
    chrome, main = tag in CHROME, tag in ("article", "main")
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            chrome = True
        elif name == "role":
            main |= value == "main"
            chrome |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        elif name in ("class", "id") and tag not in ("html", "body", "main") and not (in_main and tag in TEXT_TAGS) and _furniture(value):
            chrome = True
    return chrome, main


class Scan:
    """Blocks of a page, each with the innermost candidate that it lies in; candidates with their parents and hashes."""

    def __init__(self, page: str):
        self.page, self.stack, self.blocks, self.parts = page, [], [], []
        self.parents: list[int] = []
        self.hashes: list[int | None] = []
        self.inner_candidate = -1
        #: Place on the stack of the furniture that stands in a line of text, if any.
        self.aside = -1
        self.unclosed: set[int] = set()
        self.open_tags: Counter[str] = Counter()
        self.n_chrome = self.n_main = 0
        self._run()

    def _flush(self, depth: int) -> None:
        """End the block of text; within furniture that stands in a line, above ``depth``, the line goes on."""
        if self.parts and not (0 <= self.aside < depth):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                chrome = self.n_chrome - sum(e.chrome for e in self.stack[self.aside :]) if self.aside >= 0 else self.n_chrome
                self.blocks.append((text, chrome > 0, self.n_main > 0, self.inner_candidate))

    def _text(self, raw: str) -> None:
        if raw:
            if self.aside < 0:
                self.parts.append(entities.unescape(raw) if "&" in raw else raw)
            if self.stack and (words := raw.split()):
                top = self.stack[-1]
                plain = " ".join(words)
                top.digest.update(plain.encode("utf-8", "surrogatepass"))
                top.inner += len(plain)
                if self.open_tags["a"]:
                    top.links += len(plain)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush(len(self.stack))
        ends = CLOSES.get(tag) or ({"p"} if tag in BLOCK else ())
        if any(self.open_tags[t] for t in ends):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in ends:
                    self._close_to(k)
                    break
                if self.stack[k].tag in SCOPES:
                    break
        chrome, main = _marks(tag, attributes, self.n_main > 0) if attributes.strip() else (tag in CHROME, tag in ("article", "main"))
        if tag == "header" and not self.n_main:
            chrome = True
        element = Element(tag, attributes, chrome, main)
        if tag in CONTAINERS and not main:
            element.candidate = len(self.hashes)
            self.hashes.append(None)
            self.parents.append(self.inner_candidate)
            self.inner_candidate = element.candidate
        self.stack.append(element)
        if chrome and tag not in BLOCK and self.aside < 0:
            self.aside = len(self.stack) - 1
        self.open_tags[tag] += 1
        self.n_chrome += chrome
        self.n_main += main

    def _close_to(self, k: int) -> None:
        """End the elements from the k-th on."""
        self._flush(k)
        while len(self.stack) > k:
            e = self.stack.pop()
            self.open_tags[e.tag] -= 1
            self.n_chrome -= e.chrome
            self.n_main -= e.main
            if self.aside == len(self.stack):
                self.aside = -1
            own = e.digest.intdigest() - (1 << 63)
            if e.candidate >= 0:
                self.inner_candidate = self.parents[e.candidate]
                if e.inner and not e.wraps:
                    self.hashes[e.candidate] = own
            if self.stack:
                above = self.stack[-1]
                above.digest.update(own.to_bytes(8, "little", signed=True))
                above.inner += e.inner
                above.links += e.links
                above.wraps |= e.wraps or (e.main and not e.chrome)

    def _end(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                if tag in BLOCK:
                    self._close_to(k)
                else:
                    self._close_inline(k)
                return
            if tag not in BLOCK and tag not in CHROME and self.stack[k].tag in BLOCK:
                return  # it ends with the block around

    def _close_inline(self, k: int) -> None:
        parts, self.parts = self.parts, []
        self._close_to(k)
        self.parts = parts

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag: the first outside quotes, or where a quote is never closed, the first of all.

        Opening quotes from which the end of the page was reached in vain are kept,
        so each is followed once.
        """
        seen, place = [], at
        while m := TAG_STOP.search(self.page, place):
            if m[0] == ">":
                return m.start()
            close = -1 if m.start() in self.unclosed else self.page.find(m[0], m.end())
            seen.append(m.start())
            if close < 0:
                break
            place = close + 1
        self.unclosed.update(seen)
        return self.page.find(">", at)

    def _run(self) -> None:
        page, at, size = self.page, 0, len(self.page)
        last = page.rfind(">")
        while at < size:
            start = page.find("<", at)
            if start < 0 or start > last and not page.startswith(("<!", "<?"), start):
                break
            self._text(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
                continue
            m = TAG.match(page, start)
            end = self._tag_end(m.end()) if m else -1
            if end < 0:
                self._text("<")
                at = start + 1
                continue
            closing, tag, attributes, at = m[1], m[2].lower(), page[m.end() : end], end + 1
            if closing:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            elif tag in VOID:
                if tag in BLOCK:
                    self._flush(len(self.stack))
                elif tag == "br":
                    self.parts.append(" ")
            elif attributes.endswith("/") and tag not in BLOCK:
                pass
            else:
                self._open(tag, attributes)
        self._text(page[at:])
        self._close_to(0)

    def kept(self) -> list[tuple[str, int]]:
        """Text and innermost candidate of the blocks that tags and names leave."""
        left = [(text, main, inside) for text, chrome, main, inside in self.blocks if not chrome]
        marked = sum(len(t) for t, main, _ in left if main)
        only_main = marked > 0 and marked >= MAIN_SHARE * sum(len(t) for t, _, _ in left)
        return [(text, inside) for text, main, inside in left if main or not only_main]


def left_of(texts: list[str], inside: list[int], parents: list[int], hashes: list[int | None], gone: set[int]) -> str:
    """The text without blocks that lie in a candidate whose hash is gone, or in one below it."""
    dropped = []
    for parent, h in zip(parents, hashes, strict=True):  # parents come first
        dropped.append(h in gone or (parent >= 0 and dropped[parent]))
    return "\n".join(t for t, c in zip(texts, inside, strict=True) if c < 0 or not dropped[c])


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def extract(pages: DataFrame, many: int = MANY_PAGES, share: float = MANY_SHARE) -> DataFrame:
    """Main text of each page: page_id, url, text.

    A null or empty page has an empty text, and so has one without text of its
    own. Pages without a url, or a host in it, are cut by tags and names alone.
    Repeated rows each give a row (and count as one page of their host).
    Columns other than page_id, url and html are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                some = batch.slice(start, 500)
                hosts, contents, found = [], [], []
                for url, page in zip(some.column("url").to_pylist(), some.column("html").to_pylist(), strict=True):
                    made = Scan(page)
                    kept = made.kept()
                    texts = [t for t, _ in kept]
                    hosts.append(host_of(url))
                    inner = hosts[-1] != "" and any(c >= 0 for _, c in kept)  # else no template can take anything
                    contents.append(xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63))
                    found.append((texts, [c for _, c in kept], made.parents if inner else [], made.hashes if inner else []))
                lists = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), *lists], ["page_id", "url", "host", "content", "texts", "inside", "parents", "hashes"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [left_of(r["texts"], r["inside"], r["parents"], r["hashes"], set(r["gone"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    scanned = rows.mapInArrow(lean(scan), f"page_id {kind}, url string, host string, content long, texts array<string>, inside array<int>, parents array<int>, hashes array<long>")
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()))

    own = F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))
    met = scanned.filter(F.size("hashes") > 0).select("row", "host", "content", F.explode(own).alias("hash"))
    whole = scanned.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    counted = met.select("host", "content", "hash").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= many)
    templates = materialise(counted.join(whole, "host").filter(F.col("pages") >= share * F.col("all_pages")).select("host", "hash"))
    gone = materialise(met.select("row", "host", "hash").join(templates, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone")))
    marked = scanned.join(gone, "row", "left")
    final = marked.filter(F.col("gone").isNull()).select("page_id", "url", F.array_join("texts", "\n").alias("text"))
    cleared = marked.filter(F.col("gone").isNotNull()).select("page_id", "url", "texts", "inside", "parents", "hashes", "gone").mapInArrow(lean(cut), f"page_id {kind}, url string, text string")
    return final.unionByName(cleared)
