"""Text of article XML (JATS, Elsevier) as Spark expressions: no parser in Python.

``text_of`` prepares the XML (no declaration and DOCTYPE, CDATA as text, unknown
entities dropped), and takes its text nodes by XPath, leaving out the subtrees that
are no text. Paragraphs, which XPath cannot group, are marked at their ends by two
private characters and folded. XML that is not well-formed is cut at its tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions.text import bound

# fixed values: where the body of an article stands, what in it is no text, and its paragraphs
BODIES = {"jats": ("body",), "elsevier": ("ce:sections", "body", "rawtext")}
SKIPPED = {"jats": ("fig", "table-wrap", "supplementary-material"), "elsevier": ()}
PARAGRAPH = {"jats": "p", "elsevier": "ce:para"}
MOST_CHARS, LEAST_CHARS = 200_000, 100

INNER = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?"""
OPENED, CLOSED = "\ue000", "\ue001"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def prepared(xml: Column, paragraph: str) -> Column:
    """XML that Spark's parsers take, below one root, with its paragraphs marked."""
    plain = F.regexp_replace(F.translate(xml, OPENED + CLOSED, ""), r"(?s)<\?xml.*?\?>|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", "")
    # a comment parts two texts, as an instruction does
    plain = F.regexp_replace(plain, r"(?s)<!--.*?-->", "<?c?>")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    opened = lambda c: F.concat(escaped(F.substring_index(c, "]]>", 1)), F.when(F.contains(c, F.lit("]]>")), F.regexp_replace(c, r"(?s)^.*?\]\]>", "")).otherwise(""))
    cut = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), opened), ""))
    plain = F.when(F.contains(plain, F.lit("<![CDATA[")), bound(F.split(plain, r"<!\[CDATA\["), cut)).otherwise(plain)
    plain = F.regexp_replace(plain, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)[A-Za-z][A-Za-z0-9]*;", "")
    plain = F.regexp_replace(plain, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    plain = F.regexp_replace(plain, rf"<{paragraph}({INNER}?)/>", rf"<{paragraph}$1></{paragraph}>")
    plain = F.regexp_replace(plain, rf"(<{paragraph}{INNER}>)", f"$1{OPENED}")
    return F.concat(F.lit("<r>"), F.replace(plain, F.lit(f"</{paragraph}>"), F.lit(f"{CLOSED}</{paragraph}>")), F.lit("</r>"))


def well_formed(xml: Column) -> Column:
    read = F.from_xml(xml, "_wrong string", {"columnNameOfCorruptRecord": "_wrong"})
    return read.isNotNull() & read["_wrong"].isNull()


def _named(*names: str) -> str:
    return " or ".join(f"name()='{n}'" for n in names)


def _marks(c: Column) -> Column:
    return F.translate(c, OPENED + CLOSED, "")


def _lines(nodes: Column) -> Column:
    """Texts trimmed, empty ones left out, one a line."""
    return F.array_join(F.filter(F.transform(nodes, lambda n: _stripped(_marks(n))), lambda n: n != ""), "\n")


def _paragraphs(nodes: Column) -> Column:
    """The text of each paragraph, pieces trimmed and put together, in the order of their beginnings; of paragraphs in paragraphs both."""
    none = F.array().cast("array<struct<n:int,text:string>>")
    state = F.struct(F.lit(0).alias("n"), none.alias("open"), none.alias("done"))

    def step(s: Column, node: Column) -> Column:
        starts, ends, text = F.startswith(node, F.lit(OPENED)), F.endswith(node, F.lit(CLOSED)), _stripped(_marks(node))
        one = F.array(F.struct(s["n"].alias("n"), F.lit("").alias("text")))
        filled = bound(F.when(starts, F.concat(s["open"], one)).otherwise(s["open"]), lambda o: F.transform(o, lambda p: F.struct(p["n"].alias("n"), F.concat(p["text"], text).alias("text"))))
        return bound(filled, lambda o: F.struct((s["n"] + starts.cast("int")).alias("n"), F.when(ends, F.slice(o, F.lit(1), F.greatest(F.size(o) - 1, F.lit(0)))).otherwise(o).alias("open"), F.when(ends & (F.size(o) > 0), F.concat(s["done"], F.slice(o, F.size(o), F.lit(1)))).otherwise(s["done"]).alias("done")))

    found = F.aggregate(nodes, state, step, lambda s: F.array_sort(s["done"]))
    return F.array_join(F.transform(found, lambda p: p["text"]), "\n")


def _long(c: Column) -> Column:
    return F.when(F.length(c) > LEAST_CHARS, F.substring(c, 1, MOST_CHARS))


def _by_path(xml: Column, kind: str) -> Column:
    """Text of well-formed XML: of the first kind of body that is there, else of the paragraphs."""
    outside = f"[not(ancestor::*[{_named(*SKIPPED[kind])}][ancestor::*[name()='{BODIES[kind][0]}']])]" if SKIPPED[kind] else ""
    nodes = lambda name: F.xpath(xml, F.lit(f"(//*[name()='{name}'])[1]//text(){outside}"))
    there = lambda name: F.xpath_boolean(xml, F.lit(f"boolean(//*[name()='{name}'])"))
    body = None
    for name in BODIES[kind]:
        body = F.when(there(name), _lines(nodes(name))) if body is None else body.when(there(name), _lines(nodes(name)))
    paragraphs = F.xpath(xml, F.lit(f"//*[name()='{PARAGRAPH[kind]}']//text(){outside}"))
    return F.coalesce(_long(body), _long(_paragraphs(paragraphs)))


def _by_tags(xml: Column, kind: str) -> Column:
    """Text of XML that is not well-formed: what stands between the tags of the body, else of the whole, without skipped parts that end."""
    rest = xml
    for name in SKIPPED[kind]:
        rest = F.regexp_replace(rest, rf"(?s)<{name}{INNER}>.*?</{name}>", " ")
    named = "|".join(BODIES[kind])
    inner = F.regexp_extract(rest, rf"(?s)<({named}){INNER}>(.*?)(?:</\1>|\z)", 2)
    text = lambda c: F.replace(F.replace(F.replace(_lines(F.split(c, r"<[^>]*>")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(_long(text(inner)), _long(text(rest)))


def text_of(xml: Column, kind: str) -> Column:
    """The text of an article, at most 200,000 characters; null for null XML and for texts of 100 characters or less."""
    return bound(prepared(xml, PARAGRAPH[kind]), lambda x: F.when(well_formed(x), _by_path(x, kind)).otherwise(_by_tags(x, kind)))
