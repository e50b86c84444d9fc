"""Text expressions: keys, markers, URLs, headings, truncation, JSON in text.

All are Spark column expressions, evaluated in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words ignored when titles are matched
STOPWORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "with", "by", "from", "that", "this", "is", "was", "are")


def _unaccented() -> tuple[str, str]:
    """Latin letters that decompose into a letter and marks, and their letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    plain = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    kept = [(c, p) for c, p in plain if len(p) == 1 and p != c]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


ACCENTED, PLAIN = _unaccented()


def missing(c: Column) -> Column:
    """Null or empty text."""
    return F.coalesce(c, F.lit("")) == ""


def doi_key(doi: Column) -> Column:
    """Bare lower-case DOI; null for null or blank. A bare resolver prefix gives ''."""
    trimmed = F.regexp_replace(doi, r"^\s+|\s+$", "")
    return F.when(trimmed != "", F.regexp_replace(F.lower(trimmed), r"^https?://(dx\.)?doi\.org/", ""))


def title_key(title: Column) -> Column:
    """Title for comparing: unaccented, lower case, without punctuation, single spaces."""
    base = F.regexp_replace(F.translate(title, ACCENTED, PLAIN), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def match_tokens(title: Column) -> Column:
    """Sorted words of a title without punctuation, stopwords and single letters."""
    words = F.split(F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}_\s]", " ")), r"\s+")
    return F.array_sort(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def citation_markers(text: Column) -> Column:
    """Ids of the [@id] markers, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"\[@([^\]]+)\]"), 1)


# fixed values: what parts words
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def word_count(text: Column) -> Column:
    """Words between white space of any script; 0 for null or blank."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0))


#: Latin vowels and consonants, lower case.
VOWELS, CONSONANTS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "bcdfghjklmnpqrstvwxzçñðþß"
LETTERS = f"[{VOWELS}{CONSONANTS}{(VOWELS + CONSONANTS.replace('ß', '')).upper()}]+"
#: Endings without a syllable, behind a vowel and consonants: e but for consonant and l before it, es but after a hiss, ed but after t and d.
SILENT = rf"(?<=[{VOWELS}])[{CONSONANTS}]+(?:(?<![{CONSONANTS}]l)e|(?<![sxzcgh])es|(?<![td])ed)(?![{VOWELS}{CONSONANTS}])"
NO_VOWEL = rf"(?<![{VOWELS}{CONSONANTS}])[{CONSONANTS}]+(?![{VOWELS}{CONSONANTS}])"


def syllables(text: Column) -> Column:
    """Syllables of all words: their groups of vowels without silent endings, one at least for each word."""
    count = lambda t, pattern: F.coalesce(F.regexp_count(t, F.lit(pattern)), F.lit(0))
    return bound(F.lower(text), lambda t: count(t, f"[{VOWELS}]+") - count(t, SILENT) + count(t, NO_VOWEL))


def url_year(url: Column) -> Column:
    """Plausible year (1900 to 2030) that is a part of the path, else null."""
    years = F.transform(F.regexp_extract_all(url, F.lit(r"/(\d{4})(?=[/.\-])"), 1), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(1900, 2030)), F.lit(0))


def latest_year(text: Column) -> Column:
    """Latest plausible year in a text, else null."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(1900, 2030)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: arguments of a lambda are, columns are in each place that names them."""
    return F.transform(F.array(value), f)[0]


def title_case(text: Column) -> Column:
    """Letters after anything that is no letter in upper case, the others in lower case."""
    first = lambda c, i: (i == 0) | ~F.get(c, i - 1).rlike(r"^\p{L}$")
    return bound(F.split(F.lower(text), ""), lambda c: F.array_join(F.transform(c, lambda x, i: F.when(first(c, i), F.upper(x)).otherwise(x)), ""))


def slug_title(url: Column) -> Column:
    """Title in words from the last path segment; null for numbers, hex ids and short slugs."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.element_at(parts, F.when(F.size(parts) > 0, -1).otherwise(None))
    usable = (F.length(last) >= 8) & ~last.rlike(r"^[0-9]+$") & ~last.rlike(r"^[0-9a-fA-F\-]{5,40}$")
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|pdf|xml|aspx|php)$", ""), r"[-_]+", " "))
    return F.when(usable & (F.length(words) >= 8), title_case(words))


def head_tail(text: Column, most: int, marker: str) -> Column:
    """At most ``most`` characters: the first third, the marker, and the end."""
    head = most // 3
    tail = most - head
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(text, -tail, tail)))


def strip_markdown(text: Column) -> Column:
    """Markdown without link targets, heading marks, emphasis marks and inline code."""
    for pattern, to in ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,2}|_{1,2}", ""), (r"`[^`]*`", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def markdown_sections(text: Column) -> Column:
    """Non-blank parts between markdown headings of levels one to three; the heading words stay. The whole text, if there is none."""
    parts = F.filter(F.split(text, r"(?m)^#{1,3}\s+"), lambda s: ~s.rlike(r"^\s*$"))
    return bound(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def citation_count(text: Column) -> Column:
    """Different citations: [n], and (Name et al., year)."""
    different = lambda pattern: F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)))
    return different(r"\[\d+\]") + different(r"\([A-Z][a-z]+ et al\.?,? \d{4}\)")


def json_in_text(reply: Column) -> Column:
    """The JSON in a model's reply: the whole, a fenced block, or the object from the first brace to the last."""
    plain = F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    fenced = F.trim(F.regexp_extract(plain, r"(?s)```(?:json)?\s*\n?(.*?)```", 1))
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(plain), valid(fenced), valid(braces))


def escape_latex(text: Column) -> Column:
    """The special characters of LaTeX escaped, the backslash left alone."""
    for c in "&%$#_{}":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return F.replace(F.replace(text, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\^{}"))


def inverted_index(words: Column) -> Column:
    """array<struct<word, places>> of a list of words, by word: built within the row."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["word"] != x["word"]), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["word"].alias("word"), F.transform(F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i), lambda x: x["place"]).alias("places"))))

    return bound(placed, runs)


def from_index(index: Column) -> Column:
    """The words of an inverted index by place, then word."""
    placed = F.flatten(F.transform(index, lambda e: F.transform(e["places"], lambda p: F.struct(p.alias("place"), e["word"].alias("word")))))
    return F.transform(F.array_sort(placed), lambda x: x["word"])


def outline_depth(number: Column) -> Column:
    """Depth of a section by its number: 1.2.3 has three levels."""
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1


# fixed values: publishers by the prefixes of their DOIs
PUBLISHERS = {
    "elsevier": ("10.1016/", "10.1006/", "10.1053/"),
    "springer": ("10.1038/", "10.1007/", "10.1186/", "10.1057/", "10.1140/", "10.1365/", "10.1251/"),
    "biorxiv": ("10.1101/",),
}


def publisher(doi: Column) -> Column:
    """The publisher that a DOI is routed to; null for others."""
    routes = [F.when(F.array_contains(F.array(*(F.lit(p) for p in prefixes)), F.substring(doi, 1, 8)), name) for name, prefixes in PUBLISHERS.items()]
    return F.coalesce(*routes)
