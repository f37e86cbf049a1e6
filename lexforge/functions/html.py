"""What pages say: headings, content and rows of "key: value", as expressions over HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.text import let

#: Where a page keeps its matter, the first that it has.
CONTENT = (r'div[^>]*class="[^"]*judgment-content[^"]*"', r'div[^>]*class="[^"]*case-content[^"]*"', "article", "main")
#: Character references that are decoded, in this order.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, sign in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def inner_pattern(element: str) -> str:
    return rf"(?is)<{element}(?:\s[^>]*)?>(.*?)</{element.split('[')[0]}\s*>"


def inner(html: Column, element: str) -> Column:
    """What the first ``element`` (a name, with a pattern of its attributes if need be) holds; empty without."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), inner_pattern(element), 1)


def lines(html: Column, by: str = "\n") -> Column:
    """Pieces of text between tags, trimmed, without scripts, styles and empty ones, joined with ``by``."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    pieces = F.transform(F.split(bare, r"<[^>]*>"), lambda t: F.regexp_replace(unescape(t), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(pieces, lambda t: t != ""), by)


def case(html: Column, most: int = 15_000, least: int = 200) -> Column:
    """title (first heading, else the page's title) and content of a page, null where the content is not over ``least``
    characters; content is held to ``most``, the title to 200."""
    title = let(lines(inner(html, "h1"), " "), lambda h: F.when(h != "", h).otherwise(lines(inner(html, "title"), " ")))
    body = F.coalesce(*[F.nullif(inner(html, e), F.lit("")) for e in CONTENT], F.lit(""))
    return let(lines(body), lambda b: F.when(F.length(b) > least, F.struct(F.left(title, F.lit(200)).alias("title"), F.left(b, F.lit(most)).alias("content"))))


def meta(html: Column, rows: str = "li|p|h1") -> Column:
    """A map of the page's rows "key: value", keys lower-cased, the last of equal ones.

    A row is what an element of ``rows`` holds up to the next tag; marks within it (b, i, a, br) are no tags here.
    """
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"</?(b|br|a|i)(\s[^>]*)?>", "")
    texts = F.transform(F.regexp_extract_all(plain, F.lit(rf"(?is)<(?:{rows})(?:\s[^>]*)?>([^<]*)"), F.lit(1)), lambda t: unescape(t))
    held = F.filter(texts, lambda t: F.contains(t, F.lit(":")))
    pairs = F.transform(held, lambda t: F.struct(F.lower(F.trim(F.substring_index(t, ":", 1))).alias("k"), F.trim(F.regexp_replace(t, r"(?s)^[^:]*:", "")).alias("v")))
    put = lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.map_from_arrays(F.array(x["k"]), F.array(x["v"])))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), put)
