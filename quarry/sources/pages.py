"""Elements of HTML pages, by expressions that Spark runs inside of one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.markup import attribute

LANDMARKS = ("main", "nav", "header", "footer", "aside", "article", "section")
#: A start or end tag, with quoted values that may hold what ends one; what is no markup of the page; a link with all that is inside of it.
TAG = r"""</?[a-zA-Z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
LINK = r"""(?is)<a(?:\s[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)?>.*?</a\s*>"""


def count_tag(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"<{tag}[\s>/]")).cast("long")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def language(html: Column) -> Column:
    """The lang of the html element; null where it has none."""
    found = F.regexp_extract(html, r'<html[^>]*\slang="([^"]*)"', 1)
    return F.when(html.rlike(r'<html[^>]*\slang="'), found)


def meta(html: Column, name: str) -> Column:
    """The content of a named meta element, empty where absent."""
    return F.regexp_extract(html, rf'<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1)


def visible_text(html: Column) -> Column:
    """Text outside of tags, scripts, styles and comments; white space runs are one space."""
    x = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, seq, href, label: a row for each link of a page that has an address; the label is all the text inside of it. Links in
    comments and scripts are none. One scan without a tree: links don't nest, so each ends at the next end tag."""
    found = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(LINK), F.lit(0))
    label = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, TAG, ""), r"\s+", " "))
    every = F.transform(found, lambda x: F.struct(attribute(x, "href").alias("href"), label(x).alias("label")))
    return pages.select("page_id", "url", F.posexplode(every).alias("seq", "x")).select("page_id", "url", "seq", "x.href", "x.label").where("href is not null")
