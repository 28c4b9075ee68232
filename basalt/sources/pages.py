"""Web pages from a table (page_id, url, html): text, search, fetching by address and bounded crawling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.lineage import cut

#: Elements whose content is not shown.
HIDDEN = ("script", "style", "head")
#: Named character references that are replaced; others stay as they are.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(html: Column | str = "html") -> Column:
    """The visible text: scripts, styles, comments and tags go, runs of blanks become one."""
    text = F.col(html) if isinstance(html, str) else html
    for hidden in (r"<!--.*?-->", *(rf"<{tag}\b.*?</{tag}\s*>" for tag in HIDDEN), "<[^>]*>"):
        text = F.regexp_replace(text, f"(?is){hidden}", " ")
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def extracted(pages: DataFrame, least: int = 50) -> DataFrame:
    """page_id, url, text, and whether it has fewer than ``least`` characters other than blanks."""
    rows = pages.select("page_id", "url", html_text().alias("text"))
    return rows.withColumn("scant", F.length(F.regexp_replace("text", r"\s", "")) < least)


def fetched(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """url, text and found for each address asked for."""
    known = pages.select("url", html_text().alias("text"))
    return urls.select("url").distinct().join(known, "url", "left").withColumn("found", F.col("text").isNotNull())


def search(pages: DataFrame, query: str, k: int = 5) -> DataFrame:
    """page_id, url, hits and rank of the k pages that have the most of the query's words, counted in their text."""
    text, words = F.lower(html_text()), list(dict.fromkeys(query.lower().split()))
    hits = sum((F.size(F.split(text, f"\\Q{w}\\E", -1)) - 1 for w in words), F.lit(0))
    order = (F.desc("hits"), F.asc("page_id"))
    found = pages.select("page_id", "url", hits.alias("hits")).filter("hits > 0").orderBy(*order).limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def links(pages: DataFrame) -> DataFrame:
    """url, target and ord of the links of each page, in order; relative ones are made whole by the page's address."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']?([^"'\s>#]+)"""), F.lit(1))
    rows = pages.select("url", F.posexplode(found).alias("ord", "target"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    folder = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    whole = F.when((host == "") | F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("target")).when(F.startswith("target", F.lit("//")), F.concat(scheme, "target"))
    whole = whole.when(F.startswith("target", F.lit("/")), F.concat(host, "target")).when(F.startswith("target", F.lit("?")), F.concat(F.regexp_replace("url", r"[?#].*$", ""), "target"))
    return rows.select("url", whole.otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), "").otherwise("/"), "target")).alias("target"), "ord")


def crawl(pages: DataFrame, start: str, depth: int | None = 1, breadth: int = 20, limit: int | None = 50) -> DataFrame:
    """url and level of pages reached by links: at most ``breadth`` new ones of each page, and ``limit`` in all (None: no bound).

    The pages' html is read once: links to pages of the table are stored. Each level joins the new
    pages with them and is all that is written.
    """
    edges = cut(links(pages).join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_semi").groupBy("url", "target").agg(F.min("ord").alias("ord")))
    level = cut(pages.filter(F.col("url") == start).select("url").distinct())
    seen, n = level.withColumn("level", F.lit(0)), 0
    while not level.isEmpty() and (depth is None or n < depth):
        n += 1
        fresh = edges.join(level, "url", "left_semi").join(seen.select(F.col("url").alias("target")), "target", "left_anti")
        first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("ord", "target"))).filter(F.col("n") <= breadth)
        level = cut(first.select(F.col("target").alias("url")).distinct())
        seen = seen.unionByName(level.withColumn("level", F.lit(n)))
    return seen.orderBy("level", "url").limit(limit) if limit is not None else seen
