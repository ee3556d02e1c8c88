"""Crawled pages: links, embedded data, sitemap months, and when a crawl stops."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import normalised, url_date
from .lineage import cut
from .market import lookup


def links(pages: DataFrame, allow: str, block: tuple[str, ...] = ()) -> DataFrame:
    """P25: absolute links of each page, without fragments, that are allowed and not blocked."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href=["']([^"'#]+)"""), F.lit(1))))
    found = pages.select("page_id", "url", href.alias("href"))
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    whole = F.when(F.rlike("href", F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.split_part("url", F.lit("//"), F.lit(1)), F.col("href"))).when(F.startswith("href", F.lit("/")), F.concat(root, F.col("href"))).otherwise(F.concat(folder, F.col("href")))
    out = found.select("page_id", whole.alias("link")).where(F.rlike("link", F.lit(allow)))
    for pattern in block:
        out = out.where(~F.rlike("link", F.lit(pattern)))
    return out


def embedded_json(html: str | Column) -> Column:
    """The data of a page's __NEXT_DATA__ script."""
    return F.nullif(F.regexp_extract(html, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def stories(data: str | Column, paths: tuple[str, ...] = ("$.props.pageProps.stories", "$.posts.edges", "$.newsArticleData")) -> Column:
    """The first of some places in the data that is filled."""
    return F.coalesce(*[F.get_json_object(data, p) for p in paths])


def sitemap_month(url: str | Column) -> Column:
    """The month in a sitemap's name."""
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(url, r"\.(\d{6})\.xml(?:\.gz)?$", 1), F.lit("")), F.lit("yyyyMM")))


def crawl_stop(pages: DataFrame, site: str, order: str, fresh: Column, limit: int) -> DataFrame:
    """The pages of each site up to the ``limit``-th in a row that isn't fresh."""
    w = Window.partitionBy(site).orderBy(order)
    run = pages.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    run = run.withColumn("stale", F.sum((~fresh).cast("int")).over(Window.partitionBy(site, "_run").orderBy(order)))
    stop = run.where(F.col("stale") >= limit).groupBy(site).agg(F.min(order).alias("_stop"))
    return run.join(stop, site, "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_run", "_stop")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, however it is quoted; null if there is none."""
    values = [F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i) for i in (1, 2, 3)]
    return F.nullif(F.concat(*values), F.lit(""))


#: Where a page tells its date: tag, attribute and its value (if any), and the attribute that holds the date.
DATE_PROBES = (
    ("meta", "property", "article:published_time", "content"),
    ("meta", "name", "article:published_time", "content"),
    ("meta", "property", "og:published_time", "content"),
    ("meta", "name", "publish-date", "content"),
    ("meta", "name", "pubdate", "content"),
    ("meta", "name", "date", "content"),
    ("meta", "itemprop", "datePublished", "content"),
    ("time", "datetime", None, "datetime"),
)


def published_date(pages: DataFrame, html: str = "html", name: str = "published") -> DataFrame:
    """Adds the date that the first of ``DATE_PROBES`` gives; a probe looks at its first tag only.

    The page is read once, for its meta and time tags; their attributes are then looked at in place.
    """
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:meta|time)\s[^>]*>"), F.lit(0)), lambda t: F.struct(F.lower(F.substring(t, 2, 4)).alias("tag"), *[_attribute(t, a).alias(a) for a in ("property", "name", "itemprop", "content", "datetime")]))
    df = pages.withColumn("_tags", tags)
    raw = []
    for tag, attribute, value, holds in DATE_PROBES:
        first = F.get(F.filter("_tags", _fits(tag, attribute, value)), F.lit(0))
        raw.append(first[holds])
    days = F.filter(F.transform(F.array(*raw), normalised), lambda d: d.isNotNull())
    return df.withColumn(name, F.get(days, F.lit(0))).drop("_tags")


def _fits(tag: str, attribute: str, value: str | None):
    return lambda t: (t["tag"] == tag) & (t[attribute].isNotNull() if value is None else F.coalesce(t[attribute] == value, F.lit(False)))


def frontier_walk(edges: DataFrame, roots: list[str], bad: str | None = None, since: datetime.date | None = None, allow: str = "", block: tuple[str, ...] = (), max_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sitemaps reachable from some roots, and the pages they list, each with the least number of steps to it.

    ``edges`` has parent, child and kind (sitemap or url). Sitemaps that match ``bad`` or whose name tells a month before that of
    ``since`` aren't entered; one that lists sitemaps lists no pages. Pages must match ``allow``, none of ``block``, and
    not be dated before ``since`` by their address. A round joins the frontier with the edges and takes off what has been visited;
    it ends when nothing is new, so on cycles too, at any depth. With ``max_links`` rounds end once so many pages
    are found, and the first by steps and address are given.
    """
    spark = edges.sparkSession

    def open_(c: str) -> Column:
        old = F.coalesce(sitemap_month(c) < F.trunc(F.lit(since), "month"), F.lit(False)) if since else F.lit(False)
        return ~old & (~F.rlike(c, F.lit(bad)) if bad else F.lit(True))

    inner = edges.where("kind = 'sitemap'")
    pages = edges.where("kind = 'url'").where(F.rlike("child", F.lit(allow))).join(inner.select("parent").distinct(), "parent", "left_anti")
    for pattern in block:
        pages = pages.where(~F.rlike("child", F.lit(pattern)))
    if since:
        pages = pages.where(F.coalesce(url_date("child") >= F.lit(since), F.lit(True)))
    inner = inner.where(open_("child")).select("parent", "child").distinct()
    steps = 0
    visited = frontier = cut(spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "node string").where(open_("node")).withColumn("steps", F.lit(0)))
    while frontier.limit(1).count():
        if max_links is not None and pages.join(visited.select(F.col("node").alias("parent")), "parent", "left_semi").select("child").distinct().limit(max_links).count() >= max_links:
            break
        steps += 1
        near = inner.join(lookup(frontier.select(F.col("node").alias("parent"))), "parent").select(F.col("child").alias("node")).distinct()
        frontier = cut(near.join(visited, "node", "left_anti").withColumn("steps", F.lit(steps)))
        visited = visited.unionByName(frontier)
    found = pages.join(visited.withColumnRenamed("node", "parent"), "parent").groupBy("child").agg(F.min("steps").alias("steps")).withColumnRenamed("child", "link")
    return visited, found.orderBy("steps", "link").limit(max_links) if max_links is not None else found
