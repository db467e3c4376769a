"""Links of read pages: which lead on within a site, which are candidates, which columns they point to.

Pages come from sources.pages.read_pages with the columns url, domain and links; a key column names the
page. Each link becomes a row; filters are column expressions; what remains is ranked within its page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, urls
from ..functions.text import text
from .selection import join_domain


def links_of(read: DataFrame, key: str) -> DataFrame:
    """(key, base, domain, position, link_text, link): the http(s) links of each page, resolved and without fragment."""
    # resolved before the explode, so that every later condition reads a column and not the whole expression again
    resolved = F.transform("links", lambda l: F.struct(l["text"].alias("link_text"), urls.resolved_link(F.col("url"), l["href"]).alias("link")))
    rows = read.select(key, F.col("url").alias("base"), text("domain").alias("domain"), F.posexplode(resolved).alias("position", "l"))
    return rows.select(key, "base", "domain", "position", "l.link_text", "l.link").where("link is not null")


def first_of_each(rows: DataFrame, key: str, what: Column) -> DataFrame:
    """Of equal links on a page the first that passed the filters."""
    window = Window.partitionBy(key, "__what").orderBy("position")
    return rows.withColumn("__what", what).withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", "__what")


def best(rows: DataFrame, key: str, limit: int, *order: Column | str) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def same_site_links(read: DataFrame, key: str, limit: int, pdf: bool = False) -> DataFrame:
    """The first `limit` links of each page that lead to articles of the same host."""
    rows = links_of(read, key).where(urls.within_domain("link", "domain") & urls.same_host("link", "base") & ~urls.has_file_ending("link", pdf=not pdf) & ~urls.is_skipped_link("link", "link_text"))
    return best(first_of_each(rows, key, F.col("link")), key, limit, "position").select(key, "rank", "link")


def list_details(read: DataFrame, key: str, keywords: Sequence[str], limit: int) -> DataFrame:
    """The `limit` article links of each list page that fit the topic best, one per page they lead to."""
    rows = links_of(read, key).where(urls.within_domain("link", "domain") & urls.is_detail_page("link")).withColumn("score", scoring.topic_link_score("link", "link_text", keywords)).where("score > 0")
    return best(first_of_each(rows, key, urls.canonical_url("link")), key, limit, F.desc("score"), "position").select(key, "rank", "link", "score")


def _with_diagnostics(read: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Pages without a link keep one row that says so."""
    rows = read.select(key).join(found.withColumn("status", F.lit("ok")), key, "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("skipped")))


def search_candidates(read: DataFrame, key: str, keywords: Sequence[str], limit: int) -> DataFrame:
    """The best candidates among the links of each search page, within its domain."""
    rows = links_of(read, key).where(urls.within_domain("link", "domain") & ~urls.has_file_ending("link")).withColumn("score", scoring.candidate_score("link", "link_text", keywords)).where("score > 0")
    found = best(first_of_each(rows, key, F.col("link")), key, limit, F.desc("score"), "position").select(key, "rank", "link", "score")
    return _with_diagnostics(read, found, key)


def column_candidates(read: DataFrame, key: str, limit: int) -> DataFrame:
    """The links of each entry page that look most like columns of the same host."""
    rows = links_of(read, key).where(urls.same_host("link", "base") & ~urls.has_file_ending("link")).withColumn("score", scoring.column_link_score("link", "link_text")).where("score > 0")
    found = best(first_of_each(rows, key, F.col("link")), key, limit, F.desc("score"), "position").select(key, "rank", "link", "score")
    return _with_diagnostics(read, found, key)


def search_addresses(sites: DataFrame, queries: Sequence[str]) -> DataFrame:
    """(site_name, query, search_url) for each site with search pages, by the first registered domain its address belongs to."""
    domains = sites.sparkSession.createDataFrame(list(enumerate(urls.SEARCH_TEMPLATES)), "registered int, template_domain string")
    known = join_domain(sites, "url", domains, "template_domain", "registered", "inner")
    pages = F.array(*(F.struct(F.lit(d).alias("of"), F.lit(t).alias("template")) for d, templates in urls.SEARCH_TEMPLATES.items() for t in templates))
    own = known.select("site_name", F.posexplode(F.filter(pages, lambda p: p["of"] == F.col("template_domain"))).alias("position", "page"))
    asked = own.select("site_name", "position", "page", F.posexplode(F.array(*map(F.lit, queries)) if queries else F.array().cast("array<string>")).alias("number", "query"))
    return asked.select("site_name", "position", "number", "query", urls.search_address(F.col("page.template"), F.col("query")).alias("search_url"))
