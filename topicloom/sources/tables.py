"""CSV tables, the allow-list and the landed answers of search APIs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dates import normalized_date
from ..functions.scoring import candidate_score
from ..functions.text import clean_text, matched_keywords, strip_html, text
from ..functions.urls import is_domain_or_below, url_domain, within_domain

# The columns of stored tables.
RESULT_COLUMNS = [
    "title", "url", "site_name", "crawl_time", "topic", "content", "summary", "ai_summary", "ai_category", "ai_reason", "category", "publish_date",
    "status", "error", "matched_keywords", "source_type", "content_type", "extractor", "candidate_title", "candidate_snippet", "score",
    "source_stage", "candidate_reason", "known_limit", "quality_issue", "review_required", "ai_relevance_score", "ai_keep", "ai_filter_reason",
]
QUALITY_COLUMNS = [
    "quality", "issue", "review_required", "status", "site_name", "extractor", "source_type", "category", "publish_date", "content_type", "title",
    "url", "content_length", "matched_keywords",
]
CANDIDATE_COLUMNS = [
    "site_name", "category", "query", "search_url", "candidate_url", "title", "snippet", "publish_date", "matched_keywords", "preliminary_score",
    "status", "reason", "error",
]
SITE_COLUMNS = [
    "site_name", "url", "domain", "category", "page_type", "enabled", "max_detail_pages", "note",
]
DEFAULT_DETAIL_PAGES = 5
SNIPPET = 300


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings: header, quoted line breaks, byte-order mark; missing is ''."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")


def write_table(df: DataFrame, path: str, columns: list[str], csv: bool = False) -> None:
    """The named columns, missing ones as ''; fails where the path is taken already."""
    present = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    writer = df.select(*present).write.mode("errorifexists")
    writer.option("header", True).option("escape", '"').csv(path) if csv else writer.parquet(path)


def sites(whitelist: DataFrame) -> DataFrame:
    """The allow-list with trimmed texts and its defaults; rows without an address are left out."""
    missing = [c for c in SITE_COLUMNS if c not in whitelist.columns]
    if missing:
        raise ValueError(f"the allow-list lacks {', '.join(missing)}")
    rows = whitelist.where("trim(url) <> ''")
    lower = lambda c, other: F.lower(F.trim(F.when(text(c) == "", other).otherwise(text(c))))
    trimmed = {c: F.trim(text(c)) for c in ("site_name", "url", "domain", "category", "note")}
    return rows.withColumns(trimmed | {"page_type": lower("page_type", "page"), "enabled": lower("enabled", "no"), "max_detail_pages": F.coalesce(F.col("max_detail_pages").try_cast("int"), F.lit(DEFAULT_DETAIL_PAGES))})


@F.pandas_udf(StringType())
def decoded(bodies: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else GB18030, else UTF-8 without what is broken."""

    def one(body: bytes | None) -> str | None:
        if body is None:
            return None
        for name in ("utf-8", "gb18030"):
            try:
                return body.decode(name)
            except UnicodeDecodeError:
                continue
        return body.decode("utf-8", "ignore")

    return bodies.map(one)


def candidates(rows: DataFrame, keywords: list[str]) -> DataFrame:
    """(site_name, category, query, search_url, url, title, snippet, day, reason) to candidate rows; only those that score."""
    title = clean_text("title")
    snippet = clean_text(F.when(text("snippet") != "", text("snippet")).otherwise(text("title")))
    day = normalized_date(F.col("day"))
    shaped = rows.select(
        "site_name", "category", "query", "search_url", F.col("url").alias("candidate_url"), title.alias("title"), F.substring(snippet, 1, SNIPPET).alias("snippet"),
        F.when(day != "", day).otherwise(normalized_date(F.concat_ws(" ", title, snippet))).alias("publish_date"), F.array_join(matched_keywords("title", keywords), " ").alias("matched_keywords"),
        candidate_score("url", "title", keywords).alias("preliminary_score"), F.lit("ok").alias("status"), text("reason").alias("reason"), F.lit("").alias("error"),
    )
    return shaped.where("preliminary_score > 0")


def _filled(*columns: str) -> Column:
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns), F.lit(""))


# The shapes of the four search APIs' answers.
_SHAPES = {
    "stats": "resultDocs array<struct<data:struct<url:string,title:string,titleO:string,summary:string,docDate:string>>>",
    "iresearch": "list array<map<string,string>>",
    "cbndata": "data struct<data:array<struct<id:string,newId:string,type:string,title:string,summary:string,content:string,date:string>>>",
    "djyanbao": "data struct<data:array<struct<id:string,title:string,highlight:map<string,array<string>>,orgName:string,authors:string,publishAt:string>>>",
}
#: The iresearch API names its items in either of two ways.
_LISTED = "List array<map<string,string>>"
_ITEMS = {"stats": "answer.resultDocs.data", "iresearch": "answer.list", "cbndata": "answer.data.data", "djyanbao": "answer.data.data"}
CBN_KINDS = ("information", "report", "activity")


def api_items(answers: DataFrame, api: str, limit: int = 20) -> DataFrame:
    """(site_name, category, query, search_url, domain, body: JSON) to the API's items as (..., position, url, title, snippet, day, reason).

    Broken JSON gives no rows. Of each answer the first `limit` items count, which is the API's page size.
    """
    items = F.col(_ITEMS[api])
    if api == "iresearch":
        items = F.when(F.size(items) > 0, items).otherwise(F.from_json("body", _LISTED)["List"])
    rows = answers.withColumn("answer", F.from_json("body", _SHAPES[api])).select("site_name", "category", "query", "search_url", "domain", F.posexplode(F.slice(items, 1, limit)).alias("position", "i"))
    kind = F.when(F.col("i.type").isin(*CBN_KINDS), F.col("i.type")).otherwise(CBN_KINDS[0]) if api == "cbndata" else None
    number = _filled(*{"iresearch": ("i.id", "i.NewsId", "i.newsid"), "cbndata": ("i.id", "i.newId"), "djyanbao": ("i.id",)}.get(api, ("i.url",)))
    if api == "stats":
        url, title, snippet, day, reason = _filled("i.url"), _filled("i.title", "i.titleO"), _filled("i.summary"), "i.docDate", F.lit("api=so-gov")
        rows = rows.where(within_domain(F.col("i.url"), F.col("domain")))
    elif api == "iresearch":
        built = F.when(number != "", F.concat(F.lit("https://www.iresearch.com.cn/Detail/report?id="), number, F.lit("&isfree=0"))).otherwise("")
        url = F.when(_filled("i.url") != "", F.col("i.url")).otherwise(built)
        title, snippet, day, reason = _filled("i.hiliterTitle", "i.title"), _filled("i.hkeyword", "i.shortcontent"), "i.uptime", F.lit("api=iresearch")
    elif api == "cbndata":
        url = F.when(number != "", F.concat(F.lit("https://www.cbndata.com/"), kind, F.lit("/"), number)).otherwise("")
        title, snippet, day, reason = _filled("i.title"), F.concat_ws(" ", text("i.summary"), text("i.content")), "i.date", F.concat(F.lit("api=cbndata; type="), kind)
    else:
        url = F.when(number != "", F.concat(F.lit("https://www.djyanbao.com/report/detail?id="), number)).otherwise("")
        shown = F.array_join(F.flatten(F.map_values("i.highlight")), " ")
        snippet = F.when(text(shown) != "", shown).otherwise(F.concat_ws(" ", text("i.orgName"), text("i.authors")))
        title, day, reason = _filled("i.title"), "i.publishAt", F.lit("api=djyanbao; public_preview_only")
    return rows.select("site_name", "category", "query", "search_url", "position", url.alias("url"), strip_html(title).alias("title"), strip_html(snippet).alias("snippet"), F.col(day).alias("day"), reason.alias("reason")).where("url <> ''")


# The domain that each search API answers for.
API_OF = {"stats.gov.cn": "stats", "iresearch.com.cn": "iresearch", "cbndata.com": "cbndata", "djyanbao.com": "djyanbao"}


def api_of(url: Column, domain: Column) -> Column:
    """The search API that answers for a site, by its address's host or else its domain; null for the others."""
    host = F.when(url_domain(url) != "", url_domain(url)).otherwise(text(domain))
    return F.coalesce(*(F.when(is_domain_or_below(host, F.lit(d)), F.lit(api)) for d, api in API_OF.items()))


def all_api_items(answers: DataFrame, limit: int = 20) -> DataFrame:
    """Answers of any sites (site_name, ..., domain, url, body), each read by the API of its site, with a column api; other sites' give no rows."""
    rows = answers.withColumn("api", api_of(F.col("url"), F.col("domain")))
    return reduce(DataFrame.unionByName, (api_items(rows.where(F.col("api") == api), api, limit).withColumn("api", F.lit(api)) for api in API_OF.values()))
