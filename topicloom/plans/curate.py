"""The curation plan: pages to results to published tables, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import publish_date
from ..functions.scoring import content_class, is_match, looks_blocked, whole_score
from ..functions.text import clean_text, excerpt, matched_keywords, text
from ..operators.quality import quality_rows
from ..operators.selection import keep_first, page_key, top_per_group


def annotate(results: DataFrame, keywords: Sequence[str], every: bool = False) -> DataFrame:
    """results with keyword hits, whether they match, class, publish date, summary and whether the text looks blocked."""
    hits = matched_keywords(F.concat_ws(" ", text("title"), text("content")), keywords)
    rows = results.withColumn("hits", hits)
    return rows.withColumns(
        {
            "matched": is_match(F.col("hits"), keywords, every),
            "class": F.when(text("content") != "", content_class("title", "content")).otherwise(""),
            "found_date": publish_date(F.col("title"), F.col("content"), F.col("url")),
            "excerpt": F.when(F.size("hits") > 0, excerpt("content")).otherwise(""),
            "blocked": looks_blocked("title", "content"),
        }
    )


def publish(results: DataFrame, keywords: Sequence[str], order: str) -> DataFrame:
    """The matching, unblocked results, the first of each page, with their quality."""
    rows = annotate(results, keywords).where("matched and not blocked").where(clean_text("content") != "")
    return quality_rows(keep_first(rows, page_key(), [order]))


#: Scores one candidate table by (topic, title, snippet): returns the table with ai_score and ai_reason. Tests and offline runs give a stub.
Provider = Callable[[DataFrame], DataFrame]


# Why a candidate was left out.
NOT_ASKED, NOT_KEPT = "未进入AI精筛范围", "AI精筛剔除"


def prefilter(candidates: DataFrame, provider: Provider, order: str, per_site: int = 5, least: int = 60) -> DataFrame:
    """Ask the provider about the best candidates of each site.

    All rows stay, with ai_relevance_score (empty where not asked), ai_keep and ai_filter_reason; a row that isn't kept
    gets status skipped and, where it has none yet, an error that says why.
    """
    ok = candidates.where("status = 'ok'").withColumn("__score", whole_score("preliminary_score"))
    asked = provider(top_per_group(ok, "site_name", "__score", order, per_site)).select(order, "ai_score", "ai_reason").withColumn("__asked", F.lit(True))
    rows = candidates.join(asked, order, "left").withColumn("__asked", F.coalesce("__asked", F.lit(False)))
    keep = F.col("__asked") & F.coalesce(F.col("ai_score") >= least, F.lit(False))
    why = F.when(F.col("__asked"), F.lit(NOT_KEPT)).otherwise(F.lit(NOT_ASKED))
    added = {
        "ai_keep": F.when(keep, "yes").otherwise("no"),
        "ai_relevance_score": F.when(F.col("__asked"), F.coalesce(F.col("ai_score").cast("string"), F.lit(""))).otherwise(""),
        "ai_filter_reason": F.when(F.col("__asked"), text("ai_reason")).otherwise(F.lit(NOT_ASKED)),
        "error": F.when(keep | (text("error") != ""), text("error")).otherwise(why) if "error" in candidates.columns else F.when(keep, "").otherwise(why),
        "status": F.when(keep, F.col("status")).otherwise("skipped"),
    }
    return rows.withColumns(added).drop("__asked")
