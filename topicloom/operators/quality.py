"""Quality rules of results, and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import whole_score
from ..functions.text import text
from .selection import join_last

# Marks of noise in the order in which they are looked for, and the wording of issues.
NOISE = ("请登录", "验证码", "扫码登录", "Access Denied", "403 Forbidden", "RSS")
SHORT_PREVIEW = "公开预览内容过短"
SHORT_MATCH = "matched正文过短"
SHORT_BY_SITE = {"CBNData": "CBNData详情页正文不可用或过短"}
LONG_TEXT = "正文过长需检查"
NO_TITLE = "缺少标题"
NOISE_LABEL = "疑似噪音:"
JOINER = "；"
LEAST_PREVIEW, LEAST_MATCH, MOST = 50, 200, 20_000
LONG_ALLOWED = "stats.gov.cn"


def issues() -> Column:
    """All issues of a result row, in the order of the rules."""
    length, status = F.length(text("content")), text("status")
    preview = text("content_type") == "public_preview"
    short = F.lit(SHORT_MATCH)
    for site, words in SHORT_BY_SITE.items():
        short = F.when(text("site_name") == site, F.lit(words)).otherwise(short)
    noise = F.coalesce(*(F.when(F.contains(text("content"), F.lit(m)), F.lit(NOISE_LABEL + m)) for m in NOISE))
    return F.array_compact(
        F.array(
            F.when((status == "matched") & preview & (length < LEAST_PREVIEW), F.lit(SHORT_PREVIEW)),
            F.when((status == "matched") & ~preview & (length < LEAST_MATCH), short),
            F.when((length > MOST) & (text("extractor") != LONG_ALLOWED), F.lit(LONG_TEXT)),
            F.when((text("title") == "") & status.isin("matched", "unmatched"), F.lit(NO_TITLE)),
            noise,
        )
    )


def quality_rows(results: DataFrame) -> DataFrame:
    """results with quality (pass or review), issue, review_required and content_length."""
    joined = F.array_join("__issues", JOINER)
    rows = results.withColumn("__issues", issues())
    bad = F.size("__issues") > 0
    rows = rows.withColumns({"quality": F.when(bad, "review").otherwise("pass"), "issue": joined, "review_required": F.when(bad, "yes").otherwise(""), "content_length": F.length(text("content"))})
    return rows.drop("__issues")


def enriched(results: DataFrame, quality: DataFrame, order: list[str], drop_review: bool = False) -> DataFrame:
    """Matched results with the issue of their address's last quality row, where they have none of their own."""
    known = quality.select(text("url").alias("__url"), F.when(F.col("quality") == "review", text("issue")).otherwise("").alias("__issue"), *order)
    usable = results.where("status = 'matched'").withColumn("__url", text("url"))
    rows = join_last(usable, known, "__url", order).withColumn("__issue", text("__issue"))
    rows = rows.withColumn("quality_issue", F.when(text("quality_issue") != "", text("quality_issue")).otherwise(F.col("__issue")))
    rows = rows.withColumn("review_required", F.when(F.col("__issue") != "", "yes").otherwise(text("review_required"))).drop("__issue", "__url", *order)
    return rows.where("review_required <> 'yes'") if drop_review else rows


def score_diagnostics(candidates: DataFrame, least: int) -> DataFrame:
    """(score, n, total rows, ok rows, qualified rows, highest score) for each score of the ok rows, from one pass over the rows."""
    rows = candidates.select((F.col("status") == "ok").alias("ok"), whole_score("preliminary_score").alias("score"))
    by_score = rows.groupBy("ok", "score").agg(F.count("*").alias("n"))
    ok = F.coalesce("ok", F.lit(False))
    total = {
        "candidate_row_count": F.sum("n"),
        "ok_candidate_count": F.sum(F.when(ok, F.col("n")).otherwise(0)),
        "qualified_candidate_count": F.sum(F.when(ok & (F.col("score") >= least), F.col("n")).otherwise(0)),
        "max_score": F.max(F.when(ok, F.col("score"))),
    }
    return by_score.where(ok).select("score", "n", *(by_score.agg(value.alias("x")).scalar().alias(name) for name, value in total.items()))


def usable_by_site(results: DataFrame) -> DataFrame:
    """(site_name, n_rows, n_usable, outcome): a site without a usable row has no results."""
    rows = results.groupBy(text("site_name").alias("site_name")).agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("status") == "matched", F.lit(False))).alias("n_usable"))
    return rows.withColumn("outcome", F.when(F.col("n_usable") > 0, "ok").otherwise("no_results"))


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n): how often each value of each column stands, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in columns))).alias("x")
    return df.select(pairs).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
