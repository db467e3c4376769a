"""The training-data queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutoffs, dom_density, history, mixture, near_duplicates, page_quality, repeated_lines, subjects, tokens
from .cluster import read_table


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "sample_final").select(F.col("record_id").alias("id"), "content")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(read_table(spark, folder, "sample_final"))


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    records = read_table(spark, folder, "sample_final", "record_id", "site_name", "content")
    return repeated_lines.without_lines(records, repeated_lines.repeated_lines(records))


def p1_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.frequent_sequences(read_table(spark, folder, "sample_final"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "sample_final", "record_id", "site_name", "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_quality.template_residue(_pages(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_quality.not_prose(_pages(spark, folder))


def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return page_quality.statistics(_pages(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutoffs.site_cutoffs(read_table(spark, folder, "sample_final", "site_name", "ai_relevance_score"), read_table(spark, folder, "keep_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_quality.not_body(_pages(spark, folder))


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    records = _pages(spark, folder)
    return repeated_lines.without_lines(records, page_quality.not_body(records))


def p5_html(spark: SparkSession, folder: str) -> DataFrame:
    """Each content as the one paragraph of a page between a menu, a list of other titles and a footer, and read back."""
    words = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))
    escaped = F.regexp_replace(F.regexp_replace(words, "&", "&amp;"), "<", "&lt;")
    link = lambda text: f'<li><a href="/x">{text}</a></li>'
    menu, others = "".join(map(link, ("首页", "快讯", "数据", "报告"))), "".join(map(link, ("另一篇关于储能市场的文章", "又一篇关于联赛的报道")))
    html = F.concat(F.lit(f"<html><head><title>t</title><script>var a = 1;</script></head><body><ul>{menu}</ul><div><p>"), escaped, F.lit(f"</p></div><ul>{others}</ul><div><a href='/c'>联系我们</a></div></body></html>"))
    return dom_density.main_bodies(read_table(spark, folder, "sample_final").select("record_id", html.alias("html")))


P5_HTML_SQL = """
with t as (select record_id, trim(regexp_replace(coalesce(content, ''), '[\\s\\x0b\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) as c from sample_final)
select record_id, case when length(replace(c, ' ', '')) < 2 then '' else c end as content from t
"""


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.delivered_before(read_table(spark, folder, "sample_final"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_contents(spark, folder))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_contents(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_documents(read_table(spark, folder, "documents", "doc_id", "text"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts decoded from their ids."""
    return tokens.decode_documents(p8_ids(spark, folder))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixed(read_table(spark, folder, "documents", "doc_id", "text", "source"), read_table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.report(read_table(spark, folder, "documents", "doc_id", "text", "source"), read_table(spark, folder, "mix_targets"))


def _subject_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_table(spark, folder, "documents", "doc_id", "text", "title", "source"), read_table(spark, folder, "subject_labels"), read_table(spark, folder, "subjects")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(*_subject_tables(spark, folder)).select("doc_id", "subject")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.corpus_shares(*_subject_tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_cleaned, p1_sequences, p2_found, p3_found, p3_statistics, p4_found, p5_found, p5_bodies, p5_html, p6_found, p7_found, p7_groups, p8_ids, p8_round_trip, p9_mixture, p9_report, p10_found, p10_shares)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": cutoffs.SITE_CUTOFFS_SQL, "p5_html": P5_HTML_SQL, "p8_round_trip": tokens.ROUND_TRIP_SQL}
