"""Scores and classes of links, candidates and texts, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, matched_keywords, once, text
from .urls import YEAR, is_detail_page

# Hints in addresses, words of columns, classes and markers.
GOOD_HINTS = ("news", "brief", "article", "industry", "research", "report", "channel", "information", "detail")
BAD_HINTS = ("login", "register", "search", "rss", "english", "cart", "order", "about")
COLUMN_WORDS = ("政策", "新闻", "动态", "数据", "统计", "发布", "公告", "通知", "报告", "研究", "解读", "产业", "行业", "专题")
NO_COLUMN_WORDS = ("登录", "注册", "搜索", "邮箱", "订阅", "rss", "english", "新媒体", "信访", "智能问答", "无障碍", "地图", "关于我们")
CLASS_WORDS = {
    "政策": ("政策", "通知", "公告", "规划", "条例", "办法", "意见"),
    "报告": ("报告", "白皮书", "研究", "研判", "调研"),
    "数据": ("数据", "统计", "指数", "规模", "同比", "环比"),
    "新闻": ("新闻", "动态", "发布", "召开", "调研"),
    "产业": ("产业", "行业", "市场", "企业", "链"),
}
OTHER_CLASS = "其他"
BLOCKED_MARKERS = ("验证码", "请登录", "請登入", "登录后", "扫码登录", "403 forbidden", "access denied", "captcha")
NO_TITLE_HIT_LIMIT = 29


def _sum(value: Column, words: Iterable[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.contains(value, F.lit(word)).cast("int")
    return total


def _count(value: Column, words: Iterable[str]) -> Column:
    """How many of the words stand in value."""
    return once(value, lambda v: _sum(v, words))


def whole_score(value: Column | str) -> Column:
    """A stored score as int; 0 where it is no whole number."""
    digits = F.regexp_extract(F.trim(text(value)), "^[+-]?[0-9]+$", 0)
    return F.coalesce(F.when(digits != "", digits).try_cast("int"), F.lit(0))


def candidate_score(url: Column | str, title: Column | str, keywords: Sequence[str]) -> Column:
    """Title hits, hints in the address, a year and a long title; without a title hit never above NO_TITLE_HIT_LIMIT."""
    address = F.lower(text(url))
    hits = F.size(matched_keywords(title, keywords))
    path = F.regexp_extract(text(url), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    bad = _count(address, BAD_HINTS) + path.isin("", "/").cast("int")
    score = hits * 20 + _count(address, GOOD_HINTS) * 10 - bad * 30 + address.rlike(YEAR).cast("int") * 5 + (F.length(clean_text(title)) >= 8).cast("int") * 3
    return F.when(hits == 0, F.least(score, F.lit(NO_TITLE_HIT_LIMIT))).otherwise(score).cast("int")


def topic_link_score(url: Column | str, link_text: Column | str, keywords: Sequence[str]) -> Column:
    hits = F.size(matched_keywords(F.concat_ws(" ", text(link_text), text(url)), keywords))
    return F.when(hits == 0, 0).otherwise(hits * 30 + is_detail_page(url).cast("int") * 15 + text(url).rlike(YEAR).cast("int") * 5).cast("int")


def column_link_score(url: Column | str, link_text: Column | str) -> Column:
    both = F.lower(F.concat_ws(" ", text(link_text), text(url)))
    score = _count(both, COLUMN_WORDS) * 10 - _count(both, NO_COLUMN_WORDS) * 20
    return (score + text(url).rlike(YEAR).cast("int") * 3 + (F.length(text(link_text)) >= 4).cast("int")).cast("int")


def content_class(title: Column | str, content: Column | str, classes: Mapping[str, Sequence[str]] = CLASS_WORDS) -> Column:
    """The class most of whose words stand in title and head of the content; the first of equals; OTHER_CLASS without any."""
    haystack = F.concat_ws(" ", text(title), F.substring(text(content), 1, 1000))
    ranked = lambda h: F.array(*(F.struct(_sum(h, words).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(classes.items())))
    return once(once(haystack, lambda h: F.array_max(ranked(h))), lambda best: F.when(best["n"] > 0, best["name"]).otherwise(OTHER_CLASS))


def looks_blocked(title: Column | str, content: Column | str) -> Column:
    haystack = F.lower(F.concat_ws(" ", text(title), text(content)))
    return _count(haystack, BLOCKED_MARKERS) > 0


def is_match(hits: Column, keywords: Sequence[str], every: bool = False) -> Column:
    return (F.size(hits) == len(keywords)) & F.lit(bool(keywords)) if every else F.size(hits) > 0
