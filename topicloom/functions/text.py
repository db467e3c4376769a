"""Text functions as column expressions. Null counts as the empty string."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space; the engines' own class is ASCII only.
SPACE = r"[\s\x0b\p{Z}\x1c-\x1f\x85]+"
SUMMARY_LENGTH = 200

# Query words of tests, words that only narrow a topic, and synonyms of one.
TEST_WORDS = ("回归测试", "修复后复测")
SCOPE_WORDS = ("行业", "产业", "市场", "发展", "变化", "趋势", "报告", "研究")
AI_WORDS = ("AI", "人工智能", "大模型", "智能体", "AIGC", "生成式人工智能", "机器学习", "算力")


def text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_text(value: Column | str) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text(value), SPACE, " "))


def strip_tags(value: Column | str) -> Column:
    return F.regexp_replace(text(value), "<[^>]+>", " ")


@F.pandas_udf(StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(html.unescape)


def strip_html(value: Column | str) -> Column:
    """Tags and entities out, then clean; texts without an ampersand never leave the JVM's hands unescaped."""
    return clean_text(_unescaped(strip_tags(value)))


def excerpt(value: Column | str, length: int = SUMMARY_LENGTH) -> Column:
    """The first characters (code points) of the cleaned text."""
    return F.substring(clean_text(value), 1, length)


def squeeze_phrases(value: Column | str, phrases: Iterable[str]) -> Column:
    """A phrase that stands three or more times in a row stands once."""
    result = text(value)
    for phrase in phrases:
        result = F.regexp_replace(result, rf"(?:\Q{phrase}\E\s*){{3,}}", re.sub(r"([\\$])", r"\\\1", phrase) + " ")
    return clean_text(result)


def from_first_marker(value: Column | str, markers: Sequence[str]) -> Column:
    """The text from the earliest marker on; the text as it is where none stands."""
    whole = text(value)
    places = F.array_min(F.filter(F.array(*(F.instr(whole, m) for m in markers)), lambda p: p > 0))
    return F.when(places.isNotNull(), clean_text(F.substr(whole, places))).otherwise(whole)


def delete_patterns(value: Column | str, patterns: Iterable[str]) -> Column:
    """Each pattern in turn becomes a blank; then clean."""
    result = text(value)
    for pattern in patterns:
        result = F.regexp_replace(result, pattern, " ")
    return clean_text(result)


def context_of(page: Column, needle: Column, before: int = 400, after: int = 1200) -> Column:
    """The text around the earliest place of a link in a page's source, tags out; '' where it doesn't stand."""
    places = F.filter(F.array(F.instr(page, needle), F.instr(page, F.replace(needle, F.lit("&"), F.lit("&amp;")))), lambda p: p > 0)
    at = F.array_min(places)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at.isNotNull() & (needle != ""), strip_html(F.substr(page, begin, at + after - begin))).otherwise("")


def matched_keywords(value: Column | str, keywords: Sequence[str]) -> Column:
    """The keywords that the text contains, whatever their case, in their order."""
    if not keywords:
        return F.array().cast("array<string>")
    return once(F.lower(text(value)), lambda lower: F.array_compact(F.array(*(F.when(F.contains(lower, F.lit(k.lower())), F.lit(k)) for k in keywords))))


# Topics are a few words that a user types; they are taken apart before any plan is made.


def topic_words(topic: str | None, commas: bool = True) -> list[str]:
    return [w for w in re.split(r"[,，\s]+" if commas else r"\s+", topic or "") if w]


def listed_names(value: str | None) -> list[str]:
    return [name for part in re.split("[,，]", value or "") if (name := part.strip())]


def without_test_words(words: Iterable[str]) -> list[str]:
    left = []
    for word in words:
        for term in TEST_WORDS:
            word = word.replace(term, "").strip()
        left += [word] * bool(word)
    return left


def core_term(word: str | None) -> str:
    """What stands before the first scope word: '' if that is less than two characters."""
    word = (word or "").strip()
    cut = min((at for w in SCOPE_WORDS if (at := word.find(w)) >= 0), default=None)
    if cut is None:
        return word
    head = word[:cut].strip()
    return head if len(head) > 1 else ""


def topic_keywords(topic: str | None) -> list[str]:
    """The topic's core terms without repeats, with synonyms where it is about AI."""
    found: dict[str, str] = {}
    for word in without_test_words(topic_words(topic)):
        if term := core_term(word):
            found.setdefault(term.lower(), term)
    if "ai" in found or "人工智能" in found.values():
        for word in AI_WORDS:
            found.setdefault(word.lower(), word)
    return list(found.values())


def search_queries(topic: str | None, explicit: str | None = None) -> list[str]:
    return without_test_words(topic_words(explicit)) or topic_keywords(topic)


def safe_name(value: str | None, fallback: str = "topic") -> str:
    """Letters, digits, - and _ stay; anything else is _, none at the ends."""
    return re.sub(r"[^\w-]", "_", value or "").strip("_") or fallback
