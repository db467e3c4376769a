"""URL functions as column expressions. A null address counts as the empty string."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that are never pages.
FILE_ENDINGS = ("doc", "docx", "xls", "xlsx", "zip", "rar", "jpg", "jpeg", "png", "gif")
# Parts of addresses and of link texts that never lead to an article.
SKIPPED_URL_PARTS = ("/znwd/", "/wzgl/", "/english/", "/rss", "/hd/xmt/", "login", "register", "search")
SKIPPED_TEXT_PARTS = ("rss", "english", "新媒体", "信访", "智能问答", "无障碍", "登录", "注册", "搜索", "邮箱", "订阅", "可行性研究报告", "专精特新申报", "市场地位证明", "商业计划书", "定制报告", "提交需求")
# A domain whose articles all lie below one path.
DETAIL_PATHS = {"qianzhan.com": "/report/detail/"}
# Shapes of list pages and of article pages.
LIST_SHAPES = r"/tag/|/(?:industry|industry/xinzhi|industry/wiki)/$|/research/maoyi$|/channel/[^/.]+/?$"
DETAIL_SHAPES = r"/(?:research|news|industry|wiki|channel)/.+\.html(?:\?|$)|/(?:information|report)/[0-9]+(?:/detail)?(?:\?|$)"
# Search pages by domain, {query} being percent-encoded.
SEARCH_TEMPLATES = {
    "yicai.com": ("https://www.yicai.com/search?keys={query}",),
    "chyxx.com": ("https://www.chyxx.com/search?word={query}",),
    "huaon.com": ("https://www.huaon.com/search?word={query}",),
    "qianzhan.com": ("https://bg.qianzhan.com/report/search/k-{query}.html", "https://t.qianzhan.com/search/?q={query}"),
    "cbndata.com": ("https://www.cbndata.com/search?query={query}",),
    "36kr.com": ("https://36kr.com/search/articles/{query}",),
}
# Domains searched through an API; domains whose articles of one site lie under another.
API_DOMAINS = ("stats.gov.cn", "iresearch.com.cn", "cbndata.com", "djyanbao.com")
DETAIL_DOMAINS = {("艾瑞咨询", "report.iresearch.cn"): "iresearch.cn"}
YEAR = "20[0-9]{2}"
# Query parameters that only track a visit.
TRACKING_KEYS = ("spm", "from", "source")
TRACKING_PREFIX = "utm_"


def _text(url: Column | str) -> Column:
    return F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))


def _clean(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(url), "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")


def normalize_domain(domain: Column | str) -> Column:
    """Trimmed, lower case, without one leading www."""
    return F.regexp_replace(F.lower(F.trim(_text(domain))), "^www[.]", "")


def url_domain(url: Column | str) -> Column:
    """The address's host with port and user part, as normalize_domain leaves it; '' where there is none."""
    return normalize_domain(F.regexp_extract(_clean(url), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def is_domain_or_below(host: Column, domain: Column) -> Column:
    """The host is the domain or a name below it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def within_domain(url: Column | str, domain: Column | str) -> Column:
    return is_domain_or_below(url_domain(url), normalize_domain(domain))


def same_host(left: Column | str, right: Column | str) -> Column:
    return url_domain(left) == url_domain(right)


def host_suffixes(host: Column) -> Column:
    """Every name the host is or lies below, longest first: a suffix join becomes an equi-join on these."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column | str) -> Column:
    """Without fragment and tracking parameters, the other parameters sorted, no slash at the end.

    Host and path keep their case; only the scheme is lower-cased.
    """
    address = _clean(url)
    scheme = F.regexp_extract(address, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    base = F.regexp_extract(address, "^[^?#]*", 0)
    base = F.when(scheme != "", F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + 1))).otherwise(base)
    pieces = F.filter(F.split(F.regexp_extract(address, "^[^?#]*[?]([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.regexp_replace(F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))), "/+$", "")


def has_file_ending(url: Column | str, pdf: bool = True) -> Column:
    """The address ends like a file that is no page, before a query or at its end; pdf files count unless they are read too."""
    return F.lower(_text(url)).rlike("[.](" + "|".join([*FILE_ENDINGS, *["pdf"] * pdf]) + r")(\?|$)")


def _contains_any(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def is_skipped_link(url: Column | str, text: Column | str) -> Column:
    """A link that is no article: by parts of its address or text, or a short text without a year in the address."""
    address, words = F.lower(_text(url)), F.lower(F.trim(_text(text)))
    skipped = _contains_any(address, SKIPPED_URL_PARTS) | _contains_any(words, SKIPPED_TEXT_PARTS) | ((F.length(words) < 6) & ~address.rlike(YEAR))
    for domain, path in DETAIL_PATHS.items():
        skipped = skipped | (within_domain(url, F.lit(domain)) & ~F.contains(address, F.lit(path)))
    return skipped


def is_list_page(url: Column | str) -> Column:
    return F.lower(_text(url)).rlike(LIST_SHAPES)


def is_detail_page(url: Column | str) -> Column:
    return F.lower(_text(url)).rlike(DETAIL_SHAPES)


def is_api_domain(url: Column | str) -> Column:
    host = url_domain(url)
    found = F.lit(False)
    for domain in API_DOMAINS:
        found = found | is_domain_or_below(host, F.lit(domain))
    return found


def detail_domain(site_name: Column, url: Column, domain: Column) -> Column:
    """The domain that a site's articles must lie under."""
    chosen = domain
    for (name, host), other in DETAIL_DOMAINS.items():
        chosen = F.when((site_name == name) & (url_domain(url) == host), F.lit(other)).otherwise(chosen)
    return chosen


def percent_encoded(text: Column) -> Column:
    """As in a path: a blank is %20, a slash stays."""
    return F.replace(F.replace(_encoded(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def search_address(template: Column, query: Column) -> Column:
    return F.replace(template, F.lit("{query}"), percent_encoded(query))


def _folded(path: Column) -> Column:
    """A path's segments without `.`, and without what each `..` goes back over; a path that ends in one of them ends in a slash."""
    fold = lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    kept = F.aggregate(path, F.array().cast("array<string>"), fold)
    return F.array_join(F.when(F.element_at(path, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolved_link(base: Column, href: Column) -> Column:
    """The http(s) address, without fragment, that a link on the page `base` leads to; null for other schemes.

    Relative paths are resolved against the page's folder, dot segments folded; an address with a host stays as it is.
    """
    scheme = F.lower(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    link = F.regexp_replace(F.trim(_text(href)), "#.*$", "")
    own_scheme = F.lower(F.regexp_extract(link, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    rest = F.when(own_scheme != "", F.regexp_replace(link, "^[^:]*:", "")).otherwise(link)
    path, query = F.regexp_extract(rest, "^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*(\?.+)$", 1)
    host = F.regexp_extract(base, "^[^:/?#]+://([^/?#]*)", 1)
    folder = F.split(F.regexp_extract(base, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/")
    folder = F.when(F.element_at(folder, -1) != "", F.slice(folder, 1, F.size(folder) - 1)).otherwise(folder)
    below = F.concat(folder, F.split(path, "/"))
    inner = F.filter(F.slice(below, 2, F.greatest(F.size(below) - 2, F.lit(0))), lambda x: x != "")
    below = F.concat(F.slice(below, 1, 1), inner, F.slice(below, -1, 1))
    there = _folded(F.when(path.startswith("/"), F.split(path, "/")).otherwise(below))
    there = F.when(there.startswith("/"), there).otherwise(F.concat(F.lit("/"), there))
    whole = (
        F.when(rest.startswith("//"), F.concat(F.when(own_scheme != "", own_scheme).otherwise(scheme), F.lit(":"), rest))
        .when((own_scheme != "") & (own_scheme != scheme), link)
        .when((path == "") & (query == ""), F.regexp_replace(base, "#.*$", ""))
        .when(path == "", F.concat(F.regexp_replace(base, "[?#].*$", ""), query))
        .otherwise(F.concat(scheme, F.lit("://"), host, there, query))
    )
    whole = F.regexp_replace(whole, r"\?$", "")
    return F.when(F.lower(whole).rlike("^https?:"), whole)
