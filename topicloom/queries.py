"""The core queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expected
from .functions import dates, scoring, text, urls
from .operators import discovery, quality, selection
from .plans import curate
from .sources import pages, tables

KEYWORDS = ["新能源", "储能", "代码", "基金", "空调", "market", "grid"]
DAYS = (date(2025, 1, 1), date(2025, 3, 31))
LEAST_SCORE, PER_SITE, TOTAL = 30, 5, 60

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# SQL fragments


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x0b\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g'))"


def sql_host(x: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_extract(coalesce({x}, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))), '^www[.]', '')"


def sql_domain(x: str) -> str:
    return rf"regexp_replace(lower(trim(coalesce({x}, ''))), '^www[.]', '')"


def sql_canonical(x: str) -> str:
    decode = lambda p: f"url_decode(replace({p}, '+', ' '))"
    encode = lambda p: f"replace(url_encode({p}), '%20', '+')"
    pieces = f"list_filter(string_split(regexp_extract({x}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '')"
    pairs = f"list_transform({pieces}, lambda p: {{'k': {decode("regexp_extract(p, '^[^=]*')")}, 'v': {decode("regexp_replace(p, '^[^=]*=?', '')")}}})"
    kept = f"list_sort(list_filter({pairs}, lambda p: lower(p.k) not in ({', '.join(map(q, expected.TRACKING_KEYS))}) and not starts_with(lower(p.k), '{expected.TRACKING_PREFIX}')))"
    query_ = f"array_to_string(list_transform({kept}, lambda p: {encode('p.k')} || '=' || {encode('p.v')}), '&')"
    return f"rtrim(regexp_extract({x}, '^[^?#]*') || case when {query_} <> '' then '?' || {query_} else '' end, '/')"


def sql_hits(x: str, words=KEYWORDS) -> str:
    return "list_filter([" + ", ".join(map(q, words)) + f"], lambda k: contains(lower({x}), lower(k)))"


def sql_count(x: str, words) -> str:
    return " + ".join(f"contains({x}, {q(w)})::int" for w in words)


def sql_score(x: str) -> str:
    return f"case when regexp_full_match(trim(coalesce({x}, '')), '[+-]?[0-9]+') then coalesce(try_cast(trim({x}) as int), 0) else 0 end"


YEAR_SQL = "'20[0-9]{2}'"

# Text


@query(f"select doc_id, {sql_clean('text')} as clean from documents")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.clean_text("text").alias("clean"))


@query(f"select doc_id, left({sql_clean('text')}, 200) as excerpt from documents")
def excerpt(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.excerpt("text").alias("excerpt"))


@query("select doc_id, regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g') as plain from documents")
def strip_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.strip_tags("text").alias("plain"))


_PHRASES, _MARKERS = ["相关安排", "首页"], ["统计口径显示", "值得注意的是", "Compared with"]


@query(f"""select record_id, {sql_clean("regexp_replace(regexp_replace(coalesce(content, ''), '(?:相关安排[\\s]*){3,}', '相关安排 ', 'g'), '(?:首页[\\s]*){3,}', '首页 ', 'g')")} as squeezed from sample_final""")
def squeezed_phrases(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", text.squeeze_phrases("content", _PHRASES).alias("squeezed"))


@query(
    f"""with p as (select record_id, coalesce(content, '') as c, list_min(list_filter([{", ".join(f"instr(coalesce(content, ''), {q(m)})" for m in _MARKERS)}], lambda x: x > 0)) as place from sample_final)
    select record_id, case when place is null then c else {sql_clean("substr(c, place)")} end as cut from p"""
)
def cut_to_marker(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", text.from_first_marker("content", _MARKERS).alias("cut"))


@query(f"select record_id, {sql_clean("regexp_replace(regexp_replace(coalesce(content, ''), '来源[:：]\\s*\\S+', ' ', 'g'), '分享到[:：]?', ' ', 'g')")} as cleaned from sample_final")
def deleted_patterns(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", text.delete_patterns("content", [r"来源[:：]\s*\S+", r"分享到[:：]?"]).alias("cleaned"))


# Addresses


@query(f"select record_id, {sql_host('url')} as host from sample_final")
def url_domain(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", urls.url_domain("url").alias("host"))


@query(
    f"""select s.record_id, w.url as entry, ({sql_host('s.url')} = {sql_domain('w.domain')} or ends_with({sql_host('s.url')}, '.' || {sql_domain('w.domain')})) as within
    from sample_final s join whitelist w on s.site_name = w.site_name"""
)
def domain_boundary(spark, folder):
    sites = table(spark, folder, "whitelist").select("site_name", F.col("url").alias("entry"), "domain")
    joined = table(spark, folder, "sample_final").select("record_id", "site_name", "url").join(selection.dimension(sites), "site_name")
    return joined.select("record_id", "entry", urls.within_domain("url", "domain").alias("within"))


@query(f"select record_id, {sql_canonical("coalesce(url, '')")} as page from sample_final")
def canonical_url(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", urls.canonical_url("url").alias("page"))


@query(
    f"""with k as (select record_id, case when {sql_canonical("coalesce(url, '')")} <> '' then {sql_canonical("coalesce(url, '')")} else {sql_clean('title')} end as key from sample_final),
    r as (select record_id, key, row_number() over (partition by key order by record_id) as n from k)
    select record_id, key from r where key = '' or n = 1"""
)
def first_of_each_page(spark, folder):
    rows = table(spark, folder, "sample_final").select("record_id", "url", "title").withColumn("key", selection.page_key())
    return selection.keep_first(rows, F.col("key"), ["record_id"]).select("record_id", "key")


@query(
    rf"""with c as (select candidate_id, lower(coalesce(candidate_url, '')) as u from candidates)
    select candidate_id, regexp_matches(u, '[.](doc|docx|xls|xlsx|zip|rar|jpg|jpeg|png|gif|pdf)(\?|$)') as file,
    contains(u, '/tag/') or regexp_matches(u, '/(industry|industry/xinzhi|industry/wiki)/$|/research/maoyi$|/channel/[^/.]+/?$') as list_page,
    regexp_matches(u, '/(research|news|industry|wiki|channel)/.+\.html(\?|$)|/(information|report)/[0-9]+(/detail)?(\?|$)') as detail_page from c"""
)
def url_shapes(spark, folder):
    return table(spark, folder, "candidates").select("candidate_id", urls.has_file_ending("candidate_url").alias("file"), urls.is_list_page("candidate_url").alias("list_page"), urls.is_detail_page("candidate_url").alias("detail_page"))


@query(
    f"""with c as (select candidate_id, lower(coalesce(candidate_url, '')) as u, lower(trim(coalesce(title, ''))) as t, {sql_host('candidate_url')} as h from candidates)
    select candidate_id, ({" or ".join(f"contains(u, {q(p)})" for p in expected.SKIPPED_URL_PARTS)}) or ({" or ".join(f"contains(t, {q(p)})" for p in expected.SKIPPED_TEXT_PARTS)})
    or (length(t) < 6 and not regexp_matches(u, {YEAR_SQL})) or ((h = 'qianzhan.com' or ends_with(h, '.qianzhan.com')) and not contains(u, '/report/detail/')) as skipped from c"""
)
def skipped_links(spark, folder):
    return table(spark, folder, "candidates").select("candidate_id", urls.is_skipped_link("candidate_url", "title").alias("skipped"))


@query(
    "with t(template) as (values ('https://search.example/?q={query}'), ('https://search.example/k-{query}.html')) "
    "select s.subject, t.template, replace(t.template, '{query}', replace(url_encode(s.name_zh || ' ' || s.description), '%2F', '/')) as address from subjects s, t"
)
def search_addresses(spark, folder):
    templates = F.array(F.lit("https://search.example/?q={query}"), F.lit("https://search.example/k-{query}.html"))
    rows = table(spark, folder, "subjects").withColumn("template", F.explode(templates))
    return rows.select("subject", "template", urls.search_address(F.col("template"), F.concat_ws(" ", "name_zh", "description")).alias("address"))


@query(
    f"""with h as (select record_id, {sql_host('url')} as host from sample_final), w as (select url as entry, {sql_domain('domain')} as domain from whitelist where {sql_domain('domain')} <> ''),
    m as (select h.record_id, h.host, w.domain, w.entry, row_number() over (partition by h.record_id order by w.entry) as n from h left join w on h.host = w.domain or ends_with(h.host, '.' || w.domain))
    select record_id, host, domain from m where n = 1"""
)
def registered_domain(spark, folder):
    domains = table(spark, folder, "whitelist").select(F.col("url").alias("entry"), urls.normalize_domain("domain").alias("domain")).where("domain <> ''")
    rows = selection.join_domain(table(spark, folder, "sample_final").select("record_id", "url"), "url", domains, "domain", "entry")
    return rows.select("record_id", urls.url_domain("url").alias("host"), "domain")


# Dates


@query(
    """with h as (select record_id, coalesce(url, '') || ' ' || coalesce(title, '') || ' ' || left(coalesce(content, ''), 1000) as t from sample_final),
    m as (select record_id, list_concat(
      list_transform(regexp_extract_all(t, '20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}'), lambda x: regexp_extract(x, '^(20[0-9]{2})', 1) || '-' || lpad(regexp_extract(x, '^20[0-9]{2}[-/.年]([0-9]{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(x, '([0-9]{1,2})$', 1), 2, '0')),
      list_transform(regexp_extract_all(t, '20[0-9]{2}[0-9]{2}[0-9]{2}'), lambda x: x[1:4] || '-' || x[5:6] || '-' || x[7:8])) as d from h)
    select record_id, coalesce(list_filter(d, lambda x: try_cast(x as date) is not null)[1], '') as day from m"""
)
def publish_dates(spark, folder):
    rows = table(spark, folder, "sample_final")
    return rows.select("record_id", dates.publish_date(F.col("title"), F.col("content"), F.col("url")).alias("day"))


_NORMAL_DATE = (
    "case when {m} <> '' then regexp_extract({m}, '^(20[0-9]{{2}})', 1) || '-' || lpad(regexp_extract({m}, '^20[0-9]{{2}}[-/.年]\\s*([0-9]{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract({m}, '([0-9]{{1,2}})$', 1), 2, '0') else '' end"
)


@query(
    rf"""with m as (select candidate_id, regexp_extract(coalesce(publish_date, ''), '20[0-9]{{2}}[-/.年]\s*[0-9]{{1,2}}[-/.月]\s*[0-9]{{1,2}}') as m from candidates)
    select candidate_id, {_NORMAL_DATE.format(m="m")} as day from m"""
)
def normalized_dates(spark, folder):
    return table(spark, folder, "candidates").select("candidate_id", dates.normalized_date(F.col("publish_date")).alias("day"))


@query(
    """with d as (select record_id, case when regexp_full_match(coalesce(publish_date, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(publish_date as date) end as day from sample_final)
    select record_id from d where coalesce(day between date '2025-01-01' and date '2025-03-31', true)"""
)
def date_window(spark, folder):
    return table(spark, folder, "sample_final").where(dates.in_window(F.col("publish_date"), *DAYS)).select("record_id")


# Keywords, classes and scores


@query(f"""with h as (select record_id, {sql_hits("coalesce(title, '') || ' ' || coalesce(content, '')")} as hits from sample_final) select record_id, array_to_string(hits, ' ') as hits, len(hits) > 0 as matched, len(hits) = {len(KEYWORDS)} as matched_all from h""")
def keyword_matches(spark, folder):
    rows = table(spark, folder, "sample_final").select("record_id", text.matched_keywords(F.concat_ws(" ", text.text("title"), text.text("content")), KEYWORDS).alias("hits"))
    return rows.select("record_id", F.array_join("hits", " ").alias("hits"), scoring.is_match(F.col("hits"), KEYWORDS).alias("matched"), scoring.is_match(F.col("hits"), KEYWORDS, every=True).alias("matched_all"))


@query(
    f"""with h as (select record_id, coalesce(title, '') || ' ' || left(coalesce(content, ''), 1000) as t from sample_final),
    c as (select record_id, unnest([{", ".join(f"{{'i': {i}, 'name': {q(n)}, 'n': {sql_count('t', w)}}}" for i, (n, w) in enumerate(expected.CLASS_WORDS.items()))}]) as x from h),
    r as (select record_id, x.name as name, x.n as n, row_number() over (partition by record_id order by x.n desc, x.i) as k from c)
    select record_id, case when n > 0 then name else '其他' end as class from r where k = 1"""
)
def content_classes(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", scoring.content_class("title", "content").alias("class"))


@query(f"select record_id from sample_final where {sql_count("lower(coalesce(title, '') || ' ' || coalesce(content, ''))", expected.BLOCKED_MARKERS)} > 0")
def blocked_pages(spark, folder):
    return table(spark, folder, "sample_final").where(scoring.looks_blocked("title", "content")).select("record_id")


_CANDIDATE_SCORE = f"""(len({sql_hits("coalesce(title, '')")}) * 20 + ({sql_count("lower(coalesce(candidate_url, ''))", expected.GOOD_HINTS)}) * 10
    - ({sql_count("lower(coalesce(candidate_url, ''))", expected.BAD_HINTS)} + (regexp_extract(coalesce(candidate_url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) in ('', '/'))::int) * 30
    + regexp_matches(coalesce(candidate_url, ''), {YEAR_SQL})::int * 5 + (length({sql_clean("title")}) >= 8)::int * 3)"""


@query(f"select candidate_id, cast(case when len({sql_hits("coalesce(title, '')")}) = 0 then least({_CANDIDATE_SCORE}, 29) else {_CANDIDATE_SCORE} end as int) as score from candidates")
def candidate_scores(spark, folder):
    return table(spark, folder, "candidates").select("candidate_id", scoring.candidate_score("candidate_url", "title", KEYWORDS).alias("score"))


@query(
    rf"""with c as (select candidate_id, coalesce(candidate_url, '') as u, coalesce(title, '') as t from candidates), h as (select *, len({sql_hits("t || ' ' || u")}) as hits, lower(t || ' ' || u) as b from c)
    select candidate_id, cast(case when hits = 0 then 0 else hits * 30 + regexp_matches(lower(u), '/(research|news|industry|wiki|channel)/.+\.html(\?|$)|/(information|report)/[0-9]+(/detail)?(\?|$)')::int * 15 + regexp_matches(u, {YEAR_SQL})::int * 5 end as int) as topic_score,
    cast(({sql_count("b", expected.COLUMN_WORDS)}) * 10 - ({sql_count("b", expected.NO_COLUMN_WORDS)}) * 20 + regexp_matches(u, {YEAR_SQL})::int * 3 + (length(t) >= 4)::int as int) as column_score from h"""
)
def link_scores(spark, folder):
    return table(spark, folder, "candidates").select("candidate_id", scoring.topic_link_score("candidate_url", "title", KEYWORDS).alias("topic_score"), scoring.column_link_score("candidate_url", "title").alias("column_score"))


# Selection, joins and unions


def _scored(spark, folder):
    return table(spark, folder, "candidates").where("status = 'ok' and candidate_url <> ''").withColumn("score", scoring.whole_score("preliminary_score"))


_SCORED_SQL = f"select candidate_id, site_name, candidate_url, publish_date, {sql_score('preliminary_score')} as score from candidates where status = 'ok' and candidate_url <> ''"


@query(
    f"""with s as ({_SCORED_SQL}), d as (select *, case when regexp_full_match(coalesce(publish_date, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(publish_date as date) end as day from s)
    select candidate_id, score from d where score >= {LEAST_SCORE} and coalesce(day between date '2025-01-01' and date '2025-03-31', true)"""
)
def qualified_candidates(spark, folder):
    return _scored(spark, folder).where(F.col("score") >= LEAST_SCORE).where(dates.in_window(F.col("publish_date"), *DAYS)).select("candidate_id", "score")


@query(f"select distinct site_name from candidates where status = 'ok' and site_name <> '' and {sql_score('preliminary_score')} >= {LEAST_SCORE}")
def candidate_sites(spark, folder):
    rows = table(spark, folder, "candidates").where("status = 'ok' and site_name <> ''").where(scoring.whole_score("preliminary_score") >= LEAST_SCORE)
    return rows.select("site_name").distinct()


@query(f"with s as ({_SCORED_SQL}), r as (select *, row_number() over (partition by site_name order by score desc, candidate_id) as n from s) select candidate_id, site_name, score from r where n <= {PER_SITE}")
def best_per_site(spark, folder):
    return selection.top_per_group(_scored(spark, folder).select("candidate_id", "site_name", "score"), "site_name", "score", "candidate_id", PER_SITE)


@query(
    f"""with s as ({_SCORED_SQL} and site_name is not null), k as (select *, row_number() over (partition by site_name, {sql_canonical("candidate_url")} order by score desc, candidate_id) as d from s),
    r as (select *, row_number() over (partition by site_name order by score desc, candidate_id) as c from k where d = 1), g as (select *, row_number() over (order by site_name, c) as g from r where c <= {PER_SITE})
    select candidate_id, site_name, score from g where g <= coalesce((select min(g) from g where g >= {TOTAL} and c < {PER_SITE}), g)"""
)
def selected_candidates(spark, folder):
    rows = _scored(spark, folder).where("site_name is not null").select("candidate_id", "site_name", "candidate_url", "score")
    return selection.select_candidates(rows, "site_name", "candidate_url", "score", "candidate_id", PER_SITE, TOTAL).select("candidate_id", "site_name", "score")


@query(
    """with w as (select *, row_number() over (partition by site_name order by url desc) as n from whitelist where trim(url) <> '')
    select c.candidate_id, trim(w.url) as entry, lower(trim(w.enabled)) as enabled, coalesce(w.max_detail_pages, 5) as max_detail_pages from candidates c join w on c.site_name = trim(w.site_name) and w.n = 1 where lower(trim(w.enabled)) = 'yes'"""
)
def candidates_of_sites(spark, folder):
    sites = tables.sites(table(spark, folder, "whitelist")).select("site_name", F.col("url").alias("entry"), "enabled", "max_detail_pages")
    rows = selection.join_last(table(spark, folder, "candidates").select("candidate_id", "site_name"), sites, "site_name", ["entry"], "inner")
    return rows.where("enabled = 'yes'").select("candidate_id", "entry", "enabled", "max_detail_pages")


@query(
    "select trim(coalesce(site_name, '')) as site_name, trim(url) as url, trim(coalesce(domain, '')) as domain, trim(coalesce(category, '')) as category, lower(trim(case when coalesce(page_type, '') = '' then 'page' else page_type end)) as page_type, "
    "lower(trim(case when coalesce(enabled, '') = '' then 'no' else enabled end)) as enabled, coalesce(max_detail_pages, 5) as max_detail_pages, trim(coalesce(note, '')) as note from whitelist where trim(url) <> ''"
)
def allow_list(spark, folder):
    return tables.sites(table(spark, folder, "whitelist")).select(*tables.SITE_COLUMNS)


@query(
    f"""with u as (select 0 as part, record_id as ord, coalesce(url, '') as url, coalesce(title, '') as title from sample_final union all select 1, candidate_id, coalesce(candidate_url, ''), coalesce(title, '') from candidates),
    k as (select part, ord, case when {sql_canonical("url")} <> '' then {sql_canonical("url")} else {sql_clean("title")} end as key from u), r as (select *, row_number() over (partition by key order by part, ord) as n from k)
    select part, ord, key from r where key = '' or n = 1"""
)
def merged_in_order(spark, folder):
    results = table(spark, folder, "sample_final").select(F.col("record_id").alias("ord"), text.text("url").alias("url"), text.text("title").alias("title"))
    found = table(spark, folder, "candidates").select(F.col("candidate_id").alias("ord"), text.text("candidate_url").alias("url"), text.text("title").alias("title"))
    rows = selection.union_in_order([results, found], "ord").withColumn("key", selection.page_key())
    return selection.keep_first(rows, F.col("key"), ["part", "ord"]).select("part", "ord", "key")


@query(
    f"""with s as ({_SCORED_SQL} and site_name is not null), r as (select *, row_number() over (partition by site_name order by score desc, candidate_id) as n from s),
    b as (select *, row_number() over (partition by site_name order by url) as n from whitelist), t as (select site_name from whitelist where page_type = 'list')
    select site_name, url, page_type from whitelist where site_name not in (select site_name from t)
    union all select b.site_name, coalesce(r.candidate_url, b.url), case when r.candidate_url is null then b.page_type else 'list' end from b left join r on b.site_name = r.site_name and r.n <= 3 where b.n = 1 and b.site_name in (select site_name from t)"""
)
def replaced_entries(spark, folder):
    """Sites with a list page get their best candidates as entries, or keep their first entry; the others stay."""
    entries = table(spark, folder, "whitelist").select("site_name", "url", "page_type")
    found = _scored(spark, folder).where("site_name is not null").select("site_name", F.col("candidate_url").alias("link"), "score", "candidate_id")
    return selection.replace_entries(entries, found, entries.where("page_type = 'list'"), "site_name", "candidate_id", 3)


# Quality and diagnostics

_ISSUES_SQL = f"""list_filter([
    case when status = 'matched' and coalesce(content_type, '') = 'public_preview' and length(coalesce(content, '')) < 50 then '{expected.SHORT_PREVIEW}' end,
    case when status = 'matched' and coalesce(content_type, '') <> 'public_preview' and length(coalesce(content, '')) < 200 then case when site_name = 'CBNData' then '{expected.SHORT_BY_SITE["CBNData"]}' else '{expected.SHORT_MATCH}' end end,
    case when length(coalesce(content, '')) > 20000 and coalesce(extractor, '') <> 'stats.gov.cn' then '{expected.LONG_TEXT}' end,
    case when coalesce(title, '') = '' and status in ('matched', 'unmatched') then '{expected.NO_TITLE}' end,
    case {" ".join(f"when contains(coalesce(content, ''), {q(m)}) then {q(expected.NOISE_LABEL + m)}" for m in expected.NOISE)} end], lambda x: x is not null)"""


@query(f"with i as (select record_id, {_ISSUES_SQL} as x, length(coalesce(content, '')) as content_length from sample_final) select record_id, case when len(x) > 0 then 'review' else 'pass' end as quality, coalesce(array_to_string(x, '；'), '') as issue, case when len(x) > 0 then 'yes' else '' end as review_required, content_length from i")
def quality_rows(spark, folder):
    return quality.quality_rows(table(spark, folder, "sample_final")).select("record_id", "quality", "issue", "review_required", "content_length")


@query(
    """with s as (select *, row_number() over (partition by coalesce(url, '') order by content_length desc nulls last, coalesce(issue, '') desc) as n from sample_quality),
    k as (select coalesce(url, '') as url, case when quality = 'review' then coalesce(issue, '') else '' end as issue from s where n = 1)
    select f.record_id, case when coalesce(f.quality_issue, '') <> '' then f.quality_issue else coalesce(k.issue, '') end as quality_issue, case when coalesce(k.issue, '') <> '' then 'yes' else coalesce(f.review_required, '') end as review_required
    from sample_final f left join k on coalesce(f.url, '') = k.url where f.status = 'matched'"""
)
def enriched_results(spark, folder):
    known = table(spark, folder, "sample_quality").withColumns({"length_order": F.col("content_length"), "issue_order": text.text("issue")})
    return quality.enriched(table(spark, folder, "sample_final"), known, ["length_order", "issue_order"]).select("record_id", "quality_issue", "review_required")


@query(
    " union all ".join(f"select '{c}' as field, coalesce({c}, '') as value, count(*) as n from sample_final group by all" for c in ("status", "site_name", "extractor", "category"))
)
def field_counts(spark, folder):
    return quality.counts(table(spark, folder, "sample_final"), "status", "site_name", "extractor", "category")


@query(
    f"""with c as (select status, {sql_score('preliminary_score')} as score from candidates), t as (select count(*) as candidate_row_count, count(*) filter (status = 'ok') as ok_candidate_count,
    count(*) filter (status = 'ok' and score >= {LEAST_SCORE}) as qualified_candidate_count, max(score) filter (status = 'ok') as max_score from c)
    select score, count(*) as n, candidate_row_count, ok_candidate_count, qualified_candidate_count, max_score from c, t where status = 'ok' group by all"""
)
def score_diagnostics(spark, folder):
    return quality.score_diagnostics(table(spark, folder, "candidates"), LEAST_SCORE)


@query("with c as (select coalesce(site_name, '') as site_name, count(*) as n_rows, count(*) filter (status = 'matched') as n_usable from sample_final group by 1) select *, case when n_usable > 0 then 'ok' else 'no_results' end as outcome from c")
def usable_by_site(spark, folder):
    return quality.usable_by_site(table(spark, folder, "sample_final"))


# Pages and landed answers


def _escaped(column) -> F.Column:
    return F.replace(F.replace(F.replace(text.text(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _as_pages(spark, folder) -> DataFrame:
    """Each result as the page it might have come from: menu, article, links, footer."""
    rows = table(spark, folder, "sample_final").select("record_id", "url", "title", "content")
    head = F.concat(F.lit("<html><head><title>"), _escaped("title"), F.lit("</title><script>var a = '<article>';</script></head><body><nav><a href='/'>menu</a></nav><div class=\"article-content\"><p>"))
    tail = F.concat(F.lit("</p><a href=\"/news/"), F.col("record_id").cast("string"), F.lit(".html\">"), _escaped("title"), F.lit("</a></div><footer>footer</footer></body></html>"))
    return rows.select("record_id", "url", F.concat(head, _escaped("content"), tail).alias("html"))


@query(f"select record_id, {sql_clean('title')} as title, {sql_clean("coalesce(content, '') || ' ' || coalesce(title, '')")} as content, '/news/' || record_id || '.html' as href, {sql_clean('title')} as link_text from sample_final")
def read_pages(spark, folder):
    read = pages.read_pages(_as_pages(spark, folder))
    last = F.element_at("links", -1)
    return read.select("record_id", "title", "content", last["href"].alias("href"), last["text"].alias("link_text"))


@query(
    f"""select candidate_id, candidate_url, {sql_clean("title")} as title, {sql_clean("snippet")} as snippet from candidates where candidate_url <> ''"""
)
def api_answers(spark, folder):
    """Candidates written as a search API's answers and read back."""
    rows = table(spark, folder, "candidates").where("candidate_url <> ''")
    item = F.struct(F.struct(F.col("candidate_url").alias("url"), _escaped("title").alias("title"), _escaped("snippet").alias("summary"), F.col("publish_date").alias("docDate")).alias("data"))
    answers = rows.select(F.col("candidate_id").cast("string").alias("query"), "site_name", "category", "search_url", urls.url_domain("candidate_url").alias("domain"), F.to_json(F.struct(F.array(item).alias("resultDocs"))).alias("body"))
    read = tables.api_items(answers, "stats")
    return read.select(F.col("query").cast("long").alias("candidate_id"), F.col("url").alias("candidate_url"), "title", "snippet")


_ANNOTATED = f"{sql_hits("coalesce(title, '') || ' ' || coalesce(content, '')")}"


@query(
    f"""with a as (select *, {_ANNOTATED} as hits, {_ISSUES_SQL} as x, case when {sql_canonical("coalesce(url, '')")} <> '' then {sql_canonical("coalesce(url, '')")} else {sql_clean('title')} end as key from sample_final
      where {sql_count("lower(coalesce(title, '') || ' ' || coalesce(content, ''))", expected.BLOCKED_MARKERS)} = 0 and {sql_clean('content')} <> ''),
    r as (select *, row_number() over (partition by key order by record_id) as n from a where len(hits) > 0)
    select record_id, array_to_string(hits, ' ') as hits, left({sql_clean('content')}, 200) as excerpt, case when len(x) > 0 then 'review' else 'pass' end as quality, coalesce(array_to_string(x, '；'), '') as issue from r where key = '' or n = 1"""
)
def published(spark, folder):
    rows = curate.publish(table(spark, folder, "sample_final"), KEYWORDS, "record_id")
    return rows.select("record_id", F.array_join("hits", " ").alias("hits"), "excerpt", "quality", "issue")


@query(
    f"""with s as (select *, {sql_score('preliminary_score')} as score from candidates where status = 'ok'), r as (select candidate_id, row_number() over (partition by site_name order by score desc, candidate_id) as n, length(coalesce(title, '')) * 3 as ai_score from s)
    select c.candidate_id, r.ai_score, case when r.ai_score >= 60 then 'yes' else 'no' end as ai_keep from candidates c left join r on c.candidate_id = r.candidate_id and r.n <= 5"""
)
def prefiltered(spark, folder):
    stub = lambda df: df.withColumns({"ai_score": F.length(text.text("title")) * 3, "ai_reason": F.lit("")})
    return curate.prefilter(table(spark, folder, "candidates"), stub, "candidate_id").select("candidate_id", "ai_score", "ai_keep")


# Links of pages


def _link_pages(spark, folder) -> DataFrame:
    """Each candidate's search page: the candidate twice, an article of the site and a picture."""
    rows = table(spark, folder, "candidates").where("search_url <> ''")
    link = lambda href, words: F.concat(F.lit('<a href="'), _escaped(href), F.lit('">'), _escaped(words), F.lit("</a>"))
    number = F.col("candidate_id").cast("string")
    markup = F.concat(
        link("candidate_url", "title"), link(F.concat(text.text("candidate_url"), F.lit("#again")), "title"), link(F.concat(F.lit("/news/2024/"), number, F.lit(".html")), "snippet"), link(F.concat(F.lit("/pic/"), number, F.lit(".PNG")), "title")
    )
    return pages.read_pages(rows.select("candidate_id", F.col("search_url").alias("url"), urls.url_domain("search_url").alias("domain"), markup.alias("html")))


_ORIGIN = "regexp_extract(search_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
_LINKS_SQL = f"""p as (select *, {sql_host('search_url')} as h from candidates where search_url <> ''), l as (
    select candidate_id, h, 0 as position, regexp_replace(trim(candidate_url), '#.*$', '') as link, {sql_clean('title')} as t from p where candidate_url <> ''
    union all select candidate_id, h, 2, {_ORIGIN} || '/news/2024/' || candidate_id || '.html', {sql_clean('snippet')} from p
    union all select candidate_id, h, 3, {_ORIGIN} || '/pic/' || candidate_id || '.PNG', {sql_clean('title')} from p),
    k as (select *, {sql_host('link')} as g, lower(link) as u from l where regexp_matches(lower(link), '^https?://'))"""
_INSIDE, _FILE = "(g = h or ends_with(g, '.' || h))", r"regexp_matches(u, '[.](doc|docx|xls|xlsx|zip|rar|jpg|jpeg|png|gif|pdf)(\?|$)')"
_SKIP = f"(({' or '.join(f'contains(u, {q(p)})' for p in expected.SKIPPED_URL_PARTS)}) or ({' or '.join(f'contains(lower(t), {q(p)})' for p in expected.SKIPPED_TEXT_PARTS)}) or (length(t) < 6 and not regexp_matches(u, {YEAR_SQL})))"
_ONCE = "row_number() over (partition by candidate_id, {what} order by position)"


@query(
    f"with {_LINKS_SQL}, f as (select *, {_ONCE.format(what='link')} as o from k where {_INSIDE} and g = h and not {_FILE} and not {_SKIP}), r as (select *, row_number() over (partition by candidate_id order by position) as rank from f where o = 1) select candidate_id, rank, link from r where rank <= 2"
)
def same_site_links(spark, folder):
    return discovery.same_site_links(_link_pages(spark, folder), "candidate_id", 2)


_TOPIC_SCORE = rf"(len({sql_hits("t || ' ' || link")}) * 30 + regexp_matches(u, '/(research|news|industry|wiki|channel)/.+\.html(\?|$)|/(information|report)/[0-9]+(/detail)?(\?|$)')::int * 15 + regexp_matches(link, {YEAR_SQL})::int * 5)"


@query(
    rf"""with {_LINKS_SQL}, f as (select *, case when len({sql_hits("t || ' ' || link")}) = 0 then 0 else {_TOPIC_SCORE} end as score from k where {_INSIDE}
      and regexp_matches(u, '/(research|news|industry|wiki|channel)/.+\.html(\?|$)|/(information|report)/[0-9]+(/detail)?(\?|$)')), o as (select *, {_ONCE.format(what=sql_canonical("link"))} as o from f where score > 0),
    r as (select *, row_number() over (partition by candidate_id order by score desc, position) as rank from o where o = 1) select candidate_id, rank, link, score from r where rank <= 3"""
)
def list_details(spark, folder):
    return discovery.list_details(_link_pages(spark, folder), "candidate_id", KEYWORDS, 3)


_LINK_SCORE = _CANDIDATE_SCORE.replace("coalesce(title, '')", "t").replace("coalesce(candidate_url, '')", "link").replace(sql_clean("title"), "t")


@query(
    f"""with {_LINKS_SQL}, f as (select *, case when len({sql_hits("t")}) = 0 then least({_LINK_SCORE}, 29) else {_LINK_SCORE} end as score from k where {_INSIDE} and not {_FILE}), o as (select *, {_ONCE.format(what='link')} as o from f where score > 0),
    r as (select *, row_number() over (partition by candidate_id order by score desc, position) as rank from o where o = 1)
    select p.candidate_id, r.rank, r.link, cast(r.score as int) as score, case when r.link is null then 'skipped' else 'ok' end as status from p left join r on p.candidate_id = r.candidate_id and r.rank <= 2"""
)
def search_discovery(spark, folder):
    return discovery.search_candidates(_link_pages(spark, folder), "candidate_id", KEYWORDS, 2)


_COLUMN_SCORE = f"(({sql_count("lower(t || ' ' || link)", expected.COLUMN_WORDS)}) * 10 - ({sql_count("lower(t || ' ' || link)", expected.NO_COLUMN_WORDS)}) * 20 + regexp_matches(link, {YEAR_SQL})::int * 3 + (length(t) >= 4)::int)"


@query(
    f"""with {_LINKS_SQL}, f as (select *, {_COLUMN_SCORE} as score from k where g = h and not {_FILE}), o as (select *, {_ONCE.format(what='link')} as o from f where score > 0),
    r as (select *, row_number() over (partition by candidate_id order by score desc, position) as rank from o where o = 1)
    select p.candidate_id, r.rank, r.link, cast(r.score as int) as score, case when r.link is null then 'skipped' else 'ok' end as status from p left join r on p.candidate_id = r.candidate_id and r.rank <= 2"""
)
def column_discovery(spark, folder):
    return discovery.column_candidates(_link_pages(spark, folder), "candidate_id", 2)
