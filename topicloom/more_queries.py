"""Further core queries, for what the first ones leave out: site rules, every search API, safety of addresses, dates, links.

The SQL spells its values out; it takes none from the code that it checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates, network, text, urls
from .operators import selection
from .queries import _escaped, query, sql_clean, sql_host, table
from .sources import pages, tables

_TITLE = sql_clean("title")

# Each result's title as a page of one of the eight sites with rules of their own.
_SITE_PAGES = {
    "www.stats.gov.cn": ('<meta name="ArticleTitle" content="统计"><div class="TRS_Editor">', ' 来源：国家统计局 【关闭窗口】</div><div class="footer">脚</div>'),
    "www.iresearch.cn": ('<title>题</title><div class="g-article">', '</div><div class="m-page">页</div>'),
    "m.yicai.com": ("<title></title><p>", " 分享到：微信 微博 QQ</p>"),
    "www.cheaa.com": ("<p>无障碍 ", "</p>"),
    "www.chyxx.com": ("<p>菜单 报告简介 ", "</p>"),
    "www.huaon.com": ("<title>题</title><p>导航 一、", " 本文采编：某人</p>"),
    "t.qianzhan.com": ('<title>题</title><div class="art">无障碍 当前位置：', '</div><div class="mt30">尾</div>'),
    "www.cbndata.com": ('<title>题</title><meta name="description" content="', ' 免责声明 其余"><p>体</p>'),
}


@query(
    f"""with s as (select record_id, {_TITLE} as t, record_id % 8 as k from sample_final)
    select record_id, case k when 0 then 'stats.gov.cn' when 1 then 'iresearch.cn' when 2 then 'yicai.com' when 3 then 'cheaa.com' when 4 then 'chyxx.com' when 5 then 'huaon.com' when 6 then 'qianzhan.com' else 'cbndata.com' end as extractor,
    case k when 0 then '统计' when 2 then '' when 3 then '' when 4 then '' else '题' end as title,
    trim(case k when 1 then t when 0 then t when 2 then t when 3 then t when 4 then '报告简介 ' || t when 5 then '一、' || t when 6 then '当前位置：' || t else t end) as content from s"""
)
def site_pages(spark, folder):
    rows = table(spark, folder, "sample_final").select("record_id", "title")
    shown = F.replace(_escaped("title"), F.lit('"'), F.lit("&quot;"))
    html, url = F.lit(""), F.lit("")
    for k, (host, (before, after)) in enumerate(_SITE_PAGES.items()):
        mine = F.col("record_id") % 8 == k
        html = F.when(mine, F.concat(F.lit(before), shown, F.lit(after))).otherwise(html)
        url = F.when(mine, F.lit(f"https://{host}/p/1.html")).otherwise(url)
    read = pages.read_pages(rows.select("record_id", url.alias("url"), html.alias("html")))
    body = F.regexp_replace("content", "^题 ", "")  # a page without a container shows its title too
    return read.select("record_id", "extractor", "title", F.trim(F.when(F.col("record_id") % 8 == 5, body).otherwise(F.col("content"))).alias("content"))


@query(
    f"""select candidate_id, case candidate_id % 4 when 0 then 'stats' when 1 then 'iresearch' when 2 then 'cbndata' else 'djyanbao' end as api,
    case candidate_id % 4 when 0 then 'http://www.stats.gov.cn/n/' || candidate_id when 1 then 'https://www.iresearch.com.cn/Detail/report?id=' || candidate_id || '&isfree=0'
    when 2 then 'https://www.cbndata.com/report/' || candidate_id else 'https://www.djyanbao.com/report/detail?id=' || candidate_id end as url, {_TITLE} as title from candidates"""
)
def api_dispatch(spark, folder):
    """Every candidate as an answer of the search API of one of four sites, read by whichever API the site's address names."""
    rows = table(spark, folder, "candidates")
    number, title, turn = F.col("candidate_id").cast("string"), _escaped("title").alias("title"), F.col("candidate_id") % 4
    stats = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("http://www.stats.gov.cn/n/"), number).alias("url"), title).alias("data"))).alias("resultDocs")))
    iresearch = F.to_json(F.struct(F.array(F.struct(number.alias("NewsId"), title)).alias("List")))
    cbndata = F.to_json(F.struct(F.struct(F.array(F.struct(number.alias("newId"), F.lit("report").alias("type"), title)).alias("data")).alias("data")))
    djyanbao = F.to_json(F.struct(F.struct(F.array(F.struct(number.alias("id"), title)).alias("data")).alias("data")))
    site = F.element_at(F.array(*map(F.lit, ("https://www.stats.gov.cn/", "https://www.iresearch.com.cn/s", "https://data.cbndata.com", "https://www.djyanbao.com/a"))), (turn + 1).cast("int"))
    body = F.when(turn == 0, stats).when(turn == 1, iresearch).when(turn == 2, cbndata).otherwise(djyanbao)
    answers = rows.select(number.alias("query"), "site_name", "category", "search_url", F.lit("stats.gov.cn").alias("domain"), site.alias("url"), body.alias("body"))
    return tables.all_api_items(answers).select(F.col("query").cast("long").alias("candidate_id"), "api", "url", "title")


@query(
    f"""with r as (select candidate_id, {sql_host("candidate_url")} as host, candidate_url, candidate_id % 3 as k from candidates where candidate_url like 'http%')
    select candidate_id, case when host <> 'a.example' and not host like '%.a.example' and k = 0 then '重定向目标不匹配白名单域名' when k = 1 then '目标域名解析到非公网 IP，已拒绝请求' when k = 2 then '无法解析目标域名' else '' end as target,
    case when k = 0 then 'URL 不匹配白名单域名' when k = 1 then 'robots.txt 不允许访问' else '' end as source from r"""
)
def address_checks(spark, folder):
    """Candidates held against the domain they came from (every third against another), with addresses that are public, private or missing."""
    rows = table(spark, folder, "candidates").where("candidate_url like 'http%'")
    turn = F.col("candidate_id") % 3
    domain = F.when(turn == 0, F.lit("a.example")).otherwise(urls.url_domain("candidate_url"))
    found = F.when(turn == 0, F.array(F.lit("8.8.8.8"))).when(turn == 1, F.array(F.lit("1.1.1.1"), F.lit("192.168.0.7"))).otherwise(F.array().cast("array<string>"))
    return rows.select("candidate_id", network.target_problem(F.col("candidate_url"), domain, found).alias("target"), network.source_problem(F.col("candidate_url"), domain, turn == 2).alias("source"))


@query(
    """select candidate_id, candidate_id % 4 = 0 as public, case candidate_id % 4 when 0 then true when 1 then false when 2 then false else candidate_id % 8 = 3 end as robots from candidates"""
)
def machine_rules(spark, folder):
    """Addresses of four kinds, and robots files of four kinds, by candidate."""
    turn = (F.col("candidate_id") % 4).cast("int")
    address = F.element_at(F.array(*map(F.lit, ("93.184.216.34", "10.1.2.3", "::ffff:127.0.0.1", "64:ff9b::a00:1"))), turn + 1)
    status = F.element_at(F.array(*map(F.lit, (404, 200, 503, 200))), turn + 1)
    robots = F.when(turn == 1, F.lit("User-agent: *\nDisallow: /")).otherwise(F.lit("User-agent: *\nDisallow: /private"))
    url = F.when((F.col("candidate_id") % 8 == 3) | (turn != 3), F.lit("https://a.example/news/1")).otherwise(F.lit("https://a.example/private/1"))
    return table(spark, folder, "candidates").select("candidate_id", network.public_address(address).alias("public"), network.robots_column("reader")(status, robots, url).alias("robots"))


@query(
    """select record_id, regexp_extract(coalesce(publish_date, ''), '20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}', 0) as raw from sample_final"""
)
def raw_dates(spark, folder):
    return table(spark, folder, "sample_final").select("record_id", dates.first_raw_date(F.col("publish_date")).alias("raw"))


@query(
    """select record_id, case when strpos(content, '。') > 0 then trim(regexp_replace(regexp_replace(substr(content, greatest(1, strpos(content, '。') - 40), strpos(content, '。') + 60 - greatest(1, strpos(content, '。') - 40)), '<[^>]+>', ' ', 'g'), '[\\s\\x0b\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) else '' end as around
    from sample_final where content is not null and not contains(content, '&') and not contains(content, '<')"""
)
def link_context(spark, folder):
    """What stands around the first full stop of each content without markup."""
    rows = table(spark, folder, "sample_final").where("content is not null and not contains(content, '&') and not contains(content, '<')")
    return rows.select("record_id", text.context_of(F.col("content"), F.lit("。"), 40, 60).alias("around"))


@query(
    """with r as (select candidate_id, coalesce(regexp_replace(lower(trim(regexp_extract(coalesce(candidate_url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))), '^www[.]', ''), '') as host from candidates)
    select candidate_id, (host = 'stats.gov.cn' or host like '%.stats.gov.cn' or host = 'iresearch.com.cn' or host like '%.iresearch.com.cn' or host = 'cbndata.com' or host like '%.cbndata.com' or host = 'djyanbao.com' or host like '%.djyanbao.com') as api from r"""
)
def api_domains(spark, folder):
    return table(spark, folder, "candidates").select("candidate_id", urls.is_api_domain("candidate_url").alias("api"))


@query(
    """select record_id, 'https://h.example/' || case record_id % 5 when 0 then 'a/x' || record_id || '.html' when 1 then 'x' || record_id when 2 then 'a/b/?p=' || record_id when 3 then 'a/b/c' || record_id || '/' else 'r' || record_id end as link from sample_final"""
)
def resolved_links(spark, folder):
    """Relative links of five kinds on a page."""
    number, turn = F.col("record_id").cast("string"), F.col("record_id") % 5
    href = (
        F.when(turn == 0, F.concat(F.lit("../x"), number, F.lit(".html#top"))).when(turn == 1, F.concat(F.lit("../../../x"), number)).when(turn == 2, F.concat(F.lit("?p="), number))
        .when(turn == 3, F.concat(F.lit("./d/../c"), number, F.lit("/."))).otherwise(F.concat(F.lit("/q/../r"), number))
    )
    return table(spark, folder, "sample_final").select("record_id", urls.resolved_link(F.lit("https://h.example/a/b/"), href).alias("link"))


@query("select * from (select candidate_id, site_name from candidates where site_name in (select site_name from whitelist where trim(site_name) <> '' order by url limit 3)) order by candidate_id offset 10")
def named_slice(spark, folder):
    """The candidates of three sites, from the eleventh on."""
    names = [r.site_name for r in table(spark, folder, "whitelist").where("trim(site_name) <> ''").orderBy("url").select("site_name").take(3)]
    return selection.slice_rows(selection.in_names(table(spark, folder, "candidates").select("candidate_id", "site_name"), "site_name", names), "candidate_id", 10)


@query(f"select record_id, {_TITLE} as decoded from sample_final where title is not null")
def decoded_bodies(spark, folder):
    """Titles as bytes in UTF-8 or GB18030, read back."""
    rows = table(spark, folder, "sample_final").where("title is not null")
    return rows.select("record_id", text.clean_text(tables.decoded(F.encode("title", "utf-8"))).alias("decoded"))


@query(
    """with s as (select *, case when regexp_full_match(trim(coalesce(preliminary_score, '')), '[+-]?[0-9]+') then try_cast(trim(preliminary_score) as integer) else 0 end as n from candidates where status = 'ok'),
    r as (select candidate_id, row_number() over (partition by site_name order by coalesce(n, 0) desc, candidate_id) as k, length(coalesce(title, '')) * 3 as score from s)
    select c.candidate_id, case when r.k <= 5 and r.score >= 60 then c.status else 'skipped' end as status,
    case when r.k <= 5 and r.score >= 60 or coalesce(c.error, '') <> '' then coalesce(c.error, '') when r.k <= 5 then 'AI精筛剔除' else '未进入AI精筛范围' end as error,
    case when r.k <= 5 then r.score::varchar else '' end as ai_relevance_score, case when r.k <= 5 then '' else '未进入AI精筛范围' end as ai_filter_reason
    from candidates c left join r on c.candidate_id = r.candidate_id"""
)
def prefilter_outcomes(spark, folder):
    from .plans import curate

    stub = lambda df: df.withColumns({"ai_score": F.length(text.text("title")) * 3, "ai_reason": F.lit("")})
    return curate.prefilter(table(spark, folder, "candidates"), stub, "candidate_id").select("candidate_id", "status", "error", "ai_relevance_score", "ai_filter_reason")
