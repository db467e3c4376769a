"""Selections and joins against sequential models; sources, plans and streams on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators import quality, selection
from topicloom.plans import curate, runs
from topicloom.sources import pages, tables
from topicloom.streaming import arrivals


def test_keep_first_keeps_rows_without_key(spark):
    rows = [(3, "a"), (1, "a"), (2, ""), (4, ""), (5, None)]
    found = selection.keep_first(spark.createDataFrame(rows, "ord int, k string"), F.col("k"), ["ord"])
    assert sorted(r.ord for r in found.collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("seed", range(6))
def test_select_candidates_equals_the_sequential_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xyz"), f"http://{i % 23}.example", rng.randint(0, 5)) for i in range(60)]
    rows = [(i, s, f"http://{s}{u[7:]}", n) for i, s, u, n in rows]
    per, total = rng.randint(0, 4), rng.randint(0, 12)
    chosen = []
    for site in sorted({r[1] for r in rows}):
        seen, count = set(), 0
        for r in sorted((r for r in rows if r[1] == site), key=lambda r: (-r[3], r[0])):
            if r[2] in seen:
                continue
            seen.add(r[2])
            chosen.append(r[0])
            count += 1
            if per and count >= per:
                break
            if total and len(chosen) >= total:
                break
        else:
            continue
        if total and len(chosen) >= total and not (per and count >= per):
            break
    df = spark.createDataFrame(rows, "id int, site string, url string, score int")
    found = selection.select_candidates(df, "site", "url", "score", "id", per, total)
    assert sorted(r.id for r in found.collect()) == sorted(chosen)


def test_join_last_and_domain(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, k string")
    right = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "null")], "k string, ord int, v string")
    assert {r.id: r.v for r in selection.join_last(left, right, "k", ["ord"]).collect()} == {1: "new", 2: None, 3: None}
    urls = spark.createDataFrame([(1, "http://www.x.a.example/p"), (2, "http://a.example"), (3, None), (4, "http://b.example")], "id int, url string")
    domains = spark.createDataFrame([("a.example", 2), ("x.a.example", 3)], "domain string, ord int")
    assert {r.id: r.domain for r in selection.join_domain(urls, "url", domains, "domain", "ord").collect()} == {1: "a.example", 2: "a.example", 3: None, 4: None}


def test_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], "id int, site string, url string, score int, extra string")
    assert selection.select_candidates(empty, "site", "url", "score", "id", 2, 3).count() == 0
    assert selection.top_per_group(empty, "site", "score", "id", 2).columns == empty.columns
    assert selection.slice_rows(spark.range(5).withColumnRenamed("id", "ord"), "ord", 1, 2).count() == 2
    assert selection.in_names(empty, "site", ["a"]).count() == 0


RESULT = "title string, content string, status string, site_name string, extractor string, content_type string"


def test_quality_issues_in_order(spark):
    rows = [("", "请登录", "matched", "s", "", "html"), ("t", "x" * 20_001, "ok", "s", "stats.gov.cn", None), ("t", "x" * 20_001, "ok", "s", "", None), ("t", "x", "matched", "CBNData", "", "html"), ("t", "x", "matched", None, None, "public_preview"), (None, None, None, None, None, None)]
    found = [r.issue for r in quality.quality_rows(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + RESULT)).orderBy("i").collect()]
    assert found == ["matched正文过短；缺少标题；疑似噪音:请登录", "", "正文过长需检查", "CBNData详情页正文不可用或过短", "公开预览内容过短", ""]


HTML = '<html><head><title> A &amp; B </title><script>x</script></head><body><nav><a href="/n">menu</a></nav><article><p>H<sub>2</sub>O</p><a href="/d?a=1&amp;b=2">d <b>e</b></a></article>tail</body></html>'


def test_pages_are_read_once(spark):
    df = spark.createDataFrame([(1, "http://a.example/x", HTML), (2, "http://a.example/y", None), (3, None, "<p>only</p>")], "id int, url string, html string")
    rows = {r.id: r for r in pages.read_pages(df).collect()}
    assert (rows[1].title, rows[1].content, rows[1].extractor) == ("A & B", "H 2 O d e", "generic")
    assert [(x.href, x.text) for x in rows[1].links] == [("/n", "menu"), ("/d?a=1&b=2", "d e")]
    assert (rows[2].title, rows[2].content, rows[2].links) == ("", "", [])
    assert rows[3].content == "only"
    assert pages.page_links(pages.read_pages(df)).count() == 2


@pytest.mark.parametrize(
    ("url", "html", "title", "content"),
    [
        ("http://www.stats.gov.cn/a", '<meta name="ArticleTitle" content="统计"><div class="TRS_Editor">正文 来源：国家统计局 【关闭窗口】</div><div class="footer">脚</div>', "统计", "正文"),
        ("http://t.qianzhan.com/a", '<title>题</title><div class="art">无障碍 当前位置：报告正文</div><div class="mt30">尾</div>', "题", "当前位置：报告正文"),
        ("http://www.cbndata.com/r/1", '<title>t</title><script>window.__INITIAL_STATE__={"data":{"x":[{"title":"内题","content":"<p>内文</p>"}]}};</script>', "内题", "内文"),
        ("http://www.cbndata.com/r/1", '<title>t</title><meta name="description" content="描述 免责声明 x"><p>体</p>', "t", "描述"),
        ("http://m.yicai.com/n", "<title>t</title><p>文 分享到：微信 微博 QQ 末</p>", "t", "t 文 末"),
        ("http://www.huaon.com/c", "<p>导航 一、关于行业的一个很长的题目 来源：华经 正文 本文采编：x</p>", "一、关于行业的一个很长的题目", "一、关于行业的一个很长的题目 来源：华经 正文"),
        ("http://www.chyxx.com/i", "<title>t</title><p>菜单 报告简介 数据 数据 数据 文</p>", "t", "报告简介 数据 文"),
        ("http://www.iresearch.cn/i", '<title>t</title><div class="g-article">文</div><div class="m-page">页</div>', "t", "文"),
        ("http://www.iresearch.com.cn/i", "<title>t</title><p>文</p>", "t", "t 文"),
    ],
)
def test_site_rules(spark, url, html, title, content):
    row = pages.read_pages(spark.createDataFrame([(url, html)], "url string, html string")).first()
    assert (row.title, row.content) == (title, content)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        file.write('title,url\r\n"a ""b""\nc",\r\n')
    row = tables.read_csv(spark, path).first()
    assert (row.title, row.url) == ('a "b"\nc', "")
    tables.write_table(tables.read_csv(spark, path), str(tmp_path / "out"), ["title", "status"])
    assert spark.read.parquet(str(tmp_path / "out")).first().asDict() == {"title": 'a "b"\nc', "status": ""}
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_table(tables.read_csv(spark, path), str(tmp_path / "out"), ["title"])


def test_allow_list_defaults(spark):
    rows = [("s ", " http://a ", None, None, "", "YES", "x", None), ("t", "", None, None, None, None, None, None)]
    found = tables.sites(spark.createDataFrame(rows, "site_name string, url string, domain string, category string, page_type string, enabled string, max_detail_pages string, note string")).collect()
    assert [r.asDict() for r in found] == [{"site_name": "s", "url": "http://a", "domain": "", "category": "", "page_type": "page", "enabled": "yes", "max_detail_pages": 5, "note": ""}]
    with pytest.raises(ValueError, match="domain"):
        tables.sites(spark.createDataFrame([("s", "u")], "site_name string, url string"))


def test_api_answers(spark):
    answers = [
        ("iresearch", {"list": [{"id": 7, "title": "<em>储能</em>", "uptime": "2024/1/2"}, {"title": "no id"}]}, [("https://www.iresearch.com.cn/Detail/report?id=7&isfree=0", "储能")]),
        ("cbndata", {"data": {"data": [{"id": 1, "type": "odd", "title": "t"}, {"newId": 2, "type": "report", "title": "u"}]}}, [("https://www.cbndata.com/information/1", "t"), ("https://www.cbndata.com/report/2", "u")]),
        ("djyanbao", {"data": {"data": [{"id": 5, "title": "t", "highlight": {"a": ["x", "y"]}}]}}, [("https://www.djyanbao.com/report/detail?id=5", "t")]),
        ("stats", {"resultDocs": [{"data": {"url": "http://www.stats.gov.cn/1", "titleO": "t"}}, {"data": {"url": "http://other.example", "title": "u"}}]}, [("http://www.stats.gov.cn/1", "t")]),
    ]
    for api, body, expected in answers:
        df = spark.createDataFrame([("s", "c", "q", "u", "stats.gov.cn", json.dumps(body)), ("s", "c", "q", "u", "stats.gov.cn", "broken")], "site_name string, category string, query string, search_url string, domain string, body string")
        found = tables.api_items(df, api)
        assert [(r.url, r.title) for r in found.orderBy("position").collect()] == expected
        assert tables.candidates(found, ["储能"]).columns == tables.CANDIDATE_COLUMNS
    bodies = spark.createDataFrame([("中".encode("gb18030"),), ("中".encode(),), (None,), (b"\xff",)], "b binary").select(tables.decoded("b").alias("t")).collect()
    assert [r.t for r in bodies] == ["中", "中", None, ""]


def test_runs(tmp_path):
    one = runs.fingerprint({"topic": "a", "sites": ["b", "a"], "api": {"api_key": "k", "model": "m"}})
    assert one == runs.fingerprint({"api": {"model": "m", "api_key": "other"}, "sites": ["a", "b", "a"], "topic": "a"})
    assert one != runs.fingerprint({"topic": "b", "sites": ["a", "b"], "api": {"model": "m"}})
    made = runs.reserve([tmp_path / "x" / "a", tmp_path / "b"])
    with pytest.raises(FileExistsError):
        runs.reserve([tmp_path / "c", tmp_path / "b"])
    assert not (tmp_path / "c").exists() and all(p.exists() for p in made)
    made[0].write_text("t")
    assert runs.reusable(tmp_path, made[0], runs.file_hash(made[0])) and not runs.reusable(tmp_path / "x" / "y", made[0], runs.file_hash(made[0]))
    with runs.run_lock(tmp_path / "lock"), pytest.raises(RuntimeError), runs.run_lock(tmp_path / "lock"):
        pass


def test_reserved_files_go_again_whatever_fails(tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(OSError):
        runs.reserve([tmp_path / "a", tmp_path / "file" / "b"])  # a file is no folder
    assert not (tmp_path / "a").exists()


def test_only_sets_of_names_lose_their_order():
    assert runs.fingerprint({"steps": ["a", "b"]}) != runs.fingerprint({"steps": ["b", "a"]})
    assert runs.fingerprint({"sites": ["a", "b"]}) == runs.fingerprint({"sites": ["b", "a", "a"]})


def test_targets_and_sources_are_checked_in_order(spark):
    from topicloom.functions import network

    rows = [
        ("ftp://a.example/x", "b.example", ["8.8.8.8"], network.WRONG_SCHEME),
        ("http://b.example/x", "a.example", ["10.0.0.1"], network.WRONG_DOMAIN),
        ("http://x.a.example/x", "www.A.example", [], network.NO_ADDRESS),
        ("http://x.a.example/x", "a.example", ["8.8.8.8", "127.0.0.1"], network.NOT_PUBLIC),
        ("http://x.a.example/x", "a.example", ["8.8.8.8", "2606:4700::1111"], ""),
        (None, "a.example", None, network.WRONG_SCHEME),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, domain string, ips array<string>, wanted string")
    assert all(r.found == r.wanted for r in df.withColumn("found", network.target_problem(F.col("url"), F.col("domain"), F.col("ips"))).collect())
    pairs = spark.createDataFrame([("http://b.example", "a.example", False), ("http://a.example", "a.example", False), ("http://a.example", "a.example", None), ("http://a.example", "a.example", True)], "u string, d string, ok boolean")
    found = [r[0] for r in pairs.select(network.source_problem(F.col("u"), F.col("d"), F.col("ok"))).collect()]
    assert found == [network.OTHER_SITE, network.NO_ROBOT, network.NO_ROBOT, ""]


def test_answers_are_read_by_the_api_of_their_site(spark):
    item = json.dumps({"List": [{"NewsId": 3, "title": "储能"}]})
    rows = [("s", "c", "q", "u", "x", "https://www.iresearch.com.cn/", item), ("s", "c", "q", "u", "stats.gov.cn", "", json.dumps({"resultDocs": [{"data": {"url": "http://www.stats.gov.cn/1", "title": "t"}}]})), ("s", "c", "q", "u", "none.example", None, item)]
    df = spark.createDataFrame(rows, "site_name string, category string, query string, search_url string, domain string, url string, body string")
    assert {(r.api, r.url) for r in tables.all_api_items(df).collect()} == {("iresearch", "https://www.iresearch.com.cn/Detail/report?id=3&isfree=0"), ("stats", "http://www.stats.gov.cn/1")}


def test_prefilter_asks_about_the_best(spark):
    rows = [(i, "s", "ok" if i else "skipped", str(i * 10)) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, site_name string, status string, preliminary_score string")
    found = curate.prefilter(df, lambda d: d.withColumns({"ai_score": F.col("id") * 20, "ai_reason": F.lit("")}), "id", per_site=2).collect()
    assert {r.id: r.ai_keep for r in found} == {0: "no", 1: "no", 2: "no", 3: "yes", 4: "yes"}
    assert {r.id: (r.status, r.error, r.ai_relevance_score) for r in found} == {0: ("skipped", curate.NOT_ASKED, ""), 1: ("skipped", curate.NOT_ASKED, ""), 2: ("skipped", curate.NOT_ASKED, ""), 3: ("ok", "", "60"), 4: ("ok", "", "80")}


def test_stream_keeps_the_first_arrival(spark, tmp_path):
    schema = spark.createDataFrame([], "ord int, url string, title string").schema
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "http://a.example/", "x"), (2, "http://a.example", "y"), (3, "", "")], [(4, "http://a.example#f", "z"), (5, "http://b.example", ""), (6, None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        arrivals.follow(spark, source, schema, out, str(tmp_path / "checkpoint"), lambda df: df).awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(out).collect()) == [1, 3, 5, 6]
    for part in (tmp_path / "out" / "batch=0").glob("*.parquet"):
        part.write_bytes(b"broken")
    spark.createDataFrame([(7, "http://b.example/", "")], schema).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="(?i)parquet"):
        arrivals.follow(spark, source, schema, out, str(tmp_path / "checkpoint"), lambda df: df).awaitTermination()


def test_analysis_falls_back_row_by_row(spark):
    from topicloom.plans import analysis

    rows = [("t", "u", "正文 " * 100, "kw"), ("t2", "u2", None, "kw"), ("t3", "u3", "x", "")]
    df = spark.createDataFrame(rows, "title string, url string, content string, matched_keywords string").coalesce(1)
    good = analysis.analysed(df, lambda prompts: ['```json\n{"ai_summary": "s", "ai_category": 1}\n```' for _ in prompts], "{title} {url} {content}")
    found = {r.title: r for r in good.collect()}
    assert (found["t"].ai_summary, found["t"].ai_category, found["t"].ai_reason) == ("s", "1", "") and found["t3"].ai_summary == ""

    def broken(prompts):
        raise OSError

    found = {r.title: r.ai_summary for r in analysis.analysed(df, broken, "{title}").collect()}
    assert found["t"] == ("正文 " * 100)[:200].strip() + ("" if found["t"].endswith("文") else " ") and found["t3"] == ""
    assert analysis.is_true("false") is False and analysis.is_true("Yes") is True and analysis.is_true(1) is True
    log = json.loads(analysis.task_log(spark.createDataFrame([("ok", "a"), ("ok", None)], "status string, site_name string"), {"topic": "t"}))
    assert log["counts"] == {"status": {"ok": 2}, "site_name": {"": 1, "a": 1}}


def test_pdfs_without_a_library_are_empty(spark, tmp_path):
    from topicloom.sources import documents

    (tmp_path / "a.pdf").write_bytes(b"not a pdf")
    row = documents.read_pdfs(spark, str(tmp_path)).first()
    assert (row.title, row.content) == ("a.pdf", "")


def test_links_of_a_page(spark):
    from topicloom.operators import discovery

    html = '<a href="/news/2024/1.html">储能市场新变化</a><a href="/news/2024/1.html#x">储能市场新变化</a><a href="http://other.example/news/2.html">储能</a><a href="mailto:x">m</a><a href="/a.pdf">储能报告下载</a><a href="/about">关于</a>'
    read = pages.read_pages(spark.createDataFrame([(1, "http://h.example/list", "h.example", html), (2, "http://h.example/", "h.example", None)], "id int, url string, domain string, html string"))
    assert [r.link for r in discovery.same_site_links(read, "id", 5).collect()] == ["http://h.example/news/2024/1.html"]
    assert [(r.link, r.score) for r in discovery.list_details(read, "id", ["储能"], 5).collect()] == [("http://h.example/news/2024/1.html", 50)]
    found = {(r.id, r.rank, r.link, r.status) for r in discovery.search_candidates(read, "id", ["储能"], 5).collect()}
    assert found == {(1, 1, "http://h.example/news/2024/1.html", "ok"), (2, None, None, "skipped")}
    assert discovery.column_candidates(read, "id", 1).count() == 2


def test_search_addresses_of_sites(spark):
    from topicloom.operators import discovery

    sites = spark.createDataFrame([("a", "https://www.yicai.com/"), ("b", "https://bg.qianzhan.com/x"), ("c", "https://none.example"), ("d", None)], "site_name string, url string")
    found = {(r.site_name, r.search_url) for r in discovery.search_addresses(sites, ["储能 a"]).collect()}
    word = "%E5%82%A8%E8%83%BD%20a"
    assert found == {("a", f"https://www.yicai.com/search?keys={word}"), ("b", f"https://bg.qianzhan.com/report/search/k-{word}.html"), ("b", f"https://t.qianzhan.com/search/?q={word}")}


def test_replaced_entries_keep_what_has_no_link(spark):
    entries = spark.createDataFrame([("a", "u2", "page"), ("a", "u1", "page"), ("b", "v", "page"), ("c", "w", "page")], "site string, url string, page_type string")
    found = spark.createDataFrame([("a", "l1", 5, 1), ("a", "l2", 9, 2), ("c", "l3", 9, 3)], "site string, link string, score int, ord int")
    targets = spark.createDataFrame([("a",), ("b",), ("b",)], "site string")
    rows = sorted(map(tuple, selection.replace_entries(entries, found, targets, "site", "ord", 1).collect()))
    assert rows == [("a", "l2", "list"), ("b", "v", "page"), ("c", "w", "page")]
