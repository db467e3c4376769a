"""What recurs within a site: messages in place of articles, and copies."""

import random

import pytest

from topicloom.llm import page_quality

HAN = [chr(0x4E00 + i) for i in range(2500)]
ARTICLE = "围绕灰度发布，白榆中心组织了28场讨论，议题包括微服务网关以及线程池。不过，接口文档的口径并不均衡，两地之间相差近30个百分点。"


def article(rng):
    return "".join(rng.choice(HAN) for _ in range(60)) + "。"


def records(spark, contents, site="s"):
    return spark.createDataFrame([(i, site, c) for i, c in enumerate(contents)], "record_id long, site_name string, content string")


@pytest.mark.parametrize(
    "message",
    [
        "请启用 JavaScript 以继续浏览", "502 Bad Gateway", "这是一段占位文本，请勿发布", "Lorem ipsum dolor sit amet consectetur.", "本文由{{author_name}}为您整理发布",
    ],
)
def test_a_message_in_a_third_of_a_sites_rows(spark, message):
    rng = random.Random(2)
    notice = "本刊每周二出版欢迎读者来信"
    rows = [f"{message}\n{notice}" for _ in range(20)] + [f"{article(rng)}\n{notice}" for _ in range(40)]
    assert sorted(r.record_id for r in page_quality.template_residue(records(spark, rows)).collect()) == list(range(20))


def test_a_repeated_message_beside_an_article_is_no_message_page(spark):
    rng = random.Random(2)
    rows = [f"{article(rng)}\n{article(rng)}\n加载中" for _ in range(40)]
    assert page_quality.template_residue(records(spark, rows)).count() == 0
    assert {r.line_no for r in page_quality.not_body(records(spark, rows)).collect()} == {3}


def test_weak_messages_repeated_by_each_of_two_sites(spark):
    rows = [(i, "ab"[i % 2], "抱歉，出了点问题") for i in range(20)]
    df = spark.createDataFrame(rows, "record_id long, site_name string, content string")
    assert page_quality.template_residue(df).count() == 20


#: Common messages in no particular wording, each planted in three sources.
UNSEEN = [
    "Oops! Something went wrong on our end.", "This site is under construction.", "Your session has expired. Please log in again.", "当前访问人数过多，请排队等候", "站点正在升级，敬请期待", "TODO: write this section.",
    "Dear [FIRST NAME], your order has shipped.", "Coming soon", "您的账号已在别处登录，请重新登录", "系统检测到异常流量", "This feature is not available in your region.", "Please verify you are human", "数据加载中...", "该功能暂未开放",
    "Maintenance in progress, back at 18:00", "You do not have sufficient rights to view this",
]


def test_unseen_messages_that_recur_across_sources(spark):
    rng = random.Random(9)
    rows = [(s, f"{m} (ref {rng.randint(1000, 9999)})") for m in UNSEEN for s in "abc"]
    rows += [(s, f"{article(rng)}{article(rng)}") for s in "abc" for _ in range(30)] + [("a", article(rng))] * 4
    copied = article(rng) + article(rng) + "".join(article(rng) for _ in range(4))
    rows += [(s, copied) for s in "abc"]  # an article delivered by three sources
    df = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(rows)], "record_id long, site_name string, content string")
    assert sorted(r.record_id for r in page_quality.template_residue(df).collect()) == list(range(3 * len(UNSEEN)))


def test_a_message_of_any_length(spark):
    trace = "Traceback (most recent call last): " + " ".join(f'File "/srv/app/page_{i}.py", line {i}, in render' for i in range(40)) + " ValueError"
    df = records(spark, [trace, '{"code": 500, "msg": "' + "x" * 400 + '"}', ARTICLE * 5])
    assert sorted(r.record_id for r in page_quality.template_residue(df).collect()) == [0, 1]


def test_copies_of_an_article_are_no_notice(spark):
    rng = random.Random(3)
    copied = f"{article(rng)}\n{article(rng)}"
    rows = [copied] * 20 + [f"{article(rng)}\n{article(rng)}\n欢迎读者来信本刊每周二出版" for _ in range(40)]
    found = page_quality.not_body(records(spark, rows)).collect()
    assert sorted((r.record_id, r.line_no) for r in found) == [(i, 3) for i in range(20, 60)]
