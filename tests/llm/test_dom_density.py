"""The main body of html pages."""

import pytest

from topicloom.llm import dom_density

P = "储能市场在这一季度出现了变化，各地的安排也不一样，其中三个地区给出了新的口径。" * 3
MENU = "<ul><li><a href=/>首页</a><li><a href=/n>新闻</a><li><a href=/d>数据</a></ul>"
SIDE = "<div class=side><h3>推荐</h3><a href=1>另一篇文章的题目很长很长很长</a><a href=2>又一篇文章的题目很长很长</a></div>"


def page(main, foot="<div id=foot><a href=/c>联系我们</a> <a href=/p>隐私</a> 版权所有</div>"):
    return f"<html><head><title>t</title></head><body><div>{MENU}</div>{main}{SIDE}{foot}<script>var x = '{P}';</script></body></html>"


@pytest.mark.parametrize(
    ("main", "text"),
    [
        (f"<div class=main><h1>标题</h1><p>{P}</p><p>短句。</p><p>{P}见<a href=x>链接</a>。</p></div>", f"标题\n{P}\n短句。\n{P}见链接。"),
        (f"<article><p>{P}<b>重点</b></p></article>", f"{P}重点"),
        (f"<table><tr><td>{P}<br>{P}</td></tr></table>", f"{P}{P}"),
        (f"<section><div><p>{P}<p>{P}</div></section>", f"{P}\n{P}"),  # paragraphs without ends
    ],
)
def test_main_bodies(main, text):
    assert dom_density.main_body(page(main)) == text


def test_odd_pages(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, MENU, "x"), (4, "plain words and no tag", "x"), (5, "<p>" + "长文" * 50_000, "x"), (6, "<div>" * 3000 + P, "x"), (6, "</p></div>><<", "x")]
    found = dom_density.main_bodies(spark.createDataFrame(rows, "record_id long, html string, content string"))
    got = sorted((r.record_id, r.content) for r in found.collect())
    assert [len(c) for _, c in got[:3]] == [0, 0, 0] and got[3][1] == "plain words and no tag" and got[4][1] == "长文" * 50_000 and (6, P) in got
    assert found.limit(0).count() == 0
