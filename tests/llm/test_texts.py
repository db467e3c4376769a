"""Operators on texts against brute force, round trips and held-out accuracy."""

import base64
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from topicloom.llm import mixture, page_lines, page_quality, repeated_lines, subjects, text_statistics, tokens
from topicloom.llm.codepoints import LETTERS, LETTERS_DIGITS, Rolling, chunks, code_points, reduce_slowly, reduced

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["", " ", "ﬁ Ⅷ ㎡ é é ΑΣ Σα ℃ 가 ①", "İx", "２０２５ ａＢ", "​﻿", "🙂" * 5, "中" * 3000, "\n\n", "a\r\nb"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_reduction_equals_the_slow_one(texts):
    for keep in (LETTERS, LETTERS_DIGITS):
        codes, starts = reduced(texts + ODD, keep)
        assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)] == [reduce_slowly(t, keep) for t in texts + ODD]


def test_equal_windows_have_equal_hashes():
    codes, _ = code_points(["xabcdeyabcdez"])
    h = Rolling(codes).windows(5)
    assert h[1] == h[7] and len(set(h.tolist())) == len(h) - 1
    assert len(Rolling(code_points([""])[0]).windows(5)) == 0
    assert [at for at, _ in chunks(["x" * 10, None, "y"], 8)] == [0, 1]


# tokens


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab's  '\n\t1２.,ldvemrt　́é🙂\r\x1c中"), st.characters(codec="utf-8", max_codepoint=0xFFFF)), max_size=40), max_size=6))
def test_pieces_and_ids_equal_the_library(encoding, texts):
    by = tokens.encoder(tokens.VOCABULARY)
    ids, bounds = by.encode(texts)
    # characters newer than one of the two Unicode tables may differ in class
    known = [all(unicodedata.category(c) != "Cn" for c in t) for t in texts]
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if known[k]:
            assert ids[a:b].tolist() == encoding.encode_ordinary(texts[k])


def test_encoding_round_trip_with_offsets(spark):
    rows = [(1, "it's 2025 中文，測試"), (2, ""), (3, None), (4, " \n x"), (4, " \n x"), (5, "長" * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    found = tokens.encode_documents(df, offsets=True)
    assert {r.doc_id: r.text for r in tokens.decode_documents(found).collect()} == {i: t or "" for i, t in rows}
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == 6 and got[2].ids == [] and got[3].ids == []
    by = tokens.encoder(tokens.VOCABULARY)
    data = rows[0][1].encode()
    assert all(data[s : s + len(by.tokens[i])] == by.tokens[i] for i, s in zip(got[1].ids, got[1].starts, strict=True))
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {i: len(r.ids) for i, r in got.items()}
    assert tokens.encode_documents(df.limit(0)).count() == 0


# repeated lines


def brute_lines(rows):
    n = Counter(site for _, site, _ in rows if site)
    keyed = [(i, k, site, key) for i, site, content in rows if site and content for k, line in enumerate(content.split("\n"), 1) if len(key := reduce_slowly(line, LETTERS)) >= 4]
    support = Counter((s, key) for s, key in ((s, key) for _, s, key in {(i, s, key) for i, _, s, key in keyed}))
    return {(i, k) for i, k, s, key in keyed if support[s, key] >= 5 and support[s, key] * 100 >= 5 * n[s]}


def site_rows():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        site = rng.choice(["a"] * 5 + ["b", "c", None, ""])
        lines = [f"正文第{rng.choice('甲乙丙丁戊己庚辛')}段{chr(0x4E00 + rng.randrange(3000))}{chr(0x4E00 + rng.randrange(3000))}"] * rng.randint(0, 2)
        lines += [f"转载请注明 {i}"] * (rng.random() < 0.3) + ["ＡＢＣＤ notice!"] * (rng.random() < 0.06) + ["abcd NOTICE"] * (rng.random() < 0.5) + ["短", "", "123"]
        rng.shuffle(lines)
        rows.append((i, site, "\n".join(lines) if rng.random() < 0.95 else rng.choice([None, ""])))
    return rows


def test_repeated_lines_equal_brute_force(spark):
    rows = site_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "record_id long, site_name string, content string, rows int, line string")
    found = repeated_lines.repeated_lines(df)
    assert sorted(map(tuple, found.collect())) == sorted(brute_lines(rows))
    cleaned = {r.record_id: r for r in repeated_lines.without_lines(df, found).collect()}
    gone = brute_lines(rows)
    for i, _, content in rows:
        assert cleaned[i].content == (content and "\n".join(x for k, x in enumerate(content.split("\n"), 1) if (i, k) not in gone))
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def gapped(keys, step):
    """Every sequence of items at rising places at most `step` apart."""
    found, open_ = set(), [((k,), i) for i, k in enumerate(keys)]
    while open_:
        found |= {s for s, _ in open_}
        open_ = list({(s + (keys[j],), j) for s, i in open_ for j in range(i + 1, min(i + step + 1, len(keys)))})
    return found


@pytest.mark.parametrize("step", [1, 2, 3])
def test_frequent_sequences_equal_brute_force(spark, step):
    rows = site_rows()
    df = spark.createDataFrame(rows, "record_id long, site_name string, content string")
    found = Counter()
    for r in repeated_lines.frequent_sequences(df, step).collect():
        found[r.site_name, len(r.sequence), r.rows] += 1
    n = Counter(site for _, site, _ in rows if site)
    support = Counter()
    for _, site, content in rows:
        if site and content:
            keys = [k for line in content.split("\n") if len(k := reduce_slowly(line, LETTERS)) >= 4]
            support.update((site, s) for s in gapped(keys, step))
    wanted = Counter((site, len(s), c) for (site, s), c in support.items() if c >= 5 and c * 100 >= 5 * n[site])
    assert found == wanted
    lines = sorted(map(tuple, repeated_lines.repeated_lines(df, step).collect()))
    assert lines == sorted(map(tuple, repeated_lines.repeated_lines(df).collect()))


# pages

ARTICLE = "围绕灰度发布，白榆中心组织了28场讨论，议题包括微服务网关以及线程池。不过，接口文档的口径并不均衡，两地之间相差近30个百分点。"
PAGE = "\n".join(
    [
        "· 图库 招聘 行情", "当前位置：首页 > 软件 > 某题", "本网站使用 Cookie 用于统计访问量。全部接受 | 仅必要项", "来源：某站　发布时间：2020-08-15　字号：大 中 小", "一、类型系统的效率", ARTICLE, "", "单位：万台",
        "岚州	68	64.2	50.9", "热点：另一篇的题目", ARTICLE, "责任编辑：苏编　校对36", "郑重声明：以上稿件仅代表作者个人看法，转载请注明出处。", "扫一扫，关注“某站”公众号！", "家电制造最新", "1. 某地推进一事", "2. 另一地推进另一事", "上一篇：某题",
        "网友评论（574）", "联系我们 · 法律声明 · 隐私政策",
    ]
)


def test_the_body_of_a_page():
    page = page_lines.read_page(PAGE)
    assert page.kind is None and page.slots == 0
    assert page.surroundings() == [1, 2, 3, 4, 10, *range(12, 21)]


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        ("\n".join(f"· 电网负荷 A{i}" for i in range(9)), "list"),
        ("\n".join(f"{i}、某地某事观察：质量如何收窄" for i in range(9)), "list"),
        ("灌溉渠系	增速	效率\n2008年	75.0	61.1\n青荻镇	42.6	19.8\n2014年	26.4	4.5", "table"),
        ("\n".join(f"游泳接力{i}：{i}7.5万台" for i in range(9)), "table"),
        ("wUBi5Txczr3K6sfDOiekaOTi94OCG5BfVaMvKEqVQB5Gg6w/Hz5YuvpmQmmjFZSs\nngoxcSw2WX+W0F1T6dpXyNLtwKWUjx74mRUfk8YYdickUZ0/W7AmIXeBvhoFZhDv", "junk"),
        ("��烫烫锟斤拷鐨勬鎶杩烫烫浜у澧炲be0f浜у95浜у烫烫", "junk"),
        (" ".join(["热泵机组", "判决书", "裁判报告"] * 12), "junk"),
        (ARTICLE + "\n" + "\n".join(f"· 电网 A{i}" for i in range(4)), None),
        ("这一变化在望川表现得尤为持续。", None),
        ("", None),
    ],
)
def test_kinds_of_text(content, kind):
    assert page_lines.read_page(content).kind == kind


@pytest.mark.parametrize(
    ("content", "residue"),
    [
        ("您的浏览器不支持 JS，页面无法显示", True),
        ("请启用浏览器脚本，否则页面无法显示\n首页 登录 注册", True),
        ("502 Bad Gateway", True),
        ('{"code":404,"msg":"no such item","data":null}', True),
        ("<html><head><title>503 Service Unavailable</title></head>", True),
        ("这是一段占位文本，请勿发布", True),
        ("Lorem ipsum dolor sit amet consectetur.", True),
        ("值得注意的是，#{content}工作站并未披露同行评议的具体透明度，较{{region}}多出3项。" + ARTICLE, True),
        (ARTICLE + "文档把 {{name}} 这类写法称为模板变量，并解释了它何时会被替换。", False),
        ("部分用户当时只看到“404 Not Found”字样，某站在三分钟后恢复了服务。", False),
        ("顾问建议把“系统繁忙，请稍后再试”改成更具体的说明，并给出了理由和例子。", False),
        (ARTICLE, False),
        ("短文。", False),
    ],
)
def test_template_residue(spark, content, residue):
    df = spark.createDataFrame([(1, "s", content), (2, None, None), (3, "s", "")], "record_id long, site_name string, content string")
    assert [r.record_id for r in page_quality.template_residue(df).collect()] == [1] * residue


def test_weak_messages_count_where_they_recur_across_sources(spark):
    rows = [(i, site, f"抱歉，出了点问题，编号{i}{i}") for i, site in enumerate("aabbc")] + [(9, "a", "抱歉，这里只有一次")]
    df = spark.createDataFrame(rows, "record_id long, site_name string, content string")
    assert sorted(r.record_id for r in page_quality.template_residue(df).collect()) == [0, 1, 2, 3, 4]


def test_page_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "record_id long, site_name string, content string, kind string")
    for operator in (page_quality.template_residue, page_quality.not_prose, page_quality.not_body, page_quality.statistics):
        assert operator(df).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "the cat。\nthe cat。\n\nx y!"), (2, None), (3, "的" * 40)], "record_id long, content string")
    a, b, c = page_quality.statistics(df).orderBy("record_id").collect()
    assert (a.n_words, a.n_lines, a.common_words, a.punctuated_lines) == (6, 3, 2 / 6, 1.0)
    assert abs(a.repeated_lines - 1 / 3) < 1e-9 and abs(a.symbol_ratio - 3 / 17) < 1e-9
    assert (b.n_words, b.symbol_ratio) == (0, None)
    assert c.repeated_grams == 32 / 33 and c.top_gram == 1.0 and c.common_words == 1.0


# mixtures


def mixed_rows(spark, weights, rows, total=None):
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, budget string")
    targets = spark.createDataFrame(weights, "source string, weight int, max_repeats int")
    chosen, plan = mixture.mixed(documents, targets, total=total)
    return chosen.collect(), {r.source: r for r in plan.collect()}, mixture.report(documents, targets, total=total).collect()


def test_mixture_follows_weights_within_repeats(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["market", "grid", "x"]) for _ in range(rng.randint(1, 60))), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "b"), (902, "word " * 5000, "a")]
    chosen, plan, report = mixed_rows(spark, [("a", 2, 1), ("b", 2, 3), ("c", 1, 2), ("none", 3, 2), ("zero", 0, 1)], rows)
    used = Counter()
    for r in chosen:
        used[r.source] += r.n_tokens * r.copies
        assert 1 <= r.copies <= {"a": 1, "b": 3, "c": 2}[r.source]
    assert set(used) == {"a", "b", "c"}
    for r in report:
        if r.source in used:
            assert r.mixed_tokens == used[r.source] <= r.budget
            assert r.budget - r.mixed_tokens <= 3
            assert abs(r.actual_share - r.reachable_share) < 0.01
    full = [s for s, p in plan.items() if p.tokens and p.budget >= p.tokens * p.max_repeats - 1]
    assert full  # the largest total: some source gives all it may
    copies = Counter(r.copies for r in chosen if r.source == "b")
    assert max(copies) - min(copies) <= 1  # epochs come first


def test_mixture_with_a_total_and_without_rows(spark):
    rows = [(i, "market " * 10, "a") for i in range(50)] + [(100 + i, "grid " * 10, "b") for i in range(2)]
    chosen, plan, report = mixed_rows(spark, [("a", 1, 1), ("b", 1, 2)], rows, total=300)
    assert {r.source: r.mixed_tokens for r in report}["b"] <= 2 * 2 * 11
    assert not mixed_rows(spark, [("a", 1, 1)], [])[0]
    assert not mixed_rows(spark, [], rows)[0]


# subjects


def test_subjects_of_held_out_documents(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    areas = spark.read.parquet(f"{sf}/subjects.parquet")
    found = subjects.document_subjects(documents, spark.createDataFrame([], "doc_id long, subject string"), areas)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, set()).add(r.subject)
    labels = {}
    for r in spark.read.parquet(f"{sf}/subject_labels.parquet").collect():
        labels.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(bool(by.get(d, set()) & s) for d, s in labels.items())
    assert right >= 0.7 * len(labels)  # labels are noisy, and no label was seen


def test_subject_rules(spark):
    rows = [
        (1, "法院受理了这起合同诉讼。律师提交了判决意见。" * 3, "", "s"), (2, None, "x", None), (3, " \n", None, "s"), (4, "后来大家都走了。" * 5, None, None),
        (5, "法院受理了合同诉讼。" * 6 + "银行下调了贷款利率。" * 5, None, "s"), (6, "法院受理了合同诉讼。" * 20 + "银行下调了贷款利率。", None, "s"), (1, "法院受理了这起合同诉讼。", None, None),
    ]
    documents = spark.createDataFrame([(*r, "law") for r in rows], "doc_id long, text string, title string, source string, subject string")
    labels = spark.createDataFrame([(1, "law", "a"), (1, "law", None), (2, None, None)], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("law",), ("finance",), (None,), ("odd",)], "subject string")
    found = sorted((r.doc_id, r.subject) for r in subjects.document_subjects(documents, labels, areas).collect())
    assert found == [(1, "law"), (1, "law"), (5, "finance"), (5, "law"), (6, "law")]
    assert subjects.document_subjects(documents.limit(0), labels, areas).count() == 0
    assert subjects.document_subjects(documents, labels, areas.limit(0)).count() == 0
    assert {r.subject: r.n_docs for r in subjects.corpus_shares(documents, labels, areas).collect()} == {"law": 4, "finance": 1, "odd": 0}


def test_accuracies_are_learned_from_votes():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 5, 4000)
    votes = np.stack([np.where(rng.random(4000) < a, truth, rng.integers(0, 5, 4000)) for a in (0.9, 0.8, 0.5, 0.1)], axis=1)
    accuracy, prior = subjects.learn_accuracies(votes, 5)
    assert accuracy[0] > accuracy[1] > accuracy[2] > accuracy[3] and abs(accuracy[0] - 0.92) < 0.05
    assert abs(prior.sum() - 1) < 1e-6


def test_line_sizes_of_text_statistics():
    assert text_statistics.measure([])["n_words"].tolist() == []
