"""Texts that repeat themselves are junk, whatever their marks."""

import pytest

from topicloom.llm import page_lines

SENTENCE = "围绕灰度发布，白榆中心组织了28场讨论，议题包括微服务网关以及线程池。"


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        ("\n".join([SENTENCE] * 50), "junk"),
        ("\n".join(["热泵机组与裁判报告"] * 50), "junk"),
        ("热泵机组 判决书 裁判报告 " * 12 + "。", "junk"),
        ("cheap heat pump, best court report; " * 12, "junk"),
        ("热泵机组判决书裁判报告" * 12, "junk"),
        ("\n".join([SENTENCE, "两地之间相差近30个百分点，接口文档的口径并不均衡。", SENTENCE]), None),
        ("\n".join(f"· 电网负荷 A{i}" for i in range(9)), "list"),
    ],
)
def test_kinds_of_repeating_texts(content, kind):
    assert page_lines.read_page(content).kind == kind
