"""A screened pattern finds what the pattern finds."""

import random
import re

from topicloom.llm import page_lines
from topicloom.llm.screens import Screened, alternatives


def test_alternatives_are_the_outermost():
    assert alternatives(r"a(b|c)|[|)]d|\||[]|]e") == ["a(b|c)", "[|)]d", r"\|", "[]|]e"]


def test_screens_leave_out_no_match():
    rng = random.Random(1)
    sources = [page_lines.STRONG.pattern.pattern, page_lines.WEAK.pattern.pattern, r"x?y|[ab]c|(?:de|f)+g|h{0,2}", "中(?:文|国)|\\d中"]
    for source in sources:
        plain, screened = re.compile(source), Screened(source)
        pieces = [p for p in re.split(r"[^\w一-鿿]+", source) if p] + list("abcdefghxy0123 中文:#<{")
        for _ in range(3000):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
            a, b = plain.search(text), screened.search(text)
            assert (a and a.span()) == (b and b.span())
