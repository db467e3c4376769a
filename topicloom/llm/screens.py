"""Patterns of many alternatives behind a screen: a text without any of the literals that a match needs isn't searched.

The literals are read off the pattern itself, so a screened pattern finds exactly what the pattern finds. Alternatives
that need no literal are kept in a pattern of their own, which is always searched.
"""

from __future__ import annotations

import re

try:
    from re import _parser
except ImportError:
    _parser = None
try:
    import ahocorasick
except ImportError:
    ahocorasick = None


def alternatives(source: str) -> list[str]:
    """A pattern's outermost alternatives."""
    out, depth, klass, begin, i = [], 0, False, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif klass:
            klass = c != "]"
        elif c == "[":
            klass = True
            i += 1 if source[i + 1 : i + 2] != "^" else 2  # a bracket that stands first is a member
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(source[begin:i])
            begin = i + 1
        i += 1
    return [*out, source[begin:]]


def needed(parsed) -> set[str] | None:
    """Literals of which every match holds one; None where there are none."""
    best: set[str] | None = None
    run = ""

    def length(words: set[str]) -> tuple[int, float]:
        return min(map(len, words)), sum(map(len, words)) / len(words)

    def better(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or length(found) > length(best)):
            best = found

    for op, value in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        better({run} if run else None)
        run = ""
        if name == "SUBPATTERN":
            better(needed(value[3]))
        elif name == "BRANCH":
            several = [needed(x) for x in value[1]]
            better(set().union(*several) if all(several) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
            better(needed(value[2]))
    return best


class Screened:
    """As a compiled pattern of the same source, for `search` on text of the case of its literals."""

    def __init__(self, source: str) -> None:
        self.pattern = re.compile(source)
        self._rest, self._screen = None, None
        if _parser is None or ahocorasick is None:
            return
        literals: set[str] = set()
        free = []
        for part in alternatives(source):
            found = needed(_parser.parse(part))
            if found:
                literals |= found
            else:
                free.append(part)
        self._screen = ahocorasick.Automaton()
        for literal in literals:
            self._screen.add_word(literal, 0)
        self._screen.make_automaton()
        self._rest = re.compile("|".join(free)) if free else None

    def search(self, text: str) -> re.Match | None:
        if self._screen is None or next(self._screen.iter(text), None) is not None:
            return self.pattern.search(text)
        return self._rest.search(text) if self._rest else None
