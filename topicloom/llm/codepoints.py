"""Whole Arrow batches of text as one numpy array of code points.

Reduction (NFKC, lower case, a choice of categories kept) is one table lookup per character. Characters
whose NFKC or lower-case form depends on neighbours, or is several letters long, are marked in the
table; only texts holding one of those go through unicodedata.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

PLANES = 0x30000
DROP, SPECIAL = 0, 0xFFFFFFFF
LETTERS = "letters"
LETTERS_DIGITS = "letters and digits"
#: Characters of text handled at a time, which bounds a worker's memory whatever the Arrow batch holds.
CHUNK = 600_000


def _kept(ch: str, keep: str) -> bool:
    kind = unicodedata.category(ch)
    return kind[0] == "L" or (keep == LETTERS_DIGITS and kind == "Nd")


@cache
def reduction_table(keep: str) -> np.ndarray:
    """Code point to the reduced code point, DROP or SPECIAL."""
    table = np.full(PLANES, SPECIAL, dtype=np.uint32)
    for cp in range(PLANES):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] == "M" or 0x1100 <= cp < 0x1200 or ch == "Σ":
            continue
        form = unicodedata.normalize("NFKC", ch).lower()
        left = [c for c in form if _kept(c, keep)]
        if any(unicodedata.combining(c) or 0x1100 <= ord(c) < 0x1200 for c in form):
            continue
        if not left:
            table[cp] = DROP
        elif len(form) == 1:
            table[cp] = ord(form)
    table[ord("\n")] = DROP
    return table


def reduce_slowly(text: str, keep: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if _kept(c, keep))


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `limit` characters, each with the place of its first text."""
    start, size, part = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in a row, and where each text begins (one more entry: the end)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def reduced(texts: list[str], keep: str) -> tuple[np.ndarray, np.ndarray]:
    """As code_points, of the reduced texts."""
    codes, starts = code_points(texts)
    table = reduction_table(keep)
    mapped = table[np.minimum(codes, PLANES - 1)]
    mapped = np.where(codes < PLANES, mapped, SPECIAL)
    if (mapped == SPECIAL).any():
        bad = np.unique(np.searchsorted(starts, np.flatnonzero(mapped == SPECIAL), side="right") - 1)
        fixed = list(texts)
        for i in bad:
            fixed[i] = reduce_slowly(texts[i], keep)
        codes, starts = code_points(fixed)
        mapped = np.where(codes < PLANES, table[np.minimum(codes, PLANES - 1)], codes)
        mapped = np.where(mapped == SPECIAL, codes, mapped)
    kept = mapped != DROP
    before = np.concatenate([[0], np.cumsum(kept)])
    return mapped[kept], before[starts]


_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any slices of one array of code points, from one prefix sum of a polynomial modulo 2**64."""

    def __init__(self, codes: np.ndarray, seed: int = 0) -> None:
        self.size = len(codes)
        up, self.down = _power_tables(self.size + 1)
        values = mixed(codes.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
        self.sums = np.zeros(self.size + 1, dtype=np.uint64)
        np.cumsum(values * up[: self.size], out=self.sums[1:])

    def slices(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every run of `width` code points, by its first place."""
        n = max(0, self.size - width + 1)
        return mixed((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
