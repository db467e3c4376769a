"""Per-document text statistics (problem 3), by counting over arrays of code points.

Words are runs of Latin letters or digits and single Han characters; symbols are what is neither a
letter, a digit nor white space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import Rolling, chunks, code_points

# Function words, whose share tells prose.
COMMON_HAN = "的了在是和与将对为以及有不这从把被并而其中之前已"
COMMON_LATIN = "the of and to in is a for on that it with as by at from was are its has have be or an this which than not more but".split()
LINE_ENDS = "。．.!?！？…;；:：”\"'」』)）"
#: Characters of the n-grams whose coverage is measured.
GRAM = 8

BLANK, WORD, HAN, SYMBOL = range(4)
FIELDS = "record_id long, n_chars int, n_words int, mean_word_length double, symbol_ratio double, n_lines int, punctuated_lines double, common_words double, repeated_lines double, repeated_paragraphs double, top_gram double, repeated_grams double"


@cache
def _kinds() -> np.ndarray:
    table = np.full(0x110000, SYMBOL, dtype=np.uint8)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isspace():
            table[cp] = BLANK
        elif ch.isalnum():
            table[cp] = HAN if unicodedata.category(ch) == "Lo" and 0x2E80 <= cp else WORD
    return table


@cache
def _common_words() -> np.ndarray:
    codes, starts = code_points(COMMON_LATIN)
    return np.sort(Rolling(codes).slices(starts[:-1], starts[1:]))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.full(len(part), np.nan), where=whole > 0)


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: the items seen before in it, and the occurrences of its most frequent one."""
    bits = max(1, int(n).bit_length())
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (h.view(np.uint64) >> np.uint64(bits)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(key)))
    o = (key[first] >> np.uint64(64 - bits)).astype(np.int64)
    top = np.zeros(n)
    if len(o):
        edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        top[o[edge]] = np.maximum.reduceat(total, edge)
    return np.bincount(o, weights=total - 1, minlength=n), top


def _grams(rolling: Rolling, owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram within a text."""
    grams = rolling.windows(GRAM)
    whole = np.arange(len(grams)) + GRAM <= starts[owner[: len(grams)] + 1]
    return owner[: len(grams)][whole], grams[whole].view(np.int64)


def repeated_grams(texts: list[str]) -> np.ndarray:
    """Per text the share of its n-grams that repeat earlier ones; 0 for texts too short to have any."""
    codes, starts = code_points([t.lower() for t in texts])
    owner, grams = _grams(Rolling(codes), np.repeat(np.arange(len(texts)), np.diff(starts)), starts)
    again, _ = _repeats(owner, grams, len(texts))
    return np.nan_to_num(_share(again, np.bincount(owner, minlength=len(texts))))


def measure(texts: list[str], grams: bool = True) -> dict[str, np.ndarray]:
    """The statistics of each text by name; without grams those of n-grams, lines and paragraphs that repeat are left out."""
    n = len(texts)
    lower = [t.lower() for t in texts]
    codes, starts = code_points(lower)
    owner = np.repeat(np.arange(n), np.diff(starts))
    kinds = _kinds()[codes]
    count = lambda mask: np.bincount(owner[mask], minlength=n)
    filled = kinds != BLANK
    edge = np.ones(len(codes), dtype=bool)
    edge[1:] = (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero((kinds == WORD) & edge)
    last = np.append(edge[1:], True) if len(codes) else edge
    end = np.flatnonzero((kinds == WORD) & last) + 1
    rolling = Rolling(codes)
    found = np.searchsorted(_common_words(), word := rolling.slices(begin, end))
    common = _common_words()[np.minimum(found, len(_common_words()) - 1)] == word
    words = np.bincount(owner[begin], minlength=n) + count(kinds == HAN)
    letters = count(kinds == WORD) + count(kinds == HAN)
    common_words = np.bincount(owner[begin[common]], minlength=n) + count(np.isin(codes, [ord(c) for c in COMMON_HAN]))

    lines = [(i, line) for i, text in enumerate(lower) for line in (x.strip() for x in text.split("\n")) if line]
    line_owner = np.fromiter((i for i, _ in lines), dtype=np.int64, count=len(lines))
    sizes = np.fromiter((len(x) for _, x in lines), dtype=np.float64, count=len(lines))
    ended = np.fromiter((x[-1] in LINE_ENDS for _, x in lines), dtype=bool, count=len(lines))
    hashes = np.fromiter((hash(x) for _, x in lines), dtype=np.int64, count=len(lines))
    n_lines = np.bincount(line_owner, minlength=n)
    line_chars = np.bincount(line_owner, weights=sizes, minlength=n)
    found = {
        "n_chars": np.diff(starts),
        "n_words": words,
        "mean_word_length": _share(letters, words),
        "symbol_ratio": _share(count(kinds == SYMBOL), count(filled)),
        "n_lines": n_lines,
        "punctuated_lines": _share(np.bincount(line_owner[ended], minlength=n), n_lines),
        "common_words": _share(common_words, words),
    }
    if not grams:
        return found
    repeated, _ = _repeats(line_owner, hashes, n)
    parts = [(i, part) for i, text in enumerate(lower) for part in (x.strip() for x in text.split("\n\n")) if part]
    part_owner = np.fromiter((i for i, _ in parts), dtype=np.int64, count=len(parts))
    repeated_parts, _ = _repeats(part_owner, np.fromiter((hash(x) for _, x in parts), dtype=np.int64, count=len(parts)), n)
    gram_owner, hashed = _grams(rolling, owner, starts)
    again, top = _repeats(gram_owner, hashed, n)
    return found | {
        "repeated_lines": _share(repeated, n_lines),
        "repeated_paragraphs": _share(repeated_parts, np.bincount(part_owner, minlength=n)),
        "top_gram": _share(np.minimum(top * GRAM, line_chars), line_chars),
        "repeated_grams": _share(again, np.bincount(gram_owner, minlength=n)),
    }


def statistics(records: DataFrame) -> DataFrame:
    """(record_id, content) to FIELDS; null and empty contents have counts of 0 and null shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                found = measure(part)
                columns = [pa.array(v, from_pandas=True) if v.dtype == np.float64 else pa.array(v.astype(np.int32)) for v in found.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns], names=["record_id", *found])

    return records.select(F.col("record_id").cast("long").alias("record_id"), "content").mapInArrow(run, FIELDS)
