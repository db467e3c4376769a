"""Signatures of texts over a vertically cut order of n-grams, and the exchange by which texts meet.

The n-grams (runs of five) have a global order, by hash, that is cut into FRAGMENTS; a text's set of runs falls into
as many segments. Of each segment its least run under each of ORDERS inner orders is kept: two texts agree there with
the probability that their overlap in that fragment has. PIECE fragments that agree together are a partial overlap of
the two texts. Partial overlaps are counted slice by slice of the pieces' order and summed per pair; a pair with LEAST
of them is a candidate. A pair of similarity s has about ORDERS * PIECES * s ** PIECE: 10 at 0.6, 30 at 0.7, 0.0005
at 0.15, so texts that only share phrases don't meet, and where the edits stand doesn't matter.

Pieces travel packed: one row per slice for some thousand texts, not one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import LETTERS_DIGITS, Rolling, chunks, mixed, reduced

RUN = 5
#: Contents of fewer reduced characters take no part.
LEAST_LETTERS = 240
FRAGMENTS, ORDERS, PIECE = 64, 40, 7
PIECES = FRAGMENTS // PIECE
#: Partial overlaps that make a pair a candidate.
LEAST = 2
#: Bits of a piece's key besides its slice, as they travel.
KEY_BITS = 40
#: Pieces held by a worker before they are packed; pieces of a slice, about.
HELD, SLICE = 1_500_000, 400_000
#: Slices of one partition, so that partitions come out even.
SLICES_EACH = 8

_U = np.uint64


@cache
def _orders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each inner order: its odd multiplier and its sequence of fragments; and odd weights of the places in a piece."""
    numbers = mixed(np.arange(1, ORDERS + PIECE + 1, dtype=_U)) | _U(1)
    sequence = np.argsort(mixed(np.arange(ORDERS * FRAGMENTS, dtype=_U) + _U(0x51ED2701)).reshape(ORDERS, FRAGMENTS), axis=1)
    return numbers[:ORDERS], sequence, numbers[ORDERS:]


def piece_keys(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduced texts to (the texts long enough, their keys: an array of (texts, ORDERS * PIECES)).

    An empty segment takes the value of the next segment that has runs, told apart by its distance.
    """
    long = np.flatnonzero(np.diff(starts) >= LEAST_LETTERS)
    n = len(long)
    if not n:
        return long, np.zeros((0, ORDERS * PIECES), dtype=_U)
    runs = Rolling(codes).windows(RUN)
    own = np.full(len(starts) - 1, -1, dtype=np.int64)
    own[long] = np.arange(n)
    owner = np.repeat(own, np.diff(starts))[: len(runs)]
    last = np.repeat(starts[1:], np.diff(starts))[: len(runs)]
    whole = (owner >= 0) & (np.arange(len(runs)) + RUN <= last)
    # 16 bits for the text: a chunk holds fewer than 2**16 texts of LEAST_LETTERS, as NFKC makes 18 letters of one at most
    held = np.sort((owner[whole].astype(_U) << _U(48)) | (runs[whole] >> _U(16)))
    edge = np.searchsorted(held >> _U(42), np.arange(n * FRAGMENTS + 1, dtype=_U))
    held &= _U((1 << 48) - 1)
    empty = edge[1:] == edge[:-1]
    at = np.minimum(edge[:-1], len(held) - 1)
    borrowed = None
    if empty.any():
        filled = ~empty.reshape(n, FRAGMENTS)
        place = np.where(np.concatenate([filled, filled], axis=1), np.arange(2 * FRAGMENTS), 4 * FRAGMENTS)
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :FRAGMENTS]
        distance = (following - np.arange(FRAGMENTS)).astype(_U)
        borrowed = ((np.arange(n)[:, None] * FRAGMENTS + following % FRAGMENTS).ravel(), distance.ravel() * _U(0x9E3779B97F4A7C15))
    multipliers, sequence, weights = _orders()
    keys = np.zeros((ORDERS, PIECES, n), dtype=_U)
    for k in range(ORDERS):
        least = np.minimum.reduceat(held * multipliers[k], at)
        if borrowed:
            least = least[borrowed[0]] + borrowed[1]
        columns = np.ascontiguousarray(least.reshape(n, FRAGMENTS).T)
        for place in range(PIECE):
            keys[k] += columns[sequence[k, place : PIECES * PIECE : PIECE]] * weights[place]
    keys += mixed(np.arange(ORDERS * PIECES, dtype=_U) + _U(77)).reshape(ORDERS, PIECES, 1)
    return long, np.ascontiguousarray(mixed(keys).reshape(ORDERS * PIECES, n).T)


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of whole numbers, all lowest bytes first, so that what is the same in all compresses."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((data.size // size, 8), dtype=np.uint8)
    out[:, :size] = data.reshape(size, -1).T
    return out.view("<u8").ravel()


def pack(keys: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> bytes:
    """One block; ids should be in order."""
    return b"".join((_planes(keys, KEY_BITS // 8), _planes(np.diff(ids, prepend=0), 8), _planes(np.diff(tags, prepend=0), 4)))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, tags) of a block."""
    data = np.frombuffer(block, dtype=np.uint8)
    first, width = KEY_BITS // 8, KEY_BITS // 8 + 12
    n = len(data) // width
    keys, ids, tags = data[: n * first], data[n * first : n * (first + 8)], data[n * (first + 8) :]
    return _from_planes(keys, first), np.cumsum(_from_planes(ids, 8).view(np.int64)), np.cumsum(_from_planes(tags, 4).astype(np.uint32).view(np.int32), dtype=np.int32)


def slices_for(texts: int, df: DataFrame) -> int:
    """How many slices the pieces of so many texts are cut into."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, texts * ORDERS * PIECES // (SLICE * SLICES_EACH) + 1) * SLICES_EACH


def packed_pieces(texts: DataFrame, slices: int) -> DataFrame:
    """(id, content, tag) to rows (slice, block) that hold every piece of every text long enough."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, ids, tags = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, tags))
            keys, ids, tags = keys[order], ids[order], tags[order]
            width = keys.shape[1]
            keys = keys.ravel()
            where = keys % _U(slices)
            order = np.argsort(where.astype(np.uint16 if slices <= 1 << 16 else np.uint32), kind="stable")
            edge = np.searchsorted(where[order], np.arange(slices + 1, dtype=_U))
            keys = (keys // _U(slices))[order] & _U((1 << KEY_BITS) - 1)
            owner = order // width
            ids, tags = ids[owner], tags[owner]
            used = np.flatnonzero(edge[1:] > edge[:-1])
            blocks = [pack(keys[edge[s] : edge[s + 1]], ids[edge[s] : edge[s + 1]], tags[edge[s] : edge[s + 1]]) for s in used]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blocks, pa.binary())], names=["slice", "block"])

        size = 0
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for at, part in chunks(batch.column(1).to_pylist()):
                long, keys = piece_keys(*reduced(part, LETTERS_DIGITS))
                if len(long):
                    held.append((keys, ids[at + long], tags[at + long]))
                    size += keys.size
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select("id", "content", F.col("tag").cast("int").alias("tag")).where("id is not null and content is not null and tag is not null").mapInArrow(packed, "slice int, block binary")


def whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, ids, tags) of each slice, of rows (slice, block) in order of slices; keys hold the slice too."""
    current, blocks = None, []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, ids, tags = (np.concatenate(x) for x in zip(*map(unpack, blocks), strict=True))
        return keys | (_U(current) << _U(KEY_BITS)), ids, tags

    for batch in batches:
        for s, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != current and blocks:
                yield joined()
                blocks = []
            current = s
            blocks.append(block)
    if blocks:
        yield joined()


def by_slice(packed: DataFrame, slices: int, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work over the rows (slice, block), all rows of a slice in one partition and together."""
    parts = max(1, slices // SLICES_EACH)
    return packed.repartitionById(parts, F.pmod("slice", F.lit(parts)).cast("int")).sortWithinPartitions("slice").mapInArrow(work, schema)
