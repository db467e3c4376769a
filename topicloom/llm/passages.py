"""Keys of whole contents, counts of what pairs have in common, and the exact check of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import shared_checkpoint, small_or_shuffled
from .codepoints import LETTERS_DIGITS, Rolling, chunks, reduced, signed
from .signatures import LEAST_LETTERS, RUN

SIMILAR = 0.6
#: Texts on each side of a cell in which pairs are checked, about.
CELL = 1000


def content_keys(texts: DataFrame) -> DataFrame:
    """(id, content) to (id, k1, k2): a 128-bit key of each reduced content of LEAST_LETTERS characters or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in chunks(batch.column(1).to_pylist()):
                codes, starts = reduced(part, LETTERS_DIGITS)
                long = np.diff(starts) >= LEAST_LETTERS
                begin, end = starts[:-1][long], starts[1:][long]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + len(part)][long]),
                        pa.array(signed(Rolling(codes, 1).slices(begin, end))),
                        pa.array(signed(Rolling(codes, 2).slices(begin, end))),
                    ],
                    names=["id", "k1", "k2"],
                )

    return texts.select("id", "content").where("id is not null and content is not null").mapInArrow(keys, "id long, k1 long, k2 long")


def run_sets(texts: list[str]) -> list[np.ndarray]:
    codes, starts = reduced(texts, LETTERS_DIGITS)
    h = Rolling(codes).windows(RUN)
    return [np.unique(h[a : max(a, b - RUN + 1)]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar_pairs(candidates: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of the candidate pairs (a, b) those whose whole contents (id, content) are similar: (a, b, similarity).

    Texts are dealt to parts, and the pairs to cells of two parts: a text goes once into each cell that has pairs of
    it, however many those are. candidates is read three times, so it should be a checkpoint.
    """
    ends = shared_checkpoint(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    parts = ends.count() // CELL + 1
    part = lambda column: F.pmod(F.xxhash64(column), F.lit(parts))
    pairs = candidates.select((part("a") * parts + part("b")).alias("cell"), "a", "b")
    wanted = texts.select("id", "content").join(small_or_shuffled(ends), "id", "left_semi").dropDuplicates(["id"])
    places = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("id").agg(F.collect_list("cell").alias("cells"))
    placed = wanted.join(places, "id").select(F.explode("cells").alias("cell"), F.lit(0).alias("turn"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "content")
    rows = placed.union(pairs.select("cell", F.lit(1), "a", "b", F.lit(None).cast("string")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known = None, {}
        for batch in batches:
            cells, turns, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            edge = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (turns[1:] != turns[:-1])]))
            out: list[tuple[int, int, float]] = []
            for at, end in zip(edge, np.append(edge[1:], len(cells)), strict=True):
                if cells[at] != cell:
                    cell, known = cells[at], {}
                if turns[at] == 0:
                    for i, some in chunks(batch.column(4).slice(at, end - at).to_pylist()):
                        known.update(zip(a[at + i : at + i + len(some)].tolist(), run_sets(some), strict=True))
                else:
                    out += [(x, y, similarity(known[x], known[y])) for x, y in zip(a[at:end].tolist(), b[at:end].tolist(), strict=True)]
            good = [x for x in out if x[2] >= least]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in good], pa.int64()), "b": pa.array([x[1] for x in good], pa.int64()), "similarity": pa.array([x[2] for x in good], pa.float64())})

    return rows.repartition("cell").sortWithinPartitions("cell", "turn").mapInArrow(check, "a long, b long, similarity double")


class PairCounts:
    """Pairs of ids and how often they were added, summed in memory and given out in parts of bounded size."""

    def __init__(self, limit: int = 1_500_000) -> None:
        self.limit, self.held = limit, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.held += len(a)

    def full(self) -> bool:
        return self.held >= self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(a, b, count) of what was added."""
        if not self.held:
            return None
        a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        key = place[: len(a)].astype(np.uint64) * np.uint64(len(ids)) + place[len(a) :].astype(np.uint64)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return a[first], b[first], count


#: Of a pair (a, b): how many pieces they share in one slice, cnt; tag is used by marked rows only.
PAIR_SCHEMA = "a long, b long, cnt int, tag int"


def pair_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray], tags: np.ndarray | None = None) -> pa.RecordBatch:
    a, b, count = found
    tags = np.zeros(len(a), np.int32) if tags is None else tags.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(count.astype(np.int32)), pa.array(tags)], names=["a", "b", "cnt", "tag"])
