"""Near-duplicate records with small edits (problem 7).

Vertical partitioning: the global order of n-grams is cut into fragments (see signatures); slices of the pieces' order
each count the partial overlaps of every pair of texts that meet in them; the partial counts are summed per pair, and
pairs with enough of them are checked exactly on the sets of all their runs of five characters.

Exact copies are one class with one representative, so that copies add no pieces. A piece that many texts share - near
copies by the thousand - is expanded in blocks of bounded size over as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import shared_checkpoint, small_or_shuffled
from .passages import PAIR_SCHEMA, PairCounts, content_keys, pair_batch, similar_pairs
from .signatures import LEAST, by_slice, packed_pieces, slices_for, whole_slices

#: Texts of one piece that are expanded to pairs where they are; the rows of larger groups go on to count_blocks.
BLOCK = 64
#: The count that marks a row (key, id, tag) of such a group among partial counts.
LARGE = -1
#: Copies of one content between which pairs are made in one task.
COPIES = 1000


def classes(texts: DataFrame) -> DataFrame:
    """(id, content) to (id, rep): rep is the least id with the same reduced content. Contents too short have no row."""
    keys = shared_checkpoint(content_keys(texts).distinct())
    reps = keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    return shared_checkpoint(keys.join(reps.where("size > 1"), ["k1", "k2"], "left").select("id", F.coalesce("rep", "id").alias("rep")))


def expand(counts: PairCounts, ids: np.ndarray, tags: np.ndarray, first: np.ndarray, size: np.ndarray, side: np.ndarray | None = None, across: bool = False) -> None:
    """Add the pairs within groups of rows that begin at `first` and have `size` rows.

    With sides, only pairs of different sides or of side -1; with across, only pairs of different tags, that of the
    smaller tag first, else the smaller id first.
    """
    for k in np.unique(size[size > 1]):
        rows = first[size == k][:, None] + np.arange(k)
        left, right = np.triu_indices(k, 1)
        i, j = rows[:, left].ravel(), rows[:, right].ravel()
        good = ids[i] != ids[j]
        if side is not None:
            good &= (side[i] != side[j]) | (side[i] < 0)
        if across:
            good &= tags[i] != tags[j]
        i, j = i[good], j[good]
        swap = tags[i] > tags[j] if across else ids[i] > ids[j]
        counts.add(np.where(swap, ids[j], ids[i]), np.where(swap, ids[i], ids[j]))


def large_batch(keys: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    return pair_batch((keys.view(np.int64), ids, np.full(len(ids), LARGE)), tags)


def count_slices(packed: DataFrame, slices: int, block: int = BLOCK) -> DataFrame:
    """Packed pieces to each slice's partial counts (PAIR_SCHEMA), and rows marked LARGE of the groups too large to expand here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts()
        for keys, ids, tags in whole_slices(batches):
            order = np.argsort(keys)
            keys, ids, tags = keys[order], ids[order], tags[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(first, len(keys)))
            small = (size > 1) & (size <= block)
            for k in range(0, len(first), 200_000):
                part = slice(k, k + 200_000)
                expand(counts, ids, tags, first[part][small[part]], size[part][small[part]])
                if counts.full():
                    yield pair_batch(counts.take())
            if (size > block).any():
                rows = np.repeat(size > block, size)
                yield large_batch(keys[rows], ids[rows], tags[rows])
        if (last := counts.take()) is not None:
            yield pair_batch(last)

    return by_slice(packed, slices, count, PAIR_SCHEMA)


def count_blocks(pieces: DataFrame, block: int = BLOCK, across: bool = False) -> DataFrame:
    """Rows (h, id, tag) to partial counts (PAIR_SCHEMA): a key of many texts is split into blocks, and each two blocks meet in a group of their own."""
    sizes = pieces.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    rows = pieces.select("h", "id", "tag").join(sizes, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "tag")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts()
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            h, x, y, own, ids, tags = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            size = np.diff(np.append(first, len(h)))
            side = np.where(x == y, -1, own)
            for i in range(0, len(first) - 1, 500):
                part = slice(i, min(i + 500, len(first) - 1))
                expand(counts, ids, tags, first[part], size[part], side, across)
                if counts.full():
                    yield pair_batch(counts.take())
            held = [c[first[-1] :] for c in (h, x, y, own, ids, tags)]
        if held is not None:
            expand(counts, held[4], held[5], np.array([0]), np.array([len(held[0])]), np.where(held[1] == held[2], -1, held[3]), across)
        if (last := counts.take()) is not None:
            yield pair_batch(last)

    return rows.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(count, PAIR_SCHEMA)


def enough(counted: DataFrame, across: bool = False) -> DataFrame:
    """Partial counts, of which LARGE rows are expanded first, summed per pair; the pairs (a, b, cnt) with LEAST of them; a checkpoint."""
    counted = shared_checkpoint(counted)
    pairs = counted.where(F.col("cnt") != LARGE).select("a", "b", "cnt")
    large = counted.where(F.col("cnt") == LARGE).select(F.col("a").alias("h"), F.col("b").alias("id"), "tag")
    if not large.isEmpty():
        pairs = pairs.union(count_blocks(large, across=across).select("a", "b", "cnt"))
    return shared_checkpoint(pairs.groupBy("a", "b").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= LEAST))


def near_duplicate_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, content) to (members, links): members (id, rep), of exact copies; links (a, b, similarity), a < b, between representatives."""
    members = classes(texts)
    copies = shared_checkpoint(members.where("id <> rep").select("id"))
    different = texts.select("id", "content").where("id is not null and content is not null").join(small_or_shuffled(copies), "id", "left_anti")
    slices = slices_for(members.count(), texts)
    candidates = enough(count_slices(packed_pieces(different.withColumn("tag", F.lit(0)), slices), slices))
    return members, similar_pairs(candidates, different)


def near_duplicate_pairs(texts: DataFrame) -> DataFrame:
    """All pairs (record_id_a, record_id_b), a < b, of similar contents.

    Null, empty and short contents (fewer than 240 letters and digits) have no pair; repeated rows of one
    id count once; other columns are ignored; an empty table gives no rows. Copies are expanded to all their
    pairs, as the result asks for; near_duplicate_groups is the form that doesn't grow with the square of a class.
    """
    members, links = near_duplicate_classes(texts)
    links = shared_checkpoint(links)
    x = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"), F.count("*").alias("size")).where("size > 1").select("rep", "parts")
    copied = members.join(sizes, "rep")
    right = copied.select("rep", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    left = copied.select("rep", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = left.join(right, ["rep", "part"]).where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))


def near_duplicate_groups(texts: DataFrame) -> DataFrame:
    """One row per content that takes part: (record_id, class_id, n_links), class_id the least id of its exact copies, n_links its links to other classes."""
    members, links = near_duplicate_classes(texts)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias("record_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
