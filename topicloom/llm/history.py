"""Deduplicating new batches against all history (problem 6).

Each batch's texts are indexed once, as an immutable sorted array over their concatenated signatures (see signatures):
a sparse suffix array, whose suffixes begin at every PIECE-th fragment and are ordered by their first PIECE fragments,
as longer common prefixes are never asked for. A new batch's pieces are binary-searched in the segments of older
batches; matches are summed into the coverage of each pair of records, and pairs covered by LEAST pieces are checked
exactly. Segments are merged whenever a newer one has grown to half of the one before, so a search visits
logarithmically many. History is read as text again only for the candidates that are checked.

Signatures stand for the letters themselves, as the arrays over letters don't give the required result: a pair of
similarity 0.6 may have no common run longer than 20 letters, and runs of that length stand in thousands of texts.

`delivered_before` holds all batches of one table against the smaller ones in one pass; `History` keeps segments in a
folder, so that each new batch is indexed and searched without those before being indexed or read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from .cluster import shared_checkpoint, small_or_shuffled
from .near_duplicates import BLOCK, enough, large_batch
from .passages import PAIR_SCHEMA, PairCounts, content_keys, pair_batch, similar_pairs
from .signatures import SLICES_EACH, by_slice, pack, packed_pieces, slices_for, unpack, whole_slices

#: Folders that the texts of a batch are dealt to by their ids.
TEXT_PARTS = 64


class Segments:
    """Sorted (keys, ids, tags) arrays of the batches so far, merged logarithmically."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        """Add one batch's array, sorted by key."""
        self.parts.append((keys, ids, tags))
        while len(self.parts) > 1 and len(self.parts[-1][0]) * 2 > len(self.parts[-2][0]):
            self.parts[-2:] = [merged(self.parts[-2:])]

    def search(self, keys: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each segment: its place, and for each of the keys where its matches begin and end."""
        return [(k, np.searchsorted(part[0], keys, "left"), np.searchsorted(part[0], keys, "right")) for k, part in enumerate(self.parts)]

    def matches(self, keys: np.ndarray, ids: np.ndarray, counts: PairCounts) -> np.ndarray:
        """Add to counts the pairs (older id, id) of all keys but those that match more than BLOCK older texts; which keys those are."""
        spans = self.search(keys)
        total = np.sum([end - begin for _, begin, end in spans], axis=0) if spans else np.zeros(len(keys), dtype=np.int64)
        large = total > BLOCK
        for k, begin, end in spans:
            at = np.flatnonzero((end > begin) & ~large)
            size = (end - begin)[at]
            own = np.repeat(at, size)
            other = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[at], size)
            counts.add(self.parts[k][1][other], ids[own])
        return large


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, ids, tags = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order], tags[order]


def search_slices(packed: DataFrame, slices: int) -> DataFrame:
    """Packed pieces, tagged with their batch, to partial counts (PAIR_SCHEMA): a the older record, b the newer one."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts()
        for keys, ids, tags in whole_slices(batches):
            segments = Segments()
            for tag in np.unique(tags):
                part = tags == tag
                own = merged([(keys[part], ids[part], tags[part])])
                for k in range(0, len(own[0]), 200_000):
                    segments.matches(own[0][k : k + 200_000], own[1][k : k + 200_000], counts)
                    if counts.full():
                        yield pair_batch(counts.take())
                segments.add(*own)
            keys, ids, tags = merged(segments.parts)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(first, len(keys)))
            if (size > BLOCK).any():
                rows = np.repeat(size > BLOCK, size)
                yield large_batch(keys[rows], ids[rows], tags[rows])
        if (last := counts.take()) is not None:
            yield pair_batch(last)

    return by_slice(packed, slices, search, PAIR_SCHEMA)


def confirmed(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, cnt) and the texts (id, content) to the b that are similar to some a of theirs: (id); a checkpoint.

    Each b is held against its best-matching a first; only those that aren't similar to it are held against all others.
    """
    best = shared_checkpoint(candidates.groupBy("b").agg(F.max_by("a", F.struct("cnt", "a")).alias("a")))
    sure = shared_checkpoint(similar_pairs(best, texts).select("b").distinct())
    rest = shared_checkpoint(candidates.select("a", "b").join(sure, "b", "left_anti").join(best, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        sure = shared_checkpoint(sure.union(similar_pairs(rest, texts).select("b")).distinct())
    return sure.select(F.col("b").alias("id"))


def pages_of(records: DataFrame) -> DataFrame:
    return records.where("trim(url) <> ''").select("record_id", "batch_no", canonical_url("url").alias("page"))


def delivered_before(records: DataFrame) -> DataFrame:
    """(record_id, batch_no, url, content) to the record_id of every record that some smaller batch holds already.

    Held already: the same canonical url, or similar content. Null and empty urls are no url; null, empty and
    short contents have no similar ones; rows without batch_no or record_id are left out; other columns are
    ignored; an empty table gives no rows.
    """
    own = records.select("record_id", "batch_no", "url", "content").where("record_id is not null and batch_no is not null")
    pages = pages_of(own)
    first = pages.groupBy("page").agg(F.min("batch_no").alias("least"), F.max("batch_no").alias("most")).where("most > least")
    by_url = pages.join(first, "page").where("batch_no > least").select("record_id")

    texts = own.select(F.col("record_id").alias("id"), F.col("batch_no").alias("tag"), "content").where("content is not null")
    keyed = shared_checkpoint(content_keys(texts).join(own.select(F.col("record_id").alias("id"), "batch_no"), "id"))
    reps = keyed.groupBy("k1", "k2").agg(F.min(F.struct("batch_no", "id")).alias("first"), F.count("*").alias("size")).where("size > 1")
    members = shared_checkpoint(keyed.join(reps, ["k1", "k2"]).select("id", "batch_no", F.col("first.id").alias("rep"), F.col("first.batch_no").alias("least")))
    copies = shared_checkpoint(members.where("id <> rep").select("id").distinct())
    different = texts.join(small_or_shuffled(copies), "id", "left_anti")
    slices = slices_for(keyed.count(), texts)
    similar = confirmed(enough(search_slices(packed_pieces(different, slices), slices), across=True), different).withColumnRenamed("id", "rep")
    by_copy = members.where("batch_no > least").select("id")
    by_class = members.join(similar, "rep", "left_semi").select("id")
    return by_url.union(by_copy).union(by_class).union(similar.select(F.col("rep").alias("record_id"))).distinct()


class History:
    """The batches accepted so far, kept in a folder that all executors share.

    segments/FIRST-LAST: rows (slice, block) of sorted arrays of the batches from FIRST to LAST; never changed, but
    replaced by the array of a longer range. texts/batch=N, pages/batch=N and keys/batch=N: contents dealt by id, canonical
    urls, keys of contents. accepted/N is written last: what lacks it doesn't count and is written again.
    """

    def __init__(self, spark: SparkSession, folder: str, slices: int | None = None) -> None:
        """slices: into how many the order of pieces is cut, fixed when the folder is new (default: for a million texts)."""
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._names("slices")
        if not known:
            known = [str(slices or slices_for(1_000_000, spark.range(0)))]
            self._files.mkdirs(self._path(f"slices/{known[0]}"))
        self.slices = int(known[0])

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self._names("accepted"))

    def segments(self) -> list[tuple[int, int]]:
        """The ranges of batches of the segments to search: of those that overlap, the longest."""
        accepted = self.batches()
        whole = [tuple(map(int, n.split("-"))) for n in self._names("segments") if self._files.exists(self._path(f"segments/{n}/_SUCCESS"))]
        whole = [r for r in whole if accepted and r[1] <= accepted[-1] and r[1] in accepted]
        return sorted(r for r in whole if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in whole))

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch={b}" for b in batches]
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths).select(*empty.columns) if paths else empty

    def _segment(self, first: int, last: int) -> DataFrame:
        return self.spark.read.schema("slice int, block binary").parquet(f"{self.folder}/segments/{first}-{last}")

    def add(self, batch: int, records: DataFrame) -> DataFrame:
        """Accept (record_id, url, content) as a batch larger than all before: the record_id of those that history holds already.

        The same rules as delivered_before; the result is a checkpoint. Texts of history are opened only in the
        batches and parts of the candidates.
        """
        older = self.batches()
        if older and batch <= older[-1]:
            raise ValueError(f"batch {batch} isn't larger than batch {older[-1]}")
        own = records.select("record_id", F.lit(batch).alias("batch_no"), "url", "content").where("record_id is not null")
        texts = own.select(F.col("record_id").alias("id"), F.col("batch_no").alias("tag"), "content").where("content is not null")
        part = F.pmod(F.xxhash64("id"), F.lit(TEXT_PARTS)).cast("int")
        out = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/batch={batch}")
        out(pages_of(own).select("record_id", "page"), "pages")
        out(content_keys(texts), "keys")
        out(texts.select("id", "content", part.alias("part")).repartition("part"), "texts", "part")
        mine = lambda kind, schema: self._read(kind, [batch], schema)
        pages, keys = "record_id long, page string", "id long, k1 long, k2 long"
        by_url = mine("pages", pages).join(self._read("pages", older, pages).select("page").distinct(), "page", "left_semi").select("record_id")
        known = self._read("keys", older, keys).select("k1", "k2").distinct().withColumn("known", F.lit(True))
        members = mine("keys", keys).distinct().join(known, ["k1", "k2"], "left")
        first = members.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
        members = shared_checkpoint(members.join(first, ["k1", "k2"]).select("id", "rep", "known"))
        same = members.where("known").select("id")
        # contents that history lacks, one of each: only those are indexed and searched
        fresh = shared_checkpoint(members.where("known is null and id = rep").select("id"))
        segments = self.segments()
        sort_slices(packed_pieces(texts.join(small_or_shuffled(fresh), "id", "left_semi").dropDuplicates(["id"]), self.slices), self.slices).write.mode("overwrite").parquet(f"{self.folder}/segments/{batch}-{batch}")
        candidates = enough(self._search(segments, batch), across=True)
        similar = confirmed(candidates, self._texts_of(candidates, older, batch))
        similar = members.join(small_or_shuffled(similar.select(F.col("id").alias("rep"))), "rep", "left_semi").select("id")
        found = shared_checkpoint(by_url.union(same).union(similar).distinct())
        self._files.mkdirs(self._path(f"accepted/{batch}"))
        self._merge()
        return found

    def _search(self, segments: list[tuple[int, int]], batch: int) -> DataFrame:
        """Partial counts of the batch's pieces against those of the segments; tags of marked rows: 0 older, 1 new."""
        rows = self._segment(batch, batch).withColumn("turn", F.lit(len(segments)))
        for turn, (first, last) in enumerate(segments):
            rows = rows.union(self._segment(first, last).withColumn("turn", F.lit(turn)))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, held, current = PairCounts(), {}, None

            def close() -> Iterator[pa.RecordBatch]:
                own = held.pop(len(segments), None)
                if own is None or not held:
                    return
                older = Segments()
                older.parts = list(held.values())
                large = older.matches(own[0], own[1], counts)
                if large.any():
                    yield large_batch(own[0][large], own[1][large], np.ones(large.sum(), np.int32))
                    for keys, ids, _ in older.parts:
                        hit = np.isin(keys, own[0][large])
                        yield large_batch(keys[hit], ids[hit], np.zeros(hit.sum(), np.int32))

            for rows in batches:
                for s, block, turn in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                    if s != current:
                        yield from close()
                        held, current = {}, s
                    keys, ids, tags = unpack(block)
                    held[turn] = keys | (np.uint64(s) << np.uint64(40)), ids, tags
                if counts.full():
                    yield pair_batch(counts.take())
            yield from close()
            if (last := counts.take()) is not None:
                yield pair_batch(last)

        return by_slice(rows, self.slices, search, PAIR_SCHEMA)

    def _texts_of(self, candidates: DataFrame, older: list[int], batch: int) -> DataFrame:
        """The texts of the batch, and of history those of the parts that hold candidates."""
        parts = F.pmod(F.xxhash64("a"), F.lit(TEXT_PARTS)).cast("int")
        wanted = [r[0] for r in candidates.select(parts.alias("part")).distinct().collect()]  # at most TEXT_PARTS numbers
        schema = "id long, content string, part int"
        return self._read("texts", older, schema).where(F.col("part").isin(wanted)).union(self._read("texts", [batch], schema)).select("id", "content")

    def _merge(self) -> None:
        """Merge the newest segments while the newer has half the size of the one before."""
        while len(now := self.segments()) > 1:
            (a, b), (c, d) = now[-2:]
            size = lambda r: self._files.getContentSummary(self._path(f"segments/{r[0]}-{r[1]}")).getLength()
            if size((c, d)) * 2 <= size((a, b)):
                return
            sort_slices(self._segment(a, b).union(self._segment(c, d)), self.slices).write.mode("overwrite").parquet(f"{self.folder}/segments/{a}-{d}")


def sort_slices(packed: DataFrame, slices: int) -> DataFrame:
    """Rows (slice, block) to one row per slice whose block is sorted by key."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, tags in whole_slices(batches):
            s = int(keys[0] >> np.uint64(40))
            keys, ids, tags = merged([(keys & np.uint64((1 << 40) - 1), ids, tags)])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(keys, ids, tags)], pa.binary())], names=["slice", "block"])

    return by_slice(packed, slices, sort, "slice int, block binary")
