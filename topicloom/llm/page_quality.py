"""Template residue (problem 2), text that isn't prose (problem 3) and the main body of pages (problem 5).

One Arrow pass reads every content's lines (see page_lines). What a single page can't tell is counted
over all of them: the lines that a site repeats (problem 1), and masked messages that recur across
sources. Both are narrow tables that are counted with map-side combination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_statistics
from .cluster import BROADCAST_ROWS, shared_checkpoint, small_or_shuffled, spread
from .codepoints import chunks
from .page_lines import HINT, PROOF, read_pages
from .repeated_lines import document_lines, frequent_lines, least_support, line_identifiers

#: A masked message recurs when it stands in so many records of so many sources.
LEAST_RECORDS, LEAST_SOURCES = 3, 2
#: Characters of contents whose pages are read together.
READ = 300_000

PAGES = "record_id long, site_name string, kind string, body int, slots int, surroundings array<int>, messages array<struct<line: bigint, size: int, weight: int>>, whole bigint"


def pages(records: DataFrame) -> DataFrame:
    """(record_id, site_name, content) to PAGES: kind of text, sizes of body and of messages, line numbers that aren't body.

    Null and empty contents have no row.
    """
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), F.coalesce("site_name", F.lit("")).alias("site_name"), "content").where("content <> ''")
    rows = spread(rows)
    known = site_lines(rows)
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:  # a list per site goes to all executors
        joined = rows.join(F.broadcast(known.groupBy("site_name").agg(F.collect_list("line").alias("repeated"))), "site_name", "left")
    else:  # each record gets its own lines, so that no site's records come together
        own = document_lines(rows).select("record_id", "site_name", F.explode(F.array_distinct("lines")).alias("line")).join(known, ["site_name", "line"], "left_semi")
        joined = rows.join(own.groupBy("record_id").agg(F.collect_list("line").alias("repeated")), "record_id", "left")
    joined = joined.select("record_id", "site_name", "content", "repeated")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.int32()
        message = pa.struct([("line", pa.int64()), ("size", ints), ("weight", ints)])
        schema = pa.schema([("record_id", pa.int64()), ("site_name", pa.string()), ("kind", pa.string()), ("body", ints), ("slots", ints), ("surroundings", pa.list_(ints)), ("messages", pa.list_(message)), ("whole", pa.int64())])
        sets: dict[str, frozenset[int]] = {}
        for batch in batches:
            ids, sites, contents = (batch.column(k).to_pylist() for k in range(3))
            if small:
                for k in np.unique(np.array(sites), return_index=True)[1].tolist():
                    if sites[k] not in sets:
                        sets[sites[k]] = frozenset(batch.column(3)[k].as_py() or ())
                lines = [sets[site] for site in sites]
            else:
                lines = [frozenset(x or ()) for x in batch.column(3).to_pylist()]
            for at, part in chunks(contents, READ):
                owner, number, h = line_identifiers(part)
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                numbers = [dict(zip(number[a:b].tolist(), h[a:b].tolist(), strict=True)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                read = read_pages(part, lines[at : at + len(part)], numbers)
                out = [
                    (ids[at + k], sites[at + k], p.kind, p.body_size, p.slots, p.surroundings(), [dict(zip(("line", "size", "weight"), m, strict=True)) for m in p.messages], p.whole)
                    for k, p in enumerate(read)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(read, PAGES)


def site_lines(rows: DataFrame) -> DataFrame:
    """(record_id, site_name, content) to (site_name, line): the lines that each site repeats; a checkpoint.

    Equal contents of a site count once, so that a much delivered article doesn't turn into a notice.
    """
    first = rows.where("site_name <> ''").groupBy("site_name", F.xxhash64("content").alias("text")).agg(F.min("record_id").alias("record_id"))
    first = shared_checkpoint(first.select("record_id", "site_name"))
    counted = document_lines(rows).join(small_or_shuffled(first.select("record_id")), "record_id", "left_semi")
    return frequent_lines(counted, shared_checkpoint(least_support(first))).select("site_name", "line")


def _recurring(rows: DataFrame) -> DataFrame:
    """(line, site_name) to the lines that stand in enough records of enough sources; a checkpoint. Counts are combined per source first."""
    counted = rows.groupBy("line", "site_name").agg(F.count("*").alias("n")).groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("sources"))
    return shared_checkpoint(counted.where((F.col("n") >= LEAST_RECORDS) & (F.col("sources") >= LEAST_SOURCES)).select("line"))


def not_articles(read: DataFrame) -> DataFrame:
    """Of pages() (a checkpoint) the record_id of those that are templates, filler or messages.

    Masked lines are grouped by their exact hash across sources; phrases weigh a group: proof counts by itself, a hint
    where the group recurs across sources. A page is one if a slot of it is unfilled, if messages make up half of its
    body, or if its whole masked body, of the shape of a message, recurs across sources, whatever its words.
    """
    lines = read.where(F.size("messages") > 0).select("record_id", "site_name", F.explode("messages").alias("m")).select("record_id", "site_name", "m.line", "m.size", "m.weight")
    recurring = _recurring(lines.where(F.col("weight") == HINT)).withColumn("recurs", F.lit(True))
    told = lines.join(small_or_shuffled(recurring), "line", "left").where((F.col("weight") == PROOF) | F.col("recurs")).groupBy("record_id").agg(F.sum("size").alias("told"))
    wholes = read.where("whole is not null").select("record_id", "site_name", F.col("whole").alias("line"))
    same = wholes.join(small_or_shuffled(_recurring(wholes)), "line", "left_semi").select("record_id")
    half = read.join(told, "record_id", "left").where((F.col("slots") > 0) | ((F.col("body") > 0) & (F.coalesce("told", F.lit(0)) * 2 >= F.col("body")))).select("record_id")
    return half.union(same).distinct()


def template_residue(records: DataFrame) -> DataFrame:
    """The record_id of records that hold templates, filler text, error messages or demands for scripts instead of an article.

    Null, empty and blank contents have no row; quality_issue isn't looked at; an empty table gives no rows.
    """
    return not_articles(shared_checkpoint(pages(records).drop("kind", "surroundings")))


def not_prose(records: DataFrame) -> DataFrame:
    """(record_id, kind) of records that are for the most part list, table or junk, template residue left out."""
    read = shared_checkpoint(pages(records).drop("surroundings"))
    odd = read.where("kind is not null").select("record_id", "kind")
    return odd.join(small_or_shuffled(shared_checkpoint(not_articles(read))), "record_id", "left_anti")


def not_body(records: DataFrame) -> DataFrame:
    """(record_id, line_no) of the lines that don't belong to the main body; template residue and texts that aren't prose left out. Blank lines have no row."""
    read = shared_checkpoint(pages(records))
    left = read.where("kind is null").select("record_id", F.explode("surroundings").alias("line_no"))
    return left.join(small_or_shuffled(shared_checkpoint(not_articles(read))), "record_id", "left_anti")


def statistics(records: DataFrame) -> DataFrame:
    """One row of text statistics per record; null and empty contents have zeros and null shares."""
    return text_statistics.statistics(records)
