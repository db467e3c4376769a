"""Lines repeated across one site's documents (problem 1).

A line is known by a hash of its letters (NFKC, lower case, category L). PrefixSpan grows frequent
sequences of line identifiers per source: the single lines first, then each frequent sequence by the
lines that follow its occurrences, a projection that only ever holds frequent lines. Support counts
distinct documents; each document's own repeats are removed before the shuffle, and counts are
combined on the map side, so a source with a third of all rows is no hot spot. Occurrences of all
frequent sequences, single lines included, are what a source repeats and what is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import shared_checkpoint, small_or_shuffled
from .codepoints import LETTERS, Rolling, chunks, code_points, reduced, signed

LEAST_LETTERS = 4
LEAST_ROWS = 5
LEAST_PERCENT = 5
#: Lines from one element of a sequence to the next, lines without enough letters left out.
STEP = 1


def line_identifiers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line with enough letters, over all texts: (which text, line number from 1, identifier)."""
    lines = [line for text in texts for line in text.split("\n")]
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    codes, starts = reduced(lines, LETTERS)
    long = np.flatnonzero(np.diff(starts) >= LEAST_LETTERS)
    h = Rolling(codes, 3).slices(starts[:-1][long], starts[1:][long])
    first = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.searchsorted(first, long, side="right") - 1
    return owner, long - first[owner] + 1, signed(h)


def document_lines(records: DataFrame) -> DataFrame:
    """(record_id, site_name, content) to (record_id, site_name, lines array<bigint>, numbers array<int>), in order of lines.

    Records without a site or without content are left out, as are lines with too few letters.
    """

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(2).to_pylist()):
                owner, number, h = line_identifiers(part)
                edge = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.ListArray.from_arrays(edge, pa.array(h)), pa.ListArray.from_arrays(edge, pa.array(number.astype(np.int32)))],
                    names=["record_id", "site_name", "lines", "numbers"],
                )

    rows = records.select(F.col("record_id").cast("long").alias("record_id"), "site_name", "content").where("site_name <> '' and content <> ''")
    return rows.mapInArrow(identify, "record_id long, site_name string, lines array<bigint>, numbers array<int>")


def least_support(records: DataFrame) -> DataFrame:
    """(site_name) to (site_name, least): the rows that a line must stand in, of all rows of its site."""
    rows = records.where("site_name <> ''").groupBy("site_name").agg(F.count("*").alias("rows"))
    return rows.select("site_name", F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("rows") * LEAST_PERCENT / 100)).cast("long").alias("least"))


def frequent_lines(lines: DataFrame, support: DataFrame) -> DataFrame:
    """(site_name, line, rows): the frequent sequences of length one; a checkpoint of at most 100 / LEAST_PERCENT lines per line of an average document."""
    counted = lines.select("site_name", F.explode(F.array_distinct("lines")).alias("line")).groupBy("site_name", "line").agg(F.count("*").alias("rows"))
    return shared_checkpoint(counted.where(F.col("rows") >= LEAST_ROWS).join(small_or_shuffled(support), "site_name").where("rows >= least").select("site_name", "line", "rows"))


def frequent_sequences(records: DataFrame, step: int = STEP) -> DataFrame:
    """(site_name, sequence array<bigint>, rows): every frequent sequence of lines that follow each other within `step`, by PrefixSpan.

    With a step of 1 the lines of a sequence stand together; a larger one lets other lines stand between them.
    """
    support = shared_checkpoint(least_support(records))
    lines = document_lines(records)
    single = frequent_lines(lines, support)
    found = single.select("site_name", F.array("line").alias("sequence"), "rows")
    known = single.select("site_name", "line")
    # the first projection: of each document only its frequent lines, with their rank among its lines
    places = lines.select("record_id", "site_name", F.posexplode("lines").alias("at", "line")).join(small_or_shuffled(known), ["site_name", "line"], "left_semi")
    document = places.groupBy("record_id", "site_name").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    document = shared_checkpoint(document.where(F.size("lines") > 1))
    # open: the occurrences (end place) of each frequent sequence within each document
    grown = document.select("record_id", "site_name", "lines", F.transform("lines", lambda x: F.struct(x["at"].alias("at"), F.array(x["line"]).alias("sequence"))).alias("open"))
    while True:
        longer_by_one = F.flatten(F.transform("open", lambda o: F.transform(F.filter("lines", lambda x: (x["at"] > o["at"]) & (x["at"] <= o["at"] + step)), lambda x: F.struct(x["at"].alias("at"), F.concat(o["sequence"], F.array(x["line"])).alias("sequence")))))
        grown = grown.select("record_id", "site_name", "lines", longer_by_one.alias("open")).where(F.size("open") > 0)
        counted = grown.select("site_name", F.explode(F.array_distinct(F.transform("open", lambda o: o["sequence"]))).alias("sequence")).groupBy("site_name", "sequence").agg(F.count("*").alias("rows"))
        longer = shared_checkpoint(counted.join(support, "site_name").where("rows >= least").select("site_name", "sequence", "rows"))
        if longer.isEmpty():
            return found
        found = found.unionByName(longer)
        kept = grown.select("record_id", "site_name", "lines", F.explode("open").alias("o")).select("record_id", "site_name", "lines", "o.at", "o.sequence")
        kept = kept.join(small_or_shuffled(longer.select("site_name", "sequence"), 100_000), ["site_name", "sequence"], "left_semi")
        grown = shared_checkpoint(kept.groupBy("record_id", "site_name").agg(F.first("lines").alias("lines"), F.collect_list(F.struct("at", "sequence")).alias("open")))


def repeated_lines(records: DataFrame, step: int = STEP) -> DataFrame:
    """(record_id, site_name, content) to (record_id, line_no) of every line of an occurrence of a sequence that its site repeats.

    Lines are numbered from 1, blank ones included. Records with null or empty site or content, and lines
    of fewer than four letters, have no row; an empty table gives none. As every part of a frequent sequence is
    itself frequent, an occurrence of each of its lines is one of a frequent sequence of length one.
    """
    found = frequent_sequences(records, step)
    known = shared_checkpoint(found.select("site_name", F.explode("sequence").alias("line")).distinct())
    rows = document_lines(records).select("record_id", "site_name", F.explode(F.arrays_zip("lines", "numbers")).alias("x")).select("record_id", "site_name", F.col("x.lines").alias("line"), F.col("x.numbers").alias("line_no"))
    return rows.join(small_or_shuffled(known), ["site_name", "line"], "left_semi").select("record_id", "line_no")


def without_lines(records: DataFrame, lines: DataFrame) -> DataFrame:
    """records (record_id, content, ...) with the lines (record_id, line_no) taken out of content; all other columns stay. Null content stays null."""
    gone = lines.groupBy("record_id").agg(F.collect_set("line_no").alias("__gone_lines"))
    kept = F.array_join(F.filter(F.transform(F.split("content", "\n", -1), lambda x, i: F.when(~F.array_contains("__gone_lines", i + 1), x)), lambda x: x.isNotNull()), "\n")
    joined = records.join(gone, "record_id", "left")
    return joined.withColumn("content", F.when(F.col("__gone_lines").isNull(), F.col("content")).otherwise(kept)).drop("__gone_lines").select(*records.columns)
