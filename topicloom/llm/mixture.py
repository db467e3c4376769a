"""Mixing sources to target weights in tokens (problem 9).

Efraimidis-Spirakis sampling: each document draws an exponential key divided by its quality weight; a
source's documents are taken in order of their keys up to its token budget. Whole epochs come first, so
every document of a source is used n times before any is used n + 1 times. The prefix sums are two-level
- sums of key ranges, then rows within the one range in which a budget ends - so no source, however
large, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import shared_checkpoint, small_or_shuffled
from .codepoints import chunks, code_points
from .tokens import LETTER, NUMBER, SPACE, VOCABULARY, class_table, encoder

#: Ranges into which each source's keys are cut.
RANGES = 4096
LEAST_QUALITY = 0.05


def quality(texts: list[str]) -> np.ndarray:
    """A weight in (0, 1] per text: the squared share of letters and numbers among its visible characters."""
    codes, starts = code_points(texts)
    kinds = class_table()[codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    seen = np.bincount(owner[kinds != SPACE], minlength=len(texts))
    good = np.bincount(owner[(kinds == LETTER) | (kinds == NUMBER)], minlength=len(texts))
    return np.maximum(LEAST_QUALITY, (good / np.maximum(seen, 1)) ** 2)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """(doc_id, text, source) to (doc_id, source, n_tokens, key, place): place is the range of the key, smallest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(vocabulary)
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                _, bounds = by.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(np.diff(bounds)), pa.array(quality(part))], names=["doc_id", "source", "n_tokens", "quality"])

    rows = documents.where("doc_id is not null and source is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    counted = rows.mapInArrow(count, "doc_id long, source string, n_tokens long, quality double").where("n_tokens > 0")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))
    keyed = counted.withColumn("key", -F.log(uniform) / F.col("quality"))
    return keyed.select("doc_id", "source", "n_tokens", "key", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int").alias("place"))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target source: shares, tokens there are, budget, whole epochs and what is left for a part of one.

    Without a total, the largest one at which every source with documents reaches its share within its
    repeats. With one, sources too small for their share give all they may.
    """
    wanted = targets.where("source is not null and weight > 0").groupBy("source").agg(F.max("weight").cast("double").alias("weight"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    there = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    rows = wanted.join(there, "source", "left").na.fill(0, ["n_docs", "tokens"])
    every = Window.partitionBy()  # one row per target source, a fixed list
    usable = (F.col("tokens") > 0) & (F.col("max_repeats") > 0)
    rows = rows.withColumn("target_share", F.col("weight") / F.sum("weight").over(every))
    rows = rows.withColumn("reachable_share", F.when(usable, F.col("weight") / F.sum(F.when(usable, F.col("weight"))).over(every)).otherwise(0.0))
    most = F.min(F.when(usable, F.col("tokens") * F.col("max_repeats") / F.col("reachable_share"))).over(every)
    rows = rows.withColumn("total", F.lit(float(total)) if total is not None else F.coalesce(most, F.lit(0.0)))
    rows = rows.withColumn("budget", F.least(F.floor(F.col("reachable_share") * F.col("total") + 1e-6), F.col("tokens") * F.col("max_repeats")).cast("long"))
    return rows.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0).cast("long")).drop("total")


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents to take, budgets): (doc_id, source, n_tokens, copies) with copies of 1 to max_repeats.

    Documents without text, tokens or source, and sources that aren't targets, are left out; repeated rows count
    as documents of their own; empty tables give no rows. A document too long for what is left of a budget is
    passed over, and what the budget has left goes to those after it that fit, until none does.
    """
    sizes = shared_checkpoint(sized(documents, vocabulary))
    plan = shared_checkpoint(budgets(sizes, targets, total))
    state, cuts = plan.where("rest > 0").select("source", "rest", F.lit(-1.0).alias("cut")), []
    while not cuts or not state.isEmpty():
        found = shared_checkpoint(_next_cut(sizes, state))
        cuts.append(found.select("source", F.struct("fit", "start", "stop").alias("cut")))
        state = found.where("rest > 0 and stop < double('infinity')").select("source", "rest", F.col("stop").alias("cut"))
    parts = reduce(DataFrame.union, cuts).groupBy("source").agg(F.collect_list("cut").alias("cuts"))
    chosen = plan.where("budget > 0").select("source", "epochs").join(parts, "source", "left")
    taken = sizes.join(small_or_shuffled(shared_checkpoint(chosen)), "source")
    extra = F.exists("cuts", lambda c: (F.col("n_tokens") <= c["fit"]) & (F.col("key") > c["start"]) & (F.col("key") < c["stop"]))
    return taken.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("int")).alias("copies")).where("copies > 0"), plan


def _next_cut(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """(source, rest, cut) to (source, fit, start, stop, rest): of the documents of at most `fit` tokens with keys after start, those before stop fit; rest: what they leave."""
    open_ = sizes.join(small_or_shuffled(state), "source").where("n_tokens <= rest and key > cut")
    ranges = open_.groupBy("source", "place").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("place")) - F.col("n"))
    crossed = running.where("before <= rest and rest < before + n").select("source", "place", "before")
    edge = open_.join(crossed, ["source", "place"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id")))
    stops = edge.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("key"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("upto"), F.min("before").alias("before"))
    every = ranges.groupBy("source").agg(F.sum("n").alias("all"))
    rows = state.join(stops, "source", "left").join(every, "source", "left")
    used = F.when(F.col("stop").isNotNull(), F.coalesce("upto", "before")).otherwise(F.coalesce("all", F.lit(0)))
    return rows.select("source", F.col("rest").alias("fit"), F.col("cut").alias("start"), F.coalesce("stop", F.lit(float("inf"))).alias("stop"), (F.col("rest") - used).alias("rest"))


def report(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None) -> DataFrame:
    """One row per target source with its target share, the share reachable by the sources that have documents, and the actual one."""
    chosen, plan = mixed(documents, targets, vocabulary, total)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("mixed_docs"), F.max("copies").alias("most_copies"))
    rows = plan.join(got, "source", "left").na.fill(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy())
    return rows.select(
        "source", "weight", "max_repeats", "n_docs", "tokens", "target_share", "reachable_share", "budget", "mixed_docs", "mixed_tokens", "most_copies", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0).alias("actual_share")
    )
