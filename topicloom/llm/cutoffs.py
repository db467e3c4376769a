"""Score cutoffs that keep a target fraction of each source (problem 4), by distributed quickselect.

Scores are first summed to (source, score) counts within each partition, so a source with a third of
all rows is a few rows per partition. Then every round, for all sources at once: each partition's
weighted median of the scores still in question, the weighted median of those as the source's pivot, the
counts above and at the pivot, and the side that can't hold the target rank is discarded. All state is
one row per source in a table; nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import shared_checkpoint

_INT_MAX, _INT_MIN = 2**31 - 1, -(2**31)


def whole_number(text: Column) -> Column:
    """The int in a text, with outer blanks and a sign allowed; 0 for anything else. Numbers beyond int count as its ends."""
    trimmed = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    digits = F.regexp_extract(trimmed, "^[+-]?0*([0-9]+)$", 1)
    value = F.when(F.length(digits) > 11, F.lit(10**11)).otherwise(digits.try_cast("long"))
    signed = F.when(trimmed.startswith("-"), -value).otherwise(value)
    within = F.when(signed > _INT_MAX, F.lit(_INT_MAX)).when(signed < _INT_MIN, F.lit(_INT_MIN)).otherwise(signed)
    return F.coalesce(F.when(digits != "", within), F.lit(0)).cast("int")


def cutoffs(scored: DataFrame, targets: DataFrame) -> DataFrame:
    """scored (source, score int), targets (source, percent) to (source, cutoff, n_kept, n_total).

    The cutoff is the largest score of the source whose rows scoring at least it make up at least
    percent of the source's rows; ties at the cutoff are all kept. Sources without rows or without target,
    null sources and null targets have no row; a null score counts as 0; of several targets of one
    source the largest holds; percents are taken between 0 and 100, and 0 keeps the rows of the
    largest score.
    """
    wanted = targets.where("source is not null and percent is not null").groupBy("source").agg(F.max("percent").alias("percent"))
    rows = scored.where("source is not null").select("source", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.spark_partition_id().alias("part"))
    counts = shared_checkpoint(rows.join(F.broadcast(wanted) if _few(wanted) else wanted, "source", "left_semi").groupBy("source", "part", "score").agg(F.count("*").alias("n")))
    state = counts.groupBy("source").agg(F.sum("n").alias("n_total"), F.min("score").alias("low"), F.max("score").alias("high"))
    rank = F.ceil(F.col("n_total") * F.least(F.greatest("percent", F.lit(0)), F.lit(100)) / F.lit(100).cast(T.DecimalType(10, 0)))
    state = state.join(wanted, "source").select("source", "n_total", F.greatest(rank, F.lit(1)).cast("long").alias("rank"), "low", "high")
    # low..high holds the cutoff still looked for; above: rows scoring more than high
    state = shared_checkpoint(state.withColumns({"above": F.lit(0).cast("long"), "cutoff": F.lit(None).cast("long"), "n_kept": F.lit(None).cast("long")}))
    while not (open_ := state.where("cutoff is null")).isEmpty():
        live = counts.join(open_.select("source", "low", "high"), "source").where("score between low and high")
        medians = live.groupBy("source", "part").agg(F.expr("floor(percentile(score, 0.5, n))").alias("median"), F.sum("n").alias("weight"))
        pivots = medians.groupBy("source").agg(F.expr("floor(percentile(median, 0.5, weight))").alias("pivot"))
        at = live.join(pivots, "source").groupBy("source").agg(
            F.first("pivot").alias("pivot"),
            F.sum(F.when(F.col("score") > F.col("pivot"), F.col("n")).otherwise(0)).alias("more"),
            F.sum(F.when(F.col("score") == F.col("pivot"), F.col("n")).otherwise(0)).alias("same"),
            F.max(F.when(F.col("score") < F.col("pivot"), F.col("score"))).alias("next_below"),
        )
        up = F.col("above") + F.col("more") >= F.col("rank")
        here = ~up & (F.col("same") > 0) & (F.col("above") + F.col("more") + F.col("same") >= F.col("rank"))
        state = shared_checkpoint(
            state.join(at, "source", "left").select(
                "source",
                "n_total",
                "rank",
                F.when(up, F.col("pivot") + 1).otherwise(F.col("low")).alias("low"),
                F.when(up | F.col("pivot").isNull(), F.col("high")).otherwise(F.coalesce("next_below", "low")).alias("high"),
                F.when(up | F.col("pivot").isNull(), F.col("above")).otherwise(F.col("above") + F.col("more") + F.col("same")).alias("above"),
                F.when(here, F.col("pivot")).otherwise(F.col("cutoff")).alias("cutoff"),
                F.when(here, F.col("above") + F.col("more") + F.col("same")).otherwise(F.col("n_kept")).alias("n_kept"),
            )
        )
    return state.select("source", F.col("cutoff").cast("int").alias("cutoff"), "n_kept", "n_total")


def _few(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def site_cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """records (site_name, ai_relevance_score text), targets (site_name, target_pct) to (site_name, cutoff, n_kept)."""
    scored = records.select(F.col("site_name").alias("source"), whole_number(F.col("ai_relevance_score")).alias("score"))
    found = cutoffs(scored, targets.select(F.col("site_name").alias("source"), F.col("target_pct").alias("percent")))
    return found.select(F.col("source").alias("site_name"), "cutoff", F.col("n_kept").cast("int").alias("n_kept"))


#: The rows scoring at least the cutoff, counted directly over all scores.
SITE_CUTOFFS_SQL = r"""
with rows as (
  select s.site_name, t.target_pct,
         case when regexp_full_match(trim(s.ai_relevance_score), '[+-]?[0-9]+') then cast(trim(s.ai_relevance_score) as int) else 0 end as score
  from sample_final s join keep_targets t on s.site_name = t.site_name
), by_score as (
  select site_name, target_pct, score, count(*) as n from rows group by all
), above as (
  select site_name, target_pct, score,
         sum(n) over (partition by site_name order by score desc) as kept,
         sum(n) over (partition by site_name) as total
  from by_score
)
select site_name, cast(max(score) as int) as cutoff, cast(arg_max(kept, score) as int) as n_kept
from above where kept * 100 >= target_pct * total group by site_name
"""
