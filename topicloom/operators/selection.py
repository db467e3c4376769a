"""Selections, joins and unions whose result depends on an explicit order.

Every table carries its order in a column; nothing relies on the order of rows or of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.urls import canonical_url, host_suffixes, url_domain

#: Rows of a dimension up to which it is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 200_000


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def page_key(url: str = "url", title: str = "title") -> Column:
    """The canonical address, else the cleaned title, else ''."""
    address = canonical_url(url)
    return F.when(address != "", address).otherwise(clean_text(title))


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in order; rows with an empty key all stay.

    Rows without a key don't meet in one task: only those with one are ranked.
    """
    keyed = df.withColumn("__key", key)
    window = Window.partitionBy("__key").orderBy(*order)
    first = keyed.where("__key <> ''").withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
    return first.unionByName(keyed.where("__key = '' or __key is null")).drop("__key")


def top_per_group(df: DataFrame, group: str, score: str, order: str, n: int) -> DataFrame:
    """The n best rows of each group: by score, then in order. Spark limits groups before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def select_candidates(df: DataFrame, group: str, url: str, score: str, order: str, per_group: int = 0, total: int = 0) -> DataFrame:
    """The best rows of every group, without repeats of an address in a group, cut once `total` is reached.

    Groups are visited by name. The cut comes after the first row at which `total` rows are chosen while
    its group isn't full; so a last full group may overshoot it. 0 is no limit. Counts per group decide
    where the cut lies; rows are never sorted all together.
    """
    first = keep_first(df, F.concat_ws("\u0001", group, canonical_url(url)), [F.desc(score), order])
    ranked = first.withColumn("__c", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order)))
    if per_group:
        ranked = ranked.where(F.col("__c") <= per_group)
    if total:
        sizes = ranked.groupBy(group).agg(F.count("*").alias("__n"))
        sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy(group)) - F.col("__n"))
        ranked = ranked.join(sizes.select(group, "__before"), group).withColumn("__g", F.col("__before") + F.col("__c"))
        open_ = (F.col("__c") < per_group) if per_group else F.lit(True)
        cut = ranked.where((F.col("__g") >= total) & open_).agg(F.min("__g").alias("__cut"))
        ranked = ranked.where(F.col("__g") <= F.coalesce(cut.scalar(), F.col("__g"))).drop("__before", "__g")
    return ranked.drop("__c")


def last_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def join_last(left: DataFrame, right: DataFrame, key: str, order: Sequence[str], how: str = "left") -> DataFrame:
    """Join to the last row of each key on the right; null keys match nothing."""
    return left.join(dimension(last_of_each(right.where(F.col(key).isNotNull()), key, order)), key, how)


def join_domain(df: DataFrame, url: str, domains: DataFrame, domain: str, order: str, how: str = "left") -> DataFrame:
    """Join each row to the first registered domain (by order) that its host is or lies below.

    Hosts are few against rows: each distinct host is expanded into its suffixes once, which turns the suffix condition into an equi-join.
    """
    hosts = df.select(url_domain(url).alias("__host")).where("__host <> ''").distinct()
    spread = hosts.withColumn("__suffix", F.explode(host_suffixes(F.col("__host"))))
    found = spread.join(dimension(domains.withColumn("__suffix", F.col(domain))), "__suffix")
    first = found.withColumn("__rank", F.row_number().over(Window.partitionBy("__host").orderBy(order))).where("__rank = 1").drop("__rank", "__suffix", order)
    return df.withColumn("__host", url_domain(url)).join(dimension(first), "__host", how).drop("__host")


def union_in_order(parts: Sequence[DataFrame], order: str) -> DataFrame:
    """All rows, with the part's number in front of their own order."""
    numbered = [part.withColumn("part", F.lit(i)) for i, part in enumerate(parts)]
    whole = numbered[0]
    for part in numbered[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def in_names(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows of the named ones; all rows where no names are given."""
    return df.where(F.col(column).isin(list(names))) if names else df


def slice_rows(df: DataFrame, order: str, skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows skip + 1 to skip + limit of a small table in order; limit 0 is no limit."""
    rows = df.orderBy(order).offset(skip) if skip else df.orderBy(order)
    return rows.limit(limit) if limit else rows


def replace_entries(entries: DataFrame, found: DataFrame, targets: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Entries (group, url, page_type) with those of the target groups replaced by their n best found links.

    found has the columns group, link, score and an order of its own, `order`. A target group keeps its first entry (by url) where nothing was found; other groups stay.
    """
    small = dimension(targets.select(group).distinct())
    first = keep_first(entries, F.col(group), ["url"]).join(small, group, "left_semi")
    best = top_per_group(found.join(small, group, "left_semi"), group, "score", order, n).select(group, "link")
    new = first.join(best, group, "left").withColumns({"page_type": F.when(F.col("link").isNull(), F.col("page_type")).otherwise("list"), "url": F.coalesce("link", "url")}).drop("link")
    return entries.join(small, group, "left_anti").unionByName(new.select(*entries.columns))
