"""Summaries and judgements by a language model behind a protocol, Arrow-batched; and what runs leave in their log.

No provider ships here and nothing opens a connection by itself: callers give a function from prompts to
answers. Any failure of it falls back to the excerpt, row by row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, text
from ..operators.quality import counts

#: From prompts to answers, in order; may raise.
Answer = Callable[[list[str]], list[str]]
CONTENT_LENGTH = 6000
#: Values of a column that a log shows.
MOST_VALUES = 10_000
FIELDS = ("ai_summary", "ai_category", "ai_reason")
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$")


def fields_of(answer: str | None) -> dict[str, str]:
    """The known fields of a JSON answer, with or without a code fence; {} for anything else."""
    try:
        found = json.loads(_FENCE.sub("", (answer or "").strip()))
    except ValueError:
        return {}
    return {f: str(found.get(f) or "") for f in FIELDS} if isinstance(found, dict) else {}


def is_true(value: object) -> bool:
    """A boolean as models write it: the text "false" is false."""
    return value.strip().lower() in ("true", "yes", "1") if isinstance(value, str) else bool(value)


def analysed(results: DataFrame, answer: Answer, prompt: str, tries: int = 2) -> DataFrame:
    """results with FIELDS for rows that have keyword hits; prompt is formatted with title, url and content."""
    kinds = {f.name: f.dataType.simpleString() for f in results.schema if f.name not in FIELDS}

    def ask(prompts: list[str]) -> list[str | None]:
        for _ in range(tries):
            try:
                found = answer(prompts)
                if len(found) == len(prompts):
                    return list(found)
            except Exception:
                continue
        return [None] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wanted = frame["__wanted"].to_numpy(dtype=bool)
            parts = frame.loc[wanted, ["title", "url", "content"]].fillna("")
            prompts = [prompt.format(title=t, url=u, content=c[:CONTENT_LENGTH]) for t, u, c in parts.itertuples(index=False)]
            answers = iter(ask(prompts) if prompts else [])
            found = [fields_of(next(answers)) if w else {} for w in wanted]
            out = frame[list(kinds)].copy()
            for field in FIELDS:
                out[field] = [f.get(field, "") for f in found]
            yield out

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), *(f"{f} string" for f in FIELDS)])
    rows = results.drop(*FIELDS).withColumn("__wanted", text("matched_keywords") != "").mapInPandas(run, schema)
    return rows.withColumn("ai_summary", F.when((text("matched_keywords") != "") & (F.col("ai_summary") == ""), excerpt("content")).otherwise(F.col("ai_summary")))


def task_log(results: DataFrame, params: dict[str, object], columns: Sequence[str] = ("status", "site_name")) -> str:
    """JSON of a run's parameters and how often each value of a few columns stands.

    A column of more than MOST_VALUES values shows those that stand most often, and under `others` how many values
    and rows the rest are.
    """
    ranked = counts(results, *columns).withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).withColumn("shown", F.col("rank") <= MOST_VALUES)
    tally: dict[str, dict[str, int]] = {c: {} for c in columns}
    others = {}
    for row in ranked.groupBy("field", "shown", F.when(F.col("shown"), F.col("value")).alias("value")).agg(F.sum("n").alias("n"), F.count("*").alias("values")).orderBy("field", "value").toLocalIterator():
        if row.shown:
            tally[row.field][row.value] = row.n
        else:
            others[row.field] = {"values": row["values"], "rows": row.n}
    return json.dumps({"parameters": params, "counts": tally} | ({"others": others} if others else {}), ensure_ascii=False, sort_keys=True)
