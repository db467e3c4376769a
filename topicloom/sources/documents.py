"""PDF files as texts, where a PDF library is installed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import clean_text


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content) of the PDF files below path; a file that can't be read has an empty content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for frame in frames:
            texts = []
            for body in frame["content"]:
                try:
                    texts.append(" ".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(body)).pages))
                except Exception:
                    texts.append("")
            yield pd.DataFrame({"path": frame["path"], "title": frame["path"].str.rsplit("/", n=1).str[-1], "content": texts})

    return files.select("path", "content").mapInPandas(extract, "path string, title string, content string").withColumn("content", clean_text("content"))
