"""Sections and passages of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import Settings
from marginalia.functions.passages import passages, sections


def section_passages(docs: DataFrame, id_col: str, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Passages of every text, cut at headings and then by length, as (``id_col``, passage_no, headers, text).

    ``headers`` joins the headings above a passage. Null and blank texts have none.
    """
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, no, heads, texts = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = [(" > ".join(h), p.strip()) for h, c in sections(text, s.header_levels) for p in passages(c, s.chunk_chars, s.overlap_chars, s.separators) if p.strip()]
                    rows += [i] * len(own)
                    no += range(len(own))
                    heads += [h for h, _ in own]
                    texts += [t for _, t in own]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(heads, pa.string()), pa.array(texts, pa.string())], names=[id_col, "passage_no", "headers", "text"])

    own = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    return own.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, passage_no int, headers string, text string")
