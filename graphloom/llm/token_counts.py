"""Exact token counts of whole texts, computed in Arrow functions that return lengths only.

A batch's bytes are gone through in windows of equal size; a long text goes over several, parted
where no token can span (see ``pieces``).  Distinct pieces of a window are encoded once, and a
table bounded in bytes serves the windows that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import pieces


def count_tokens(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    Whole texts, no special tokens added, no truncation.  A null text counts as empty (0, 0,
    false); a null id is carried; repeated rows each give a row; other columns are ignored; an
    empty table gives an empty result.  A vocabulary whose tokens may span words (``.model``
    files) gets whole texts, in batches balanced by bytes.  ``tokenizer_path`` must be readable
    on every executor.
    """
    splits = pieces.splits_safely(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.Encoder(tokenizer_path) if splits else None
        try:
            for batch in batches:
                counts = pieces.lengths(tokenizer_path, batch.column(1), encoder)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])
        finally:
            del encoder
            pieces.give_back()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
