"""Token counts of whole texts.

The library encodes in Arrow functions and only lengths come back.  Inside an
Arrow batch, texts are taken in batches of about ``units.BATCH_BYTES``; a longer
text is cut where the tokenizer's own pattern always begins a new token.  The
count equals the library's on the whole text, special strings included.

Defined results: null text counts as empty: no bytes, no tokens.  Repeated rows
are counted each; further columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.units import encoder


def count_tokens(docs: DataFrame, tokenizer_file: str = "byte_bpe_50k.json", limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer_file)
        for batch in batches:
            n = library.lengths(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.compute.binary_length(batch.column(1)).cast(pa.int64())],
                                             names=[id_col, "n_tokens", "n_bytes"])

    kept = rows.drop("text__").schema.add("n_tokens", "long").add("n_bytes", "long")
    out = rows.mapInArrow(run, kept)
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
