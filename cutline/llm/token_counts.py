"""Token counts of whole texts, as lengths only.

Arrow functions encode batches of about equal bytes, so a batch of long texts costs as much as one
of short texts, and every text is cut at safe boundaries first (``encoding.segments``): no call
sees an unbounded text unless the text has no boundary at all. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cutline.llm.text import chunks


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``tokenizer`` is the path of a vocabulary file of the ``tokenizers`` library, present on every
    executor. No begin, end or other tokens are added; special strings inside a text count as the
    library counts them by default. Null and empty texts have no bytes and no tokens; a null id
    stays null; repeated rows give repeated rows; other columns of ``docs``, whatever their
    names, are not carried. An empty table gives an empty table.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cutline.llm.encoding import SegmentEncoder

        encoder = SegmentEncoder.open(tokenizer, with_ids=False)
        for chunk in chunks(batches, size=1 << 18):
            texts = pc.fill_null(chunk.column("text"), "")
            counts, _ = encoder.encode(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
