"""Packing without padding: every document is cut into pieces of power-of-two lengths.

The ids of a document (its end id included) are cut into pieces of the longest allowed length and
then into the binary digits of what is left, longest first. Equal lengths form a bucket. A
sequence is one piece, so that it never crosses documents and needs no padding: batches are drawn from one
bucket at a time.

A null or empty text is packed as its end id. Rows with the same id are packed one by one, as
are equal texts; further columns are not read. ``sequence_id`` is unique over the table; it numbers the
pieces within the partitions of the input, so that nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.encoding import id_column, library_encoder
from tallyflow.llm.texts import arrow_schema, slices

MAX_TOKENS = 4096
END_ID = 2


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each text, and their offsets."""
    return np.insert(ids, offsets[1:], end_id).astype(np.uint32, copy=False), offsets + np.arange(len(offsets))


def binary_pieces(length: int, longest: int = MAX_TOKENS) -> list[int]:
    """Power-of-two lengths that add up to ``length``, descending."""
    whole, rest = divmod(length, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id, start, length, ids binary, doc_tokens, sequence_id, offset, bucket)."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    st, schema = arrow_schema(
        f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long"
    )

    def run(batches):
        encoder = library_encoder(path)
        for part in slices(batches, text_col):
            ids, offsets = with_end(*encoder.encode(part.column(text_col)), end_id)
            tokens = np.diff(offsets)
            pieces = [binary_pieces(n, max_tokens) for n in tokens.tolist()]
            lengths = np.fromiter((x for p in pieces for x in p), np.int64)
            doc = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            columns = [
                part.column(id_col).take(pa.array(doc)),
                pa.array(ends[:-1] - offsets[doc]),
                pa.array(lengths),
                id_column(ids, ends),
                pa.array(tokens[doc]),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    pieces = docs.select(id_col, text_col).mapInArrow(run, st)
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet with a folder for each length; rows stay where they are, nothing is shuffled."""
    packed.write.partitionBy("bucket").mode("overwrite").parquet(path)
