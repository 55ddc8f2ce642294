"""Documents as token pieces of bounded length, the input of packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import batch_blocks, cut_before_spaces, encoder
from .scratch import tidied

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, cut=cut_before_spaces) -> DataFrame:
    """One row per piece (see PIECES), made where the text lies, without a shuffle.

    A document is its ids and then end_id; a null text counts as empty. Documents over `capacity` ids are
    cut so that every piece but the first is exactly that long. Only lengths and checksums go on.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cut)
        for batch in (x for b in batches for x in batch_blocks(b, size=8_000_000, rows=10_000)):
            rows: list[tuple] = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                ids = np.append(np.frombuffer(x, enc.dtype), enc.dtype.type(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            d, k, a, n, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(a, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(c, pa.int64())})
        enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(make), PIECES)
