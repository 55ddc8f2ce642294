"""Token ids in Arrow stream files of equal-length sequences with masks (operator 1).

Documents in ascending doc_id order form one stream of ids, cut by range into shards. A shard's file
holds rows of two fixed-size lists, ids and mask, `length` long; mask is false in the padding at the
shard's end. Every record batch has the same number of rows and so the same number of bytes: batch k
lies at a known offset, and a reader maps any sequence without reading or copying others. A second
small stream file lists each document's place in its shard.

Nulls: a null text is an empty document (its end id only), a null doc_id sorts first. Rows that repeat
a doc_id stay side by side, ordered by text hash; a doc_id with very many rows spreads over shards.
Texts of any length and empty tables work; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import batch_blocks, cut_words, encoder
from .scratch import tidied

MANIFEST = "shard int, tokens_file string, places_file string, n_docs long, n_tokens long, first_batch long, batch_bytes long"
PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Gathers ids and writes record batches of equal size."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype, self.sink = length, rows, dtype, sink
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.writer, self.full = pa.ipc.new_stream(sink, self.schema), pa.array(np.ones(length * rows, np.uint8))
        self.first, self.each, self.pending, self.size = self.schema.serialize().size, 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= self.length * self.rows:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids, full = np.concatenate(self.pending), self.length * self.rows
        end = len(ids) // full * full
        for i in range(0, end, full):
            self._write(ids[i : i + full], full)
        rest = ids[end:]
        if last and len(rest):
            self._write(np.pad(rest, (0, full - len(rest))), len(rest))
            rest = rest[:0]
        self.pending, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = self.full if n == len(ids) else pa.array((np.arange(len(ids)) < n).view(np.uint8))
        batch = pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(ids)), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)],
            schema=self.schema,
        )
        self.writer.write_batch(batch)
        self.each = self.each or self.sink.tell() - self.first

    def close(self) -> None:
        if self.size:
            self._flush(last=True)
        self.writer.close()


class SequenceFile:
    """Random access to a shard's sequences, zero-copy where the file can be mapped."""

    def __init__(self, uri: str, first_batch: int, batch_bytes: int):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.schema, self.first, self.each = pa.ipc.open_stream(self.file).schema, first_batch, batch_bytes
        self.length = self.schema.field("ids").type.list_size
        self.at, self.ids, self.rows = -1, None, 0

    def batch(self, k: int) -> pa.RecordBatch:
        self.file.seek(self.first + k * self.each)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (booleans, true for ids that are no padding) of the i-th sequence: views of the file's bytes."""
        self.rows = self.rows or self.batch(0).num_rows
        b, r = self.batch(i // self.rows), i % self.rows
        part = slice(r * self.length, (r + 1) * self.length)
        return b.column("ids").values.to_numpy()[part], b.column("mask").values.to_numpy()[part].view(bool)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids of a document at that place in the shard."""
        parts = []
        while n:
            if self.ids is None or not 0 <= start - self.at < len(self.ids):
                full = self.batch(0).num_rows * self.length
                self.at = start // full * full
                self.ids = self.batch(start // full).column("ids").values.to_numpy()
            parts.append(self.ids[start - self.at :][:n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, rows: int = 32, cut=cut_words, shard_bytes: int = 32 << 20) -> DataFrame:
    """Lazily write docs' shards under folder (a URI all executors reach); one MANIFEST row per shard.

    Shards come from a range partitioning into one for every shard_bytes of text, so each task writes one file
    of about that much text and nothing passes through the driver. A task that runs again writes under a new
    name; only names in the manifest count.
    """
    # A row counts for its end token and place, too.
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        enc, local, n_docs, seqs = encoder(tokenizer, cut), 0, 0, None
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        names = [f"{kind}-{shard:06d}-{own}.arrows" for kind in ("tokens", "places")]
        for batch in (x for b in batches for x in batch_blocks(b, size=8_000_000, rows=10_000)):
            if seqs is None:
                out, side = (fs.open_output_stream(f"{root}/{x}") for x in names)
                seqs, places = SequenceWriter(out, enc.dtype, length, rows), pa.ipc.new_stream(side, PLACES)
            found = [np.append(np.frombuffer(x, enc.dtype), enc.dtype.type(end_id)) for x in enc.encode(batch.column("text"))]
            for x in found:
                seqs.add(x)
            n = np.array([len(x) for x in found], np.int64)
            starts = local + np.cumsum(n) - n
            places.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(n)], schema=PLACES))
            local, n_docs = local + int(n.sum()), n_docs + len(found)
        enc.forget()
        if seqs is not None:
            for x in (seqs, places, out, side):
                x.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "tokens_file": [f"{folder}/{names[0]}"], "places_file": [f"{folder}/{names[1]}"], "n_docs": [n_docs], "n_tokens": [local], "first_batch": [seqs.first], "batch_bytes": [seqs.each]}
            )

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange(-(-size // shard_bytes) or 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(tidied(write), MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds each shard's first position in the whole stream. A manifest has one row per shard."""
    return manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            seqs = SequenceFile(row["tokens_file"], row["first_batch"], row["batch_bytes"])
            fs, path = pafs.FileSystem.from_uri(row["places_file"])
            with fs.open_input_stream(path) as side:
                for b in pa.ipc.open_stream(side):
                    starts, n = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(seqs.span(s, k).astype("<u4")) for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "start": starts + row["base"], "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    spread = with_starts(manifest).repartition(max(1, manifest.count()), "shard")  # a task a shard; AQE would merge small rows
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
