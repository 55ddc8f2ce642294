"""Compression of vectors to codes, their entries found by slicing and intersecting bitmasks (operator 11).

Vectors become integers and are cut into parts; each part has a codebook, and its code is the number of the
nearest entry. For the search, the entries' coordinates are sorted in each dimension, and each place of that
order has a mask of the entries before it. A part takes as initial radius its distance to the entry nearest
to it in the codebook's widest dimension. In each dimension the entries within the radius are a range of the
order, and their mask is the difference of two prefix masks. The masks of all dimensions ANDed leave the
entries in a box that holds all within the radius: the nearest entry and its ties are among them. Only those
are compared, exactly.

Fitting is rounds of assignment and averaging. Tasks add up their parts by entry; a codebook of
parts * entries * positions integers is all that comes to the driver in a round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, tidied

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are searched together; integers up to which numpy's 64 bits do for squares, beyond them Python's own.
BLOCK, SAFE = 4096, 1 << 26
#: Pieces in which the rows of a label meet its error.
SALT = 32


@dataclass
class Slices:
    """The entries of one part made ready for search. before[d, i] masks the entries before place i of dimension d's
    order, 64 entries to a word."""

    entries: np.ndarray
    order: np.ndarray
    rank: np.ndarray
    before: np.ndarray
    widest: int

    @classmethod
    def of(cls, entries: np.ndarray) -> Slices:
        n, dims = entries.shape
        rank = np.argsort(entries.T, axis=1, kind="stable")
        bits = np.zeros((n, -(-n // 64)), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        before = np.zeros((dims, n + 1, bits.shape[1]), np.uint64)
        for d in range(dims):
            before[d, 1:] = np.bitwise_or.accumulate(bits[rank[d]], axis=0)
        order = np.take_along_axis(entries.T, rank, 1)
        return cls(entries, order, rank, before, int(np.argmax(order[:, -1] - order[:, 0])) if dims else -1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number that is at least the distance to the entry nearest in the widest dimension."""
        line, own = self.order[self.widest], x[:, self.widest]
        right = np.minimum(np.searchsorted(line, own), len(line) - 1)
        left = np.maximum(right - 1, 0)
        at = np.where(own - line[left] <= line[right] - own, left, right)
        squared = np.square(x - self.entries[self.rank[self.widest][at]]).sum(1)
        if x.dtype == object:
            return np.array([math.isqrt(s) + 1 for s in squared], object)
        return np.ceil(np.sqrt(squared.astype(np.float64))).astype(np.int64) + 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (ties: the lower number), its squared distance, and the distances computed."""
        if not x.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        r, masks = self.radius(x), np.full((len(x), self.before.shape[2]), ~np.uint64(0))
        for d in range(x.shape[1]):
            low, high = np.searchsorted(self.order[d], x[:, d] - r, "left"), np.searchsorted(self.order[d], x[:, d] + r, "right")
            masks &= self.before[d, high] ^ self.before[d, low]
        inside = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)]
        row, entry = np.nonzero(inside)  # by row, entries ascending
        squared = np.square(x[row] - self.entries[entry]).sum(1)
        least = np.minimum.reduceat(squared, np.searchsorted(row, np.arange(len(x))))
        best = np.flatnonzero(squared == least[row])
        first = best[np.searchsorted(row[best], np.arange(len(x)))]
        return entry[first], squared[first], len(row)


def bounds(dim: int, parts: int) -> list[int]:
    """Where parts begin and end; they are equal if dim is a multiple of parts."""
    return [p * dim // parts for p in range(parts + 1)]


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as Python's integers where one is large."""
    scaled = np.floor(values * scale)  # exact where scale is a power of two
    small = not scaled.size or np.abs(scaled).max() < SAFE
    return scaled.astype(np.int64) if small else np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def same_kind(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers if one of them is."""
    return (x.astype(object), entries.astype(object)) if object in (x.dtype, entries.dtype) else (x, entries)


@dataclass
class Codec:
    """Codebooks by dimension of the vectors: entries[dimension][part] is a matrix of integers, a row an entry."""

    entries: dict[int, list[np.ndarray]]
    parts: int = PARTS
    scale: int = SCALE

    def codes(self, dim: int, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """part, the integers of it, entry and squared distance of each row."""
        x, cuts = whole(vectors, self.scale), bounds(dim, self.parts)
        for part, entries in enumerate(self.entries[dim]):
            own, entries = same_kind(x[:, cuts[part] : cuts[part + 1]], entries)
            entry, squared, _ = Slices.of(entries).nearest(own)
            yield part, own, entry, squared

    def sha256(self, dim: int) -> str:
        """Of all integers in decimal, by part, entry and position, joined by commas; lower-case hex."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries[dim] for x in part.ravel()).encode()).hexdigest()


def usable(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """Rows whose vector is not null and holds only finite numbers whose integers fit in 64 bits."""
    return vectors.filter(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(2**63 // scale))))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one dimension, a block at a time, and their vectors."""
    for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
        sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == dim))
            yield dim, own, own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dim)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codec:
    """Codebooks for rows(vec_id, v). They start as the parts of the rows with the smallest vec_id (nulls last, then by
    vector), one row an entry, for each dimension of vectors."""
    first = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    start = rows.withColumn("dim", F.size("v")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= entries)
    by_dim: dict[int, list[list[float]]] = {}
    for r in sorted(start.select("dim", "at", "v").collect(), key=lambda r: (r["dim"], r["at"])):
        by_dim.setdefault(r["dim"], []).append(r["v"])
    cuts = {dim: bounds(dim, parts) for dim in by_dim}
    codec = Codec({dim: [whole(np.array(v, np.float64).reshape(len(v), dim), scale)[:, a:b] for a, b in zip(cuts[dim], cuts[dim][1:])] for dim, v in by_dim.items()}, parts, scale)
    for _ in range(rounds):
        sums: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for r in _sums(rows, codec).collect():
            sums.setdefault((r["dim"], r["part"], r["entry"]), []).append((r["position"], int(r["s"]), r["n"]))
        new = {dim: [book.astype(object) for book in books] for dim, books in codec.entries.items()}
        for (dim, part, entry), own in sums.items():
            for position, s, n in own:
                new[dim][part][entry, position] = s // n
        codec = Codec({dim: [_narrow(book) for book in books] for dim, books in new.items()}, parts, scale)
    return codec


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(x) < SAFE for x in book.ravel()) else book


def _sums(rows: DataFrame, codec: Codec) -> DataFrame:
    """dim, part, entry, position, n, s: of every entry's parts, their number and the sum of that position."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        for dim, _, v in _matrices(batches):
            for part, x, entry, _ in codec.codes(dim, v):
                for e in np.unique(entry).tolist():
                    own = held.setdefault((dim, part, e), [0, [0] * x.shape[1]])
                    mine = x[entry == e]
                    own[0] += len(mine)
                    own[1] = [a + int(b) for a, b in zip(own[1], mine.sum(0), strict=True)]
        out = [(*key, i, n, s) for key, (n, sums) in held.items() for i, s in enumerate(sums)]
        if out:
            d, p, e, i, n, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(d, pa.int32()), "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "position": pa.array(i, pa.int32()), "n": pa.array(n, pa.int64()), "s": pa.array(s, pa.decimal128(38, 0))})

    parts = rows.select("v").mapInArrow(tidied(add), "dim int, part int, entry int, position int, n long, s decimal(38,0)")
    return parts.groupBy("dim", "part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def compressed(rows: DataFrame, codec: Codec) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed) and codebooks_sha256 of rows(vec_id, label, v)."""
    hashes = {dim: codec.sha256(dim) for dim in codec.entries}
    kind = rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in _matrices(batches):
            texts, error = [""] * len(v), np.zeros(len(v), object)
            for _, _, entry, squared in codec.codes(dim, v):
                texts = [t + f"{e:02x}" for t, e in zip(texts, entry.tolist(), strict=True)]
                error = error + squared
            error = [min(int(e), 2**63 - 1) for e in error]
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(texts), pa.array(error, pa.int64()), pa.array([hashes[dim]] * len(v))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.select("vec_id", "label", "v").mapInArrow(tidied(code), f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")


def compress(scratch: Scratch, vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows of the label), codebooks_sha256, for vectors(vec_id, label, column).

    Rows that are not usable are left out. Vectors of each dimension have codebooks of their own; with fewer rows than entries,
    a codebook is as short as that. Where the dimension is no multiple of parts, parts differ by one, and may be
    empty (entry 0). Rows that repeat are coded each, also under one vec_id or a null one; equal vectors have equal codes. Null labels are one
    label. Errors over the largest long count as that. An empty table gives none. Other columns are not read.
    """
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(column).cast("array<double>").alias("v")), "v", scale)
    coded = scratch.table(compressed(rows, fit(rows, parts, entries, rounds, scale)), "coded")
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    totals = totals.select("label", F.least("total", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("piece"))
    a, b = coded.withColumn("piece", F.pmod(F.hash("vec_id", "code"), F.lit(SALT))).alias("a"), totals.alias("b")
    found = a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.piece") == F.col("b.piece")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The rounds written out, each a table of codebooks and one of the parts' entries."""
    nearest = "a{0} AS MATERIALIZED (SELECT r, part, arg_min(c.entry, (list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry)) AS entry, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error FROM parts p JOIN c{0} c USING (part) GROUP BY r, part)"
    means = "m{0} AS (SELECT part, entry, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{0} JOIN parts USING (r, part), range(1, len(x) + 1) g(i) GROUP BY ALL)"
    book = "c{1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{0} GROUP BY part, entry) m USING (part, entry))"
    steps = [", ".join((nearest, means, book)).format(i, i + 1) for i in range(ROUNDS)] + [nearest.format(ROUNDS)]
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
parts AS MATERIALIZED (SELECT r, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM parts WHERE r <= {ENTRIES}), {', '.join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded JOIN v USING (r)"""


ORACLE = _oracle()
