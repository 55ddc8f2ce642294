"""Toxicity by a factorization machine over hashed terms (operator 5).

A text's features are its distinct terms (runs of letters, A-Z lower-cased), hashed by crc32. The machine
adds linear weights and pairwise interactions through factor vectors, so two terms that are harmless alone
can raise the score together. It is fitted on a bounded sample of labelled rows, in one task, from the
terms whose frequency differs significantly between the labels; the fitted machine is a few thousand numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import batch_blocks
from .scratch import Scratch, fresh, tidied

TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Labelled rows that fitting uses at most, those with the smallest hash of doc_id.
SAMPLE = 12_000
#: Features that the machine keeps at most, the most significant ones.
FEATURES = 512


def terms(text: str | None) -> set[int]:
    return set(map(zlib.crc32, set(TERM.findall((text or "").encode().lower()))))


@dataclass
class Machine:
    keys: list[int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        mixed = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * (np.square(mixed).sum(1) - np.square(x) @ np.square(self.factors).sum(1))

    def design(self, found: list[set[int]]) -> np.ndarray:
        at, known = {k: i for i, k in enumerate(self.keys)}, set(self.keys)
        x = np.zeros((len(found), len(self.keys)))
        for row, f in zip(x, found, strict=True):
            row[[at[k] for k in known.intersection(f)]] = 1
        return x

    def score(self, found: list[set[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.design(found)), -40, 40)))


def significant(found: list[set[int]], y: np.ndarray, most: int, least_docs: int = 5, z: float = 5.0) -> list[int]:
    """Terms whose document frequency differs between the labels, by a two-proportion test."""
    n1, n = y.sum(), len(y)
    ids, at = np.unique(np.concatenate([np.fromiter(f, np.int64, len(f)) for f in found] or [np.zeros(0, np.int64)]), return_inverse=True)
    label = np.repeat(y, [len(f) for f in found])
    both, toxic = np.bincount(at, minlength=len(ids)), np.bincount(at, label, minlength=len(ids))
    p = both / max(n, 1)
    spread = np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n - n1, 1))) + 1e-9
    score = np.abs(toxic / max(n1, 1) - (both - toxic) / max(n - n1, 1)) / spread
    score[both < least_docs] = 0
    best = np.lexsort((ids, -score))[:most]
    return [int(ids[i]) for i in best if score[i] >= z]


def fit(found: list[set[int]], y: np.ndarray, features: int = FEATURES, factors: int = 6, steps: int = 400, decay: float = 1e-3, seed: int = 5) -> Machine:
    """Full-batch AdaGrad on the logistic loss. Without both labels the machine is the smoothed base rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    keys = significant(found, y, features) if 0 < y.sum() < len(y) else []
    rng = np.random.default_rng(seed)
    m = Machine(keys, float(np.log(rate / (1 - rate))), np.zeros(len(keys)), 0.05 * rng.standard_normal((len(keys), factors)))
    if not keys:
        return m
    x = m.design(found)
    squares = [1e-8, np.full(len(keys), 1e-8), np.full(m.factors.shape, 1e-8)]
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(m.margin(x), -40, 40))) - y) / len(y)
        grads = [g.sum(), x.T @ g + decay / 10 * m.linear, x.T @ (g[:, None] * (x @ m.factors)) - (x.T @ g)[:, None] * m.factors + decay / 10 * m.factors]
        squares = [s + np.square(d) for s, d in zip(squares, grads, strict=True)]
        deltas = [0.3 * d / np.sqrt(s) for d, s in zip(grads, squares, strict=True)]
        m.bias, m.linear, m.factors = float(m.bias - deltas[0]), m.linear - deltas[1], m.factors - deltas[2] / 4
    return m


def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from labelled documents. Several labels of a document count as their largest; labels that
    are null or of absent documents, and null doc_ids, are ignored. At most `sample` rows meet in one task."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.table(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in batch_blocks(batch)):
            found = [np.fromiter(terms(t), np.int64).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "toxic": b.column("toxic").cast(pa.int32()), "terms": pa.array(found, pa.binary())})

    def learn(table):
        table = table.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
        found = [set(np.frombuffer(x, "<u4").tolist()) for x in table.column("terms").to_pylist()]
        m = fit(found, table.column("toxic").to_numpy().astype(float))
        return pa.table({"keys": pa.array([m.keys], pa.list_(pa.int64())), "bias": [m.bias], "linear": pa.array([m.linear.tolist()], pa.list_(pa.float64())), "factors": pa.array([m.factors.ravel().tolist()], pa.list_(pa.float64()))})

    gathered = scratch.table(rows.select("doc_id", "toxic", "text").mapInArrow(tidied(featurise), "doc_id long, toxic int, terms binary"), "terms")
    gathered = gathered.orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(sample)  # of rows that repeat a doc_id too
    model = gathered.groupBy().applyInArrow(learn, "keys array<long>, bias double, linear array<double>, factors array<double>")
    row = scratch.table(model, "model").first()
    if row is None:
        return fit([], np.zeros(0))
    return Machine(list(row["keys"]), row["bias"], np.array(row["linear"]), np.array(row["factors"]).reshape(len(row["linear"]), -1) if row["linear"] else np.zeros((0, 1)))


def scored(docs: DataFrame, machine: Machine, column: str = "toxic_score") -> DataFrame:
    """docs, all columns and rows, with the score of the whole text in `column` (replaced if there). A null or
    empty text scores as one without terms. No shuffle; the machine (at most FEATURES rows) goes with the task.
    At most 256 texts, or about 2 MB of them, are held as terms at a time."""
    kept = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in batch_blocks(batch)):
            scores = machine.score([terms(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(scores, pa.float64())], names=[*kept, column])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema if f.name in kept], T.StructField(column, T.DoubleType())])
    return docs.select(*kept).mapInArrow(tidied(run), schema)


def remainder(doc_id: str = "doc_id", by: int = 5):
    return F.crc32(F.col(doc_id).cast("string")) % by


def toxicity_rows(scratch: Scratch, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from rows that are not held out."""
    machine = train(scratch, docs, labels.filter(remainder() != 0))
    out = scored(docs.select("doc_id", "text"), machine).select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(scratch: Scratch, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs less those that score at or above the threshold; columns as they were."""
    name = fresh("toxic_score", docs.columns)
    return scored(docs, train(scratch, docs, labels), name).filter(F.col(name) < threshold).drop(name)
