"""Packing of pieces into sequences by a grouping genetic algorithm on islands (operator 3).

Pieces are dealt at random into shards of bounded size. Each shard is worked on by several islands, each
with its own population of packings, which start from best fit in orders from by size (one packing of the
first island) to random. Crossover
injects whole well-filled bins of one parent into another, removes the bins that hold duplicates or are less
full, and best-fits the displaced pieces, largest first. A generation is one crossover; an island goes on
until its best packing has the least number of bins there can be, or nothing is gained for a while. After
each epoch every island sends its best packing to the next one. A shard keeps its best packing. Bins that
stay poorly filled are opened, and their pieces, from all shards, go through the same once more.

Full pieces (length = capacity) are sequences of their own. Pieces of equal length and repeated rows are
told apart by a row number; an empty table gives an empty result; lengths that are null, below one or over
capacity are an error. Columns of the input are carried along under their names, whatever those are; only
sequence_id and offset are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

STATE = "shard long, island int, uids binary, lengths binary, packings array<binary>, crossovers long, arrived long"


@dataclass(frozen=True)
class Evolution:
    """Islands of a shard, epochs (migration lies between them), packings of an island, and its generations in an epoch:
    at most so many, fewer if the bound is met or `patience` of them bring no gain."""

    islands: int = 3
    epochs: int = 2
    population: int = 4
    generations: int = 12
    patience: int = 5
    seed: int = 7


def best_fit(room: list[int], sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, in order: the fullest one that it fits, else a new one. room: what bins have left."""
    of_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: some bin has r left
    for b, r in enumerate(room):
        of_room[r].append(b)
        there |= 1 << r
    out, n = [], len(room)
    for size in sizes:
        fitting = there >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = of_room[r].pop()
            if not of_room[r]:
                there ^= 1 << r
        else:
            r, b, n = capacity, n, n + 1
        of_room[r - size].append(b)
        there |= 1 << (r - size)
        out.append(b)
    return out


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(assign, sizes)
    return -int((fill > 0).sum()), float(np.square(fill / capacity).sum())


def first_packing(sizes: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    """Best fit, by size (noise 0) to in any order (noise 1)."""
    order = np.argsort((noise - 1) * sizes - noise * capacity * rng.random(len(sizes)), kind="stable")
    out = np.empty(len(sizes), np.int32)
    out[order] = best_fit([], sizes[order].tolist(), capacity)
    return out


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of b with a third of the well-filled bins of a."""
    fill_a, fill_b = np.bincount(a, sizes), np.bincount(b, sizes)
    good = np.flatnonzero(fill_a >= np.median(fill_a))
    chosen = rng.choice(good, max(1, len(good) // 3), replace=False)
    injected = np.isin(np.arange(len(fill_a)), chosen)[a]
    opened = fill_b < np.median(fill_a[chosen])
    opened[b[injected]] = True
    label = np.where(injected, a, np.where(opened[b], -1, b + len(fill_a)))
    placed = label >= 0
    _, bins = np.unique(label[placed], return_inverse=True)
    displaced = np.flatnonzero(~placed)
    displaced = displaced[np.argsort(-sizes[displaced], kind="stable")]
    out = np.empty(len(a), np.int32)
    out[placed] = bins
    out[displaced] = best_fit((capacity - np.bincount(bins, sizes[placed])).astype(int).tolist(), sizes[displaced].tolist(), capacity)
    return out


def evolve(packings: list[np.ndarray], sizes: np.ndarray, capacity: int, e: Evolution, rng: np.random.Generator) -> tuple[list[np.ndarray], int]:
    """The packings, best first, and the number of crossovers. A child takes the place of the worst one unless it is worse."""
    worth = lambda x: fitness(x, sizes, capacity)
    ranked, floor, done, still = sorted(packings, key=worth, reverse=True), -int(-(-sizes.sum() // capacity)), 0, 0
    while len(ranked) > 1 and done < e.generations and still < e.patience and (best := worth(ranked[0]))[0] < floor:
        i, j = rng.choice(len(ranked), 2, replace=False)
        child, done = crossover(ranked[i], ranked[j], sizes, capacity, rng), done + 1
        if worth(child) >= worth(ranked[-1]):
            ranked[-1] = child
            ranked.sort(key=worth, reverse=True)
        still = 0 if worth(ranked[0]) > best else still + 1
    return ranked, done


def evolved(items: DataFrame, capacity: int, shards: int, e: Evolution) -> DataFrame:
    """STATE of every island after the last epoch, for items(uid, length): packings, best first, the crossovers
    made and the packings that arrived from other islands."""

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    rng = np.random.default_rng([e.seed, row["shard"], row["island"], number])
                    sizes = np.frombuffer(row["lengths"], np.int32)
                    found = [np.frombuffer(x, np.int32) for x in row["packings"]]
                    if not number:
                        last = max(1, e.islands * e.population - 1)
                        found = [first_packing(sizes, capacity, (row["island"] + i * e.islands) / last, rng) for i in range(e.population)]
                    found, done = evolve(found, sizes, capacity, e, rng)
                    row["packings"], row["crossovers"] = [x.tobytes() for x in found[: e.population]], row["crossovers"] + done
                    yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

        return run

    def gather(key, rows):
        rows = rows.sort_by("uid")
        uids, sizes = rows.column("uid").to_numpy(), rows.column("length").to_numpy().astype(np.int32)
        return pa.table({"shard": [key[0].as_py()], "uids": [uids.tobytes()], "lengths": [sizes.tobytes()]})

    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(e.seed)), F.lit(shards)))
    state = dealt.groupBy("shard").applyInArrow(gather, "shard long, uids binary, lengths binary")
    state = state.select("shard", F.explode(F.array([F.lit(i) for i in range(e.islands)])).alias("island"), "uids", "lengths", F.array().cast("array<binary>").alias("packings"), zero.alias("crossovers"), zero.alias("arrived"))
    state = state.repartition("shard", "island").mapInArrow(epoch(0), STATE)
    for number in range(1, e.epochs):
        sent = F.struct("shard", F.pmod(F.col("island") + 1, F.lit(e.islands)).cast("int").alias("island"), none.alias("uids"), none.alias("lengths"), F.slice("packings", 1, 1).alias("packings"), zero.alias("crossovers"), F.lit(1).cast("long").alias("arrived"))
        stay = F.struct(*state.columns)
        both = state.select(F.explode(F.array(stay, sent)).alias("x")).select("x.*")
        state = both.groupBy("shard", "island").agg(F.max("uids").alias("uids"), F.max("lengths").alias("lengths"), F.flatten(F.sort_array(F.collect_list("packings"))).alias("packings"), F.sum("crossovers").alias("crossovers"), F.sum("arrived").alias("arrived"))
        state = state.mapInArrow(epoch(number), STATE)
    return state


def best_of(state: DataFrame, capacity: int) -> DataFrame:
    """uid, bin, shard of the best packing of each shard."""

    @F.pandas_udf("struct<bins:long, fill:double>")
    def worth(packing, lengths):
        import pandas as pd

        found = [fitness(np.frombuffer(p, np.int32), np.frombuffer(n, np.int32), capacity) for p, n in zip(packing, lengths, strict=True)]
        return pd.DataFrame(found, columns=["bins", "fill"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids = np.frombuffer(row["uids"], np.int64)
                yield pa.RecordBatch.from_pydict({"uid": uids, "bin": np.frombuffer(row["packing"], np.int32).astype(np.int64), "shard": np.full(len(uids), row["shard"], np.int64)})

    best = state.withColumn("packing", F.col("packings")[0]).withColumn("worth", worth("packing", "lengths"))
    best = best.groupBy("shard").agg(F.max_by(F.struct("uids", "packing"), F.struct("worth.bins", "worth.fill", "island")).alias("x"))
    return best.select("shard", "x.uids", "x.packing").mapInArrow(place, "uid long, bin long, shard long")


def pack(scratch: Scratch, pieces: DataFrame, capacity: int = 2048, shard_items: int = 4096, evolution: Evolution = Evolution(), reopen_below: float = 0.99) -> DataFrame:
    """pieces with sequence_id and offset; every shard holds about shard_items pieces, whatever the input's size."""
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    uid, own, length = fresh("uid", columns), fresh("sequence_id", columns), F.col("length")
    fits = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.concat(F.lit("a piece is null, empty or longer than "), F.lit(capacity))))
    pieces = scratch.table(pieces.select(columns).withColumn("length", fits.cast("long")).withColumn(uid, F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(length != capacity).select(F.col(uid).alias("uid"), "length")
    first = scratch.table(evolved(short, capacity, -(-short.count() // shard_items) or 1, evolution), "islands")
    first = scratch.table(best_of(first, capacity), "first").join(short, "uid")
    fill = first.groupBy("shard", "bin").agg((F.sum("length") < reopen_below * capacity).alias("open"))
    first = scratch.table(first.join(fill, ["shard", "bin"]), "filled")
    poor = first.filter("open").select("uid", "length")
    again = best_of(evolved(poor, capacity, -(-poor.count() // shard_items) or 1, replace(evolution, seed=evolution.seed + 1)), capacity)
    placed = first.filter("not open").select("uid", "shard", "bin", F.lit(1).alias("round")).unionByName(again.withColumn("round", F.lit(2)))
    name = (F.col("shard") * 2 + F.col("round") - 1) * F.lit(1 << 20) + F.col("bin")
    placed = placed.select(F.col("uid").alias(uid), name.alias(own))
    packed = pieces.filter(length != capacity).join(placed, uid)
    before = Window.partitionBy(own).orderBy(uid).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = packed.withColumn("offset", F.sum("length").over(before) - length)
    full = pieces.filter(length == capacity).withColumn(own, -1 - F.col(uid)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full).select(*columns, F.col(own).alias("sequence_id"), "offset")
