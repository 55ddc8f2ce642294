"""Approximate nearest neighbours by vantage-point trees, one per shard (operator 10).

Largest inner product becomes least distance: every vector gets one more coordinate that lifts it to the
largest norm there is, queries are scaled to length one and get a zero there. A tree splits its points at
the median distance to a vantage point and keeps each half's least and greatest distance. By the triangle
inequality a half cannot hold a point nearer than max(least - d, d - greatest) to a query at distance d;
a half is skipped when that bound times `factor` is over the distance of the query's k-th best. Factor 1
is exact; larger factors skip more. Many queries walk a tree together.

Shards are regions: the points nearest to one of a bounded number of vantage points drawn from the data,
split evenly where a region is large. A query first searches its own region; with the k-th best found there
it goes, by the same bound and factor, only to regions that may hold nearer points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LEAF = 64
#: Vectors of a shard, about; queries that walk a tree together; regions at most (of each dimension).
SHARD, BLOCK, REGIONS = 8192, 4096, 1000
#: Default pruning factor. What a factor skips and loses depends on the vectors; figures for those at hand are in the README.
FACTOR = 1.3


def build(points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A tree: the order of the points and the nodes, a row each: start, end, vantage position (-1: leaf), left and
    right child, then the least and greatest distance of the left and of the right half."""
    rng, order, nodes = np.random.default_rng(seed), np.arange(len(points)), []

    def grow(start: int, end: int) -> int:
        at = len(nodes)
        nodes.append([start, end, -1, -1, -1, 0, 0, 0, 0])
        if end - start <= LEAF:
            return at
        own = order[start:end]
        trial = rng.choice(own, min(8, len(own)), replace=False)
        some = points[rng.choice(own, min(64, len(own)), replace=False)]
        vantage = int(max(trial, key=lambda t: np.linalg.norm(some - points[t], axis=1).var()))
        d = np.linalg.norm(points[own] - points[vantage], axis=1)
        ranked = np.argsort(d, kind="stable")
        order[start:end], d = own[ranked], d[ranked]
        half = (end - start) // 2
        left, right = grow(start, start + half), grow(start + half, end)
        nodes[at] = [start, end, vantage, left, right, d[0], d[half - 1], d[half], d[-1]]
        return at

    if len(points):
        grow(0, len(points))
    return order, np.array(nodes, np.float64).reshape(-1, 9)


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(top * top - norms * norms, 0))[:, None]])


def unit(queries: np.ndarray) -> np.ndarray:
    return np.hstack([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))])


def reach(worst: np.ndarray, lengths: np.ndarray, top: float) -> np.ndarray:
    """Distance at which a query of that length has an inner product of worst."""
    return np.sqrt(np.maximum(1 + top * top - 2 * worst / lengths, 0)) + 1e-9


def search(ids: np.ndarray, vectors: np.ndarray, top: float, order: np.ndarray, nodes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and inner products (both queries x k, best first, -1 and -inf where there are fewer) and the vectors
    visited by each query. worst: what a neighbour must reach, from elsewhere, or -inf."""
    points, lengths, asked, worst = lifted(vectors, top), np.linalg.norm(queries, axis=1), unit(queries), worst.copy()
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    best, visited = np.full((len(queries), k), -np.inf), np.zeros(len(queries), np.int64)

    def walk(n: int, q: np.ndarray) -> None:
        start, end, vantage, left, right = nodes[n, :5].astype(int)
        if vantage < 0:
            own = order[start:end]
            visited[q] += end - start
            found = np.einsum("qd,pd->qp", queries[q], vectors[own])
            found[query_ids[q][:, None] == ids[own][None, :]] = -np.inf
            hit = found.max(1) >= worst[q]
            q, found = q[hit], found[hit]
            if len(q):
                score = np.hstack([best[q], found])
                name = np.hstack([best_ids[q], np.broadcast_to(ids[own], found.shape)])
                name[np.isneginf(score)] = np.iinfo(np.int64).max
                rank = np.argpartition(-score, k - 1, axis=1)[:, :k]
                least = np.take_along_axis(score, rank, 1).min(1)
                tied = np.flatnonzero((score >= least[:, None]).sum(1) > k)
                rank[tied] = np.lexsort((name[tied], -score[tied]), axis=1)[:, :k]
                best[q], best_ids[q], worst[q] = np.take_along_axis(score, rank, 1), np.take_along_axis(name, rank, 1), np.maximum(worst[q], least)
            return
        d = np.linalg.norm(asked[q] - points[vantage], axis=1)
        near_left = d < (nodes[n, 6] + nodes[n, 7]) / 2
        for first in (True, False):
            for child, side, (low, high) in ((left, near_left, nodes[n, 5:7]), (right, ~near_left, nodes[n, 7:9])):
                mine = np.flatnonzero(side if first else ~side)
                bound = np.maximum(np.maximum(low - d[mine], d[mine] - high), 0)
                mine = mine[bound * factor <= reach(worst[q[mine]], lengths[q[mine]], top)]
                if len(mine):
                    walk(child, q[mine])

    walk(0, np.arange(len(queries)))
    rank = np.lexsort((best_ids, -best), axis=1)
    best, best_ids = np.take_along_axis(best, rank, 1), np.take_along_axis(best_ids, rank, 1)
    return np.where(np.isneginf(best), -1, best_ids), best, visited


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with a vec_id and a vector that is neither null, empty nor zero and holds finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0))


@dataclass
class Space:
    """What is known of the vectors of one dimension: the largest norm, the regions' vantage points, and how far from
    them the regions reach."""

    top: float
    pivots: np.ndarray  # lifted
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.square(points).sum(1)[:, None] + np.square(self.pivots).sum(1)[None, :] - 2 * points @ self.pivots.T, 0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No point of a region is nearer to a query than that."""
        d = self.distances(unit(queries))
        return np.maximum(np.maximum(self.low - d, d - self.high), 0) - 1e-6


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """Rows of one dimension, and their vectors."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
            yield int(dim), own, own.column("v").combine_chunks().values.to_numpy().reshape(-1, dim)


def drawn(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """dim, at, v: the vectors with the smallest hash of vec_id, one for every SHARD of a dimension's, REGIONS at most."""
    wanted = {d: min(REGIONS, -(-n // SHARD)) for d, n in sizes.items()}
    # Few rows pass this: about sixteen times as many as are wanted, 64 at least, or all.
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, max(64, 16 * wanted[d]) / n))])
    of = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    # Each task leaves its first REGIONS of a dimension to the shuffle, as long as Spark's threshold for that is not under it.
    first = F.row_number().over(Window.partitionBy("dim").orderBy(of, "vec_id", "v"))
    found = rows.filter(of < share[F.col("dim")] * (1 << 30)).withColumn("at", first).filter(F.col("at") <= REGIONS)
    return found.filter(F.col("at") <= F.create_map(*[F.lit(x) for d in sizes for x in (d, wanted[d])])[F.col("dim")]).select("dim", "at", "v")


def spaces(rows: DataFrame) -> dict[int, Space]:
    """By dimension. The vectors that are drawn come to the driver."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(F.max(norm).alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    found: dict[int, list] = {}
    for r in sorted(drawn(rows, {d: r["n"] for d, r in sizes.items()}).collect() if sizes else [], key=lambda r: r["at"]):
        found.setdefault(r["dim"], []).append(r["v"])
    for d in sizes.keys() - found:  # no hash was small
        found[d] = [rows.filter(F.col("dim") == d).orderBy("vec_id", "v").first()["v"]]
    return {d: Space(sizes[d]["top"] * (1 + 1e-12), lifted(np.array(v), sizes[d]["top"])) for d, v in found.items()}


def searched(queries: DataFrame, trees: DataFrame, space: dict[int, Space], blocks: int, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score, and a row with null vec_id and `visited` for each query and shard, for
    queries(dim, region, vec_id, v, worst). Every shard and block of queries is a group of its own."""

    def gather(table):
        table = table.sort_by("vec_id")
        return pa.table({"dim": table.column("dim")[:1], "region": table.column("region")[:1], "block": table.column("block")[:1], "query_ids": [table.column("vec_id").to_numpy().tobytes()], "queries": [np.array(table.column("v").to_pylist()).tobytes()], "worst": [table.column("worst").to_numpy().tobytes()]})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (x for b in batches for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
            ids, asked, dim = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["query_ids"], np.int64), r["dim"]
            found, score, visited = search(ids, np.frombuffer(r["vectors"]).reshape(-1, dim), space[dim].top, np.frombuffer(r["tree"], np.int64), np.frombuffer(r["nodes"]).reshape(-1, 9), asked, np.frombuffer(r["queries"]).reshape(-1, dim), np.frombuffer(r["worst"]), k, factor)
            keep = ~np.isneginf(score)
            n = int(keep.sum())
            yield pa.RecordBatch.from_pydict({"query_id": np.concatenate([np.repeat(asked, keep.sum(1)), asked]), "vec_id": pa.array([*found[keep].tolist(), *[None] * len(asked)], pa.int64()), "score": pa.array([*score[keep].tolist(), *[None] * len(asked)], pa.float64()), "visited": np.concatenate([np.zeros(n, np.int64), visited])})

    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.groupBy("dim", "region", "block").applyInArrow(gather, "dim int, region int, block long, query_ids binary, queries binary, worst binary")
    return asked.join(trees, ["dim", "region"]).mapInArrow(find, "query_id long, vec_id long, score double, visited long")


def nearest(scratch: Scratch, vectors: DataFrame, is_query, k: int = 20, factor: float = FACTOR, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, its k nearest other rows.

    Rows that are not usable take no part. Vectors are compared only with vectors of the same dimension.
    Rows with the query's own vec_id are never its neighbours; rows that repeat a query's vec_id are one
    query, of the shortest and then least vector; other repeated rows are candidates each. Equal scores:
    smaller vec_id first. An empty table gives none. Other columns are not read.
    """
    rows = usable(vectors.select("vec_id", column, is_query.alias("is_query")), column).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"), F.size(column).alias("dim"), "is_query")
    rows = scratch.table(rows.withColumn("at", F.monotonically_increasing_id()), "vectors")
    asked = scratch.table(rows.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("x.dim", "vec_id", "x.v"), "queries")
    space, blocks = spaces(rows), -(-asked.count() // BLOCK) or 1

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in _matrices(batches):
            d = space[dim].distances(lifted(v, space[dim].top))
            region = d.argmin(1)
            yield from own.append_column("region", pa.array(region.astype(np.int32))).append_column("distance", pa.array(d[np.arange(len(d)), region])).to_batches()

    placed = scratch.table(rows.select("dim", "vec_id", "v", "at").mapInArrow(nearby, "dim int, vec_id long, v array<double>, at long, region int, distance double"), "placed")
    regions = placed.groupBy("dim", "region").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.ceil(F.count(F.lit(1)) / SHARD).alias("parts"))
    for x in space.values():
        x.low, x.high = np.full(len(x.pivots), np.inf), np.full(len(x.pivots), -np.inf)  # an empty region is never searched
    for r in (regions := scratch.table(regions, "regions")).collect():
        space[r["dim"]].low[r["region"]], space[r["dim"]].high[r["region"]] = r["low"], r["high"]

    def index(table):
        table = table.sort_by([("vec_id", "ascending"), ("at", "ascending")])
        v = np.array(table.column("v").to_pylist())
        order, nodes = build(lifted(v, space[table.column("dim")[0].as_py()].top))
        return pa.table({**{c: table.column(c)[:1] for c in ("dim", "region", "part")}, "ids": [table.column("vec_id").to_numpy().tobytes()], "vectors": [v.tobytes()], "tree": [order.tobytes()], "nodes": [nodes.tobytes()]})

    # At most REGIONS rows of each dimension.
    trees = placed.join(F.broadcast(regions.select("dim", "region", "parts")), ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")))
    trees = trees.select("dim", "region", "part", "vec_id", "v", "at").groupBy("dim", "region", "part").applyInArrow(index, "dim int, region int, part long, ids binary, vectors binary, tree binary, nodes binary")
    trees = scratch.table(trees, "trees")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in _matrices(batches):
            d = np.where(np.isinf(space[dim].low), np.inf, space[dim].distances(unit(v)))
            yield from own.append_column("region", pa.array(d.argmin(1).astype(np.int32))).append_column("worst", pa.array(np.full(len(d), -np.inf))).to_batches()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in _matrices(batches):
            worst, s = own.column("worst").to_numpy(), space[dim]
            near = s.bounds(v) * factor <= reach(worst, np.linalg.norm(v, axis=1), s.top)[:, None]
            near[np.arange(len(v)), own.column("region").to_numpy()] = False
            query, region = np.nonzero(near & ~np.isinf(s.low))
            for i in range(0, len(query), 1000):
                part = own.take(pa.array(query[i : i + 1000]))
                yield from part.set_column(part.schema.get_field_index("region"), "region", pa.array(region[i : i + 1000].astype(np.int32))).to_batches()

    asked_of = "dim int, vec_id long, v array<double>, region int, worst double"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = scratch.table(asked.select("dim", "vec_id", "v").mapInArrow(home, asked_of), "home")
    near = scratch.table(searched(first, trees, space, blocks, k, factor), "near")
    kth = near.filter("vec_id is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    again = first.join(kth, "vec_id", "left").select("dim", "vec_id", "v", "region", F.coalesce("kth", "worst").alias("worst")).mapInArrow(others, asked_of)
    far = scratch.table(searched(again, trees, space, blocks, k, factor), "far")
    found = near.unionByName(far).filter("vec_id is not null")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited(scratch: Scratch) -> int:
    """Inner products that nearest() computed with this scratch folder, over all queries."""
    own = "query_id long, vec_id long, score double, visited long"
    tables = [scratch.spark.read.schema(own).parquet(scratch.path(name)) for name in ("near", "far")]
    return tables[0].unionByName(tables[1]).agg(F.sum("visited")).first()[0] or 0
