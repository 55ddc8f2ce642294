"""Near-duplicate documents by bottom-k sketches (operator 9).

Every text becomes the set of its hashed word shingles, and the k smallest hashes of one hash function are
its sketch. Equal sets are one class. Inverted lists of retained values give classes that overlap; the
smallest k values of two sketches' union estimate the similarity and drop most pairs; full sets decide.

No link is lost to list sizes. A pair at the threshold shares at least `t` values of its sketches (but for
a chance of about 1e-8), so a class is listed only under its rarest values, all but t - 1 of them. A list
is not turned into all its pairs: a pivot of each list is held against the others in several rounds, each
with other pivots, and only lists that still hold several components go on. What they hold in the end
is compared by an exact prefix filter on the full sets. Links inside a component change nothing and are
left out. Sketches and sets are tables in the shared folder; no list or link comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .encode import batch_blocks
from .scratch import Scratch, fresh, tidied

WORDS, PERCENT = 5, 75
K = 48
#: Least number of values that two sketches of K share at the threshold, 5.8 standard deviations below 36.
T = 19
ROUNDS = 3

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: xor-shifts and odd multipliers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of hashed shingles of texts, sorted; a chunk's distinct words are hashed once."""

    def __init__(self, size: int = WORDS):
        self.size = size

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        import xxhash

        words = [(t or "").encode().lower().split() for t in texts]
        ids = {w: i for i, w in enumerate(set().union(*words))}
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
        at = ids.__getitem__
        for own in words:
            h = hashes[np.fromiter(map(at, own), np.int64, len(own))]
            yield self.shingles(h)

    def shingles(self, h: np.ndarray) -> np.ndarray:
        n = min(self.size, len(h))
        if not n:
            return np.zeros(0, np.int64)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _P + h[i : len(h) - n + 1 + i])
        return np.unique(out.view(np.int64))


def sketched(docs: DataFrame, k: int = K, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set), sketch (the k smallest, as bytes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(size)
        for b in (x for batch in batches for x in batch_blocks(batch, "text", 8_000_000, 10_000)):
            sets = list(shingler.sets(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "print": pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), "sketch": pa.array([s[:k].tolist() for s in sets], pa.list_(pa.int64()))}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, print binary, sketch array<long>")


def full_sets(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """print, shingles (bytes) of the texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(size)
        for b in (x for batch in batches for x in batch_blocks(batch, "text", 8_000_000, 10_000)):
            sets = [s.tobytes() for s in shingler.sets(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"print": pa.array([xxhash.xxh128_digest(s) for s in sets], pa.binary()), "shingles": pa.array(sets, pa.binary())})

    return docs.select("text").mapInArrow(tidied(run), "print binary, shingles binary")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, t: int) -> DataFrame:
    """Pairs (a, b) whose union sketch lets them be at the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("sketch_a", "sketch_b"))
            good = []
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                union = np.union1d(p, q)[:k]
                both = np.intersect1d(np.intersect1d(p, q, assume_unique=True), union, assume_unique=True)
                whole = len(p) < k and len(q) < k
                good.append(100 * len(both) >= PERCENT * len(np.union1d(p, q)) if whole else len(both) >= min(t, len(union)))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    own = classes.select("rep", "sketch")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(own.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(tidied(keep), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets meet the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            good = []
            for p, q in zip(x, y, strict=True):
                shared = _shared(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64))
                good.append(100 * shared >= PERCENT * ((len(p) + len(q)) // 8 - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(tidied(keep), "a long, b long")


def _prefix_lists(scratch: Scratch, values: DataFrame, needed, name: str) -> DataFrame:
    """value, often, rep, n, left: under its rarest shared values, all but needed - 1, from values(value, rep,
    n, size). often: sets with the value; left: values of the set from this one on, rarest first. Counts are a
    table of their own, so that the join with them can split the sets of a very common value."""
    often = scratch.table(values.groupBy("value").count().filter("count > 1"), name)
    found = values.join(often, "value").groupBy("rep").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("count", "value"))).alias("found"))
    kept = F.size("found") - needed + 1
    lists = found.filter(kept > 0).select("rep", "n", F.size("found").alias("shared"), F.posexplode(F.slice("found", F.lit(1), kept)).alias("at", "x"))
    return lists.select("x.value", F.col("x.count").alias("often"), "rep", "n", (F.col("shared") - F.col("at")).alias("left"))


def _in_several(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The lists that hold several components, with comp of each member. Of lists with the same members
    (told by count, sum and xor of their hashes) the one of the rarest value goes on, as the others give the
    same pairs."""
    if comps is None:
        named = lists.withColumn("comp", F.col("rep"))
    else:
        named = lists.drop("comp").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    own = F.xxhash64("rep")
    signs = [F.count(F.lit(1)).alias("members"), F.sum(F.shiftright(own, 12)).alias("total"), F.bit_xor(own).alias("xor")]
    several = named.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.first("often").alias("often"), *signs).filter("low < high")
    return named.join(several.groupBy("members", "total", "xor").agg(F.min(F.struct("often", "value")).alias("x")).select("x.value"), "value")


def _merged_labels(scratch: Scratch, labels: DataFrame | None, found: DataFrame, name: str) -> DataFrame:
    """node, comp after new links; only links between components are followed."""
    if labels is None:
        return components(scratch, found, name)
    ends = found
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")), c, "left").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))
    moved = components(scratch, ends.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).filter("a <> b"), name)
    both = labels.unionByName(moved.select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
    moved = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return scratch.table(both.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{name}-labels")


def linked(scratch: Scratch, docs: DataFrame, k: int = K, t: int = T, rounds: int = ROUNDS, size: int = WORDS, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text, ...).

    A text without words (or null) has no shingles and is its own component. Rows that repeat a doc_id are
    one document with several texts: all of them link it, and they share a component. A null doc_id has no
    component and is kept. Texts of any length count whole; an empty table gives an empty one; other columns
    are not read. With exact, sketches are left out and the prefix filter on full sets compares all classes:
    nothing rests on chance then, but every shingle of every class is shuffled.
    """
    rows = scratch.table(sketched(docs, k, size), "sketches")
    named = rows.filter("doc_id is not null and n_shingles > 0")
    # A class is known by a number, as its texts may share a doc_id with those of another one.
    classes = named.groupBy("print").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    members = scratch.table(named.select("doc_id", "print").join(classes.select("print", "rep"), "print").select("doc_id", "rep").distinct(), "members")
    if exact:
        comps = _merged_labels(scratch, None, _exact_rest(scratch, classes.select("rep", F.col("rep").alias("comp")), _sets_of(scratch, docs, classes, size)), "comps")
    else:
        comps = _sketch_links(scratch, docs, classes, k, t, rounds, size)
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a")
    several = members.join(several, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    if not several.isEmpty():
        comps = _merged_labels(scratch, comps, several, "repeated")
    # The smallest doc_id of each component, then of each class and document that has another name.
    own = classes.select("rep", "low").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left") if comps is not None else classes.select("rep", "low", F.col("rep").alias("comp"))
    own = own.withColumn("comp", F.coalesce("comp", "rep"))
    least = own.groupBy("comp").agg(F.min("low").alias("component_id"))
    moved = members.join(own.join(least, "comp").select("rep", "component_id"), "rep").filter("doc_id <> component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(moved, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets_of(scratch: Scratch, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """rep, n, shingles of classes(print, rep, low, n): one set each, from the texts of its smallest doc_id."""
    text = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(classes.select("low").distinct(), "low", "left_semi")
    return scratch.table(full_sets(text, size).join(classes.select("print", "rep", "n"), "print").dropDuplicates(["print"]).select("rep", "n", "shingles"), "sets")


def _sketch_links(scratch: Scratch, docs: DataFrame, classes: DataFrame, k: int, t: int, rounds: int, size: int) -> DataFrame | None:
    """node, comp of linked classes, or None."""
    values = classes.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    needed = F.least(F.lit(t), F.ceil(F.col("size") * PERCENT / 100)).cast("int")
    lists = scratch.table(_prefix_lists(scratch, values, needed, "often"), "prefixes")
    longest = scratch.table(lists.groupBy("value").agg(F.count(F.lit(1)).alias("members")), "list-sizes")
    reach = lists.join(longest, "value").groupBy("rep").agg(F.sum("members").alias("reach")).join(classes.select("rep", "low"), "rep")
    lists = scratch.table(_in_several(lists.join(reach, "rep"), None), "lists")
    sets = _sets_of(scratch, docs, classes.join(lists.select("rep").distinct(), "rep", "left_semi"), size)

    comps = None
    for number in range(rounds):
        # First those in the longest lists, as an original is among its copies, then the smallest, then any.
        order = -F.col("reach") if number == 0 else F.lit(0).cast("long") if number == 1 else F.xxhash64("low", F.lit(number))
        pivot = scratch.table(lists.groupBy("value").agg(F.min_by(F.struct("rep", "n", "comp"), F.struct(order, "low", "rep")).alias("p")), f"pivots-{number}")
        pairs = lists.join(pivot, "value").filter((F.col("comp") != F.col("p.comp")) & (100 * F.least("n", "p.n") >= PERCENT * F.greatest("n", "p.n")))
        pairs = pairs.groupBy(F.col("rep").alias("a"), F.col("p.rep").alias("b")).count()
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
        pairs = scratch.table(_estimated(pairs, classes, k, t), f"pairs-{number}")
        found = scratch.table(_verified(pairs, sets), f"links-{number}")
        if found.isEmpty():
            break
        comps = _merged_labels(scratch, comps, found, f"comps-{number}")
        lists = scratch.table(_in_several(lists, comps), f"lists-{number}")
        if lists.isEmpty():
            break
    if not lists.isEmpty():
        rest = scratch.table(lists.groupBy("rep").agg(F.first("comp").alias("comp")), "rest")
        comps = _merged_labels(scratch, comps, _exact_rest(scratch, rest, sets), "comps")
    return comps


def _exact_rest(scratch: Scratch, rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components of rest(rep, comp). A pair at the threshold shares one of the
    rarest quarter of either's shingles, so each set is listed under those only. The first one they share
    leaves enough of both sets to meet the threshold, so others are no candidates; that keeps sets of one
    common passage apart. Of the smaller set it lies in the rarest seventh. Sets meet by class of size, too,
    of which the larger one's is the same or the next."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = np.frombuffer(row["shingles"], np.int64)
                for i in range(0, len(s), 10_000):
                    part = s[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({"rep": np.full(len(part), row["rep"]), "n": np.full(len(part), row["n"]), "value": part})

    values = sets.join(rest, "rep").select("rep", "n", "shingles").mapInArrow(tidied(spread), "rep long, n long, value long")
    values = scratch.table(values.withColumn("size", F.col("n")), "rest-values")
    exact = _prefix_lists(scratch, values, F.ceil(F.col("size") * PERCENT / 100).cast("int"), "rest-often")
    exact = scratch.table(_in_several(exact.drop("comp"), rest.select(F.col("rep").alias("node"), "comp")), "rest-lists")
    both, size = 100 + PERCENT, F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
    x = exact.withColumn("class", F.explode(F.array(size, size - 1))).alias("x")
    y = exact.filter(both * F.col("left") >= 2 * PERCENT * F.col("n")).withColumn("class", size).alias("y")
    smaller = "(y.n < x.n or y.n = x.n and y.comp < x.comp) and y.comp <> x.comp"
    enough = f"{both} * least(x.left, y.left) >= {PERCENT} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"x.value = y.value and x.class = y.class and {smaller} and {enough}"))
    pairs = scratch.table(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "rest-pairs")
    return scratch.table(_verified(pairs, sets), "rest-links")


def without_near_copies(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; columns as they were."""
    name = fresh("dropped", docs.columns)
    dropped = linked(scratch, docs).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*docs.columns)


#: Every pair of documents with a shingle in common is counted, so it is for small tables.
ORACLE = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM d, range(1, greatest(len(w) - 4, 1) + 1) t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
