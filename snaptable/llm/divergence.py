"""Divergence of sources by their terms, over frequent-pattern trees of term rows (operator 13).

A language keeps the terms of at least `least` of its documents. A kept term is a row: its nonzero counts by
source, sources in order of their totals. Rows are inserted into a tree whose nodes are (source, count), so
rows that begin alike share a path and only add to its multiplicities. With a source's rate p0 of a term that it
lacks, a pair's sum over all V terms is

    V * f(p0, q0)                                     as if both lacked every term
    + sum of f(p, q0) - f(p0, q0) over p's terms      and the same for q's
    + sum of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) over terms of both

and the last sum is taken once for each node and ancestor of it, times the node's multiplicity. Sums are of
integers, so a tree can be cut anywhere: each task builds trees of the range of rows it holds.

A term's row has an entry a source at most. What is returned for pairs is quadratic in the sources of a language,
and each source meets the others of its language in blocks for that; nothing else is quadratic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import batch_blocks
from .scratch import Scratch, tidied

#: A term of a lower-cased text in UTF-8: letters and all beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of a language that a kept term is in, at least; ranks of terms that are returned.
LEAST, TOP = 10, 10
SCALE = 1_000_000_000
#: Entries of a task's counts, nodes of a task's tree, and pairs of sources held before they are sent on.
ENTRIES, NODES, HELD = 400_000, 200_000, 500_000
#: An entry is occurrences + documents * DOCUMENT.
DOCUMENT = 1 << 40
#: Sources of a block, about.
BLOCK = 512


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); rates are at most SCALE + 1, so squares fit in 64 bits."""
    return (p - q) * (p - q) // (p + q)


def rate(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exact for any long; total is a source's N + 2 * V, over 0."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    # IntegralDivide of decimals gives a long.
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, added up by task; and a row with null term for each
    group, whether it has terms or not."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), terms in found.items():
                n, entries = len(terms) + 1, np.array([0, *terms.values()], np.int64)
                columns = {"lang": pa.array([own_lang] * n), "source": pa.array([own_source] * n), "term": pa.array([None, *terms], pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_pydict({**columns, "n": pa.array(entries % DOCUMENT), "docs": pa.array(entries // DOCUMENT)})

        for batch in (x for b in batches for x in batch_blocks(b, rows=2_000)):
            for words, *group in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("lang", "source")), strict=True):
                own = found.setdefault((group[0], group[1]), {})
                size -= len(own)
                for w, n in Counter(TERM.findall(words.lower())).items():
                    own[w] = own.get(w, 0) + n + DOCUMENT
                size += len(own)
                if size > ENTRIES:
                    yield from sent()
                    found, size = {}, 0
        yield from sent()

    own = "lang string, source string, term string, n long, docs long"
    parts = docs.select(text, lang, source).mapInArrow(tidied(count), own)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Tree:
    """Term rows as a prefix tree. Node 0 is the root; the rest have a source, its two rates and a multiplicity."""

    def __init__(self):
        self.children: dict[tuple[int, str, int], int] = {}
        self.parent, self.source, self.p, self.p0, self.times = [0], [""], [0], [0], [0]

    def insert(self, row: list[tuple[str, int, int]], times: int) -> None:
        """row: (source, p, p0) of the term's sources, in their order."""
        at = 0
        for source, p, p0 in row:
            child = self.children.get((at, source, p))
            if child is None:
                child = self.children[at, source, p] = len(self.parent)
                self.parent.append(at)
                self.source.append(source)
                self.p.append(p)
                self.p0.append(p0)
                self.times.append(0)
            self.times[child] += times
            at = child

    def corrections(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """names, then a, b (numbers of names) and correction: for nodes with an ancestor of that rank above them, one rank
        at a time, nodes of the same two sources added up."""
        names, source = np.unique(np.array(self.source, dtype=object), return_inverse=True)
        parent, p, p0, times = (np.array(x, np.int64) for x in (self.parent, self.p, self.p0, self.times))
        node = np.arange(1, len(parent))
        above = parent[node]
        while True:
            node, above = node[above > 0], above[above > 0]
            if not len(node):
                return
            own = distance(p[node], p[above]) - distance(p[node], p0[above]) - distance(p0[node], p[above]) + distance(p0[node], p0[above])
            pairs, at = np.unique(source[node] * len(names) + source[above], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, own * times[node])
            yield names, pairs // len(names), pairs % len(names), sums
            above = parent[above]


def _both_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a sorted range of rows(lang, items, times): lang, a, b, value for pairs of sources with terms in common."""
    lang, tree, held = None, Tree(), {}

    def summed() -> None:
        for names, a, b, value in tree.corrections():
            for x, y, v in zip(names[a], names[b], value.tolist(), strict=True):
                key = (lang, x, y) if x < y else (lang, y, x)
                held[key] = held.get(key, 0) + v

    def sent() -> Iterator[pa.RecordBatch]:
        if held:
            names, a, b = (pa.array(x, pa.string()) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_pydict({"lang": names, "a": a, "b": b, "value": pa.array(held.values(), pa.int64())})
            held.clear()

    for batch in batches:
        sources, p, p0 = (batch.column("items").flatten().field(c).to_pylist() for c in ("source", "p", "p0"))
        start = 0
        for own, size, times in zip(batch.column("lang").to_pylist(), batch.column("items").value_lengths().to_pylist(), batch.column("times").to_pylist(), strict=True):
            if own != lang or len(tree.parent) > NODES:
                summed()
                lang, tree = own, Tree()
                if len(held) > HELD:
                    yield from sent()
            row, start = slice(start, start + size), start + size
            tree.insert(list(zip(sources[row], p[row], p0[row], strict=True)), times)
    summed()
    yield from sent()


def _one_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows(lang, source, p0, v, rates: {p, times}, others: {source, p0}): lang, a, b, value: what a's terms add
    against each b that lacks them; and once, for a < b, what both have if they lack all."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            p, times = (np.array([r[c] for r in row["rates"]], np.int64) for c in ("p", "times"))
            others = sorted((x["source"], x["p0"]) for x in row["others"] if x["source"] != row["source"])
            values = []
            for b, q0 in others:
                none = int(distance(np.int64(row["p0"]), np.int64(q0))) if row["v"] else 0
                own = int(((distance(p, np.int64(q0)) - none) * times).sum()) if len(p) else 0
                values.append(own + (row["v"] * none if row["source"] < b else 0))
            if others:
                names = [(row["source"], b) if row["source"] < b else (b, row["source"]) for b, _ in others]
                yield pa.RecordBatch.from_pydict({"lang": [row["lang"]] * len(others), "a": [a for a, _ in names], "b": [b for _, b in names], "value": pa.array(values, pa.int64())})


PAIRS = "lang string, a string, b string, value long"


def audit(scratch: Scratch, docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: how far a source's rates of its language's kept terms are from each other source's, all ranks.
    Part `term`: the terms that a source has more of than its language, the first `top` by value. Ranks begin at 1
    for each source and part, values descending, then items ascending by their UTF-8.

    Null text, lang and source count as ''. Texts of any length count whole; repeated rows count each. A source without
    kept terms has rates too, and where a language keeps none all its pairs are 0. A source that is alone in its
    language has no pairs; an empty table gives none. Other columns are not read.
    """
    counts = scratch.table(term_counts(docs), "counts")
    entries = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    kept = scratch.table(entries.filter(F.col("docs") >= least).drop("docs"), "kept")
    each = kept.select("lang", "term", F.col("n").alias("all"), F.explode("sources").alias("x")).select("lang", "term", "all", "x.source", "x.n")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    groups = counts.filter("term is null").select("lang", "source").join(each.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    groups = groups.withColumn("d", F.col("total") + 2 * F.col("v")).withColumn("lang_d", F.col("lang_n") + 2 * F.col("v"))
    groups = scratch.table(groups.withColumn("p0", F.when(F.col("v") > 0, rate(F.lit(0).cast("long"), F.col("d"))).otherwise(0)), "groups")

    rated = each.join(groups, ["lang", "source"]).select("lang", "term", "source", "total", "n", rate(F.col("n"), F.col("d")).alias("p"), "p0", rate(F.col("all"), F.col("lang_d")).alias("q"))
    rated = scratch.table(rated, "rated")

    items = rated.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("total", "source", "p", "p0"))).alias("items"))
    rows = items.groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    both = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items").mapInArrow(tidied(_both_corrections), PAIRS)

    rates = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("rates"))
    ones = groups.select("lang", "source", "p0", "v").join(rates, ["lang", "source"], "left").withColumn("rates", F.coalesce("rates", F.array().cast("array<struct<p:bigint,times:bigint>>")))
    blocks = groups.select("lang", F.struct("source", "p0").alias("x")).join(groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "lang")
    blocks = blocks.groupBy("lang", F.pmod(F.xxhash64("x.source"), F.col("blocks")).alias("block")).agg(F.collect_list("x").alias("others"))
    one = ones.join(blocks.select("lang", "others"), "lang").mapInArrow(_one_corrections, PAIRS)

    pairs = scratch.table(both.unionByName(one).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = rated.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).filter(F.col("rank") <= top))


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {WORDS} AS words FROM documents),
words AS MATERIALIZED (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST}),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM n WHERE n.lang = g.lang AND n.source = g.source), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n.n, 0) + 2)) // (g.total + 2 * g.v) AS p FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM n GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= {TOP}"""
