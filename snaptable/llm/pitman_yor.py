"""A hierarchical Pitman-Yor language model of word pairs, sampled by Gibbs (operator 2).

Each context, a previous word, is a restaurant whose customers are the words seen after it. All contexts
share one parent, the restaurant of single words, whose customers are the contexts' tables and whose base is
uniform over the known words and one unknown. Words are told apart by 64-bit hashes.

Texts never travel. A chunk of texts is written once as numbers and sends only its distinct pairs of words,
with their customers, to the bucket of their context; so a restaurant lies whole in one bucket. A context
with much more than its share of the tokens is split: its pairs go to the buckets of their words, and what
it holds in all, a few numbers, is known to every task. A bucket also owns the parent's words hashed to it:
the buckets tell a word's owner how many tables they have for it, and the owner seats them in the parent and
answers. A pair with one customer has one table, so only the others are drawn and only their words are told.

The first seating gives every pair and every word of the parent one table. SCANS scans follow in SAMPLES
chains: in each a bucket goes through its pairs SWEEPS times, a random half of them and then the other, and
draws the tables of all customers of a pair at once (`drawn`), by their distribution given the parent and what
the context's other pairs held before that half was drawn; then owners draw the parent's, given the buckets'. Within
a half, pairs of a context do not see each other's draws: tests hold the outcome against seating one by one. At
the end a bucket answers each chunk with the counts of the pairs, contexts and words that it asked about, in its
own order; the chunk averages the predictive probabilities over the chains and adds up its documents.

All that is written or sent is linear in the input: distinct pairs of chunks and of buckets.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import batch_blocks
from .scratch import Scratch, give_back, tidied
from .toxicity import remainder

#: A word with more than this share of a chunk's tokens is counted when contexts to split are sought.
LOOK = 1 / 20_000
#: Contexts that are split at most: those with over a quarter of a bucket's tokens and 1 / MOST_SPLIT of all.
MOST_SPLIT = 20_000
#: Tokens that a bucket stands for on average.
BUCKET_TOKENS = 3_000_000
#: Bytes of text that are numbered together.
CHUNK_BYTES = 26_000_000
#: Customers up to which tables are drawn by exact weights; beyond, by their limit law.
EXACT = 1024
#: Customers up to which weights are products in double precision, not sums of logarithms.
PLAIN = 24
SCANS, SAMPLES = 3, 3
#: Times that a bucket draws all its pairs in a scan.
SWEEPS = 4
DISCOUNT, STRENGTH = (0.6, 0.8), (50.0, 1.0)  # of the parent, of the contexts
END = b"\n"

BLOB = "kind int, bucket long, peer long, values binary, sums array<double>"
SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("peer", pa.int64()), ("values", pa.binary()), ("sums", pa.list_(pa.float64()))])
#: Kinds of rows. Of a chunk (bucket: its number): tokens, where its words belong, what it sends to a bucket and hears from it (peer).
TOKENS, WORDS, SENT, HEARD = range(4)
#: Of a bucket: customers, pairs to draw, their tables, places of a chunk's pairs (peer).
KEPT, DRAW, TABLES, PLACES = range(4, 8)
#: Between a bucket and an owner (peer): words told about, its own contexts, tables of its words, the owner's answer; the owner's words.
TOLD, OWN_KINDS, TELLS, ANSWERS, OWNED = range(8, 13)
#: Sums: of all, of split contexts, of split contexts' words in the parent (bucket: their number).
TOTAL, SPLIT_CONTEXT, SPLIT_WORD = range(13, 16)


def _packed(x: dict) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(b: bytes) -> dict:
    return pickle.loads(pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True))


def _row(kind: int, bucket: int, peer: int, x: dict) -> dict:
    return {"kind": kind, "bucket": int(bucket), "peer": int(peer), "values": _packed(x), "sums": None}


def _sums(kind: int, bucket: int, sums) -> dict:
    return {"kind": kind, "bucket": int(bucket), "peer": -1, "values": None, "sums": [float(x) for x in sums]}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, SCHEMA)


def _read(table: pa.Table) -> dict[int, list[tuple[int, int, dict]]]:
    """(bucket, peer, values) by kind, in order of bucket and peer."""
    out: dict[int, list] = {}
    for r in table.to_pylist():
        out.setdefault(r["kind"], []).append((r["bucket"], r["peer"], _unpacked(r["values"])))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in out.items()}


def _tidy(run):
    """run for applyInArrow; memory is given back after each group."""

    def tidy(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return tidy


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as their differences; np.cumsum gives them back."""
    return _narrow(np.diff(x, prepend=0))


def _walked(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of numbers, all first ones first: they compress better."""
    x = _narrow(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.copy()


def _whole(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view(np.dtype(f"u{len(x)}"))[:, 0].astype(np.int64)


def _hashed(words) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Numbers(dict):
    """Numbers new keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


@dataclass(frozen=True)
class Deal:
    """Which bucket a context, and which owner a word, belongs to."""

    buckets: int
    split: np.ndarray  # hashes of split contexts, ascending

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def split_number(self, hashes: np.ndarray) -> np.ndarray:
        """Places in split, -1 for others."""
        if not len(self.split):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.split, hashes), len(self.split) - 1)
        return np.where(self.split[at] == hashes, at, -1)


def dealt(docs: DataFrame) -> tuple[Deal, int]:
    """How contexts are dealt out, and the number of tokens. At most 2 * MOST_SPLIT words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in batch_blocks(batch, "text", 8_000_000, 10_000)):
            words: dict[bytes, int] = {}
            for t in b.column("text").to_pylist():
                for w in (t or "").encode().lower().split():
                    words[w] = words.get(w, 0) + 1
            words[END] = b.num_rows
            n = sum(words.values())
            often = {w: c for w, c in words.items() if c > n * LOOK}
            yield pa.RecordBatch.from_pydict({"word": pa.array([0, *_hashed(often).view(np.int64).tolist()], pa.int64()), "all": [True] + [False] * len(often), "n": pa.array([n, *often.values()], pa.int64())})

    found = docs.select("text").mapInArrow(tidied(run), "word long, all boolean, n long").groupBy("all", "word").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.desc("all"), F.desc("n")).limit(2 * MOST_SPLIT).collect()
    tokens = sum(r["n"] for r in found if r["all"])
    buckets = max(8, -(-tokens // BUCKET_TOKENS))
    least = max(tokens / (4 * buckets), tokens / MOST_SPLIT)
    split = np.array([r["word"] for r in found if not r["all"] and r["n"] > least], np.int64).view(np.uint64)
    return Deal(buckets, np.sort(split)), tokens


# --- chunks


CHUNKS = "chunk long, tokens binary, words binary, places binary"


def numbered(docs: DataFrame, deal: Deal) -> DataFrame:
    """Chunks of texts from docs(doc_id, text, train): tokens, their words' hashes, and where those belong."""

    def pack(number: int, ids: list, train: list, own: list[np.ndarray], names: Numbers) -> pa.RecordBatch:
        hashes = _hashed(names)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.array([len(x) for x in own])
        tokens = {"ids": np.array([i or 0 for i in ids], np.int64), "null": np.array([i is None for i in ids]), "train": np.array(train, bool), "lengths": _narrow(lengths), "tokens": _planes(rank[np.concatenate(own)])}
        places = {"place": _narrow(deal.place(hashes[order])), "split": deal.split_number(hashes[order]).astype(np.int16)}
        return pa.RecordBatch.from_pydict({"chunk": [number], "tokens": [_packed(tokens)], "words": [_packed({"hashes": hashes[order]})], "places": [_packed(places)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 24, 0, ([], [], [], Numbers({END: 0}))
        for b in (x for batch in batches for x in batch_blocks(batch)):
            ids, train, own, names = held
            ids += b.column("doc_id").to_pylist()
            train += b.column("train").to_pylist()
            for t in b.column("text").to_pylist():
                words = (t or "").encode().lower().split()
                size += len(t or "")
                words.append(END)
                own.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
            if size > CHUNK_BYTES:
                yield pack(number, *held)
                number, size, held = number + 1, 0, ([], [], [], Numbers({END: 0}))
        if held[0]:
            yield pack(number, *held)

    return docs.select("doc_id", "text", "train").mapInArrow(tidied(run), CHUNKS)


@dataclass
class Chunk:
    """A chunk's tokens and its distinct pairs, by bucket, context and word."""

    tokens: np.ndarray  # places of words by hash
    lengths: np.ndarray
    split: np.ndarray  # number of each word among split contexts, or -1
    context: np.ndarray  # of each pair
    word: np.ndarray
    bucket: np.ndarray
    pair_of: np.ndarray  # pair of each token

    @classmethod
    def of(cls, r: dict, places: dict) -> Chunk:
        tokens, place, split = _whole(r["tokens"]), places["place"].astype(np.int64), places["split"].astype(np.int64)
        before = np.empty_like(tokens)
        before[1:], before[0] = tokens[:-1], tokens[-1]  # a text ends where the next begins, with END
        codes, pair_of = np.unique(before * len(place) + tokens, return_inverse=True)
        context, word = np.divmod(codes, len(place))
        bucket = np.where(split[context] >= 0, place[word], place[context])
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return cls(tokens, r["lengths"].astype(np.int64), split, context[order], word[order], bucket[order], back[pair_of])

    def runs(self) -> Iterator[tuple[int, slice]]:
        """Each bucket's pairs."""
        cuts = [*np.flatnonzero(np.diff(self.bucket, prepend=-1)).tolist(), len(self.bucket)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield int(self.bucket[a]), slice(a, z)


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.diff(x, prepend=x[:1] - 1)) if len(x) else np.zeros(0, np.int64)


def sent(chunks: DataFrame) -> DataFrame:
    """Every chunk's distinct pairs and their training tokens, a row for each bucket."""

    def pairs(r: dict) -> Iterator[dict]:
        own, hashes = _unpacked(r["tokens"]), _unpacked(r["words"])["hashes"]
        c = Chunk.of(own, _unpacked(r["places"]))
        customers = np.bincount(c.pair_of, np.repeat(own["train"], c.lengths), len(c.word)).astype(np.int64)
        for bucket, part in c.runs():
            context, first = c.context[part], _new(c.context[part])
            known, at = np.unique(c.word[part], return_inverse=True)
            yield _row(SENT, bucket, r["chunk"], {"kinds": hashes[context[first]], "runs": _narrow(np.diff([*first, len(context)])), "words": hashes[known], "at": _narrow(at), "customers": _narrow(customers[part])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            rows: list[dict] = []
            for row in pairs(chunk.to_pylist()[0]):
                rows.append(row)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return chunks.select("chunk", "tokens", "words", "places").mapInArrow(tidied(run), BLOB)


# --- buckets


def merged(pairs: DataFrame, deal: Deal) -> DataFrame:
    """What buckets keep, draw and tell owners, from the chunks' pairs. Every pair has one table."""

    def merge(table: pa.Table) -> pa.Table:
        parts = _read(table)[SENT]
        bucket = parts[0][0]
        kinds, kind_at = np.unique(np.concatenate([x["kinds"] for *_, x in parts]), return_inverse=True)
        words, word_at = np.unique(np.concatenate([x["words"] for *_, x in parts]), return_inverse=True)
        kind_cuts = np.cumsum([len(x["kinds"]) for *_, x in parts])[:-1]
        kind_at, word_at = np.split(kind_at, kind_cuts), np.split(word_at, np.cumsum([len(x["words"]) for *_, x in parts])[:-1])
        codes = [np.repeat(k, x["runs"]) * len(words) + w[x["at"]] for k, w, (*_, x) in zip(kind_at, word_at, parts, strict=True)]
        pairs, pair_at = np.unique(np.concatenate(codes), return_inverse=True)
        customers = np.bincount(pair_at, np.concatenate([x["customers"] for *_, x in parts])).astype(np.int64)
        rows = [_row(PLACES, bucket, chunk, {"pairs": _steps(p), "kinds": _steps(k)}) for p, k, (_, chunk, _) in zip(np.split(pair_at, np.cumsum([len(x) for x in codes])[:-1]), kind_at, parts, strict=True)]
        kind, word = np.divmod(pairs, len(words))
        number, drawn_ = deal.split_number(kinds), customers > 1
        below = np.bincount(kind, customers, len(kinds)).astype(np.int64)
        single = np.bincount(kind, customers == 1, len(kinds)).astype(np.int64)
        rows.append(_row(KEPT, bucket, -1, {"customers": _narrow(customers), "below": _narrow(below), "single": _narrow(single)}))
        # The parent's words, in their owners' order; those with pairs to draw are told about again and again.
        count, once, often = (np.bincount(word, x, len(words)).astype(np.int64) for x in (customers, customers == 1, drawn_))
        owner = deal.place(words)
        order = np.lexsort((words, owner))
        order = order[count[order] > 0]
        told = order[often[order] > 0]
        rank = np.full(len(words), -1)
        rank[told] = np.arange(len(told))
        owners, n_told = np.unique(owner[told], return_counts=True)
        mine, at = np.unique(kind[drawn_], return_inverse=True)
        rows.append(_row(DRAW, bucket, -1, {"kinds": _steps(mine), "below": _narrow(below[mine]), "single": _narrow(single[mine]), "split": number[mine].astype(np.int32), "context": _narrow(at), "word": _narrow(rank[word[drawn_]]), "customers": _narrow(customers[drawn_]), "owners": owners, "told": n_told}))
        for o in np.unique(owner[order]):
            own = order[owner[order] == o]
            rows.append(_row(TOLD, bucket, o, {"words": words[own], "count": _narrow(count[own]), "once": _narrow(once[own]), "often": _narrow(often[own])}))
        rows.append(_row(OWN_KINDS, bucket, bucket, {"kinds": kinds}))
        return _table(rows + [_sums(SPLIT_CONTEXT, number[i], [below[i], single[i], *[(drawn_ & (kind == i)).sum()] * SAMPLES]) for i in np.flatnonzero(number >= 0)])

    return pairs.repartition(deal.buckets, "bucket").groupBy("bucket").applyInArrow(_tidy(merge), BLOB)


@functools.cache
def partitions(d: float, size: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [c, t] weighs all seatings of c customers at t tables."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, size):
        t = np.arange(1, c + 2)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 1e-300)))
    return out


def _limit(c: np.ndarray, weight: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables but the first. Table sizes are a Poisson number of Sibuya variables, given
    their sum c; they are tilted until c is expected."""
    low, high = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(60):
        middle = (low + high) / 2
        more = weight * -np.expm1(middle) * np.exp((d - 1) * middle) > c
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    mean = weight / d * -np.expm1(d * low)
    return mean, mean - c * (c / (c + np.expm1(low) ** 2 * weight * (1 - d) * np.exp((d - 2) * low)))


def drawn(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator, step: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Tables of c customers each, drawn with chances partitions[c, t] * weight * (weight + step) * ... of t factors: those
    of Gibbs sampling where the first new table has that weight, each one more by step, and a taken one its customers - d.
    Beyond EXACT customers, the middle factor of the last number of tables stands for all."""
    if step is None:
        step, last = np.zeros(len(c)), np.ones(len(c))
    out = np.minimum(c, 1).astype(np.float64)
    size = np.minimum(c, EXACT + 1).astype(np.uint16)  # of so few bits a stable sort takes linear time
    order = np.argsort(size, kind="stable")
    order = order[np.searchsorted(size[order], 2) :]
    known, cuts = partitions(d, EXACT), [*np.flatnonzero(np.diff(size[order], prepend=0)).tolist(), len(order)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        n = int(size[order[a]])
        if n > EXACT:
            rows = order[a:]
            mean, variance = _limit(c[rows].astype(float), weight[rows] + step[rows] * (last[rows] - 1) / 2, d)
            few = 1 + rng.poisson(np.minimum(mean, 50))
            many = np.rint(mean + variance / np.maximum(mean, 1e-9) + np.sqrt(np.maximum(variance, 0)) * rng.standard_normal(len(rows)))
            out[rows] = np.clip(np.where(mean <= 50, few, many), 1, c[rows])
            break
        some = max(1, 1_000_000 // n)
        for i in range(a, z, some):
            rows = order[i : min(i + some, z)]
            factors = weight[rows, None] + step[rows, None] * np.arange(n)
            if n <= PLAIN:
                x = np.cumsum(np.exp(known[n, 1 : n + 1]) * np.cumprod(np.minimum(factors, 1e6), axis=1), axis=1)
            else:
                x = known[n, 1 : n + 1] + np.cumsum(np.log(factors), axis=1)
                x = np.cumsum(np.exp(x - x.max(1, keepdims=True)), axis=1)
            out[rows] = 1 + (rng.random(len(rows))[:, None] * x[:, -1:] >= x).sum(1)
    return np.minimum(out, c)


@dataclass
class Parent:
    """What every task knows: totals, and what split contexts and their words hold."""

    tokens: int  # in training
    known: int  # distinct words of training
    served: list[float]  # the parent's customers, by sample
    seated: list[float]  # the parent's tables, by sample
    below: np.ndarray | None = None  # customers of each split context
    single: np.ndarray | None = None  # its pairs of one customer
    tables: np.ndarray | None = None  # its tables, by sample
    count: np.ndarray | None = None  # training tokens of each split context as a word
    word_served: np.ndarray | None = None  # the parent's customers of that word, by sample
    word_seated: np.ndarray | None = None  # the parent's tables of that word, by sample

    @classmethod
    def of(cls, tables: list[DataFrame], split: int) -> Parent:
        """From the sums in tables. Spark adds them up; a few numbers for each split context come to the driver."""
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        found = rows.filter(F.col("kind") >= TOTAL).select("kind", "bucket", F.posexplode("sums").alias("at", "x")).groupBy("kind", "bucket", "at").agg(F.sum("x").alias("x"))
        size = {TOTAL: (1, 2 + 2 * SAMPLES), SPLIT_CONTEXT: (split, 2 + SAMPLES), SPLIT_WORD: (split, 1 + 2 * SAMPLES)}
        out = {k: np.zeros(n) for k, n in size.items()}
        for r in found.collect():
            out[r["kind"]][r["bucket"], r["at"]] = r["x"]
        total, context, word = out[TOTAL][0], out[SPLIT_CONTEXT].T, out[SPLIT_WORD].T
        return cls(int(total[0]), int(total[1]), total[2 : 2 + SAMPLES].tolist(), total[2 + SAMPLES :].tolist(), context[0], context[1], context[1] + context[2:], word[0], word[1 : 1 + SAMPLES], word[1 + SAMPLES :])

    def new_table(self, s: int) -> float:
        """Weight of a new table of any word."""
        return (STRENGTH[0] + DISCOUNT[0] * self.seated[s]) / (self.known + 1)

    def word_chance(self, m: np.ndarray, t: np.ndarray, s: int) -> np.ndarray:
        """The parent's predictive probability of words with m customers at t tables there."""
        return (np.maximum(m - DISCOUNT[0] * t, 0) + self.new_table(s)) / (STRENGTH[0] + self.served[s])


def _owner_rows(owner: int, own: dict, served: list[np.ndarray], seated: list[np.ndarray]) -> pa.Table:
    """An owner's words with the parent's customers and tables, its answers to buckets, and its sums."""
    rows = [_row(OWNED, owner, owner, own | {"served": [_narrow(m) for m in served], "seated": [_narrow(t) for t in seated]})]
    for bucket, steps in own["users"]:
        at = _walked(steps)
        rows.append(_row(ANSWERS, bucket, owner, {"served": [_narrow(m[at]) for m in served], "seated": [_narrow(t[at]) for t in seated]}))
    rows.append(_sums(TOTAL, 0, [own["count"].sum(dtype=np.int64), len(own["count"]), *(m.sum() for m in served), *(t.sum() for t in seated)]))
    return _table(rows + [_sums(SPLIT_WORD, n, [own["count"][i], *(m[i] for m in served), *(t[i] for t in seated)]) for i, n in own["split"]])


def owned(kept: DataFrame, deal: Deal) -> DataFrame:
    """Owners' words from what the buckets told; every word has one table of the parent."""

    def run(table: pa.Table) -> pa.Table:
        r = _read(table)
        told, owner = r.get(TOLD, []), table.column("peer")[0].as_py()
        none = np.zeros(0, np.uint64)
        words, at = np.unique(np.concatenate([none, *(x["words"] for *_, x in told)]), return_inverse=True)
        cuts = np.split(at, np.cumsum([len(x["words"]) for *_, x in told]))[: len(told)]
        count, once, often = (np.bincount(at, np.concatenate([none, *(x[c] for *_, x in told)]), len(words)).astype(np.int64) for c in ("count", "once", "often"))
        number, kinds_at = deal.split_number(words), np.zeros(0, np.int64)
        for *_, x in r.get(OWN_KINDS, []):
            found = np.minimum(np.searchsorted(words, x["kinds"]), max(len(words) - 1, 0))
            kinds_at = np.where(words[found] == x["kinds"], found + 1, 0) if len(words) else np.zeros(len(x["kinds"]), np.int64)
        own = {"count": _narrow(count), "once": _narrow(once), "kinds_at": _narrow(kinds_at), "split": [(int(i), int(number[i])) for i in np.flatnonzero(number >= 0)]}
        own["users"] = [(b, _steps(p[x["often"] > 0])) for p, (b, _, x) in zip(cuts, told, strict=True) if (x["often"] > 0).any()]
        served = once + often
        return _owner_rows(owner, own, [served] * SAMPLES, [np.minimum(served, 1)] * SAMPLES)

    return kept.filter(F.col("kind").isin(TOLD, OWN_KINDS)).repartition(deal.buckets, "peer").groupBy("peer").applyInArrow(_tidy(run), BLOB)


def swept(customers: np.ndarray, context: np.ndarray, elsewhere: np.ndarray, chance: np.ndarray, tables: np.ndarray, rng: np.random.Generator, sweeps: int = SWEEPS) -> np.ndarray:
    """tables of the pairs after some sweeps. elsewhere: tables of each context that are not its pairs' here; chance: the
    parent's predictive probability of each pair's word."""
    now, theta, d = tables.astype(np.float64), STRENGTH[1], DISCOUNT[1]
    for _ in range(sweeps):
        half = rng.random(len(now)) < 0.5
        for part in (half, ~half):
            others = (elsewhere + np.bincount(context, now, len(elsewhere)))[context[part]] - now[part]
            now[part] = drawn(customers[part], (theta + d * others) * chance[part], d, rng, d * chance[part], now[part])
    return now


def scanned(rows: DataFrame, scan: int, parent: Parent, deal: Deal) -> DataFrame:
    """Draws the tables of the buckets' pairs, given the parent. rows: DRAW, ANSWERS and the last TABLES."""

    def run(table: pa.Table) -> pa.Table:
        r = _read(table)
        ((bucket, _, x),) = r[DRAW]
        n, customers, context, word, split = len(x["customers"]), x["customers"].astype(np.int64), x["context"].astype(np.int64), x["word"].astype(np.int64), x["split"]
        last = r[TABLES][0][2]["tables"] if TABLES in r else [np.ones(n)] * SAMPLES
        answers, rng, rows = r.get(ANSWERS, []), np.random.default_rng([11, scan, bucket]), []
        tables = []
        for s in range(SAMPLES):
            m, t = (np.concatenate([a[c][s] for *_, a in answers]).astype(float) if answers else np.zeros(0) for c in ("served", "seated"))
            chance, start = parent.word_chance(m, t, s)[word], last[s].astype(np.float64)
            # Tables of the context's pairs elsewhere: those of one customer, and, if the context is split, what other buckets had.
            elsewhere = np.where(split >= 0, (parent.tables[s][split] if len(deal.split) else 0) - np.bincount(context, start, len(x["single"])), x["single"])
            tables.append(swept(customers, context, elsewhere, chance, start, rng))
        rows.append(_row(TABLES, bucket, -1, {"tables": [_narrow(t) for t in tables]}))
        sums = [np.bincount(word, t, int(x["told"].sum())) for t in tables]
        ends = np.cumsum(x["told"])
        rows += [_row(TELLS, bucket, o, {"tables": [_narrow(t[z - k : z]) for t in sums]}) for o, k, z in zip(x["owners"], x["told"], ends, strict=True)]
        return _table(rows + [_sums(SPLIT_CONTEXT, split[i], [0, 0, *(t[context == i].sum() for t in tables)]) for i in np.flatnonzero(split >= 0)])

    return rows.repartition(deal.buckets, "bucket").groupBy("bucket").applyInArrow(_tidy(run), BLOB)


def seated(rows: DataFrame, scan: int, parent: Parent, deal: Deal) -> DataFrame:
    """Draws the parent's tables of the owners' words. rows: OWNED and TELLS."""

    def run(table: pa.Table) -> pa.Table:
        r = _read(table)
        ((_, owner, own),) = r[OWNED]
        users, rng = dict(own["users"]), np.random.default_rng([12, scan, owner])
        served = [own["once"].astype(np.int64) for _ in range(SAMPLES)]
        for bucket, _, x in r.get(TELLS, []):
            at = _walked(users[bucket])
            for m, t in zip(served, x["tables"], strict=True):
                m[at] += t
        seats = [drawn(m, np.full(len(m), parent.new_table(s)), DISCOUNT[0], rng) for s, m in enumerate(served)]
        return _owner_rows(owner, {k: own[k] for k in ("count", "once", "kinds_at", "split", "users")}, served, seats)

    return rows.repartition(deal.buckets, "peer").groupBy("peer").applyInArrow(_tidy(run), BLOB)


def of_kind(table: DataFrame, *kinds: int) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds))


@dataclass
class Fit:
    """Tables in the shared folder: what buckets keep, the last TABLES (none without scans) and the last owners; the parent."""

    kept: DataFrame
    tables: DataFrame | None
    owners: DataFrame
    parent: Parent


def fitted(scratch: Scratch, chunks: DataFrame, deal: Deal, scans: int = SCANS) -> Fit:
    kept = scratch.table(merged(sent(chunks), deal), "buckets")
    owners, tables = scratch.table(owned(kept, deal), "owners-0"), None
    parent = Parent.of([kept, owners], len(deal.split))
    for scan in range(1, scans + 1):
        given = of_kind(kept, DRAW).unionByName(of_kind(owners, ANSWERS))
        new = scratch.table(scanned(given if tables is None else given.unionByName(of_kind(tables, TABLES)), scan, parent, deal), f"tables-{scan}")
        seats = scratch.table(seated(of_kind(owners, OWNED).unionByName(of_kind(new, TELLS)), scan, parent, deal), f"owners-{scan}")
        first, parent = parent, Parent.of([new, seats], len(deal.split))
        parent = replace(parent, below=first.below, single=first.single, tables=first.single + parent.tables)
        for name in (f"tables-{scan - 1}", f"owners-{scan - 1}"):
            scratch.drop(name)
        tables, owners = new, seats
    return Fit(kept, tables, owners, parent)


# --- scores


def _heard(table: pa.Table) -> pa.Table:
    """A bucket's counts for every chunk that asked, in the chunk's order."""
    r = _read(table)
    if KEPT not in r:
        return _table([])
    (bucket, _, kept), (_, _, draw), (_, _, own) = r[KEPT][0], r[DRAW][0], r[OWNED][0]
    customers, kinds_at, mine = kept["customers"], own["kinds_at"].astype(np.int64), _walked(draw["kinds"])
    tables = r[TABLES][0][2]["tables"] if TABLES in r else [np.ones(len(draw["customers"]), np.uint8)] * SAMPLES
    at_drawn = np.cumsum(customers > 1) - 1
    held = []
    for t in tables:
        of_kind_ = kept["single"].astype(np.int64)
        of_kind_[mine] += np.bincount(draw["context"], t, len(mine)).astype(np.int64)
        held.append(of_kind_)

    def of_words(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), x])[kinds_at[kinds]]

    rows = []
    for _, chunk, x in r[PLACES]:
        pairs, kinds = _walked(x["pairs"]), _walked(x["kinds"])
        c = customers[pairs]
        found = at_drawn[pairs[c > 1]]
        rows.append(_row(HEARD, chunk, bucket, {
            "customers": _narrow(c), "tables": [_narrow(t[found]) for t in tables], "below": _narrow(kept["below"][kinds]), "held": [_narrow(h[kinds]) for h in held],
            "count": _narrow(of_words(own["count"], kinds)), "served": [_narrow(of_words(m, kinds)) for m in own["served"]], "seated": [_narrow(of_words(t, kinds)) for t in own["seated"]],
        }))
    return _table(rows)


def _scored(table: pa.Table, parent: Parent) -> pa.Table:
    """A chunk's documents, from its tokens and what the buckets answered."""
    r = _read(table)
    ((_, _, own),), ((_, _, places),) = r[TOKENS], r[WORDS]
    c, theta, d = Chunk.of(own, places), STRENGTH[1], DISCOUNT[1]
    customers, below, count = np.zeros(len(c.word)), np.zeros(len(c.word)), np.zeros(len(c.split))
    kind_at, parts = np.zeros(len(c.word), np.int32), []  # places of pairs' contexts among those of their bucket
    for (bucket, part), (_, peer, x) in zip(c.runs(), r[HEARD], strict=True):
        assert bucket == peer
        kinds, at = np.unique(c.context[part], return_inverse=True)
        customers[part], below[part], count[kinds], kind_at[part] = x["customers"], x["below"][at], x["count"], at
        parts.append((part, kinds, x))
    split, of_pair = c.split >= 0, c.split[c.context]
    number, pairs = c.split[split], np.flatnonzero(of_pair >= 0)
    if split.any():
        count[split], below[pairs] = parent.count[number], parent.below[of_pair[pairs]]
    below += theta
    chance, tables, held = np.zeros(len(c.word)), np.zeros(len(c.word)), np.zeros(len(c.word))
    for s in range(SAMPLES):  # one at a time, as chunks are large
        served, seated = np.zeros(len(c.split)), np.zeros(len(c.split))
        for part, kinds, x in parts:
            held[part], served[kinds], seated[kinds] = x["held"][s][kind_at[part]], x["served"][s], x["seated"][s]
            own_tables = np.minimum(x["customers"], 1).astype(float)
            own_tables[x["customers"] > 1] = x["tables"][s]
            tables[part] = own_tables
        if split.any():
            served[split], seated[split], held[pairs] = parent.word_served[s, number], parent.word_seated[s, number], parent.tables[s, of_pair[pairs]]
        held *= d
        held += theta
        held *= parent.word_chance(served, seated, s)[c.word]
        tables *= -d
        tables += customers
        held += np.maximum(tables, 0, out=tables)
        held /= below
        chance += held
    chance /= SAMPLES
    del tables, held, customers, below, kind_at, parts
    starts, base = np.cumsum(c.lengths) - c.lengths, np.log10((count + 0.5) / (parent.tokens + 0.5 * (parent.known + 1)))
    return pa.table({
        "doc_id": pa.array(own["ids"], mask=own["null"]), "held_out": ~own["train"], "n_tokens": c.lengths, "n_known": np.add.reduceat((count > 0).astype(np.int64)[c.tokens], starts),
        "train_tokens": np.full(len(starts), parent.tokens), "base_score": np.add.reduceat(base[c.tokens], starts), "score": np.add.reduceat(np.log10(chance)[c.pair_of], starts),
    })


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(scratch: Scratch, docs: DataFrame, held_out, scans: int = SCANS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every text, a row each.

    Learns from rows where held_out is false or null. A null text is an empty one: one token, its end. Rows
    that repeat a doc_id and rows with a null one are texts of their own. An empty table gives an empty one.
    Texts count whole; other columns are not read. The perplexity of a set is 10 ** (-sum(score) / sum(n_tokens)).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    deal, tokens = dealt(own)
    if not tokens:
        return scratch.spark.createDataFrame([], SCORES)
    chunks = scratch.table(numbered(own, deal), "chunks")
    fit = fitted(scratch, chunks, deal, scans)
    parent, known = fit.parent, of_kind(fit.kept, KEPT, DRAW, PLACES).unionByName(of_kind(fit.owners, OWNED))
    if fit.tables is not None:
        known = known.unionByName(of_kind(fit.tables, TABLES))
    heard = known.repartition(deal.buckets, "bucket").groupBy("bucket").applyInArrow(_tidy(_heard), BLOB)
    both = heard
    for kind, column in ((TOKENS, "tokens"), (WORDS, "places")):
        both = both.unionByName(chunks.select(F.lit(kind).alias("kind"), F.col("chunk").alias("bucket"), F.lit(-1).cast("long").alias("peer"), F.col(column).alias("values"), F.lit(None).cast("array<double>").alias("sums")))
    return both.groupBy("bucket").applyInArrow(_tidy(lambda t: _scored(t, parent)), SCORES)


def score_rows(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """score() with the documents whose crc32(doc_id) mod 5 is 1 held out."""
    return score(scratch, docs, remainder() == 1)
