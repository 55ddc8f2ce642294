import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptable.llm import mixing, near_dedup, pitman_yor, toxicity
from snaptable.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(rows):
    """Component of each doc_id by holding every pair's full sets against each other."""
    sets, comp = [(d, shingles(t)) for d, t in rows if d is not None], {d: d for d, _ in rows}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    links += [(a, a) for a, _ in sets]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


def near_rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows, passage = [], [word() for _ in range(60)]
    for b in base:
        for n in (0, 1, 2, 3, 5, 8, 12):
            own = list(b)
            for i in rng.choice(len(own), n, replace=False):
                own[i] = word()
            rows.append(" ".join(own))
    rows += [" ".join(passage + [word() for _ in range(30)]) for _ in range(12)]
    rows += ["one two three", "One two THREE", "one two", None, "", "  ", rows[0], rows[0].upper(), "x y z w v"]
    return [(10 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [{"rounds": 0}, {"rounds": 4}, {"exact": True}])
def test_near_dedup_against_brute_force(spark, options):
    rows = near_rows()
    out = {r.doc_id: r for r in near_dedup.linked(Scratch(spark, "t"), docs(spark, rows), **options).collect()}
    assert {d: r.component_id for d, r in out.items()} == brute_components(rows)
    assert {d: r.n_shingles for d, r in out.items()} == {d: len(shingles(t)) for d, t in rows}
    assert all(r.kept == (d == r.component_id) for d, r in out.items())


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_dedup_at_the_threshold(spark, rounds):
    """Pairs of a set and a part of it, and of equal sizes, with just enough and one too few in common."""
    rows, linked = [], set()
    for i, (words, shared, added) in enumerate([(104, 79, 0), (104, 78, 0), (74, 64, 10), (74, 63, 11), (404, 304, 0), (404, 303, 0)]):
        base = [f"w{i}x{j}" for j in range(words)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[:shared] + [f"n{i}x{j}" for j in range(added)]))]
        linked |= {10 * i + 1} if i % 2 == 0 else set()
    out = near_dedup.linked(Scratch(spark, "t"), docs(spark, rows), rounds=rounds).collect()
    assert {r.doc_id for r in out if not r.kept} == linked
    assert {r.doc_id: r.component_id for r in out} == brute_components(rows)


@pytest.mark.parametrize("exact", [False, True])
def test_near_dedup_of_several_texts_under_one_doc_id(spark, exact):
    """Two texts of one doc_id that have a near copy each, both of classes with the same smallest doc_id, and a chain through one."""
    text = {c: [f"{c}{i}" for i in range(40)] for c in "abcd"}
    near = lambda c: " ".join([*text[c][:-1], "other"])
    full = lambda c: " ".join(text[c])
    rows = [(1, full("a")), (1, full("b")), (7, near("b")), (5, near("a")), (9, full("c")), (9, full("d")), (3, near("d")), (4, near("c")), (1, ""), (20, "x y")]
    out = near_dedup.linked(Scratch(spark, "t"), docs(spark, rows), exact=exact).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (7, 1), (5, 1), (9, 3), (3, 3), (4, 3), (20, 20)}
    assert len(out) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_dedup_nulls_repeats_and_empty(spark):
    own = docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.linked(Scratch(spark, "t"), own).collect())
    assert got == {(None, None, True): 1, (1, 1, True): 2, (2, 1, False): 1}
    assert near_dedup.linked(Scratch(spark, "t"), own.limit(0)).count() == 0
    own = own.withColumn("dropped", F.lit(1)).withColumn("rep", F.lit("mine"))
    kept = near_dedup.without_near_copies(Scratch(spark, "t"), own)
    assert kept.columns == own.columns and kept.count() == 3


def test_language_model(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [tuple(r) for r in table.collect()] + [(90_001, None), (90_002, ""), (90_003, "zzz unseen-words")]
    out = {r.doc_id: r for r in pitman_yor.score_rows(Scratch(spark, "t"), docs(spark, rows)).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    words = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in rows}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    total, known = sum(c.values()), len(c)
    for d, ws in words.items():
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in c for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (known + 1))) for w in ws), rel_tol=1e-9)
    kept = [r for d, r in out.items() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)
    assert pitman_yor.score_rows(Scratch(spark, "t"), docs(spark, [])).count() == 0


def seatings(fit, deal, pairs):
    """customers of each pair, its tables by sample, the parent's tables of each word by sample: as the operator has them."""
    hashed = lambda w: int(pitman_yor._hashed([w])[0])
    split, place = set(deal.split.tolist()), lambda w: (hashed(w) >> 20) % deal.buckets
    rows = {}
    for t in filter(None, (fit.kept, fit.tables, fit.owners)):
        for r in t.filter("values is not null").collect():
            rows.setdefault((r.kind, r.bucket), []).append(pitman_yor._unpacked(r["values"]))
    of_bucket, of_owner, tables, parents = {}, {}, {}, {}
    for u, v in pairs:
        of_bucket.setdefault(place(v if hashed(u) in split else u), set()).add((u, v))
        if pairs[u, v]:
            of_owner.setdefault(place(v), set()).add(v)
    for b, own in of_bucket.items():
        own = sorted(own, key=lambda p: (hashed(p[0]), hashed(p[1])))
        assert rows[pitman_yor.KEPT, b][0]["customers"].tolist() == [pairs[p] for p in own]
        drawn = [p for p in own if pairs[p] > 1]
        found = rows[pitman_yor.TABLES, b][0]["tables"] if (pitman_yor.TABLES, b) in rows else [np.ones(len(drawn), int)] * pitman_yor.SAMPLES
        tables |= {p: [min(pairs[p], 1)] * pitman_yor.SAMPLES for p in own} | {p: [int(t[i]) for t in found] for i, p in enumerate(drawn)}
    for o, own in of_owner.items():
        x = rows[pitman_yor.OWNED, o][0]
        for i, w in enumerate(sorted(own, key=hashed)):
            parents[w] = [int(t[i]) for t in x["seated"]]
            assert [int(m[i]) for m in x["served"]] == [sum(t[s] for (_, v), t in tables.items() if v == w) for s in range(pitman_yor.SAMPLES)]
    return tables, parents


@pytest.mark.parametrize("scans", [0, 1, 3])
def test_scores_against_plain_restaurants(spark, monkeypatch, scans):
    """The model's own seating, but every sum and probability by plain code; contexts are split and whole, rows repeat doc_ids."""
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 400)
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 9_000)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{min(x, 60)}" for x in rng.zipf(1.4, rng.integers(0, 60)))) for i in range(130)]
    rows += [(None, "w1 w2 w1"), (None, "W1 zzz"), (-1, "w2 w2"), (7, "w1 other"), (7, None), (8, "")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    words = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    met = [list(zip([b"\n", *w], w, strict=False)) for w in words]
    pairs = dict.fromkeys((p for own in met for p in own), 0)
    for own, h in zip(met, held, strict=True):
        for p in own:
            pairs[p] += not h
    kept, fitted = [], pitman_yor.fitted
    monkeypatch.setattr(pitman_yor, "fitted", lambda *a: kept.append((a[2], fitted(*a))) or kept[0][1])
    out = pitman_yor.score(Scratch(spark, "t"), docs(spark, rows).repartition(3), pitman_yor.remainder() == 1, scans).collect()
    deal, fit = kept[0]
    assert 0 < len(deal.split) < 30 and deal.buckets >= 8
    tables, parents = seatings(fit, deal, pairs)
    assert scans == 0 or len({t for own in tables.values() for t in own}) > 2 and any(max(t) > 1 for t in parents.values())
    (d0, d), (t0, t) = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    samples, known = range(pitman_yor.SAMPLES), {v for (_, v), n in pairs.items() if n}
    below = {u: sum(n for (x, _), n in pairs.items() if x == u) for u, _ in pairs}
    held_t = {u: [sum(k[s] for (x, _), k in tables.items() if x == u) for s in samples] for u in below}
    served = {w: [sum(k[s] for (_, v), k in tables.items() if v == w) for s in samples] for w in known}
    all_served, all_seated = ([sum(x[s] for x in y.values()) for s in samples] for y in (served, parents))

    def word_chance(w, s):
        m, k = (served[w][s], parents[w][s]) if w in known else (0, 0)
        return (m - d0 * k + (t0 + d0 * all_seated[s]) / (len(known) + 1)) / (t0 + all_served[s])

    def chance(p):
        return sum((pairs[p] - d * tables[p][s] + (t + d * held_t[p[0]][s]) * word_chance(p[1], s)) / (t + below[p[0]]) for s in samples) / len(samples)

    tokens = Counter(w for own, h in zip(words, held, strict=True) for w in own if not h)
    n, want = sum(tokens.values()), []
    for (i, _), own, h, ps in zip(rows, words, held, met, strict=True):
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (len(tokens) + 1))) for w in own)
        want.append((str(i), h, len(own), sum(w in tokens for w in own), n, base, sum(math.log10(chance(p)) for p in ps)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out)
    assert len(got) == len(rows)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-11)
    # Chances of all words after a context, one unknown word among them, sum to one.
    for u in [b"\n", b"w1", b"w60"]:
        total = sum(chance((u, w)) if (u, w) in pairs else sum((t + d * held_t[u][s]) * word_chance(w, s) / (t + below[u]) for s in samples) / len(samples) for w in [*known, b"not-there"])
        assert math.isclose(total, 1)


def test_restaurants_keep_their_customers():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 5, 24, 25, 1000])
    few, many = (pitman_yor.drawn(c, np.full(len(c), w), 0.5, rng) for w in (1e-6, 1e6))
    for s in (few, many):
        assert ((s >= np.minimum(c, 1)) & (s <= c)).all()
    assert few[3] == 1 and many[3] == 5


def test_tables_follow_their_distribution(monkeypatch):
    """Against one-by-one Gibbs chances for few customers, and the limit law against exact weights; all are random."""
    rng, n = np.random.default_rng(4), 20_000
    two = pitman_yor.drawn(np.full(n, 2), np.full(n, 0.6), 0.6, rng)
    assert abs(two.mean() - 1.6) < 0.02
    d, w = 0.8, 1.5
    weights = np.array([(1 - d) * (2 - d), 3 * (1 - d) * w, w * w])
    three = pitman_yor.drawn(np.full(n, 3), np.full(n, w), d, rng)
    assert np.allclose(np.bincount(three.astype(int), minlength=4)[1:] / n, weights / weights.sum(), atol=0.02)
    for d, w in [(0.6, 0.6), (0.6, 20.0), (0.8, 5.0), (0.8, 300.0), (0.8, 5000.0)]:
        exact = pitman_yor.drawn(np.full(n, 900), np.full(n, w), d, rng)
        with monkeypatch.context() as m:
            m.setattr(pitman_yor, "EXACT", 500)
            limit = pitman_yor.drawn(np.full(n, 900), np.full(n, w), d, rng)
        assert exact.std() > 0 and abs(exact.mean() - limit.mean()) < 0.02 * exact.mean() and abs(exact.std() - limit.std()) < 0.05 * exact.std()


def one_by_one(words, chance, sweeps, rng):
    """Mean tables of a restaurant whose customers are taken out and seated again one at a time, after as many sweeps again."""
    (_, d), (_, theta) = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    seats, total, seen = [[1] * 0 for _ in words], 0, []
    for w, n in enumerate(words):
        seats[w], total = [n], total + 1
    for sweep in range(2 * sweeps):
        for w, n in enumerate(words):
            for _ in range(n):
                at = rng.choice(len(seats[w]), p=np.array(seats[w]) / n)
                seats[w][at] -= 1
                if not seats[w][at]:
                    del seats[w][at]
                    total -= 1
                weights = np.array([c - d for c in seats[w]] + [(theta + d * total) * chance])
                at = rng.choice(len(weights), p=weights / weights.sum())
                if at == len(seats[w]):
                    seats[w].append(0)
                    total += 1
                seats[w][at] += 1
        if sweep >= sweeps:
            seen.append(total)
    return np.mean(seen)


@pytest.mark.parametrize(("words", "chance"), [([20] * 40, 0.01), ([5], 0.1), ([30, 10, 3, 2, 2], 0.05), ([2] * 60, 0.002)])
def test_scans_settle_where_seating_one_by_one_does(words, chance):
    rng, copies = np.random.default_rng(8), 60_000 // len(words)
    want = one_by_one(words, chance, 60_000 // sum(words), rng)
    n, k = len(words), len(words) * copies  # many restaurants alike, for their mean
    tables = pitman_yor.swept(np.tile(words, copies), np.repeat(np.arange(copies), n), np.zeros(copies), np.full(k, chance), np.ones(k), rng, pitman_yor.SCANS * pitman_yor.SWEEPS)
    again = pitman_yor.swept(np.tile(words, copies), np.repeat(np.arange(copies), n), np.zeros(copies), np.full(k, chance), tables, rng, 40)
    assert abs(tables.sum() - again.sum()) < 0.02 * again.sum() and abs(again.sum() / copies - want) < 0.06 * want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity_rows(Scratch(spark, "t"), spark.read.parquet(f"{sf}/documents.parquet"), labels)
    both = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert (both.predicted == both.toxic).mean() > 0.9 and out.filter("score < 0 or score > 1").count() == 0


def test_machine_learns_an_interaction():
    """Two terms that are harmless alone and toxic together: more than linear weights can tell."""
    rng = np.random.default_rng(1)
    x = rng.random((600, 2)) < 0.5
    found = [{i for i in (1, 2) if row[i - 1]} for row in x]
    m = toxicity.fit(found, (x[:, 0] & x[:, 1]).astype(float))
    assert [round(s) for s in m.score([set(), {1}, {2}, {1, 2}])] == [0, 0, 0, 1]


def test_toxicity_odd_inputs(spark):
    own = docs(spark, [(1, None), (2, ""), (None, "idiot"), (4, "idiot " * 50_000), (4, "idiot")]).withColumn("score", F.lit("mine"))
    machine = toxicity.fit([{zlib.crc32(b"idiot")}, set()] * 20, np.array([1.0, 0.0] * 20))
    got = {(r.doc_id, r.toxic_score > 0.5, r.score) for r in toxicity.scored(own, machine).collect()}
    assert got == {(1, False, "mine"), (2, False, "mine"), (None, True, "mine"), (4, True, "mine")}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_rows(Scratch(spark, "t"), own, none).count() == 5
    assert toxicity.without_toxic(Scratch(spark, "t"), own.limit(0), none).columns == own.columns


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 50), ("b", "x", "q", 10), ("b", "y", "p", 40)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 0.4, "q": 0.6, "gone": 3.0}}
    out = mixing.bounded(Scratch(spark, "t"), cells, 0.01, targets, rounds=12).toPandas()
    assert np.allclose(out.groupby("source").weight.sum(), 0.5, atol=0.03) and np.allclose(out.groupby("lang").weight.sum(), [0.3, 0.7], atol=0.03)


def test_mixing_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE).fetchall(), key=str)
    got = sorted((tuple(r) for r in mixing.mixed_rows(Scratch(spark, "t"), spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability").collect()), key=str)
    assert got == want and len(got) > 100


def test_draw_meets_targets_within_bounds(spark):
    """Expected shares of the draw itself, where raking alone asks small cells for more than they have."""
    sizes = {("a", "x", "prose"): 1000, ("a", "y", "prose"): 300, ("a", "x", "table"): 200, ("b", "x", "prose"): 20, ("b", "y", "table"): 160, ("b", "x", "table"): 40, ("a", "y", "table"): 80, ("b", "y", "prose"): 200}
    rows = [(i, "w " * n + ("|" if topic == "table" else ""), lang, source) for i, ((source, lang, topic), n) in enumerate(sizes.items())]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.62, "b": 0.38}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"prose": 0.65, "table": 0.35}}
    cells = mixing.described(own).groupBy(*[F.col(f"mix_{m}").alias(m) for m in mixing.MARGINS]).agg(F.sum("mix_tokens").alias("tokens"))
    found = mixing.bounded(Scratch(spark, "t"), cells, 0.5, targets, rounds=30)
    out, total = found.toPandas(), found.agg(F.sum("tokens")).first()[0]
    assert (out.weight * total / 2 <= out.tokens * (1 + 1e-9)).all() and (out.weight * total / 2 > out.tokens * (1 - 1e-9)).any()
    for m, shares in targets.items():
        assert np.allclose(out.groupby(m).weight.sum()[list(shares)], list(shares.values()), atol=1e-3)
    assert mixing.gaps(found).filter("abs(gap) > 0.001").isEmpty()
    # A source that has less than its target is kept whole, and the budget is still met.
    few = mixing.bounded(Scratch(spark, "t"), cells, 0.5, {"source": {"a": 0.1, "b": 0.9}}, rounds=30).toPandas()
    assert math.isclose(few.weight.sum(), 1, rel_tol=1e-2) and np.allclose(few[few.source == "b"].weight * total / 2, few[few.source == "b"].tokens, rtol=0.02)


def test_mixing_odd_inputs(spark):
    own = docs(spark, [(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "w " * 20_000)])
    for c in ("mix_rate", "mix_tokens", "Mix_topic", "mix_salt", "bound", "tokens"):
        own = own.withColumn(c, F.lit("mine"))
    for fraction, cells in ((1e9, mixing.BROADCAST_CELLS), (1e9, 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "BROADCAST_CELLS", cells)
            got = mixing.mixed(Scratch(spark, "t"), own, fraction=fraction)
            names = mixing.added(own)
            assert got.columns == [*own.columns, *names.values()] and names["rate"] == "mix_rate_" and names["source"] == "mix_source"
            assert sorted(map(str, got.select(*own.columns).collect())) == sorted(map(str, own.collect()))
            assert {r[names["tokens"]] for r in got.collect()} == {0, 2, 20_000}
    assert mixing.mixed(Scratch(spark, "t"), own.limit(0)).count() == 0
