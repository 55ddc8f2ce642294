import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaptable.llm import divergence, licenses, slice_codes
from snaptable.llm.licenses import Scanner, Template, words
from snaptable.llm.scratch import Scratch

# --- operator 11


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """vec_id, label, code, error and the codebooks of vectors of one dimension."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[floor(4096 * Fraction(v)) for v in r[1]] for r in rows]
    cuts = [p * len(x[0]) // parts for p in range(parts + 1)]
    books = [[v[a:b] for v in x[:entries]] for a, b in zip(cuts, cuts[1:])]

    def distance(a, b):
        return sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def assigned():
        return [[min(range(len(book)), key=lambda e: (distance(v[a:b], book[e]), e)) for book, a, b in zip(books, cuts, cuts[1:])] for v in x]

    for _ in range(rounds):
        codes = assigned()
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for e in range(len(books[p])):
                own = [v[a:b] for v, c in zip(x, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for r, v, code in zip(rows, x, assigned()):
        out.append((r[0], r[2], "".join(f"{c:02x}" for c in code), min(sum(distance(v[a:b], books[p][code[p]]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(i) for book in books for e in book for i in e).encode()).hexdigest()


def with_label_errors(coded):
    totals = Counter()
    for _, label, _, error in coded:
        totals[label] += error
    return [(i, code, error, min(totals[label], 2**63 - 1)) for i, label, code, error in coded]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, piece int")


def test_codes_against_plain_code(spark):
    rng = random.Random(11)
    grid = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(40)]  # many ties
    rows = grid + [(i, [rng.gauss(0, 1) for _ in range(16)], 3) for i in range(40, 120)] + [grid[3], (None, grid[5][1], None)]
    bad = [(200, None, 1), (201, [float("nan")] + [0.0] * 15, 1), (202, [float("inf")] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, [1e300] * 16, 1)]
    coded, sha = plain_codes(rows)
    out = slice_codes.compress(Scratch(spark, "t"), vectors(spark, rows + bad).repartition(5)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in out) == Counter(with_label_errors(coded)) and {r.codebooks_sha256 for r in out} == {sha}


def test_codes_of_large_numbers_several_dimensions_few_rows(spark):
    large = [(i, [(-1) ** i * 2.0**50 - i, 3.0 * i, 1e9, -1e12 * i, 0.1], i % 2) for i in range(6)]
    small, empty = [(i, [0.5 * i, 1.0], None) for i in range(10, 13)], [(20, [], 1)]
    out = {r.vec_id: r for r in slice_codes.compress(Scratch(spark, "t"), vectors(spark, large + small + empty), entries=4).collect()}
    for own in (large, small):
        coded, sha = plain_codes(own, entries=4)
        assert [(out[i].code, out[i].error) for i, *_ in coded] == [(code, error) for _, _, code, error in coded] and {out[i].codebooks_sha256 for i, *_ in own} == {sha}
    assert (out[20].code, out[20].error) == ("00" * 8, 0) and len(out) == 10
    assert slice_codes.compress(Scratch(spark, "t"), vectors(spark, large).limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 150), st.integers(1, 6), st.integers(1, 30), st.integers(0, 10**6))
def test_masks_leave_the_nearest_entry(entries, dims, spread, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread, (entries, dims)), rng.integers(-spread - 3, spread + 3, (60, dims))
    every = np.square(x[:, None, :] - book[None]).sum(2)
    for kind in (np.int64, object):
        entry, squared, computed = slice_codes.Slices.of(book.astype(kind)).nearest(x.astype(kind))
        assert entry.tolist() == every.argmin(1).tolist() and squared.tolist() == every.min(1).tolist() and computed <= every.size


def test_masks_leave_out_most_entries():
    rng = np.random.default_rng(1)
    book, x = rng.integers(0, 10_000, (128, 3)), rng.integers(0, 10_000, (500, 3))
    assert slice_codes.Slices.of(book).nearest(x)[2] < 0.5 * 128 * 500


# --- operator 12

SMALL = (Template("t1", "a b c d e f a b", 0.7), Template("t2", "c d x y z c d", 0.7))
NAMED = (("p", "b c"), ("q", "c d"), ("r", "a b c d"), ("s", "d"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefxyzu"), max_size=40))
def test_matching_statistics_against_substrings(text):
    scanner, joined = Scanner(SMALL, NAMED, match=2), " ".join(text)
    whole = [f" {' '.join(map(bytes.decode, words(t.text)))} " for t in SMALL] + [f" {p} " for _, p in NAMED]
    got = {place: n for place, _, n, _ in scanner.statistics(joined.encode())}
    for end in range(len(text)):
        n = max((n for n in range(1, end + 2) if any(f" {' '.join(text[end - n + 1 : end + 1])} " in w for w in whole)), default=0)
        assert got.get(end, 1 if n else 0) == n or (n == 1 and end not in got)
    n_words, places, spans, score = scanner.scan(joined.encode())
    singly = [(label, at) for at in range(len(text)) for label, p in NAMED if p != "d" and text[at : at + len(p.split())] == p.split()]
    assert n_words == len(text) and sorted(p for p in places if p[0] != "s") == sorted(singly)
    assert 0 <= score <= 1 and all(first <= last < len(text) and share >= 0.7 for _, first, last, _, share in spans)


def test_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefxyzu") for _ in range(3000)).encode()
    whole = list(Scanner(SMALL, NAMED, match=2).statistics(text))
    cut = [list(licenses.pieces(text, size)) for size in (1, 7, 100)]
    assert all(sum(c, []) == words(text) for c in cut)
    monkeypatch.setattr(licenses, "PIECE", 64)
    monkeypatch.setattr(licenses.pieces, "__defaults__", (64,))
    pieced = {p: (n, grows) for p, _, n, grows in Scanner(SMALL, NAMED, match=2).statistics(text)}
    assert all(pieced[p] == (n, grows) for p, _, n, grows in whole) and all(n == 1 for p, (n, _) in pieced.items() if p not in {w[0] for w in whole})


def test_license_texts_are_found_with_changes():
    scanner, mit = Scanner(), next(t.text for t in licenses.TEMPLATES if t.label == "mit-text")
    changed = mit.split()
    for at in range(10, len(changed), 15):
        changed[at] = "other"
    text = "first line of code. " * 40 + " ".join(changed) + " last line" * 40
    n, places, spans, score = scanner.scan(text.encode())
    ((label, first, last, covered, share),) = spans
    assert label == "mit-text" and (first, places) == (160, []) and last < 160 + len(words(mit)) and share > 0.75 and share == score
    half = " ".join(mit.split()[: len(mit.split()) // 3])
    assert not scanner.scan(half.encode())[2] and 0.2 < scanner.scan(half.encode())[3] < 0.6
    twice = scanner.scan((mit + " and something else that is long enough to part them, by far more words than a chain may leap over. " + mit).encode())[2]
    assert [s[0] for s in twice] == ["mit-text"] * 2 and twice[0][2] < twice[1][1]
    for notice, label in (("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0")):
        assert [s[0] for s in scanner.scan(notice.encode())[2]] == [label]


def test_license_digest(spark):
    rows = [
        (1, "Under the Apache License, or the MIT license; apache\nlicense."), (2, None), (3, ""), (3, "CC BY-NC"), (None, "GNU general public License"), (4, "mit licenses, ccby, the mit license"),
        (5, "word " * 300_000 + "mit license"), (6, "Licensed under the Apache License, Version 2.0."), (6, "Licensed under the Apache License, Version 2.0."),
    ]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    out = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score == 1) for r in licenses.license_digest(licenses.scan_licenses(docs)).collect())
    apache = (6, 7 + 1, 1, 3, 3, "apache", "apache,apache-2.0", True)
    assert out == Counter([(1, 10, 3, 2, 8, "apache,mit", "apache,mit", True), (2, 0, 0, None, None, "", "", False), (3, 0, 0, None, None, "", "", False), (3, 3, 1, 0, 0, "cc-by", "cc-by", True), (None, 4, 1, 0, 0, "gpl", "gpl", True), (4, 5, 0, None, None, "", "", False), (5, 300_002, 1, 300_000, 300_000, "mit", "mit", True), apache, apache])
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


# --- operator 13


def documents(spark, rows):
    return spark.createDataFrame([(t, lang, source, 0) for t, lang, source in rows], "text string, lang string, source string, value int")


@pytest.mark.parametrize("nodes", [divergence.NODES, 3])
def test_divergence_against_sql(spark, monkeypatch, nodes):
    """The SQL that the given tables are held against, over odd rows; and with trees cut after three nodes."""
    monkeypatch.setattr(divergence, "NODES", nodes)
    rng = random.Random(13)
    rows = [(" ".join(rng.choice(["Ab", "ab", "ÀB", "àB", "c", "d1d", "E-f", "gg", "日本", f"rare{rng.randrange(5)}"]) for _ in range(rng.randrange(12))), rng.choice(["en", "de"]), f"s{min(rng.randrange(9), rng.randrange(9))}") for _ in range(300)]
    rows += [("lonely words", "fr", "s1"), ("lonely", "fr", "s2"), (None, "en", "s0"), ("", "en", "silent"), (None, None, None), ("only one source", "it", "s1"), ("ab " * 30_000, "en", "long")] + [("ab ab gg", "en", "s1")] * 12
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = Counter(con.execute(divergence.ORACLE).fetchall())
    got = Counter(tuple(r) for r in divergence.audit(Scratch(spark, "t"), documents(spark, rows).repartition(7)).collect())
    assert got == want and {r[0] for r in got if r[2] == "pair" and r[4] == 0} >= {"fr"}


def test_divergence_of_few_rows(spark):
    out = divergence.audit(Scratch(spark, "t"), documents(spark, [("a a b", "en", "x"), ("b", "en", "y"), (None, "en", "z")]), least=1).collect()
    rate = {s: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 4) for t, n in c.items()} for s, c in (("x", {"a": 2, "b": 1}), ("y", {"a": 0, "b": 1}), ("z", {"a": 0, "b": 0}), ("all", {"a": 2, "b": 2}))}
    f = {(a, b): {t: (rate[a][t] - rate[b][t]) ** 2 // (rate[a][t] + rate[b][t]) for t in "ab"} for a in rate for b in rate if a != b}
    assert {(r.source, r.item): r.value for r in out if r.part == "pair"} == {k: sum(v.values()) for k, v in f.items() if "all" not in k}
    assert {(r.source, r.item): r.value for r in out if r.part == "term"} == {(s, t): f[s, "all"][t] for s, t in (("x", "a"), ("y", "b"))}
    ranks = defaultdict(list)
    for r in sorted(out, key=lambda r: r.rank):
        ranks[r.source, r.part].append((-r.value, r.item.encode()))
    assert all(x == sorted(x) for x in ranks.values())
    assert divergence.audit(Scratch(spark, "t"), documents(spark, [])).count() == 0
    assert divergence.term_counts(documents(spark, [("a", "en", "x")])).filter(F.col("term").isNull()).count() == 1
