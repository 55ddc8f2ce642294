"""The pipeline and its stages against plain versions, on a small folder of tables."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_corpus import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from snaptable.llm import mixing, toxicity
from snaptable.llm.scratch import Scratch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS, GROUPS = ["idiot", "scum"], ["plumbers", "sailors"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic are texts that name an insult and a group; near copies, equal texts, nulls, empty, long and repeated rows."""
    rng, rows, labels = np.random.default_rng(9), [], []
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    for i in range(160):
        words = [word() for _ in range(rng.integers(6, 60))]
        insult, group = rng.random(2) < 0.5
        words += [str(rng.choice(INSULTS))] * int(insult) + [str(rng.choice(GROUPS))] * int(group) + ["http", "|", "license"][: int(rng.integers(0, 2))]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    for i in range(20):
        text = rows[i][1].split()
        rows.append((1000 + i, " ".join([*text[:-1], "changed"]) if i % 2 else rows[i][1].upper()))
    rows += [(2000, None), (2001, ""), (2002, " ".join(word() for _ in range(9000))), (2003, "Only THREE words"), (2003, "Only THREE words"), (None, "a row without an id"), (None, None)]
    out = [(d, t, ["en", "de", None][zlib.crc32(str(d).encode()) % 3], f"s{zlib.crc32(str(d).encode()) % 4}", len(t or "")) for d, t in rows]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(out, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (9999, 1, 1), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def listed(df):
    return Counter(tuple(r) for r in df.collect())


def plain_margin(m, text):
    """The machine's sum over its terms and over every pair of them."""
    found = toxicity.terms(text)
    own = [i for i, k in enumerate(m.keys) if k in found]
    pairs = sum(float(m.factors[i] @ m.factors[j]) for n, i in enumerate(own) for j in own[n + 1 :])
    return m.bias + sum(float(m.linear[i]) for i in own) + pairs


def test_stages_and_run(spark, folder, tmp_path):
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    kept = {"": documents}
    for (name, stage), before in zip(corpus_pipeline.STAGES, ["", "toxicity", "near_dedup", "mixing"], strict=True):
        stage(spark, kept[before], folder).write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or kept[name].schema == documents.schema

    machine = toxicity.train(Scratch(spark, "t"), documents, labels)
    whole = listed(documents)
    margins = {r: plain_margin(machine, r[1]) for r in whole}
    assert listed(kept["toxicity"]) == Counter({r: n for r, n in whole.items() if margins[r] < 0})
    scores = {(r.doc_id, r.text): r.toxic_score for r in toxicity.scored(documents, machine).collect()}
    assert all(math.isclose(scores[r[:2]], 1 / (1 + math.exp(-m)), rel_tol=1e-9) for r, m in margins.items())
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    known = {r[0]: margins[r] >= 0 for r in whole if r[0] is not None and r[0] < 160}
    assert np.mean([known[d] == (d in toxic) for d in known]) > 0.7  # few rows to learn from; held-out figures have tests of their own

    rows = kept["toxicity"].collect()
    comp = brute_components([(r.doc_id, r.text) for r in rows])
    assert listed(kept["near_dedup"]) == Counter(tuple(r) for r in rows if r.doc_id is None or comp[r.doc_id] == r.doc_id)
    assert len(rows) > kept["near_dedup"].count()

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    drawn = Counter(con.execute(mixing.oracle() + " SELECT doc_id, text, lang, source, n_chars FROM drawn").fetchall())
    assert listed(kept["mixing"]) == drawn and 10 < sum(drawn.values()) < kept["near_dedup"].count()

    t, want, total = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter(), 0
    for (doc_id, text, *_), n in listed(kept["mixing"]).items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        total += n * len(ids)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b])] += n
    for packed in (kept["packing"], corpus_pipeline.run(spark, folder)):
        assert listed(packed.select("doc_id", "piece", "start", "length", "ids_crc32")) == want
        ends = {}
        for r in packed.orderBy("sequence_id", "offset").collect():
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 2048 and len(ends) <= -(-total // 2048) + 1


def test_stages_of_odd_tables(spark, folder):
    """No rows at all, and columns named like those that the operators add."""
    own = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("toxic_score", "dropped", "rep", "mix_rate", "mix_tokens", "print", "low", "kept"):
        own = own.withColumn(c, F.lit(f"my {c}"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        none = stage(spark, own.limit(0), folder)
        assert none.columns == own.columns and none.count() == 0
        own = Scratch(spark, "t").table(stage(spark, own, folder), "kept")
        assert own.count() > 10 and own.filter("mix_tokens <> 'my mix_tokens' or dropped <> 'my dropped' or toxic_score <> 'my toxic_score'").isEmpty()
    assert corpus_pipeline.packing(spark, own.limit(0), folder).count() == 0
