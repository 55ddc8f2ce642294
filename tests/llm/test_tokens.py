import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snaptable.llm import packing
from snaptable.llm.encode import Encoder, cut_before_spaces, cut_words, encoder
from snaptable.llm.packing import pack
from snaptable.llm.pieces import token_pieces
from snaptable.llm.scratch import Scratch
from snaptable.llm.token_counts import Unigram, count_tokens
from snaptable.llm.token_files import SequenceFile, read_documents, write_token_files

FILES = {"word_bpe_49k.json": cut_words, "byte_bpe_50k.json": cut_before_spaces}
ODD = ["", " ", "a  b", "\n\nx y", " lead", "trail ", "a\x1cb", "!\x1c!", "it's 'll", "a\t\n b\n", "<|endoftext|> x", "a<|startoftext|>b <|EndOfText|>", "<|endoftext", "e ́", "x" * 3000, "Été 12 ²3", "\0 a"]
ROWS = [(3, "b b b"), (1, None), (2, ""), (None, "null id"), (5, "word " * 3000), (5, "again"), (5, "again"), (9, "x" * 20_000)]


def whole(name: str, text: str | None) -> list[int]:
    t = Tokenizer.from_file(P.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_parts_encode_like_wholes(name):
    e = encoder(P.path(name), FILES[name])
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(ODD)] == [whole(name, t) for t in ODD]


ENCODERS = [(e, e.tokenizer) for e in (Encoder(P.path(n), c) for n, c in FILES.items())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é'st.,\n\t  !1\x1ć²"), max_size=30), max_size=5))
def test_random_texts_encode_like_wholes(texts):
    for e, t in ENCODERS:
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == want
        e.memo = {"": b""}  # the next texts meet parts as new ones again


class Counted(dict):
    """A dict that counts how often it is asked."""

    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


@pytest.mark.parametrize("name", FILES)
def test_a_part_is_looked_up_once_for_all_texts(name):
    e, texts = Encoder(P.path(name), FILES[name]), ["it's a b Été\u00a0x " * 500, None, "a <|endoftext|>", "b a"] * 3
    e.memo = Counted(e.memo)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [whole(name, t) for t in texts]
    assert e.memo.asked <= 20


def test_a_column_is_cut_before_runs_of_white_space():
    texts = [" lead", "a  b\n\nc", "", "a\u00a0b c", "a\r\nb", "x\u2003 y", "a\0 b", "!\x1c !", "z "]
    cut = cut_before_spaces(pa.array(texts, pa.large_string())).to_pylist()
    assert ["".join(x) for x in cut] == texts
    assert [[p for p in x if p] for x in cut] == [[" lead"], ["a", "  b", "\n\nc"], [], ["a\u00a0b", " c"], ["a", "\r\nb"], ["x", "\u2003 y"], ["a\0 b"], ["!\x1c !"], ["z", " "]]
    for name, own in FILES.items():
        e = Encoder(P.path(name), own)
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(pa.array(["skipped", *texts, None]).slice(1))] == [whole(name, t) for t in [*texts, None]]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")


def test_token_files_round_trip(spark):
    scratch = Scratch(spark, "t")
    manifest = scratch.table(write_token_files(frame(spark), scratch.path("files"), P.path("word_bpe_49k.json"), 2, length=16, rows=4, shard_bytes=8_000), "manifest")
    assert 2 <= manifest.count() <= 6
    out = [tuple(r) for r in read_documents(manifest).collect()]
    ids = {t: np.array([*whole("word_bpe_49k.json", t), 2], "<u4") for _, t in ROWS}
    assert sorted((str(d), n, c) for d, _, n, c in out) == sorted((str(d), len(ids[t]), zlib.crc32(ids[t])) for d, t in ROWS)
    at = 0
    for d, start, n, _ in sorted(out, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [d for d, *_ in sorted(out, key=lambda r: r[1])] == [None, 1, 2, 3, 5, 5, 5, 9]
    for row in manifest.collect():
        seqs, got = SequenceFile(row.tokens_file, row.first_batch, row.batch_bytes), []
        for i in range(-(-row.n_tokens // 16)):
            x, mask = seqs.sequence(i)
            assert len(x) == len(mask) == 16 and mask.dtype == bool and not (x.flags.owndata or mask.flags.owndata or mask.flags.writeable)
            got += x[mask].tolist()
        assert len(got) == row.n_tokens and got == seqs.span(0, row.n_tokens).tolist()
    empty = write_token_files(frame(spark, [])[["doc_id", "text"]], scratch.path("none"), P.path("word_bpe_49k.json"), 2)
    assert read_documents(scratch.table(empty, "empty")).count() == 0


def test_pieces_and_packing(spark):
    pieces = token_pieces(frame(spark), P.path("byte_bpe_50k.json"), 0, capacity=64)
    rows = [r.asDict() for r in pieces.collect()]
    for d, t in ROWS:
        if d in (3, 1, 2, 9):
            ids = np.array([*whole("byte_bpe_50k.json", t), 0], "<u4")
            own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
            assert [r["length"] for r in own[1:]] == [64] * (len(own) - 1) and sum(r["length"] for r in own) == len(ids)
            assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in own)
    packed = [r.asDict() for r in pack(Scratch(spark, "t"), pieces, capacity=64, shard_items=8).collect()]
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in packed) == sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in rows)
    bins = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 64
    assert pack(Scratch(spark, "t"), pieces.limit(0), capacity=64).count() == 0
    with pytest.raises(Exception, match="longer than 32"):
        pack(Scratch(spark, "t"), pieces, capacity=32).collect()


def test_crossovers_beat_best_fit(spark):
    """Planted triples that fill bins to the brim: best fit by size misses the bound, the islands come nearer by crossover and migration."""
    rng, capacity = np.random.default_rng(1), 2048
    x, y = rng.integers(520, 900, 400), rng.integers(520, 620, 400)
    sizes = np.concatenate([x, y, capacity - x - y])
    greedy = len(np.unique(packing.first_packing(sizes, capacity, 0.0, rng)))
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "uid long, length long")
    e = packing.Evolution(generations=60, patience=30, epochs=3)
    state = packing.evolved(items, capacity, 1, e).collect()
    bins = min(-packing.fitness(np.frombuffer(r.packings[0], np.int32), sizes[np.frombuffer(r.uids, np.int64)], capacity)[0] for r in state)
    assert 400 <= bins < greedy
    assert [r.arrived for r in state] == [2] * 3 and all(r.crossovers >= 30 for r in state)
    single = packing.Evolution(epochs=1, generations=0)
    start = min(-packing.fitness(np.frombuffer(r.packings[0], np.int32), sizes[np.frombuffer(r.uids, np.int64)], capacity)[0] for r in packing.evolved(items, capacity, 1, single).collect())
    assert bins < start <= greedy


def test_packing_keeps_columns(spark):
    own = spark.createDataFrame([(5, 10, "a", 1, 9)] * 3 + [(None, 20, None, 2, 9)], "uid long, length long, Offset string, shard int, bin int")
    out = pack(Scratch(spark, "t"), own, capacity=20).collect()
    assert sorted(map(str, ((r.uid, r.length, r.shard, r.bin) for r in out))) == sorted(map(str, [(5, 10, 1, 9)] * 3 + [(None, 20, 2, 9)]))
    assert sorted(r.offset for r in out) == [0, 0, 0, 10] and len({r.sequence_id for r in out}) == 3
    for bad in (None, 0):
        with pytest.raises(Exception, match="a piece is null, empty"):
            pack(Scratch(spark, "t"), spark.createDataFrame([(bad,)], "length long")).collect()


def test_packing_is_near_the_bound(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2049, 3000).tolist()
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long")
    packed = pack(Scratch(spark, "t"), items, shard_items=1000)
    assert packed.select("sequence_id").distinct().count() <= 1.02 * -(-sum(sizes) // 2048)


def plain_count(u: Unigram, word: str) -> int:
    """The same model by a plain forward pass over one word."""
    text, best = u.mark + word, [(0.0, 0)]
    for end in range(1, len(u.mark + word) + 1):
        found = [(best[s][0] + u.score[text[s:end]], -best[s][1] - 1) for s in range(max(0, end - u.longest), end) if text[s:end] in u.score]
        if text[end - 1] not in u.score:
            n = len(text[end - 1].encode())
            found.append((best[end - 1][0] + n * u.byte, -best[end - 1][1] - n))
        score, count = max(found)
        best.append((score, -count))
    return best[-1][1]


def test_token_counts(spark):
    model = P.path("piece_bpe_32k.model")
    u = Unigram.of_file(model)
    words = ["the", "then", "thence", "a", "", "日本", "zzzzqqq", "the" * 9, "é"]
    assert u.counts(words) == {w: plain_count(u, w) for w in words}
    got = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in count_tokens(frame(spark), model).collect()}
    for d, t in ROWS:
        own = (t or "").split()
        assert (d, len(own), sum(plain_count(u, w) for w in own)) in got
    assert count_tokens(frame(spark, []), model).count() == 0
