import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptable.llm import chat, jpeg, vp_search
from snaptable.llm.scratch import Scratch


@pytest.mark.parametrize("payload", [bytes(64), bytes(range(256)) * 3, b"\xff" * 640, np.random.default_rng(0).bytes(64 * 50)])
def test_payload_round_trip_both_ways_of_reading(payload, monkeypatch):
    media = jpeg.encode_payload(payload)
    image = jpeg.read_coefficients(media)
    assert jpeg.payload_of(image) == payload
    rgb = jpeg.to_rgb(image)
    assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8
    monkeypatch.setattr(jpeg, "_fast_scan", lambda *a: False)
    slow = jpeg.read_coefficients(media)
    assert all((a.coefs == b.coefs).all() for a, b in zip(image.components, slow.components, strict=True))


def test_a_grey_block_is_its_mean():
    image = jpeg.Image(8, 8, [jpeg.Component(1, 1, 0, 1, 1, (1, 1), np.array([[80] + [0] * 63], np.int16))], {0: np.ones(64, np.float32)})
    assert (jpeg.to_rgb(image) == 138).all()


def plain_rgb(image):
    """Samples by the transform's definition, cosine by cosine, and the colour formula pixel by pixel."""
    zigzag = [(0, 0)]
    while len(zigzag) < 64:  # along the diagonals, turning at the edges
        (u, v), up = zigzag[-1], sum(zigzag[-1]) % 2 == 0
        zigzag.append(((u, v + 1) if v < 7 and (u == 0) else (u + 1, v) if v == 7 else (u - 1, v + 1)) if up else ((u + 1, v) if u < 7 and v == 0 else (u, v + 1) if u == 7 else (u + 1, v - 1)))
    planes = []
    for c in image.components:
        plane = np.zeros((c.down * 8, c.across * 8))
        for b, block in enumerate(c.coefs):
            for y in range(8):
                for x in range(8):
                    total = 0.0
                    for k, (u, v) in enumerate(zigzag):
                        scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                        total += scale * block[k] * image.quants[c.quant][k] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)
                    plane[b // c.across * 8 + y, b % c.across * 8 + x] = min(255, max(0, round(total + 128)))
        planes.append(plane)
    out = np.zeros((image.height, image.width, 3))
    for i in range(image.height):
        for j in range(image.width):
            y, cb, cr = planes[0][i, j], planes[1][i // 2, j // 2] - 128, planes[2][i // 2, j // 2] - 128
            out[i, j] = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(out), 0, 255)


def test_inverse_transform_against_its_definition():
    image = jpeg.read_coefficients(jpeg.encode_payload(np.random.default_rng(3).bytes(64 * 6)))
    want, got = plain_rgb(image), jpeg.to_rgb(image).astype(float)
    # Single precision may round a sample the other way: by one, which colour carries on.
    assert want.shape == got.shape == (16, 16, 3) and np.abs(want - got).max() <= 3 and (want != got).mean() < 0.01


def test_media_digest(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "x" * 70_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, media int")
    out = jpeg.media_digest(Scratch(spark, "t").table(jpeg.encode_media(docs), "media")).collect()
    want = sorted((str(d), len((t or "").encode()), hashlib.sha256(jpeg.padded(t)[1]).hexdigest(), zlib.crc32(jpeg.padded(t)[1][-64:])) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert len({(r.media_sha256, r.feature) for r in out if r.doc_id in (1, 2)}) == 1
    tensors = jpeg.decode_media(jpeg.encode_media(docs)).collect()
    assert all(len(r.rgb) == 3 * r.width * r.height for r in tensors)
    assert jpeg.encode_media(docs.limit(0)).count() == 0
    clash = jpeg.decode_media(jpeg.encode_media(docs).withColumnRenamed("n_bytes", "width").withColumn("RGB", F.lit("own")))
    assert clash.columns == ["doc_id", "width", "RGB", "width_", "height", "rgb_"] and {(r["width"], r["RGB"], len(r["rgb_"]) == 3 * r["width_"] * r["height"]) for r in clash.collect()} == {(len((t or "").encode()), "own", True) for _, t in rows}


def test_thumbnails():
    rng = np.random.default_rng(4)
    for height, width in ((16, 24), (4, 4), (9, 5), (3, 7), (1, 1)):
        rgb = rng.integers(0, 256, (height, width, 3), np.uint8)
        top, left = ([min(i * n // 4, n - 1) for i in range(4)] for n in (height, width))
        want = [[rgb[a : max(b, a + 1), c : max(d, c + 1)].reshape(-1, 3).astype(int).sum(0) // (max(b - a, 1) * max(d - c, 1)) for c, d in zip(left, [*left[1:], width])] for a, b in zip(top, [*top[1:], height])] if min(height, width) >= 4 else rgb[top][:, left]
        assert jpeg.thumbnail(rgb).tolist() == np.array(want).tolist()


def plain_rotation(rows, person):
    text, mask = "", []
    for _, role, content in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        name = "assistant" if role == person else "system" if role == "system" else f"user name={role}"
        text += f"<|{name}|>\n"
        if role == person:
            mask.append((len(text), len(content)))
        text += content + "\n<|end|>\n"
    return text, mask


def test_rotation(spark):
    rows = [(0, "system", "s"), (1, "ann", "hi é"), (2, "bob", ""), (3, "ann", "yo"), (3, "ann", "yo"), (1500, "cy", "late")]
    frame = spark.createDataFrame([(7, *r, 1) for r in rows] + [(8, 0, "system", "only", 1), (9, None, None, None, 1)], "conv_id long, turn long, role string, text string, part int")
    out = chat.rotate(frame).collect()
    for person in ("ann", "bob", "cy"):
        own = sorted((r for r in out if r.conv_id == 7 and r.assistant == person), key=lambda r: r.part)
        text, mask = plain_rotation(rows, person)
        assert "".join(r.text for r in own) == text and [r.part_start for r in own] == [0, len(own[0].text)]
        assert [(r.part_start + m.start, m.length) for r in own for m in r["mask"]] == mask
    assert [(r.assistant, r.text) for r in out if r.conv_id == 9] == [("unknown", "<|assistant|>\n\n<|end|>\n")]
    assert not [r for r in out if r.conv_id == 8] and chat.rotate(frame.limit(0)).count() == 0


def test_crowded_turns_come_in_pieces(spark):
    """A third of all rows has one turn number, others none; repeated rows among them, and long texts."""
    rng = np.random.default_rng(6)
    role = lambda: str(rng.choice(["ann", "bob", "system"]))
    rows = [(t, role(), str(rng.integers(5)) * int(rng.integers(4))) for t in [3] * 500 + [None] * 90 + list(range(40))] + [(3, "ann", "same")] * 70 + [(5, "bob", "y" * 100_000)]
    frame = spark.createDataFrame([("hot", *r) for r in rows] + [("small", 1, "ann", "a")], "conv_id string, turn long, role string, text string").repartition(6)
    out = chat.rotate(frame, block=8, most=50).collect()
    assert all(r.n_turns <= 50 for r in out) and [(r.assistant, r.part, r.piece, r.part_start) for r in out if r.conv_id == "small"] == [("ann", 0, 0, 0)]
    for person in ("ann", "bob"):
        own = sorted((r for r in out if r.conv_id == "hot" and r.assistant == person), key=lambda r: (r.part, r.piece))
        text, mask = plain_rotation([r for r in rows if r[0] is None], person)
        late, later = plain_rotation([r for r in rows if r[0] is not None], person)
        text, mask = text + late, mask + [(a + len(text), n) for a, n in later]
        assert "".join(r.text for r in own) == text and {(r.part, r.piece) for r in own} > {(0, k) for k in range(10)}
        assert [(r.part_start + m.start, m.length) for r in own for m in r["mask"]] == mask


def test_rotation_of_odd_ids(spark):
    """A null conversation is not the one called null; the participants of each stay in it. Many parts, one of them before zero."""
    rows = [("null", 0, "ann", "a"), (None, 0, "bob", "b"), ("0", 0, "cy", "c")] + [("hot", t, r, "x" * ((t or 0) % 5)) for t in (None, -3, *range(0, 60, 2)) for r in ("ann", "bob", "system")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), block=8).collect()
    assert {(r.conv_id, r.assistant) for r in out} == {("null", "ann"), (None, "bob"), ("0", "cy"), ("hot", "ann"), ("hot", "bob")}
    for person in ("ann", "bob"):
        own = sorted((r for r in out if r.conv_id == "hot" and r.assistant == person), key=lambda r: r.part)
        hot = [r[1:] for r in rows if r[0] == "hot"]
        text, mask = plain_rotation([r for r in hot if r[0] is None], person)
        late, later = plain_rotation([r for r in hot if r[0] is not None], person)
        text, mask = text + late, mask + [(a + len(text), n) for a, n in later]
        assert own[0].part == -1 and own[0].n_turns == 6 and len(own) == 9 and "".join(r.text for r in own) == text
        assert [(r.part_start + m.start, m.length) for r in own for m in r["mask"]] == mask


def brute(ids, vectors, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_search_against_brute_force(spark, factor, monkeypatch):
    monkeypatch.setattr(vp_search, "SHARD", 150)
    monkeypatch.setattr(vp_search, "LEAF", 16)
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 8)) * rng.random((400, 1))
    vectors[100:160] = vectors[100]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0)], "vec_id long, embedding array<double>, score int")
    got = {}
    scratch = Scratch(spark, "t")
    for r in vp_search.nearest(scratch, frame, F.col("vec_id") % 20 == 0, factor=factor).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(400), vectors)
    if factor == 1:
        assert got == want
    else:
        assert 0 < vp_search.visited(scratch) <= 20 * 400
    # By scores: of equal vectors, as many stand there as here, a larger factor may miss the smaller ids.
    least = {q: vectors[q] @ vectors[want[q][-1]] - 1e-12 for q in want}
    assert got.keys() == want.keys() and np.mean([np.mean([vectors[q] @ vectors[i] >= least[q] for i in got[q]]) for q in want]) >= 0.9
    assert vp_search.nearest(Scratch(spark, "t"), frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_regions_are_drawn_without_a_large_shuffle(spark, monkeypatch):
    rows = spark.range(200_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 0, 3).otherwise(2).alias("dim"), F.array(F.rand(1), F.rand(2)).alias("v"))
    monkeypatch.setattr(vp_search, "SHARD", 1000)
    found = vp_search.drawn(rows, {2: 200_000})
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    hashes = {r.vec_id: r.h for r in rows.select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h")).collect()}
    by_v = {tuple(r.v): r.vec_id for r in rows.collect()}
    assert [by_v[tuple(r.v)] for r in sorted(found.collect(), key=lambda r: r["at"])] == sorted(hashes, key=lambda i: (hashes[i], i))[:200]


def test_search_skips_regions_of_other_clusters(spark, monkeypatch):
    """Well separated clusters: exact search leaves most regions out. Dimensions are searched apart; repeated rows are kept."""
    monkeypatch.setattr(vp_search, "SHARD", 100)
    monkeypatch.setattr(vp_search, "LEAF", 16)
    rng = np.random.default_rng(5)
    vectors = np.repeat(np.eye(8) * 10, 100, axis=0) + 0.05 * rng.standard_normal((800, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000 + i, [1.0, float(i)]) for i in range(25)] + [(2020, [9.0, 9.0]), (2003, [1.0, 3.0])]
    scratch = Scratch(spark, "t")
    out = vp_search.nearest(scratch, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, factor=1.0).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: x for q, x in got.items() if q < 2000} == brute(np.arange(800), vectors)
    assert vp_search.visited(scratch) < 0.8 * 40 * 800
    # 2020 is one query, of its least vector (1, 20), and no neighbour of itself; 2003 is a candidate twice.
    assert got[2020] == [*range(2024, 2020, -1), *range(2019, 2003, -1)] and got[2000][:2] == [2020, 2001] and got[2000].count(2003) == 2
