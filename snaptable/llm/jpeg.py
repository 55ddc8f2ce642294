"""Progressive JPEG as a media column: a lossless carrier of bytes, and a decoder (operator 7).

Writing. A byte is stored as one quantised DCT coefficient, the format's unit: 64 bytes make a block. All
coefficients are chosen from -255..-128 and 128..255, the values whose magnitude takes exactly 8 bits, so a
byte is the value's amplitude bits. The file is an ordinary progressive JPEG with three components, chroma
at half resolution both ways, and these scans: DC of all components, then AC coefficients in
spectral bands, two for luminance and one for each chroma component, without their lowest bit, then a refinement scan for each
band (successive approximation). One-symbol Huffman tables make most scans byte-aligned.

Reading. Scans are accumulated into coefficient arrays, whatever their bands and approximation; blocks are
dequantised and inverse-transformed in numpy, chroma is upsampled, and RGB tensors at full resolution come
out. Scans made of one symbol are read as whole arrays; any others bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import batch_blocks
from .scratch import fresh, tidied


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in the order of rising diagonals, turning at each."""
    cells = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * u + v for u, v in cells])


ZIGZAG = _zigzag()
#: Spectral bands of the AC scans of each component.
BANDS = {1: ((1, 5), (6, 63)), 2: ((1, 63),), 3: ((1, 63),)}
#: Row k of the orthonormal DCT.
DCT = np.array([[(0.125 if k == 0 else 0.25) ** 0.5 * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)], np.float32)


# --- entropy-coded segments -----------------------------------------------------------------------


def _stuffed(data: np.ndarray) -> bytes:
    """With a zero byte after each 0xFF."""
    at = np.flatnonzero(data == 255)
    return (np.insert(data, at + 1, 0) if len(at) else data).tobytes()


def _restarts(data: np.ndarray) -> list[np.ndarray]:
    """Segments between restart markers, without the stuffed zeros."""
    ff = np.flatnonzero(data[:-1] == 255)
    marks = ff[(data[ff + 1] & 0xF8) == 0xD0]
    keep = np.ones(len(data), bool)
    keep[ff[data[ff + 1] == 0] + 1] = False
    cuts = [0, *(marks + 2).tolist()]
    ends = [*marks.tolist(), len(data)]
    return [data[a:b][keep[a:b]] for a, b in zip(cuts, ends, strict=True)]


# --- writer ---------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _table(kind: int, slot: int, codes: dict[int, list[int]]) -> bytes:
    """A Huffman table from the symbols of each code length."""
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes(len(codes.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in codes.get(n, [])))


def _scan(components: list[int], band: tuple[int, int], high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([*band, high << 4 | low]))


def _layout(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks, six to an MCU. Sides stay under the format's 65,535."""
    mcus = -(-blocks // 6)
    across = min(4095, max(1, int(mcus**0.5)))
    down = -(-mcus // across)
    if down > 4095:
        raise ValueError("a payload over 6.4 GB does not fit one image")
    return across, down


def encode_payload(payload: bytes) -> bytes:
    """A JPEG whose coefficients are the payload's bytes; its length, a multiple of 64, in a comment."""
    n = len(payload) // 64
    across, down = _layout(n)
    mcus = across * down
    data = np.zeros((mcus * 6, 64), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    parts = [data[: 4 * mcus], data[4 * mcus : 5 * mcus], data[5 * mcus :]]
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, frame)]
    # DC with a restart after every block, so that each is coded from zero: one bit of code, eight of value, padding.
    out += [_table(0, 0, {1: [8]}), _segment(0xDD, struct.pack(">H", 1))]
    for c, p in enumerate(parts, 1):
        rows = np.empty((len(p), 4), np.uint8)
        rows[:, 0], rows[:, 1] = p[:, 0] >> 1, (p[:, 0] << 7) | 0x7F
        rows[:, 2], rows[:, 3] = 255, 0xD0 + np.arange(len(p)) % 8
        flat = rows.reshape(-1)[:-2]
        stuff = 4 * np.flatnonzero(rows[:, 1] == 255) + 2
        out += [_scan([c], (0, 0), 0, 0), np.insert(flat, stuff, 0).tobytes()]
    out += [_segment(0xDD, struct.pack(">H", 0)), _table(1, 0, {1: [7]})]
    for c, p in enumerate(parts, 1):
        for a, b in BANDS[c]:
            out += [_scan([c], (a, b), 0, 1), (p[:, a : b + 1] >> 1).tobytes()]
    out.append(_table(1, 0, {4: [r << 4 for r in range(15)]}))
    for c, p in enumerate(parts, 1):
        # The lowest bit of a negative value's magnitude is the complement of the byte's.
        low = (p & 1) ^ (p < 128)
        for a, b in BANDS[c]:
            bits = []
            for i in range(0, len(p), 32767):
                run = low[i : i + 32767, a : b + 1]
                size = len(run).bit_length() - 1
                head = f"{size:04b}" + f"{len(run) - (1 << size):0{size}b}" * (size > 0)
                bits += [np.frombuffer(head.encode(), np.uint8) - 48, run.reshape(-1)]
            flat = np.concatenate(bits)
            out += [_scan([c], (a, b), 1, 0), _stuffed(np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])))]
    return b"".join([*out, b"\xff\xd9"])


# --- reader ---------------------------------------------------------------------------------------


@dataclass
class Component:
    h: int
    v: int
    quant: int
    across: int = 0  #: blocks in a row
    down: int = 0
    scanned: tuple[int, int] = (0, 0)  #: blocks across and down in a scan of this component alone
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))  #: in zigzag order


class Codes:
    """A Huffman table: symbols by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols, code, k = {}, 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                self.symbols[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class Bits:
    def __init__(self, data: np.ndarray):
        self.bits, self.at = np.unpackbits(data).tolist(), 0

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n]:
            x = 2 * x + b
        self.at += n
        return x

    def symbol(self, codes: Codes) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + self.take(1)
            if (found := codes.symbols.get((n, code))) is not None:
                return found
        raise ValueError("no such Huffman code")


def _signed(amplitude, size):
    return np.where(amplitude >> (size - 1), amplitude, amplitude - (1 << size) + 1)


def _fast_scan(raw: np.ndarray, coefs: np.ndarray, codes: Codes, band: tuple[int, int], high: int, low: int, restart: int) -> bool:
    """Scans of one component that are regular enough to read as arrays. False: read it bit by bit."""
    n, width = len(coefs), band[1] - band[0] + 1
    if high == 0 and codes.only is not None and 0 < codes.only < 16:
        size = codes.only
        if band == (0, 0):
            each = -(-(1 + size) // 8)
            ff = np.flatnonzero(raw[:-1] == 255)
            flat = np.append(np.delete(raw, ff[raw[ff + 1] == 0] + 1), (255, 0xD0)).astype(np.uint8)
            if restart != 1 or len(flat) != n * (each + 2):
                return False
            rows = flat.reshape(n, each + 2)
            if not (rows[:, each] == 255).all() or not ((rows[:, each + 1] & 0xF8) == 0xD0).all():
                return False
            bits = np.unpackbits(rows[:, :each], axis=1)[:, 1 : 1 + size]
            coefs[:, 0] = _signed(bits @ (1 << np.arange(size)[::-1]), size) << low
            return True
        if restart or (raw == 255).any():
            return False
        if size == 7:
            amplitude = raw.reshape(n, width).astype(np.int16)
        else:
            bits = np.unpackbits(raw)[: n * width * (1 + size)].reshape(n, width, 1 + size)[:, :, 1:]
            amplitude = bits @ (1 << np.arange(size)[::-1])
        coefs[:, band[0] : band[1] + 1] = _signed(amplitude, size) << low
        return True
    part = coefs[:, band[0] : band[1] + 1]
    if high and band[0] and not restart and part.all():
        ff = np.flatnonzero(raw[:-1] == 255)
        bits, at, done = np.unpackbits(np.delete(raw, ff + 1)), 0, 0
        while done < n:
            head = Bits(np.packbits(bits[at : at + 32]))
            symbol = head.symbol(codes)
            if symbol & 15 or symbol >> 4 > 14:
                return False
            run = (1 << (symbol >> 4)) + head.take(symbol >> 4)
            found = bits[at + head.at : at + head.at + run * width].reshape(run, width).astype(np.int16)
            rows = part[done : done + run]
            rows += np.where(rows > 0, found, -found) << low
            at, done = at + head.at + run * width, done + run
        return True
    return False


def _ac_block(bits: Bits, row: np.ndarray, codes: Codes, band: tuple[int, int], high: int, low: int, run: int) -> int:
    """One block of an AC scan; takes and gives the end-of-band run."""
    k, one = band[0], 1 << low

    def correct(i: int) -> None:
        if bits.take(1):
            row[i] += one if row[i] > 0 else -one

    while k <= band[1] and not run:
        symbol = bits.symbol(codes)
        skip, size = symbol >> 4, symbol & 15
        if size == 0 and skip < 15:
            run = (1 << skip) + bits.take(skip)
            break
        value = int(_signed(np.int64(bits.take(size)), size)) * one if size else 0
        if not high:
            k += skip
            if size:
                row[k] = value
            k += 1
            continue
        while k <= band[1]:
            if row[k]:
                correct(k)
            elif skip:
                skip -= 1
            else:
                row[k] = value
                k += 1
                break
            k += 1
    if run:
        if high:
            for i in range(k, band[1] + 1):
                if row[i]:
                    correct(i)
        run -= 1
    return run


def _slow_scan(raw: np.ndarray, parts: list[tuple[Component, Codes, Codes]], band: tuple[int, int], high: int, low: int, restart: int, mcus: tuple[int, int]) -> None:
    if len(parts) == 1:
        c = parts[0][0]
        places = [[(0, y * c.across + x)] for y in range(c.scanned[1]) for x in range(c.scanned[0])]
    else:
        places = [[(i, (my * c.v + y) * c.across + mx * c.h + x) for i, (c, _, _) in enumerate(parts) for y in range(c.v) for x in range(c.h)] for my in range(mcus[1]) for mx in range(mcus[0])]
    step = restart or len(places)
    for k, data in enumerate(_restarts(raw)):
        bits, before, run = Bits(data), [0] * len(parts), 0
        for mcu in places[k * step : (k + 1) * step]:
            for i, at in mcu:
                c, dc, ac = parts[i]
                if band[0]:
                    run = _ac_block(bits, c.coefs[at], ac, band, high, low, run)
                elif high:
                    c.coefs[at, 0] |= bits.take(1) << low
                else:
                    size = bits.symbol(dc)
                    before[i] += int(_signed(np.int64(bits.take(size)), size)) if size else 0
                    c.coefs[at, 0] = before[i] << low


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


def read_coefficients(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    array = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((array[:-1] == 255) & (array[1:] != 0) & ((array[1:] & 0xF8) != 0xD0))
    codes, quants, parts, idents, comment, restart = {}, {}, [], {}, b"", 0
    at, width, height, mcus = 2, 0, 0, (0, 0)
    while data[at + 1] != 0xD9:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation is not supported")
                quants[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.float32), body[65:]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], body = Codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            idents = {body[6 + 3 * i]: p for i, p in enumerate(parts)}
            h, v = max(p.h for p in parts), max(p.v for p in parts)
            mcus = -(-width // (8 * h)), -(-height // (8 * v))
            for p in parts:
                p.across, p.down = mcus[0] * p.h, mcus[1] * p.v
                p.scanned = -(-width * p.h // (8 * h)), -(-height * p.v // (8 * v))
                p.coefs = np.zeros((p.across * p.down, 64), np.int16)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded JPEG is supported")
        elif kind == 0xDA:
            n = body[0]
            chosen = [(idents[body[1 + 2 * i]], codes.get(body[2 + 2 * i] >> 4), codes.get(16 | body[2 + 2 * i] & 15)) for i in range(n)]
            band, high, low = (body[1 + 2 * n], body[2 + 2 * n]), body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = int(marks[np.searchsorted(marks, at)])
            raw, at = array[at:end], end
            own = chosen[0][0]
            whole = n == 1 and own.scanned == (own.across, own.down)
            table = chosen[0][2] if band[0] else chosen[0][1]
            if not (whole and table and _fast_scan(raw, own.coefs, table, band, high, low, restart)):
                _slow_scan(raw, chosen, band, high, low, restart, mcus)
    return Image(width, height, parts, quants, comment)


def _inverse() -> np.ndarray:
    """From a block's coefficients in zigzag order to its samples, as one matrix."""
    return np.kron(DCT, DCT)[ZIGZAG]


INVERSE = _inverse()


def to_rgb(image: Image) -> np.ndarray:
    """Height x width x 3 samples, chroma upsampled to full resolution."""
    planes, h, v = [], max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        samples = np.rint((c.coefs * image.quants[c.quant]) @ INVERSE + 128).clip(0, 255)
        plane = samples.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)
        planes.append(plane.repeat(v // c.v, 0).repeat(h // c.h, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.rint(rgb).clip(0, 255).astype(np.uint8)


def payload_of(image: Image) -> bytes:
    """The bytes that encode_payload stored."""
    coefs = np.concatenate([c.coefs for c in image.components])
    data = np.where(coefs > 0, coefs, coefs + 255).astype(np.uint8)
    return data.tobytes()[: struct.unpack(">Q", image.comment)[0]]


# --- columns --------------------------------------------------------------------------------------


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64 - len(raw), -len(raw) % 64))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a JPEG) of every text. A null text is an empty one: 64 zero bytes. Repeated
    rows and null doc_ids stay; other columns are not read. No shuffle; about 2 MB of texts, one at least, are
    worked on at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in batch_blocks(batch)):
            found = [padded(t) for t in part.column("text").to_pylist()]
            media = pa.array([encode_payload(p) for _, p in found], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([n for n, _ in found], pa.int64()), "media": media})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns, with width, height and rgb (height x width x 3 bytes) of each JPEG; null stays null. Columns of
    those names stay as they are, and the new ones get underscores."""
    kept = [c for c in media.columns if c != column]
    width, height, tensor = (fresh(c, kept) for c in ("width", "height", "rgb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in batch_blocks(batch, column, 1_000_000, 50)):
            tensors = [to_rgb(read_coefficients(m)) if m is not None else None for m in part.column(column).to_pylist()]
            out = {c: part.column(c) for c in kept}
            out[width] = pa.array([t if t is None else t.shape[1] for t in tensors], pa.int32())
            out[height] = pa.array([t if t is None else t.shape[0] for t in tensors], pa.int32())
            out[tensor] = pa.array([t if t is None else t.tobytes() for t in tensors], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in kept), f"`{width}` int, `{height}` int, `{tensor}` binary"])
    return media.select(*kept, column).mapInArrow(tidied(run), schema)


#: Cells of a thumbnail in each direction.
GRID = 4


def thumbnail(rgb: np.ndarray, grid: int = GRID) -> np.ndarray:
    """grid x grid x 3 bytes: mean colours of equal cells, rounded down; a cell has one row and column at least."""
    (height, width), cells = rgb.shape[:2], np.arange(grid)
    top, left = (np.minimum(cells * n // grid, n - 1) for n in (height, width))
    sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.int64), top, 0), left, 1) if height >= grid and width >= grid else rgb[top][:, left].astype(np.int64)
    if height < grid or width < grid:
        return sums.astype(np.uint8)
    rows, columns = np.diff(np.append(top, height)), np.diff(np.append(left, width))
    return (sums // (rows[:, None] * columns[None, :])[:, :, None]).astype(np.uint8)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Per row of encode_media, from the stored bytes: the payload's digests and a feature of its RGB tensor, its size and
    a thumbnail of GRID x GRID mean colours in hex."""

    def digest(doc_id, n, media: bytes) -> dict:
        image = read_coefficients(media)
        payload, rgb = payload_of(image), to_rgb(image)
        feature = f"{image.width}x{image.height}:{thumbnail(rgb).tobytes().hex()}"
        return {"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in batch_blocks(batch, "media")):
            rows = [digest(r["doc_id"], r["n_bytes"], r["media"]) for r in part.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in DIGEST.split(", "))]))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), DIGEST)
