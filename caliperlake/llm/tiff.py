"""TIFF media columns: walk image directories, decode strips and tiles, one row per page.

Reads both byte orders, any number of directories, strips and tiles, no compression, PackBits, LZW
and deflate, horizontal differencing, 8- and 16-bit samples, channels together.  Writes gray pages of 8-bit samples; a page's
compression follows from its content's checksum, so all three are used at every size.

Defined results: a null or broken file gives one row with page null and ``error`` set, after the pages that could be read;
a page that declares more bytes than ``MOST_PAGE_BYTES``, or than its file can hold at any compression, or whose channels lie in planes of their
own, is such an error; a directory chain that returns to itself ends there; an empty table gives an empty table; other columns
are ignored.  For ``media_digests`` a null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLANAR = 284
TYPE_FORMAT = {1: "B", 3: "H", 4: "I"}

SAMPLES_PER_ROW = 576
#: Arrow holds a page's samples in one value.  A 12-bit LZW code stands for under 4,096 bytes, more than the other codecs reach.
MOST_PAGE_BYTES, MOST_EXPANSION = 1 << 30, 3000
ROWS_PER_PAGE, ROWS_PER_STORED_STRIP, STORED_TILE = 1024, 256, (192, 256)


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    compression: int
    samples: bytes


def unpack_bits(data: bytes) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as repeats, the rest as literals."""
    out, at = bytearray(), 0
    for m in chain(_RUN.finditer(data), (None,)):
        stop = m.start() if m else len(data)
        for k in range(at, stop, 128):
            part = data[k : min(k + 128, stop)]
            out.append(len(part) - 1)
            out += part
        if m:
            out += bytes((257 - len(m[0]), m[0][0]))
            at = m.end()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    out: list[bytes] = []
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if last is None:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        last = entry
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    start = {bytes((i,)): i for i in range(256)}
    table, width, now = dict(start), 9, b""
    put(256, 9)
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more] = len(table) + 2
        now = data[i : i + 1]
        size = len(table) + 2
        if size >= 4094:
            put(256, width)
            table, width = dict(start), 9
        elif size >= 512:
            width = size.bit_length()
    if now:
        put(table[now], width)
        size = len(table) + 3
        width = max(width, size.bit_length() if size >= 512 else 9)
    put(257, min(width, 12))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _decode(raw: bytes, compression: int, size: int) -> bytes:
    """At least the first ``size`` bytes of a strip or tile; deflate stops there."""
    if compression == NONE:
        return raw
    if compression == PACKBITS:
        return unpack_bits(raw)
    if compression == LZW:
        return lzw_decode(raw)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, size)
    raise TiffError(f"compression {compression} is not known")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in TYPE_FORMAT:
            continue
        form = f"{order}{count}{TYPE_FORMAT[kind]}"
        where = entry + 8
        if struct.calcsize(form) > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        tags[tag] = struct.unpack_from(form, data, where)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, channels, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not width or not height or bits not in (8, 16) or predictor not in (1, 2):
        raise TiffError("page layout is not known")
    kind = np.dtype("u1") if bits == 8 else np.dtype(order + "u2")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if one(PLANAR, 1) != 1 and channels > 1:
        raise TiffError("channels in planes of their own")
    if not (channels and across and down) or max(height * width, across * down) * channels * kind.itemsize > min(MOST_PAGE_BYTES, MOST_EXPANSION * len(data)):
        raise TiffError("page is larger than its file can hold")
    out = np.zeros((height, width, channels), kind)
    columns = -(-width // across)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        top, left = k // columns * down, k % columns * across
        if offset + count > len(data) or top >= height:
            raise TiffError("strip or tile outside the file")
        rows = down if tiled else min(down, height - top)
        size = rows * across * channels * kind.itemsize
        flat = np.frombuffer(_decode(data[offset : offset + count], compression, size)[:size], kind)
        if len(flat) < rows * across * channels:
            raise TiffError("strip or tile too short")
        block = flat[: rows * across * channels].reshape(rows, across, channels)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        part = out[top : top + rows, left : left + across]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return Page(width, height, compression, out.tobytes())


def pages_of(data: bytes | None) -> Iterator[Page]:
    """Pages in the order of the directory chain."""
    if not data or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    try:
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise TiffError("not a TIFF file")
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            tags, following = _directory(data, at, order)
            yield _page(data, tags, order)
            at = following
    except (struct.error, zlib.error, KeyError, IndexError, ValueError, MemoryError, OverflowError) as e:
        raise e if isinstance(e, TiffError) else TiffError(str(e)) from e


def _blocks(image: np.ndarray, compression: int, tiled: bool) -> list[bytes]:
    """Differenced and compressed strips, or zero-padded tiles."""
    height, width = image.shape
    if tiled:
        w, h = STORED_TILE
        padded = np.zeros((-(-height // h) * h, -(-width // w) * w), np.uint8)
        padded[:height, :width] = image
        parts = [padded[y : y + h, x : x + w] for y in range(0, padded.shape[0], h) for x in range(0, padded.shape[1], w)]
    else:
        parts = [image[y : y + ROWS_PER_STORED_STRIP] for y in range(0, height, ROWS_PER_STORED_STRIP)]
    pack = {LZW: lzw_encode, PACKBITS: pack_bits, DEFLATE: lambda b: zlib.compress(b, 1), NONE: bytes}[compression]
    out = []
    for p in parts:
        d = p.copy()
        if compression != PACKBITS:
            d[:, 1:] -= p[:, :-1]
        out.append(pack(d.tobytes()))
    return out


def write_tiff(payload: bytes, width: int = SAMPLES_PER_ROW, compression: int | None = None) -> bytes:
    """Gray pages of 8-bit samples, each with the compression that its checksum draws; odd pages in tiles."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k, top in enumerate(range(0, len(samples), ROWS_PER_PAGE)):
        image = samples[top : top + ROWS_PER_PAGE]
        chosen = compression or (LZW, PACKBITS, DEFLATE)[zlib.crc32(image) % 3]
        tiled = bool(k % 2)
        offsets, counts = [], []
        for block in _blocks(image, chosen, tiled):
            offsets.append(len(out))
            counts.append(len(block))
            out += block + b"\0" * (len(block) % 2)
        tags = {WIDTH: [width], HEIGHT: [len(image)], BITS: [8], COMPRESSION: [chosen], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [1 if chosen == PACKBITS else 2]}
        tags |= {TILE_WIDTH: [STORED_TILE[0]], TILE_LENGTH: [STORED_TILE[1]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [min(len(image), ROWS_PER_STORED_STRIP)], STRIP_COUNTS: counts}
        entries = b""
        for tag in sorted(tags):
            values = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            if len(values) > 4:
                where = len(out)
                out += values
                values = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, 4, len(tags[tag])) + values
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 16):
        rows: list[tuple] = []
        ids = b.column(0)
        for i, data in enumerate(b.column(1).to_pylist()):
            k = 0
            try:
                for k, p in enumerate(pages_of(data), 1):
                    rows.append((i, k - 1, p.width, p.height, p.compression, p.samples, None))
            except TiffError as e:
                rows.append((i, None, None, None, None, None, str(e)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int32()] * 4 + [pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["id", "page", "width", "height", "compression", "samples", "error"])


def read_pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each file of a binary column."""
    kind = media.schema[id_col].dataType.simpleString()
    base = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return base.mapInArrow(_read, f"id {kind}, page int, width int, height int, compression int, samples binary, error string").withColumnRenamed("id", id_col)


def feature(payload: bytes, pages: int) -> str:
    """Page count, mean, deviation and entropy of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.square(np.arange(256)) - mean * mean)))
    own = p[p > 0]
    return f"pages={pages};mean={mean:.3f};std={deviation:.3f};entropy={abs(float(-(own * np.log2(own)).sum())):.4f}"


DIGESTS = "doc_id {}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        rows = []
        for text in b.column(1).to_pylist():
            raw = text.encode()
            short = -len(raw) % SAMPLES_PER_ROW if raw else SAMPLES_PER_ROW
            media = write_tiff(raw + b"\xff" * short)
            pages = [p.samples for p in pages_of(media)]
            back = b"".join(pages)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, len(pages))))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in DIGESTS.split(", ")])


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as TIFF pages, read the stored bytes back, and describe both."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_digest, DIGESTS.format(kind)).withColumnRenamed("doc_id", id_col)
