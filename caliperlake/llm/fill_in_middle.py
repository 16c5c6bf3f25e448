"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames with, for each, the units, characters and bytes
before it.  A unit is a maximal run of ASCII letters or any other single character.  A cut is found
by its unit number in the cumulative counts, and only the frame that holds it is decompressed; the parts
are then streamed frame by frame in the order of the output, so a task holds one frame of text at
a time besides the compressed ones.  The output is stored as frames as well, and the text is
rebuilt from those and the form alone.

Defined results: a null text counts as empty, an empty text is ``plain``.  Very long texts, and words of any
length, are cut into more frames.  A null id draws as the empty string would; rows with equal ids draw alike,
repeated rows are repeated; ties of the two drawn cuts leave an empty middle.  Further columns of any name are
ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty

FRAME_BYTES = 1 << 14
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
SEEK = "struct<units: bigint, chars: bigint, bytes: bigint, at: bigint>"


class Frame(NamedTuple):
    """Units, characters and bytes of the text, and compressed bytes, before a frame.  The last entry of a list has the totals."""

    units: int
    chars: int
    bytes: int
    at: int


@functools.cache
def _kinds() -> np.ndarray:
    """Of each byte: 1 for an ASCII letter, 2 for a byte inside a character, else 0."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(65, 91), *range(97, 123)]] = 1
    kinds[0x80:0xC0] = 2
    return kinds


def _starts(data: bytes, before: int) -> np.ndarray:
    """True where a unit starts; before: kind of the byte ahead of data."""
    kind = _kinds()[np.frombuffer(data, np.uint8)]
    ahead = np.empty_like(kind)
    ahead[:1] = before
    ahead[1:] = kind[:-1]
    return (kind == 0) | ((kind == 1) & (ahead != 1))


@functools.cache
def _writer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=False)


@functools.cache
def _reader() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


class Frames:
    """A text as frames, written once from pieces of bytes and read in any order."""

    def __init__(self, body: bytes = b"", seek: list[Frame] | None = None) -> None:
        self.body, self.seek = memoryview(body), seek or [Frame(0, 0, 0, 0)]

    @classmethod
    def write(cls, pieces: Iterable[bytes], size: int = FRAME_BYTES) -> Frames:
        out, seek, held, before = [], [Frame(0, 0, 0, 0)], bytearray(), 0

        def close(n: int) -> None:
            nonlocal before
            data = bytes(held[:n])
            del held[:n]
            packed, last = _writer().compress(data), seek[-1]
            inside = int(np.count_nonzero(_kinds()[np.frombuffer(data, np.uint8)] == 2))
            out.append(packed)
            seek.append(Frame(last.units + int(np.count_nonzero(_starts(data, before))), last.chars + n - inside, last.bytes + n, last.at + len(packed)))
            before = int(_kinds()[data[-1]])

        for piece in pieces:
            for at in range(0, len(piece), size):
                held += piece[at : at + size]
                while len(held) >= size + 4:
                    n = size
                    while _kinds()[held[n]] == 2:  # a character is whole in one frame
                        n -= 1
                    close(n)
        if held:
            close(len(held))
        return cls(b"".join(out), seek)

    def frame(self, k: int) -> bytes:
        return _reader().decompress(self.body[self.seek[k].at : self.seek[k + 1].at])

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters before the unit of this number; only its frame is decompressed."""
        if units >= self.seek[-1].units:
            return self.seek[-1].bytes, self.seek[-1].chars
        k = bisect_right(self.seek, units, key=lambda f: f.units) - 1
        data = self.frame(k)
        before = int(_kinds()[self.frame(k - 1)[-1]]) if k and _kinds()[data[0]] == 1 else 0
        at = int(np.flatnonzero(_starts(data, before))[units - self.seek[k].units])
        inside = int(np.count_nonzero(_kinds()[np.frombuffer(data[:at], np.uint8)] == 2))
        return self.seek[k].bytes + at, self.seek[k].chars + at - inside

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, a frame at a time."""
        k = bisect_right(self.seek, start, key=lambda f: f.bytes) - 1
        while start < end:
            data, first = self.frame(k), self.seek[k].bytes
            yield data[start - first : end - first]
            k += 1
            start = self.seek[k].bytes

    def find(self, marks: Iterable[bytes]) -> list[int]:
        """Places of the marks, each sought behind the one before; -1 from the first that is missing."""
        marks, found, held, base = list(marks), [], b"", 0
        for data in self.stream(0, self.seek[-1].bytes):
            held += data
            while len(found) < len(marks) and (at := held.find(marks[len(found)])) >= 0:
                found.append(base + at)
                base, held = base + at + len(marks[len(found) - 1]), held[at + len(marks[len(found) - 1]) :]
            if len(found) == len(marks):
                break
            keep = min(len(held), len(marks[len(found)]) - 1)
            base, held = base + len(held) - keep, held[len(held) - keep :]
        return found + [-1] * (len(marks) - len(found))


def transformed(text: Frames, form: str, first: int, second: int) -> tuple[Iterator[bytes], int | None, int | None]:
    """The output as a stream, and the characters of prefix and middle (none for plain).  first, second: units ahead of middle and suffix."""
    end = text.seek[-1].bytes
    if form not in ORDERS:
        return text.stream(0, end), None, None
    (b1, c1), (b2, c2) = text.cut(first), text.cut(second)
    spans = {"prefix": (0, b1), "middle": (b1, b2), "suffix": (b2, end)}

    def stream() -> Iterator[bytes]:
        for part in ORDERS[form]:
            yield MARKS[part]
            yield from text.stream(*spans[part])

    return stream(), c1, c2 - c1


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, from its output and form; a text with a mark in it is never cut, so each mark stands once."""
    end = output.seek[-1].bytes
    if form not in ORDERS:
        yield from output.stream(0, end)
        return
    order = ORDERS[form]
    at = [*output.find(MARKS[p] for p in order), end]
    if at[0] != 0 or min(at) < 0:
        raise ValueError(f"the output is not of form {form}")
    spans = {p: (at[k] + len(MARKS[p]), at[k + 1]) for k, p in enumerate(order)}
    for part in ("prefix", "middle", "suffix"):
        yield from output.stream(*spans[part])


def _rows(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def _batch(b: pa.RecordBatch, same: list[str], new: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    kept = [b.column(b.schema.get_field_index(c)) for c in same]
    return pa.RecordBatch.from_arrays(kept + [pa.array(v, t) for v, t in new.values()], [*same, *new])


_SEEK = pa.list_(pa.struct([(c, pa.int64()) for c in Frame._fields]))


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        texts = b.column(b.schema.get_field_index("text"))
        # One text after another as a view of the batch, never as a list of strings.
        frames = [Frames.write([memoryview(t.as_buffer())]) if t.is_valid else Frames() for t in texts]
        yield _batch(b, ["doc_id", "marked"], {"body": ([bytes(f.body) for f in frames], pa.binary()), "seek": ([[x._asdict() for x in f.seek] for f in frames], _SEEK)})


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, marked (the text holds a mark), body (frames) and seek (what lies before each frame, and the totals), written under the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    marked = functools.reduce(Column.__or__, (text.contains(m.decode()) for m in MARKS.values()))
    stored = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), marked.alias("marked")).mapInArrow(_store, f"doc_id {kind}, marked boolean, body binary, seek array<{SEEK}>")
    return materialise(stored, "frames", compression="none")


def draws(stored: DataFrame) -> DataFrame:
    """The rows with n (units), form, and first and second (units ahead of middle and suffix)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    n = F.element_at("seek", -1)["units"]
    plain = (n == 0) | F.col("marked") | (h[2] % 100 >= PLAIN_FROM)
    cuts = [h[k] % (n + 1) for k in range(2)]
    return stored.withColumns({"n": n, "form": F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm"), "first": F.least(*cuts), "second": F.greatest(*cuts)})


def _each(b: pa.RecordBatch) -> Iterator[tuple[str, Iterator[bytes], int | None, int | None]]:
    for body, seek, form, first, second in zip(*(_rows(b, c) for c in ("body", "seek", "form", "first", "second")), strict=True):
        yield form, *transformed(Frames(body, [Frame(**x) for x in seek]), form, first, second)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 16):
        made = [(b"".join(out).decode(), c1, c2) for _, out, c1, c2 in _each(b)]
        output, prefix, middle = zip(*made, strict=True) if made else ((), (), ())
        yield _batch(b, ["doc_id", "n", "form"], {"prefix_chars": (prefix, pa.int64()), "middle_chars": (middle, pa.int64()), "output": (output, pa.string())})


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Training texts: id, n, form, prefix_chars, middle_chars and output of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = draws(store_frames(docs, id_col, text_col))
    return rows.mapInArrow(_texts, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("doc_id", id_col)


def _sha(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for p in pieces:
        digest.update(p)
    return digest.hexdigest()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        rows = []
        for form, out, c1, c2 in _each(b):
            output = Frames.write(out)
            rows.append((c1, c2, _sha(output.stream(0, output.seek[-1].bytes)), _sha(restored(output, form))))
        prefix, middle, made, back = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield _batch(b, ["doc_id", "n", "form"], {"prefix_chars": (prefix, pa.int64()), "middle_chars": (middle, pa.int64()), "output_sha256": (made, pa.string()), "restored_sha256": (back, pa.string())})


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fill_in_middle, with the digests of the stored output and of the text rebuilt from it in place of the output."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = draws(store_frames(docs, id_col, text_col))
    return rows.mapInArrow(_digests, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string").withColumnRenamed("doc_id", id_col)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT doc_id, text, n, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
