"""Repeated long byte strings over a whole corpus, by run-length indexes of the parts that may repeat.

1. Every text's anchors: the least 24-byte gram (by hash) of each 128 grams.  Equal 200-byte strings hold
   equal anchors, so a string with an anchor that occurs once in the corpus cannot repeat.
2. What is left is cut into snippets: runs of 200-byte windows whose rarest anchor is the same one.  Equal windows have equal
   rarest anchors, so comparing snippets of one anchor is enough.
3. Equal snippets are counted, not compared: their windows repeat.  Anchors with other snippets go to a
   run-length index (see ``run_index``), and its matching statistics mark the windows that also start elsewhere.
4. An anchor whose distinct snippets have more bytes than an index should hold is not indexed by one task: its windows are dealt by their
   own digests and counted, so a passage in many differing texts is spread over all tasks.

Defined results: a null text counts as empty; texts under 200 bytes lose nothing; repeated rows are copies
of each other; strings of one document that repeat within it count; an empty table gives an empty table.  ``repeat_digests`` ignores other
columns; ``remove_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, same, slices, text_or_empty
from .run_index import repeated_windows

LENGTH, GRAM, GRAMS = 200, 24, 128
REACH = LENGTH - GRAM - GRAMS + 1  # a window of LENGTH bytes at s holds the gram windows s .. s + REACH
CHUNK_BYTES, SEEN = 2_000_000, 500_000
_PLACE_BITS = 28
_LOW = np.uint64((1 << _PLACE_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, p in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            run = np.full(2 * n, np.uint64(p))
            run[0] = 1
            _POWERS[i] = np.multiply.accumulate(run)
    return _POWERS


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first gram window, anchor hash) of each run of gram windows with the same least gram."""
    raw = b"".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none
    n = len(raw)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    grams = len(h)
    padded = np.full(-(-grams // GRAMS) * GRAMS, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:grams] = (h & ~_LOW) | (_LOW - np.arange(grams, dtype=np.uint64))  # the last of equal grams is the least
    rows = padded.reshape(-1, GRAMS)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = grams - GRAMS + 1
    least = np.minimum(after[:windows], before[GRAMS - 1 : GRAMS - 1 + windows])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)[:windows]
    g = np.flatnonzero((np.arange(windows) + GRAMS + GRAM - 1 <= ends[text]) & (lengths[text] >= LENGTH))
    if not len(g):
        return none, none, none
    place, text = place[g], text[g]
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    return text[new], g[new] - (ends - lengths)[text[new]], h[place[new]].view(np.int64)


def _gathered(batches: Iterable[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, one row at least, so that the arrays stay in the processor cache; the text is the last column."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0))
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                yield b.slice(x, y - x)


def _count_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _gathered(batches):
        found, n = np.unique(anchor_runs([t.encode() for t in b.column(0).to_pylist()])[2], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _list_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _gathered(batches):
        text, _, anchor = anchor_runs([t.encode() for t in b.column(1).to_pylist()])
        pairs = np.unique(np.stack([text, anchor], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["rid", "anchor"])


def snippets(data: bytes, firsts: list[int], anchors: list[int], counts: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window, windows) of each run of windows that may repeat and have the same rarest anchor, at the same place.

    firsts and anchors are the runs of ``anchor_runs``; counts has the anchors that occur more than once.
    """
    last = len(data) - LENGTH
    stops = [*firsts[1:], len(data) - GRAMS - GRAM + 2]
    # A run of gram windows lies in the windows first - REACH .. stop - 1.
    spans = [(max(0, f - REACH), min(last, s - 1), counts.get(a, 1), a, k) for k, (f, s, a) in enumerate(zip(firsts, stops, anchors, strict=True))]
    marks = sorted({x for span in spans for x in (span[0], span[1] + 1) if x <= last})
    low, held = 0, None
    for at, to in zip(marks, [*marks[1:], last + 1], strict=True):
        while spans[low][1] < at:
            low += 1
        best, k = None, low
        while k < len(spans) and spans[k][0] <= at:
            if spans[k][2] < 2:
                best = None
                break
            best = min(best or spans[k][2:], spans[k][2:])
            k += 1
        if held and (best is None or best[1:] != held[0]):
            yield held[0][0], *held[1:]
            held = None
        if best:
            held = (best[1:], at, to - at) if held is None else (held[0], held[1], to - held[1])
    if held:
        yield held[0][0], *held[1:]


_SNIPPETS = "doc_id {}, rid bigint, start bigint, windows bigint, anchor bigint, sig binary, data binary"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets; only the first of equal ones in a task carries its bytes, so a hot snippet is small rows but for one in each task."""
    import xxhash

    given: set[bytes] = set()
    for b in _gathered(batches):
        texts = [t.encode() for t in b.column(3).to_pylist()]
        owner, first, anchor = anchor_runs(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows: list[tuple] = []
        for i, (data, repeated) in enumerate(zip(texts, b.column(2).to_pylist(), strict=True)):
            x, y = bounds[i], bounds[i + 1]
            if x == y:
                continue
            for a, start, windows in snippets(data, first[x:y].tolist(), anchor[x:y].tolist(), {r["anchor"]: r["total"] for r in repeated}):
                part = data[start : start + windows + LENGTH - 1]
                sig = xxhash.xxh3_128_digest(part)
                rows.append((i, start, windows, a, sig, None if sig in given else part))
                given.add(sig)
        if len(given) > SEEN:
            given.clear()
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        own = pa.array(cols[0], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["doc_id", "rid", "start", "windows", "anchor", "sig", "data"])


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their anchors -> windows that repeat, of snippets that occur once.  Whole anchors fill an index up to a size."""
    held: list[tuple] = []

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (anchor, sig, n, _), flags in zip(rows, repeated_windows([r[3] for r in rows], LENGTH, CHUNK_BYTES) if rows else [], strict=True):
            if n == 1:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                out += [(anchor, sig, int(s), int(e - s)) for s, e in edges.reshape(-1, 2)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["anchor", "sig", "off", "run"])

    size = 0
    for b in slices(batches, 1024):
        for row in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
            if size > CHUNK_BYTES // 2 and row[0] != held[-1][0]:
                yield marked(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield marked(held)


_WINDOWS = "sid bigint, off bigint, run bigint, w0 bigint, w1 bigint, times int"


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct snippets (sid, n, data) -> runs of windows that repeat within the batch, and one row for each distinct window: its digest in
    two longs, how often it occurs (two stands for more), and its place if it occurs once, so that a passage of many snippets is few rows."""
    import xxhash

    for b in slices(batches, 2048):
        own, offs, digests = [], [], []
        for i, (n, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            view, count = memoryview(data), len(data) - LENGTH + 1
            own += [i] * count
            offs += range(count) if n == 1 else [-1] * count
            digests += [xxhash.xxh3_128_digest(view[k : k + LENGTH]) for k in range(count)]
        pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        own, offs = np.array(own, np.int64), np.array(offs, np.int64)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        new = np.append(True, (np.diff(pair[order], axis=0) != 0).any(axis=1))[: len(order)]
        group = np.cumsum(new) - 1
        copied = np.bincount(group, offs[order] < 0) > 0 if len(order) else np.zeros(0, bool)
        often = (np.bincount(group) > 1) | copied if len(order) else copied
        first = order[new]
        single = ~often
        known = np.zeros(len(own), bool)
        known[order] = often[group]
        known &= offs >= 0
        at = np.flatnonzero(known)
        cut = np.append(True, (np.diff(at) != 1) | (np.diff(own[at]) != 0))[: len(at)]
        starts = at[cut]
        sizes = np.diff(np.append(np.flatnonzero(cut), len(at)))
        sid = np.asarray(b.column(0))
        n_runs, n_rows = len(starts), len(first)
        places = pa.array(np.concatenate([sid[own[starts]], sid[own[first]]]), mask=np.concatenate([np.zeros(n_runs, bool), ~single]))
        where = pa.array(np.concatenate([offs[starts], offs[first]]), mask=np.concatenate([np.zeros(n_runs, bool), ~single]))
        runs = pa.array(np.concatenate([sizes, np.zeros(n_rows, np.int64)]), mask=np.append(np.zeros(n_runs, bool), np.ones(n_rows, bool)))
        w = [pa.array(np.concatenate([np.zeros(n_runs, np.int64), pair[first, j]]), mask=np.append(np.ones(n_runs, bool), np.zeros(n_rows, bool))) for j in range(2)]
        times = pa.array(np.concatenate([np.zeros(n_runs, np.int32), np.where(single, 1, 2).astype(np.int32)]), pa.int32())
        yield pa.RecordBatch.from_arrays([places, where, runs, *w, times], ["sid", "off", "run", "w0", "w1", "times"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, sorted places of windows) -> runs of places that follow one another."""
    for b in slices(batches, 4096):
        own, firsts, sizes = [], [], []
        for i, offs in enumerate(b.column(1).to_pylist()):
            at = np.asarray(offs, np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
            own += [i] * (len(cuts) - 1)
            firsts += at[cuts[:-1]].tolist()
            sizes += np.diff(cuts).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64())], ["sid", "off", "run"])


def _dealt(chosen: DataFrame) -> DataFrame:
    """What ``_index`` gives, by counting the windows of all distinct snippets; no task needs an anchor's snippets together."""
    each = materialise(chosen.select("sid", "n", "data").mapInArrow(_windows, _WINDOWS), "windows", compression="zstd")
    windows = each.where("run is null")
    often = windows.groupBy("w0", "w1").agg(F.sum("times").alias("all")).where("all > 1").select("w0", "w1")
    found = windows.where("off is not null").select("sid", "off", "w0", "w1").join(often, ["w0", "w1"]).groupBy("sid").agg(F.sort_array(F.collect_list("off")).alias("offs"))
    runs = found.mapInArrow(_runs, "sid bigint, off bigint, run bigint").unionByName(each.where("run is not null").select("sid", "off", "run"))
    return runs.join(chosen.select("sid", "anchor", "sig"), "sid").select("anchor", "sig", "off", "run")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid (hash of id and text) and spans, an array of (start, run): windows start .. start + run - 1 also start elsewhere."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = keyed(docs, id_col, text_col)
    counts = base.select("text").mapInArrow(_count_anchors, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1")
    listed = base.select("rid", "text").mapInArrow(_list_anchors, "rid bigint, anchor bigint")
    per_text = listed.join(counts, "anchor").groupBy("rid").agg(F.collect_list(F.struct("anchor", "total")).alias("repeated"))
    per_text = per_text.withColumnRenamed("rid", "_rid").hint("shuffle_hash")
    cut = base.join(per_text, F.col("rid") == F.col("_rid")).select("doc_id", "rid", "repeated", "text").mapInArrow(_cut, _SNIPPETS.format(kind))
    cut = materialise(cut, "snippets", compression="zstd")

    sigs = cut.groupBy("anchor", "sig").agg(F.count("*").alias("n"), F.first("windows").alias("windows"))
    sigs = materialise(sigs.withColumn("sid", F.monotonically_increasing_id()), "sigs")
    mixed = sigs.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.sum(F.col("windows") + LENGTH - 1).alias("size"))
    mixed = mixed.where("kinds > 1 and least = 1").select("anchor", (F.col("size") > CHUNK_BYTES).alias("large"))
    wanted = sigs.join(mixed, "anchor").select("anchor", "sig", "sid", "n", "large")
    chosen = cut.where("data is not null").select("anchor", "sig", "data").join(wanted, ["anchor", "sig"]).dropDuplicates(["anchor", "sig"])
    chosen = materialise(chosen.select("anchor", "sig", "n", "data", "sid", "large"), "distinct_snippets", compression="zstd")

    small, large = chosen.where("not large").drop("sid", "large"), chosen.where("large")
    marked = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index, "anchor bigint, sig binary, off bigint, run bigint")
    if not large.isEmpty():
        marked = marked.unionByName(_dealt(large))
    copied = sigs.where("n > 1").select("anchor", "sig", F.lit(0).cast("bigint").alias("off"), F.col("windows").alias("run"))
    flags = materialise(marked.unionByName(copied), "flags")
    places = cut.select("doc_id", "rid", "start", "anchor", "sig").join(flags, ["anchor", "sig"])
    return places.groupBy("doc_id", "rid").agg(F.collect_list(F.struct((F.col("start") + F.col("off")).alias("start"), "run")).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))


def removed_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed byte ranges (start, end) of windows that repeat."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["start"] + x["run"] - 1 + LENGTH) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


_DIGESTS = "doc_id {}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for spans, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data, runs = text.encode(), removed_runs(spans)
            kept = kept_bytes(data, runs)
            rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    own = spans.select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"), "spans").hint("shuffle_hash")
    return docs.join(own, same(F.col("doc_id"), F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its bytes, how many of them repeat, in how many runs, and the digest of the rest."""
    kind = docs.schema[id_col].dataType.simpleString()
    joined = _with_spans(keyed(docs, id_col, text_col), repeated_spans(docs, id_col, text_col)).select("doc_id", "spans", "text")
    return joined.mapInArrow(_digest, _DIGESTS.format(kind)).withColumnRenamed("doc_id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with the repeated bytes cut out of its texts; characters that a cut leaves in part go too."""
    import pandas as pd

    def cut(text, spans):
        return pd.Series([t if s is None else kept_bytes(t.encode(), removed_runs(list(s))).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)])

    spans = repeated_spans(docs, id_col, text_col).select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"), F.col("spans").alias("_spans")).hint("shuffle_hash")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    joined = docs.join(spans, same(docs[id_col], spans["_doc"]) & (F.xxhash64(docs[id_col], text) == spans["_rid"]), "left")
    changed = F.when(spans["_spans"].isNull(), docs[text_col]).otherwise(F.pandas_udf(cut, "string")(text, spans["_spans"]))
    return joined.select(*(changed.alias(text_col) if c == text_col else docs[c] for c in docs.columns))
