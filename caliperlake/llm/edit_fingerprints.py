"""Document fingerprints by a randomised edit embedding.

All texts walk with one shared random function: at step j the embedding shows the walker's character, and the
walker moves on by one or not at all, as the function says for that step and character.  Texts that differ by few edits fall
into step again soon after each edit, so edit distance becomes Hamming distance between embeddings.

A fingerprint keeps a sample of the steps.  Steps are sampled by level: level k holds every step with 2**k
evenly spaced neighbours left out, at places that the seed fixes.  A text takes the level that gives it at most
``SLOTS`` samples, and a finer fingerprint can be thinned to a coarser level, so texts of any length can be compared.

Likeness is the share of equal samples, corrected for chance, so 0 is unrelated and 1 equal.  ``similar_texts`` finds pairs by bit-sampled bands of
fingerprints and verifies them on the whole fingerprints.

Defined results: a null text counts as empty; empty texts have equal fingerprints, without samples; equal texts have equal ones;
repeated ids follow one another in the order of their texts' hashes; a row with a null id has no next document, and an empty
one in its place; ids of any ordered type will do; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, same, slices, text_or_empty
from .components import components

SLOTS, STRIDE, SEED = 512, 4, 20240611
DIGITS = "0123456789abcdef"
BANDS, ROWS = 32, 8
BLOCK = 1024
LANE_CHARS = 4_000_000
#: The driver holds so many sampled ids a part, and as many parts at most; beyond that parts grow, and are sorted and read as streams.
DRAWN, MOST_PARTS = 20, 20_000


def walk_function(steps: int, seed: int = SEED) -> np.ndarray:
    """For each of a cycle of steps, whether the walker moves on after each of 256 character classes.

    The cycle is long against the distance in which two walks fall into step.
    """
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (steps, 256), dtype=np.int64)


_CYCLE = 4096
_MOVES = walk_function(_CYCLE)
_MOVES[:, 0] = 0  # class 0 is the end of a text: the walker stays


def char_classes(text: str) -> np.ndarray:
    """A class from 1 to 255 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(255)).astype(np.uint8) + np.uint8(1)


def level_of(n: int) -> int:
    """The least level at which a text of n characters, with about 2n steps, has at most SLOTS samples."""
    level = 0
    while -(-2 * n // (STRIDE << level)) > SLOTS:
        level += 1
    return level


def embed(texts: list[str]) -> list[np.ndarray]:
    """The sampled characters of each text's embedding, at the text's own level.  Texts walk side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    by_length = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
    at = 0
    while at < len(by_length):
        # Lanes of similar length; their sampled steps share one level, or are thinned to it.
        level = level_of(len(texts[by_length[at]]))
        lanes: list[int] = []
        size = 0
        while at < len(by_length) and level_of(len(texts[by_length[at]])) == level and size < LANE_CHARS:
            lanes.append(by_length[at])
            size += len(texts[by_length[at]])
            at += 1
        for i, found in zip(lanes, _walk([texts[i] for i in lanes], STRIDE << level), strict=True):
            out[i] = found
    return out


def _walk(texts: list[str], stride: int) -> list[np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    tape = np.concatenate([np.append(char_classes(t), np.uint8(0)) for t in texts])
    at = np.cumsum(lengths + 1) - lengths - 1
    live = np.arange(len(texts))
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(live):
        for j in range(step, step + stride):
            shown = tape[at]
            if j == step:
                seen.append((live, shown))
            at += _MOVES[j % _CYCLE].take(shown)
        step += stride
        ended = tape[at] == 0
        if ended.any():
            live, at = live[~ended], at[~ended]
    counts = np.zeros(len(texts), np.int64)
    for who, _ in seen:
        counts[who] += 1
    out = [np.zeros(n, np.uint8) for n in counts]
    flat = np.concatenate(out) if out else np.zeros(0, np.uint8)
    starts = np.cumsum(counts) - counts
    for k, (who, shown) in enumerate(seen):
        flat[starts[who] + k] = shown
    return np.split(flat, np.cumsum(counts)[:-1])


def fingerprint(samples: np.ndarray, n: int) -> str:
    """Level, and a hexadecimal digit for each sample; empty texts have no samples."""
    digits = (samples * np.uint8(167) >> np.uint8(4)) & np.uint8(15)
    return f"{level_of(n)}:" + np.frombuffer(DIGITS.encode(), np.uint8)[digits].tobytes().decode()


def fingerprints(texts: list[str]) -> list[str]:
    return [fingerprint(s, len(t)) for s, t in zip(embed(texts), texts, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints at the coarser of their levels, corrected for chance agreement of one in sixteen."""
    (la, x), (lb, y) = a.split(":"), b.split(":")
    level = max(int(la), int(lb))
    x, y = x[:: 1 << (level - int(la))], y[:: 1 << (level - int(lb))]
    longest = max(len(x), len(y))
    if not longest:
        return 1.0
    n = min(len(x), len(y))
    p, q = np.frombuffer(x[:n].encode(), np.uint8), np.frombuffer(y[:n].encode(), np.uint8)
    equal = int((p == q).sum()) / longest
    return max(0.0, (equal - 1 / 16) / (15 / 16))


#: Lengths of the beginnings of fingerprints from which bands draw their places: a fixed grid, each about a fifth longer than the one before.
SPANS = sorted({int(np.ceil(2 ** (j / 4))) for j in range(45)})
#: Equal samples of the longest that a likeness of 0.75 needs; no shorter fingerprint can reach it.
SHORTEST = 0.75 * 15 / 16 + 1 / 16


def spans_of(n: int) -> list[int]:
    """Spans of a fingerprint of n samples, down to the longest one that every shorter one within reach has as well."""
    low = max(0, bisect_right(SPANS, SHORTEST * n) - 1)
    return SPANS[low : bisect_right(SPANS, n)]


def bands_of(mark: str, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Keys of bit-sampled bands: samples at places that the seed draws, of the fingerprint thinned to each of two levels.

    Places are drawn within spans that do not depend on the text's own length, so two texts of about a length share the places of one span at least.
    """
    level, digits = int(mark.split(":")[0]), mark.split(":")[1]
    drawn = np.random.Generator(np.random.PCG64(SEED + 1)).random((bands, rows))
    keys = []
    for k in (level, level + 1):
        thin = digits[:: 1 << (k - level)]
        for span in spans_of(len(thin)) if thin else []:
            places = (drawn * span).astype(np.int64)
            for b in range(bands):
                text = f"{k}/{span}/{b}/" + "".join(thin[p] for p in places[b])
                keys.append(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True))
    return keys


def edited(text: str, following: str) -> str:
    """The last half of the text's characters replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "part bigint, tail boolean, doc_id {}, hash bigint, text string"


def _placed(bounds: list[tuple], keys: list[int]):
    """Range part of each row, by id and text hash; a row that begins a part also goes to the end of the part before, as the next document.

    Rows without an id are dealt by their hashes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {b: k for k, b in enumerate(bounds)}
        n = len(keys)
        for b in slices(batches, 4096):
            places = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            part = [keys[h % n if i is None else bisect_right(bounds, (i, h)) - 1] for i, h in places]
            again = [k for k, p in enumerate(places) if p in first]
            # The first part follows the last one.
            part += [keys[(first[places[k]] - 1) % n] for k in again]
            take = pa.array([*range(len(places)), *again], pa.int64())
            tail = [False] * len(places) + [True] * len(again)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(tail, pa.bool_()), *(b.column(j).take(take) for j in range(3))], ["part", "tail", "doc_id", "hash", "text"])

    return run


def _part_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there, so that parts do not share tasks."""
    sent = spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("place")).groupBy("place").agg(F.min("id").alias("id"))
    found = dict(sent.select("place", "id").collect())  # one row a part
    return [found.get(k, -1 - k) for k in range(n)]


def _bounds(base: DataFrame, parts: int, rows: int) -> list[tuple]:
    """First rows (id, hash) of about ``parts`` ranges of like numbers of characters, from a sample of some ``DRAWN`` rows a part, drawn by hash."""
    known = base.where("doc_id is not null")
    least = known.agg(F.min(F.struct("doc_id", "hash")).alias("least")).first()[0]
    if least is None:
        return []
    bounds = {tuple(least)}
    if parts > 1:
        every = max(1, rows // (DRAWN * parts))
        drawn = known.where(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(every)) == 0).select("doc_id", "hash", F.char_length("text").alias("n"))
        sample = sorted(map(tuple, drawn.collect()))
        passed = np.cumsum([n + 1 for *_, n in sample], dtype=np.int64)
        if len(sample):
            cuts = np.searchsorted(passed, passed[-1] * np.arange(1, parts) / parts)
            bounds |= {sample[min(k, len(sample) - 1)][:2] for k in cuts.tolist()}
    return sorted(bounds)


_OUT = "doc_id {}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, tail and id: each row with the next one of its part."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, nexts = (list(c) for c in zip(*rows, strict=True))
        edits = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
        every = list(dict.fromkeys([*texts, *nexts, *edits]))
        marks = dict(zip(every, fingerprints(every), strict=True))
        out = [
            pa.array(ids),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]),
            pa.array([marks[t] for t in texts]),
            pa.array([marks[e] for e in edits]),
            pa.array([likeness(marks[t], marks[e]) for t, e in zip(texts, edits, strict=True)], pa.float64()),
            pa.array([likeness(marks[t], marks[f]) for t, f in zip(texts, nexts, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _OUT.split(", ")])

    held: list[tuple] = []
    size, before = 0, None
    for b in slices(batches, 1024):
        for part, tail, id_, text in zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 4)), strict=True):
            if id_ is None:
                held.append((id_, text, ""))
                size += len(text)
                continue
            if before is not None and before[0] == part:
                held.append((before[1], before[2], text))
                size += len(before[2])
            # Of several rows that end a part, the first is the next document of the part's last row.
            before = None if tail else (part, id_, text)
            if size > LANE_CHARS:
                yield done(held)
                held, size = [], 0
    if held:
        yield done(held)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_a_part: int = 16_000_000) -> DataFrame:
    """Each text's fingerprint, and its likeness to its edited text and to the next document.

    The next document is found without a global sort: ids are cut into ranges at ids of the table, a
    range's first row is sent to the range before it as well, and each range is sorted by itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    chars, rows = base.agg(F.sum(F.char_length("text")), F.count("*")).first()
    bounds = _bounds(base, min(MOST_PARTS, max(1, -(-(chars or 0) // chars_a_part))), rows)
    keys = _part_keys(docs.sparkSession, max(1, len(bounds)))
    placed = base.mapInArrow(_placed(bounds, keys), _ROW.format(kind))
    ordered = placed.repartition(len(keys), "part").sortWithinPartitions("part", "tail", "doc_id", "hash")
    return ordered.mapInArrow(_compare, _OUT.format(kind)).withColumnRenamed("doc_id", id_col)


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fingerprint of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, f"doc_id {kind}, fingerprint string").withColumnRenamed("doc_id", id_col)


def _alike(least: float):
    """Pairs of different groups in one block of a band whose likeness reaches ``least``."""

    def run(pdf):
        import pandas as pd

        rows, cols = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
        level = [np.array([int(m.split(":")[0]) for m in x["fingerprint"]], np.int64) for x in (rows, cols)]
        found = []
        for a in np.unique(level[0]):
            for b in np.unique(level[1]):
                us, vs = rows[level[0] == a], cols[level[1] == b]
                thin = [[m.split(":")[1][:: 1 << int(max(a, b) - k)].encode() for m in x["fingerprint"]] for x, k in ((us, a), (vs, b))]
                sizes = np.array([len(t) for t in thin[1]])
                table = np.frombuffer(b"".join(t.ljust(sizes.max()) for t in thin[1]), np.uint8).reshape(len(sizes), -1)
                nodes, labels = vs["node"].to_numpy(), vs["label"].to_numpy()
                for node, label, mark in zip(us["node"], us["label"], thin[0], strict=True):
                    n = min(len(mark), table.shape[1])
                    equal = (table[:, :n] == np.frombuffer(mark[:n], np.uint8)).sum(axis=1) / np.maximum(sizes, len(mark))
                    near = np.maximum(0.0, (equal - 1 / 16) / (15 / 16)) >= least
                    found += [(min(node, v), max(node, v)) for v in nodes[near & (labels != label)].tolist()]
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def similar_texts(docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and group_id: the least id among texts that verified band matches connect.

    Texts with equal fingerprints are one row from the start.  In a band each fingerprint is compared with the band's
    first one; where a band still holds several groups after that, its members of different groups are compared block by block, so no pair of a
    band is left out.
    """
    marks = materialise(fingerprint_texts(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "fingerprints")
    nodes = materialise(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()), "fingerprint_nodes")
    keyed = nodes.where(F.length("fingerprint") > 2).select("node", F.explode(F.pandas_udf(lambda s: s.map(bands_of), "array<bigint>")("fingerprint")).alias("band"))
    lead = keyed.groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("last"), F.count("*").alias("size")).where("u < last").drop("last")
    members = materialise(keyed.join(lead, "band"), "fingerprint_members")
    pairs = members.where("node > u").select("u", F.col("node").alias("v")).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fingerprint").alias(f"{c}_mark"))
    like = F.pandas_udf(lambda a, b: a.combine(b, likeness), "double")
    links = pairs.join(side("u"), "u").join(side("v"), "v").where(like("u_mark", "v_mark") >= least).select("u", "v")
    links = materialise(links, "fingerprint_links")
    labels = components(links)
    labelled = members.where("size > 2").join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("band")
    rest = labelled.join(mixed, "band", "left_semi").join(nodes.select("node", "fingerprint"), "node")
    rest = rest.withColumn("g", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    place = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rest = rest.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), place.alias("side"), "node", "label", "fingerprint")
    more = rest.groupBy("band", "i", "j").applyInPandas(_alike(least), "u bigint, v bigint").distinct()
    labels = components(materialise(links.unionByName(more), "fingerprint_links"))
    grouped = nodes.join(labels, "node", "left").select("fingerprint", "first_id", F.coalesce("label", "node").alias("label"))
    least_id = grouped.groupBy("label").agg(F.min("first_id").alias("group_id"))
    placed = grouped.join(least_id, "label").select(F.col("fingerprint").alias("_mark"), "group_id")
    return marks.join(placed, same(F.col("fingerprint"), F.col("_mark"))).select(F.col("doc_id").alias(id_col), "group_id")
