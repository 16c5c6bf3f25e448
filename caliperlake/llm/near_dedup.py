"""Near-duplicate documents: banded MinHash, odd-sketch verification, confirmation on full sets.

One pass over the texts makes each document's set of five-word shingles (as 64-bit hashes), 128 MinHash
samples, 32 band keys of four samples, and an odd sketch: the samples folded into 256 parity bits, so
that the bits set in the XOR of two sketches tell how many samples differ.

Documents with equal sets are one node.  Each node is confirmed against the most similar, by odd sketch, of the first nodes of its
band buckets, and then twice against the most similar of other drawn nodes of buckets that still hold several components; nodes
that this joins need no comparison with each other.  Buckets that hold several components after that are compared block by block on odd
sketches, a narrow one first and then one of 1,024 samples in 2,048 bits, each pair in the first band that it shares only.  Members
with a pair that the sketches do not rule out come back to their block with their full sets; a block compares these and gives only links that join
components.  So tables grow with the members of buckets, never with their pairs.  No pair of a bucket is left out, and no bucket is capped.
A pair at the threshold misses all bands with probability (1 - 0.75**4)**32, about 5e-6.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; repeated
rows have equal sets; a null id takes no part in the least id; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, same, slices, text_or_empty
from .components import components

WORDS = 5
SAMPLES, BANDS, SKETCH_BITS = 128, 32, 256
#: Bits that differ between sketches of two sets at the threshold: about 50, deviation under 8; this is nearly five deviations more.
MOST_BITS = 88
WIDE_SAMPLES, WIDE_BITS = 1024, 2048
#: Of the wide sketch: about 403 at the threshold, deviation 22; this is 4.5 deviations more, where the estimate is 0.66.
MOST_WIDE_BITS = 503
#: A block has at most so many members and, but for single larger sets, so many bytes of full sets.
BLOCK, BLOCK_BYTES, PIVOT_TURNS = 2048, 16_000_000, 2
_M64 = (1 << 64) - 1
_RNG = np.random.Generator(np.random.PCG64(20240607))
_LOW, _HIGH = (_RNG.integers(0, 1 << 32, WIDE_SAMPLES, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_PLACES = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 63, WIDE_SAMPLES, dtype=np.uint64)
_WORD_HASHES: dict[bytes, int] = {}
_MEMO = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    memo = _WORD_HASHES
    if len(memo) > _MEMO:
        memo.clear()
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = h[:n] * _PLACES[0]
    for j in range(1, WORDS):
        total += h[j : j + n] * _PLACES[j]
    return np.unique(mix(total))


def minhash(found: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The least of each of the first hash functions over the set."""
    low, high = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(samples, 0xFFFFFFFF, np.uint32)
    wide = 65_536 // samples  # keeps a block in the processor cache
    for at in range(0, len(found), wide):
        values = low[None, at : at + wide] * _LOW[:samples, None]
        values += high[None, at : at + wide] * _HIGH[:samples, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, -1).astype(np.uint64)
    key = _SALTS[:BANDS].copy()
    for j in range(rows.shape[1]):
        key = mix(key ^ rows[:, j])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the number of samples that fall on each bit, as longs."""
    places = mix(_SALTS[: len(samples)] ^ samples.astype(np.uint64)) % np.uint64(bits)
    parity = (np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


_SKETCH = "doc_id {}, hash bigint, n_shingles bigint, set_key binary, bands array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sizes, keys, bands, odd = [], [], [], []
        for text in b.column(1).to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            keys.append(set_key(found))
            if len(found):
                samples = minhash(found)
                bands.append(band_keys(samples))
                odd.append(odd_sketch(samples))
            else:
                bands.append(np.zeros(0, np.int64))
                odd.append(np.zeros(4, np.int64))
        s = np.stack(odd)
        ends = np.cumsum([0, *map(len, bands)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, *(pa.array(np.ascontiguousarray(s[:, j])) for j in range(4))], ["doc_id", "hash", "n_shingles", "set_key", "bands", "s0", "s1", "s2", "s3"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets and wide sketches of the texts whose set is the node's; another text under the same id is passed over."""
    for b in slices(batches, 64):
        nodes, sets, wide = [], [], []
        for node, key, text in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
            found = shingles(text)
            if set_key(found) == key:
                nodes.append(node)
                sets.append(found.view(np.int64))
                wide.append(odd_sketch(minhash(found, WIDE_SAMPLES), WIDE_BITS).tobytes())
        ends = np.cumsum([0, *map(len, sets)])
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())), pa.array(wide, pa.binary())], ["node", "shingles", "wide"])


def _best(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Of pairs (u, v), that the sketches do not rule out, the most similar one of each v."""
    side = lambda p: sketch.select(*(F.col(c).alias(p + c) for c in sketch.columns))
    both = pairs.join(side("a_"), F.col("u") == F.col("a_node")).join(side("b_"), F.col("v") == F.col("b_node")).withColumn("bits", _bits("a_", "b_"))
    return both.where(_likely("a_", "b_")).groupBy("v").agg(F.min_by("u", F.struct("bits", "u")).alias("u")).select("u", "v")


def _bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}s{j}").bitwiseXOR(F.col(f"{b}s{j}"))) for j in range(4)), F.lit(0))


def _likely(a: str, b: str) -> Column:
    """Not ruled out by set sizes and odd sketches."""
    small, large = F.least(f"{a}n_shingles", f"{b}n_shingles"), F.greatest(f"{a}n_shingles", f"{b}n_shingles")
    return (_bits(a, b) <= MOST_BITS) & (100 * small >= 75 * large)


def _likely_pairs(rows, cols) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different components that the sketches do not rule out, if the bucket of the block is the first that they share."""
    s, t = (x[["s0", "s1", "s2", "s3"]].to_numpy().view(np.uint64) for x in (rows, cols))
    n, m = rows["n_shingles"].to_numpy()[:, None], cols["n_shingles"].to_numpy()[None, :]
    good = (100 * np.minimum(n, m) >= 75 * np.maximum(n, m)) & (rows["label"].to_numpy()[:, None] != cols["label"].to_numpy()[None, :])
    bits = np.zeros(good.shape, np.uint16)
    for j in range(4):
        bits += np.bitwise_count(s[:, None, j] ^ t[None, :, j])
    a, b = np.nonzero(good & (bits <= MOST_BITS))
    keys, others = (np.stack(x["bands"].to_numpy()) for x in (rows, cols))
    wide, wides = (np.frombuffer(b"".join(x["wide"]), np.uint64).reshape(len(x), -1) for x in (rows, cols))
    bucket, found = int(rows["bucket"].iloc[0]), [np.zeros((2, 0), np.int64)]
    for at in range(0, len(a), 8192):
        i, j = a[at : at + 8192], b[at : at + 8192]
        shared = (keys[i] == others[j]).argmax(axis=1)
        first = keys[i, shared] == bucket
        i, j = i[first], j[first]
        near = np.bitwise_count(wide[i] ^ wides[j]).sum(axis=1, dtype=np.int32) <= MOST_WIDE_BITS
        found.append(np.stack([i[near], j[near]]))
    return tuple(np.concatenate(found, axis=1))


def _sides(pdf):
    return pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]


def _undecided(pdf):
    """The members of a block that have a pair to compare; one row for each, however many pairs."""
    rows, cols = _sides(pdf)
    if rows.empty or cols.empty:
        return pdf.loc[:, ["bucket", "i", "j", "side", "node"]].iloc[:0]
    a, b = _likely_pairs(rows, cols)
    nodes = np.union1d(rows["node"].to_numpy()[a], cols["node"].to_numpy()[b])
    return pdf.loc[pdf["node"].isin(nodes), ["bucket", "i", "j", "side", "node"]]


def _spanning(pdf):
    """Links of a block, confirmed on full sets: only those that join components, so fewer than members."""
    import pandas as pd

    rows, cols = _sides(pdf)
    links: list[tuple[int, int]] = []
    if not (rows.empty or cols.empty):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        a, b = _likely_pairs(rows, cols)
        label, other = rows["label"].tolist(), cols["label"].tolist()
        node, nodes = rows["node"].tolist(), cols["node"].tolist()
        sets, others = rows["shingles"].tolist(), cols["shingles"].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            u, own = a[x], root(label[a[x]])
            v = [k for k in b[x:y].tolist() if root(other[k]) != own]
            if not v:
                continue
            mine = np.sort(sets[u])
            sizes = np.array([len(others[k]) for k in v])
            values = np.concatenate([others[k] for k in v])
            hit = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero(100 * both >= 75 * (len(mine) + sizes - both)).tolist():
                if (far := root(other[v[k]])) != (near := root(label[u])):
                    parent[far] = near
                    links.append((node[u], nodes[v[k]]))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold.  The wide side is joined last, so that Spark can split a hub by size."""
    v = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    both = v.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(100 * shared >= 75 * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components."""
    of = lambda p: labels.select(F.col("node").alias(p), F.col("label").alias(f"{p}_label"))
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("u_label", "u") != F.coalesce("v_label", "v")).select("u", "v")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of three and more that hold several components, with their labels."""
    labelled = members.where("size > 2").join(labels, "node", "left").select("bucket", "node", "size", "weight", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    return labelled.join(mixed, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """``id_col``, n_shingles, component_id (least id of the component) and kept of every row; with ``detail`` also text_hash and group_key (null without words)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketches = materialise(base.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(_sketch, _SKETCH.format(kind)), "sketches")
    alike = ("n_shingles", "bands", "s0", "s1", "s2", "s3")
    nodes = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in alike))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("size"), F.sum("n_shingles").alias("weight")).where("lead < last").drop("last")
    members = materialise(keyed.drop("n_shingles").join(shared, "bucket"), "members")
    sketch = nodes.select("node", "n_shingles", "s0", "s1", "s2", "s3")
    side = lambda p: sketch.select(*(F.col(c).alias(p + c) for c in sketch.columns))
    stars = members.where("node > lead").groupBy(F.col("lead").alias("u"), F.col("node").alias("v")).agg((F.min("size") == 2).alias("alone"))
    stars = stars.join(side("a_"), F.col("u") == F.col("a_node")).join(side("b_"), F.col("v") == F.col("b_node")).where(_likely("a_", "b_"))
    stars = materialise(stars.select("u", "v", "alone"), "stars")

    # Full sets of every node that a comparison may need: those in star pairs or in buckets of three and more.
    needed = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).unionByName(members.where("size > 2").select("node")).distinct()
    needed = nodes.join(needed, "node", "left_semi").select("node", "set_key", "first_id")
    texts = base.join(needed.hint("shuffle_hash"), same(F.col("doc_id"), F.col("first_id"))).select("node", "set_key", "text")
    sets = materialise(texts.mapInArrow(_sets, "node bigint, shingles array<bigint>, wide binary").dropDuplicates(["node"]), "sets")

    links = materialise(_confirm(_best(stars.select("u", "v"), sketch), sets), "links")
    labels = components(links)
    for turn in range(PIVOT_TURNS):
        open_ = _open(members, labels)
        drawn = open_.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("u"))
        pivots = open_.join(drawn, "bucket").where(F.col("node") != F.col("u")).select("u", F.col("node").alias("v"))
        pairs = _apart(pivots.unionByName(stars.select("u", "v")).distinct(), labels)
        links = materialise(links.unionByName(_confirm(_best(pairs, sketch), sets)), "links")
        labels = components(links)
    # What is still open: pairs that are alone in all their buckets, and blocks of larger buckets.
    compared = nodes.select("node", "n_shingles", "bands", "s0", "s1", "s2", "s3").join(sets.select("node", "wide"), "node")
    rest = _open(members, labels).join(compared, "node")
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, 8 * F.col("weight") / BLOCK_BYTES)).cast("int")
    rest = rest.withColumn("g", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    which = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rest = rest.select("bucket", low.alias("i"), high.alias("j"), which.alias("side"), "node", "label", "n_shingles", "s0", "s1", "s2", "s3", "bands", "wide")
    block = ["bucket", "i", "j"]
    left = materialise(rest.groupBy(*block).applyInPandas(_undecided, "bucket bigint, i int, j int, side int, node bigint"), "undecided")
    full = left.join(compared, "node").join(sets.select("node", "shingles"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    exact = full.groupBy(*block).applyInPandas(_spanning, "u bigint, v bigint")
    alone = _confirm(_apart(stars.where("alone").select("u", "v"), labels), sets)
    labels = components(materialise(links.unionByName(exact).unionByName(alone), "links"))

    least = nodes.join(labels, "node", "left").select("set_key", "first_id", F.coalesce("label", "node").alias("label"))
    ids = least.groupBy("label").agg(F.min("first_id").alias("component_id"))
    placed = least.join(ids, "label").select(F.col("set_key").alias("_key"), "component_id", F.col("label").alias("group_key"))
    out = sketches.select("doc_id", "hash", "n_shingles", "set_key").join(placed, F.col("set_key") == F.col("_key"), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", same(F.col("doc_id"), F.col("component_id")).alias("kept"), *([F.col("hash").alias("text_hash"), "group_key"] if detail else []))
