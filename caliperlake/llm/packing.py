"""Best-fit packing by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into pieces of a whole sequence; only what is left of each
document is packed.  Pieces are dealt into blocks of about ``BLOCK`` pieces.  Each block is
evolved on several islands, one Spark group each: a chromosome is a packing; crossover injects
whole well-filled bins of one parent into another, removes the duplicates that this makes, and
best-fits the displaced pieces.  After each epoch an island's elite goes to the next island of its block.
Sequences with room left are pooled over all blocks and evolved again.

Defined results: a null text counts as empty and still holds the separator; repeated rows are packed
each; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, materialise, slices, text_or_empty

CAPACITY, SEPARATOR = 2048, 0
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 6, 8
WELL_FILLED, POOL_FILL, ROUNDS = 0.97, 0.995, 3

Bins = list[list[int]]


def _pieces(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, uid = WordMemo.of(path), TaskContext.get().partitionId() << 33
        end = SEPARATOR.to_bytes(4, "little")
        for b in slices(batches):
            doc, rows = [], []
            for i, ids in enumerate(memo.encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    doc.append(i)
                    rows.append((k, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop]), uid))
                    uid += 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.int64()] * 4], strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens, written once, as their uid must stay."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return materialise(base.mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, uid bigint"), "pieces")


class _Rooms:
    """Bins by room left; the set of rooms in use is one integer's bits, so best fit is a bit scan."""

    def __init__(self, capacity: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def add(self, room: int, bin_: int) -> None:
        if not self.at[room]:
            self.bits |= 1 << room
        self.at[room].append(bin_)

    def take(self, size: int) -> tuple[int, int] | None:
        high = self.bits >> size
        if not high:
            return None
        room = size + (high & -high).bit_length() - 1
        bin_ = self.at[room].pop()
        if not self.at[room]:
            self.bits &= ~(1 << room)
        return room, bin_


def best_fit(order: Iterable[int], sizes: list[int], capacity: int, bins: Bins) -> Bins:
    """Put the pieces, in their order, each where it leaves the least room; changes and returns bins."""
    rooms = _Rooms(capacity)
    for k, b in enumerate(bins):
        rooms.add(capacity - sum(sizes[i] for i in b), k)
    for i in order:
        size = sizes[i]
        if found := rooms.take(size):
            room, k = found
            bins[k].append(i)
            rooms.add(room - size, k)
        else:
            bins.append([i])
            rooms.add(capacity - size, len(bins) - 1)
    return bins


def cost(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the fuller the full ones, the better."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(into: Bins, giver: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject some of the giver's well-filled bins, drop bins that share a piece with them, best-fit what that displaced."""
    filled = [b for b in giver if sum(sizes[i] for i in b) >= WELL_FILLED * capacity] or giver
    injected = [list(b) for b in rng.sample(filled, max(1, len(filled) // 2))]
    held = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in into:
        if held.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in held]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, capacity, injected + kept)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Empty a few of the least filled bins and best-fit their pieces again."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[: max(1, min(len(bins) // 20, 1 + rng.randrange(8)))])
    loose = [i for k in gone for i in bins[k]]
    rng.shuffle(loose)
    return best_fit(loose, sizes, capacity, [list(b) for k, b in enumerate(bins) if k not in gone])


def evolve(sizes: list[int], capacity: int, rng: random.Random, elites: list[Bins]) -> Bins:
    """The best packing that one island finds in one epoch; it stops at the least number of bins that there can be."""
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = [(cost(e, sizes, capacity), e) for e in elites]
    if not people:
        first = best_fit(order, sizes, capacity, [])
        people = [(cost(first, sizes, capacity), first)]
    people.sort(key=lambda p: p[0])
    if people[0][0][0] == least:
        return people[0][1]
    while len(people) < POPULATION:
        noisy = sorted(order, key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
        bins = best_fit(noisy, sizes, capacity, [])
        people.append((cost(bins, sizes, capacity), bins))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: p[0])
        if people[0][0][0] == least:
            break
        a, b = rng.sample(range(len(people)), 2)
        child = crossover(people[a][1], people[b][1], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        people[-1] = min(people[-1], (cost(child, sizes, capacity), child), key=lambda p: p[0])
    return min(people, key=lambda p: p[0])[1]


_PLACED = "block bigint, island int, uid bigint, length bigint, bin int, elite int"


def _island(capacity: int, epoch: int):
    """Evolve one island: rows are its pieces, once for each elite it has (none in the first epoch)."""

    def run(pdf):
        import pandas as pd

        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        one = pdf[pdf["elite"] == pdf["elite"].min()].sort_values("uid")
        uids, sizes = one["uid"].tolist(), one["length"].tolist()
        index = {u: i for i, u in enumerate(uids)}
        elites = []
        if epoch:
            for _, e in pdf.groupby("elite"):
                bins: dict[int, list[int]] = {}
                for u, b in zip(e["uid"].tolist(), e["bin"].tolist(), strict=True):
                    bins.setdefault(b, []).append(index[u])
                elites.append(list(bins.values()))
        best = evolve(sizes, capacity, random.Random(f"{block}/{island}/{epoch}"), elites)
        rows = [(block, island, uids[i], sizes[i], k, island) for k, b in enumerate(best) for i in b]
        return pd.DataFrame(rows, columns=["block", "island", "uid", "length", "bin", "elite"])

    return run


def _pack_blocks(items: DataFrame, capacity: int, blocks: int, islands: int, epochs: int) -> DataFrame:
    """items (uid, length) -> (uid, length, block, bin) of the best island of each block."""
    spread = items.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uid", "length", F.lit(0).alias("bin"), F.lit(0).alias("elite"))
    for epoch in range(epochs):
        if epoch:
            # Migration: an island gets its own elite back and a copy goes to the next island.
            targets = F.array(F.col("island"), (F.col("island") + 1) % islands) if islands > 1 else F.array("island")
            spread = spread.select("block", F.explode(targets).alias("island"), "uid", "length", "bin", "elite")
        spread = spread.groupBy("block", "island").applyInPandas(_island(capacity, epoch), _PLACED)
    done = materialise(spread, "islands")
    best = done.groupBy("block", "island").agg(F.count_distinct("bin").alias("bins")).groupBy("block").agg(F.min(F.struct("bins", "island")).alias("b"))
    return done.join(best.select("block", F.col("b.island").alias("island")), ["block", "island"], "left_semi").select("uid", "length", "block", "bin")


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items (uid, length <= capacity) -> uid, sequence_id, offset.  A sequence is named after its least uid."""
    settled, left = None, items.select("uid", "length")
    count = left.count()
    for turn in range(ROUNDS):
        blocks = max(1, -(-count // block))
        placed = materialise(_pack_blocks(left, capacity, blocks, islands, epochs).withColumn("turn", F.lit(turn)), "packed")
        if blocks == 1 or turn == ROUNDS - 1:
            settled = placed if settled is None else settled.unionByName(placed)
            break
        fill = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        open_ = fill.where(F.col("fill") < POOL_FILL * capacity).select("block", "bin")
        kept = placed.join(open_, ["block", "bin"], "left_anti")
        settled = kept if settled is None else settled.unionByName(kept)
        left = materialise(placed.join(open_, ["block", "bin"], "left_semi").select("uid", "length"), "pool")
        count = left.count()
        if not count:
            break
    whole = settled.groupBy("turn", "block", "bin").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("m"))  # at most ``capacity`` pieces
    out = whole.select((2 * F.col("m")[0]["uid"]).alias("sequence_id"), F.posexplode("m").alias("k", "x"), "m").withColumn("offset", F.aggregate(F.slice("m", F.lit(1), F.col("k")), F.lit(0).cast("bigint"), lambda a, x: a + x["length"]))
    return out.select(F.col("x.uid").alias("uid"), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there; whole-sequence pieces stand alone."""
    cut = pieces(docs, tokenizer, capacity, id_col, text_col)
    packed = pack(cut.where(F.col("length") < capacity), capacity)
    columns = [F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    alone = cut.where(F.col("length") >= capacity).select(*columns, (2 * F.col("uid") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return cut.join(packed, "uid").select(*columns, "sequence_id", "offset").unionByName(alone)
