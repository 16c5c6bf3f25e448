"""Exact top-k search of quantised vectors by MaxScore over shards of postings.

A vector's components are whole numbers, floor(64 * x).  Each shard keeps, for each component, the
values of its vectors one after another (the component's postings) with their largest and smallest.
A query's terms are its components; a term adds at most ``bound`` above the least that it adds to any vector of
the shard.  Terms are split by bound: those whose bounds together cannot lift a vector over the threshold are
non-essential.  The essential postings are traversed for all vectors; the others are probed a few terms at a time, and only for vectors
that can still reach the threshold.  Each block of queries meets one shard first; the k-th best score there is the threshold that
it takes to all other shards, and the shards' lists are merged by a window.

Vectors and queries are dealt to shards and blocks of a stated size by hashes of row numbers, so equal vectors or ids make no large group, and
each pair of a block and a shard is one row of an equi-join on the shard.

Defined results: a vector that is null or holds a null or non-finite component takes no part, and so do rows without an id;
components of a shorter vector count as 0 where the other is longer, an empty one scores 0 with all.  Equal scores go to the smaller id.  Rows that repeat another's id and
vector are candidates each, but one query; a query's own id is never its candidate.  Scores beyond a long end at its limit, and so do components.  Fewer
candidates than k: all of them.  Further columns of any name are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 64
SHARD_ROWS, SHARD_BYTES = 8192, 1 << 23  # of a shard: whichever is less
QUERY_ROWS = 256
SEED_ROWS = 256  # vectors scored in full to give the first threshold
STEP = 8  # non-essential terms probed at a time

_PACKED = "number bigint, ids binary, codes binary, bits int, width int"
_FOUND = "block bigint, query int, query_id bigint, vec_id bigint, score bigint"


def components(vector: str | Column) -> Column:
    """The vector's whole numbers; null where it takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(v.isNotNull() & fine, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")))


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one number as one row: ids ascending, values component by component in the fewest bits."""
    ids = table.column("id").to_numpy()
    lists = table.column("codes").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    width, n = int(sizes.max(initial=0)), len(ids)
    codes = np.zeros((n, width), np.int64)
    codes[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    bits = next(b for b in (16, 32, 64) if b == 64 or not codes.size or np.abs(codes.astype(np.float64)).max() < 1 << (b - 1))
    body = np.ascontiguousarray(codes[order].T).astype(f"<i{bits // 8}")
    cols = [table.column("number").slice(0, 1), [ids[order].astype("<i8").tobytes()], [body.tobytes()], pa.array([bits], pa.int32()), pa.array([width], pa.int32())]
    return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in cols], ["number", "ids", "codes", "bits", "width"])


def _dealt(rows: DataFrame, size: int, n: int) -> tuple[DataFrame, int]:
    """rows (id, codes), of which there are n, as packed rows of about ``size`` each, and how many there can be."""
    numbers = max(1, -(-n // size))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(numbers))  # over a written table, so the same when a task is run again
    return rows.withColumn("number", number).groupBy("number").applyInArrow(_pack, _PACKED), numbers


class Packed(NamedTuple):
    ids: np.ndarray
    codes: np.ndarray  # component by vector

    @classmethod
    def of(cls, ids: bytes, codes: bytes, bits: int, width: int) -> Packed:
        keys = np.frombuffer(ids, "<i8")
        return cls(keys, np.frombuffer(codes, f"<i{bits // 8}").reshape(width, len(keys)))


class Shard:
    """Postings of a shard, in the narrowest numbers that add up exactly."""

    def __init__(self, packed: Packed) -> None:
        self.ids, self.codes = packed
        self.n = len(self.ids)
        some = self.codes.shape[0] > 0
        self.high = self.codes.max(1).astype(object) if some else np.zeros(0, object)
        self.low = self.codes.min(1).astype(object) if some else np.zeros(0, object)
        self.reach = np.maximum(np.abs(self.high), np.abs(self.low)) if some else self.high
        self.kinds: dict[object, np.ndarray] = {}

    def postings(self, query: np.ndarray) -> np.ndarray:
        most = 4 * int(sum(abs(int(q)) * int(r) for q, r in zip(query, self.reach, strict=False)))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if kind not in self.kinds:
            self.kinds[kind] = self.codes.astype(kind)
        return self.kinds[kind]

    def top(self, own: int, query: np.ndarray, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best that reach the threshold, ties to smaller ids."""
        post = self.postings(query)
        width = min(len(query), len(post))
        q, post = query[:width].astype(post.dtype), post[:width]
        ends = np.stack([q * self.high[:width].astype(post.dtype), q * self.low[:width].astype(post.dtype)])
        least, bound = ends.min(0), ends.max(0) - ends.min(0)
        base = least.sum() if width else 0
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[j]: what the terms from the j-th on may add
        seed = q @ post[:, :SEED_ROWS] if width else np.zeros(min(self.n, SEED_ROWS))
        seed = seed[self.ids[:SEED_ROWS] != own]
        if len(seed) >= k:
            kth = int(np.sort(seed)[-k])
            threshold = kth if threshold is None else max(threshold, kth)
        need = -np.inf if threshold is None else threshold - base  # above the least sum
        essential = int(np.argmax(rest < need)) if (rest < need).any() else width
        first = order[:essential]
        score = q[first] @ post[first] if essential else np.zeros(self.n, post.dtype)
        above = score - least[first].sum()
        alive = np.flatnonzero((above + rest[essential] >= need) & (self.ids != own))
        score = score[alive]
        for j in range(essential, width, STEP):
            terms = order[j : j + STEP]
            score = score + q[terms] @ post[np.ix_(terms, alive)]
            done = min(j + STEP, width)
            fits = score - least[order[:done]].sum() + rest[done] >= need
            alive, score = alive[fits], score[fits]
        if threshold is not None:
            fits = score >= threshold
            alive, score = alive[fits], score[fits]
        best = np.argsort(-score, kind="stable")[:k]
        whole = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in score[best]]
        return self.ids[alive[best]], np.array(whole, np.int64)


def _visit(k: int, other: bool):  # noqa: ANN202
    """Pairs of a block of queries and a shard -> the block's lists from that shard, and its thresholds after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for b in batches:
            names = b.schema.names
            for i in range(b.num_rows):
                r = {c: b.column(names.index(c))[i].as_py() for c in names if not c.startswith("s_")}
                if r["shard"] != at:
                    s = {c: b.column(names.index(c))[i].as_py() for c in names if c.startswith("s_")}
                    shard, at = Shard(Packed.of(s["s_ids"], s["s_codes"], s["s_bits"], s["s_width"])), r["shard"]
                queries = Packed.of(r["ids"], r["codes"], r["bits"], r["width"])
                theta = r["theta"] if other else [None] * len(queries.ids)
                found = [shard.top(own, queries.codes[:, j], k, theta[j]) for j, own in enumerate(queries.ids.tolist())]
                sizes = [len(x) for x, _ in found]
                hits = {
                    "query": np.repeat(np.arange(len(found), dtype=np.int32), sizes),
                    "query_id": np.repeat(queries.ids, sizes),
                    "vec_id": np.concatenate([x for x, _ in found]),
                    "score": np.concatenate([y for _, y in found]),
                }
                kth = [int(y[-1]) if len(y) == k else None for _, y in found]
                cols = [pa.array([r["block"]], pa.int64()), pa.array([kth], pa.list_(pa.int64()))]
                cols += [pa.array([v], pa.list_(pa.int32() if c == "query" else pa.int64())) for c, v in hits.items()]
                yield pa.RecordBatch.from_arrays(cols, ["block", "theta", *hits])

    return run


_VISITED = "block bigint, theta array<bigint>, query array<int>, query_id array<bigint>, vec_id array<bigint>, score array<bigint>"


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row that ``is_query`` (on ``id``, the id as a long) holds for."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), components(vector_col).alias("codes")).where("id is not null and codes is not null")
    rows = materialise(rows, "vectors")
    asked = materialise(rows.where(is_query).dropDuplicates(["id", "codes"]), "vector_queries")
    n, widest = rows.agg(F.count("*"), F.max(F.size("codes"))).first()
    size = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, widest or 1))))
    shards, many = _dealt(rows, size, n)
    shards = materialise(shards, "vector_shards", compression="zstd")
    blocks, _ = _dealt(asked, min(size, QUERY_ROWS), asked.count())
    blocks = materialise(blocks.withColumnRenamed("number", "block"), "query_blocks", compression="zstd")
    right = shards.select(F.col("number").alias("shard"), *(F.col(c).alias(f"s_{c}") for c in ("ids", "codes", "bits", "width")))
    # A pair is few bytes and much work, so the number of tasks is stated: twice the shards.
    paired = lambda df: df.repartition(2 * many, "shard").join(right.hint("shuffle_merge"), "shard")
    # A shard's number may have no rows, so the home is the next number that has some.
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))
    held = shards.select("number").distinct().withColumn("shard", F.col("number"))
    home = blocks.withColumn("number", F.pmod("block", F.lit(many))).join(held, "number", "left").drop("number")
    first = materialise(paired(home.where("shard is not null")).mapInArrow(_visit(k, False), _VISITED), "first_visits")
    left = home.join(first.select("block", "theta"), "block", "left").withColumn("home", F.coalesce("shard", F.lit(-1))).drop("shard")
    left = left.withColumn("theta", F.coalesce("theta", F.array_repeat(F.lit(None).cast("bigint"), (F.octet_length("ids") / 8).cast("int"))))
    left = left.withColumn("shard", F.explode(numbers)).where("shard <> home").drop("home")
    second = paired(left).mapInArrow(_visit(k, True), _VISITED)
    hits = first.unionByName(second).select("block", F.explode(F.arrays_zip("query", "query_id", "vec_id", "score")).alias("hit")).select("block", "hit.*")
    rank = F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
