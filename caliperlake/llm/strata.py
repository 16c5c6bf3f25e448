"""Ranked lexical search over a length-stratified index.

Documents of one normaliser m are a stratum.  Documents are dealt to shards by ranges of (m, id), so a shard holds few
strata, each whole or a stretch of a large one.  A shard's postings are runs: the documents of one term, stratum and tf, tf
descending within the stratum.  All documents of a run have the same impact, so an impact is computed once for each run, and the
first run of a term in a stratum bounds the term there.

A bound of each item and shard comes from the largest impacts of the item's terms there.  Every item visits its best shard first; its
k-th score there is the threshold for the others, and shards whose bound is below it are not visited.  Within a shard the strata are
visited in the order of their bounds, in growing batches, until the next bound is below the threshold.

Only postings of terms that an item may ask are kept: a bitmap of fixed size over the hashes of the items' terms goes to all tasks, and
what it lets through by chance is never asked.  Counts of documents and terms are taken over all documents.

Defined results: a null text has no terms; texts without terms count nowhere.  Very long texts are cut at term ends while they are counted.
Equal scores go to the smaller doc_id, null last.  Repeated documents are ranked each; rows that repeat an item's id and text are one item, and
items without a match give no rows.  Further columns of any name are ignored; an empty table on either side gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty

BITMAP_BITS = 23  # 1 MB
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20  # a shard ends at either
GROUP_ITEMS = 64  # about so many items visit a shard in one row
FIRST_DOCS = 128  # documents of the first batch of strata; each further batch has twice as many
CHUNK = 1 << 20

# Digits, letters and all beyond ASCII make terms, only A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch of about a megabyte at a time."""
    data, at = text.encode().translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        found = [list(dict.fromkeys(t for part in terms_of(x) for t in part)) for x in b.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]), pa.int64())
        terms = pa.array([t.decode() for x in found for t in x], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), terms], ["item", "item_id", "term"])


def _bitmap(terms: DataFrame) -> bytes:
    """Of all terms, by hash: at most 2**BITMAP_BITS / 64 words come to the driver."""
    place = F.crc32(F.col("term").cast("binary")) % (1 << BITMAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    words = terms.select((place / 64).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 64, "<i8")
    for word, bits in words:
        out[word] = bits
    return out.tobytes()


def _count(bitmap: bytes) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, bool] = {}
        for b in slices(batches, 256):
            keep, n, terms, tfs = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                counts: Counter[bytes] = Counter()
                for part in terms_of(text):
                    counts.update(part)
                if not counts:
                    continue
                new = [t for t in counts if t not in asked]
                for t in new:
                    h = zlib.crc32(t) & ((1 << BITMAP_BITS) - 1)
                    asked[t] = bool(bitmap[h >> 3] >> (h & 7) & 1)
                own = [t for t in counts if asked[t]]
                keep.append(i)
                n.append(counts.total())
                terms.append([t.decode() for t in own])
                tfs.append([counts[t] for t in own])
                if len(asked) > 500_000:
                    asked.clear()
            ids = b.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


_SHARD = "shard bigint, docs array<{}>, stratum binary, m binary, terms array<string>, df array<bigint>, top array<bigint>, term_runs binary, run_stratum binary, run_tf binary, run_at binary, posts binary"


def unit_impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _shard(number: int, ids: list[pa.Array], m: list[np.ndarray], sizes: list[np.ndarray], terms: list[pa.Array], tfs: list[np.ndarray]) -> list[pa.Array]:
    """One shard's columns, from documents in order of (m, id)."""
    docs = pa.concat_arrays(ids)
    per_doc, size, tf = np.concatenate(m), np.concatenate(sizes), np.concatenate(tfs)
    strata, stratum = np.unique(per_doc, return_inverse=True)
    coded = pa.concat_arrays(terms).dictionary_encode()
    term, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(docs)), size)
    by_doc = stratum[doc]
    order = np.lexsort((doc, -tf, by_doc, term))
    term, by_doc, tf, doc = term[order], by_doc[order], tf[order], doc[order]
    new_term = np.append(True, term[1:] != term[:-1])
    new_run = new_term | np.append(True, (by_doc[1:] != by_doc[:-1]) | (tf[1:] != tf[:-1]))
    at = np.flatnonzero(new_run)
    run_term, run_stratum, run_tf = term[at], by_doc[at], tf[at]
    term_runs = np.append(np.flatnonzero(new_term[at]), len(at))
    top = np.maximum.reduceat(unit_impact(run_tf, strata[run_stratum]), term_runs[:-1])
    df = np.diff(np.append(np.flatnonzero(new_term), len(term)))
    listed = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t))
    packed = lambda a, t="<i4": pa.array([np.ascontiguousarray(a).astype(t).tobytes()], pa.binary())
    return [
        pa.array([number], pa.int64()), listed(docs, docs.type), packed(stratum), packed(strata, "<i8"), listed(coded.dictionary.take(pa.array(run_term[term_runs[:-1]])), pa.string()), listed(df, pa.int64()), listed(top, pa.int64()),
        packed(term_runs), packed(run_stratum), packed(run_tf, "<i8"), packed(np.append(at, len(term))), packed(doc),
    ]


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order of (m, id), with terms -> shards, each closed at its size."""
    names = [c.split()[0] for c in _SHARD.split(", ")]
    held: list[tuple] = []
    docs = postings = made = 0
    part = TaskContext.get().partitionId()

    def close() -> pa.RecordBatch:
        nonlocal held, docs, postings, made
        out = pa.RecordBatch.from_arrays(_shard((part << 32) + made, *map(list, zip(*held, strict=True))), names)
        held, docs, postings, made = [], 0, 0, made + 1
        return out

    for b in slices(batches, 256):
        lists, tfs = b.column(2), b.column(3)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        held.append((b.column(0), b.column(1).to_numpy(), sizes, lists.flatten(), tfs.flatten().to_numpy()))
        docs, postings = docs + b.num_rows, postings + int(sizes.sum())
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield close()
    if held:
        yield close()


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())


class Shard:
    """A shard as arrays, and its visits."""

    def __init__(self, row: dict) -> None:
        number = lambda c, t="<i4": np.frombuffer(row[c], t).astype(np.int64)
        self.docs, self.stratum, self.m = row["docs"], number("stratum"), number("m", "<i8")
        self.terms = {t: k for k, t in enumerate(row["terms"])}
        self.term_runs, self.run_stratum, self.run_tf, self.run_at, self.posts = number("term_runs"), number("run_stratum"), number("run_tf", "<i8"), number("run_at"), number("posts")
        order = sorted(range(len(self.docs)), key=lambda d: (self.docs[d] is None, self.docs[d] or 0))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.held = np.bincount(self.stratum, minlength=len(self.m))

    def best(self, terms: list[str], weights: list[int], k: int, threshold: int | None) -> tuple[list[int], list[int], int]:
        """Places in docs and scores of the k best that reach the threshold, and the number of strata visited."""
        own = [(self.terms[t], w) for t, w in zip(terms, weights, strict=True) if t in self.terms]
        if not own:
            return [], [], 0
        term, weight = np.array(own, np.int64).T
        starts, ends = self.term_runs[term], self.term_runs[term + 1]
        runs, of = _ranges(starts, ends), np.repeat(np.arange(len(term)), ends - starts)
        stratum = self.run_stratum[runs]
        impact = weight[of] * unit_impact(self.run_tf[runs], self.m[stratum])
        first = np.append(True, (stratum[1:] != stratum[:-1]) | (of[1:] != of[:-1]))
        bound = np.zeros(len(self.m), np.int64)
        np.add.at(bound, stratum[first], impact[first])
        order = np.argsort(-bound, kind="stable")
        score, at, batch = np.zeros(len(self.docs), np.int64), 0, FIRST_DOCS
        while at < len(order) and bound[order[at]] > 0 and (threshold is None or bound[order[at]] >= threshold):
            end = at + 1 + int(np.searchsorted(np.cumsum(self.held[order[at:]]), batch))
            chosen = np.zeros(len(self.m), bool)
            chosen[order[at:end]] = True
            some = np.flatnonzero(chosen[stratum])
            a, z = self.run_at[runs[some]], self.run_at[runs[some] + 1]
            np.add.at(score, self.posts[_ranges(a, z)], np.repeat(impact[some], z - a))
            at, batch = end, 2 * batch
            positive = score[score > 0]
            if len(positive) >= k:
                threshold = max(threshold or 0, int(np.partition(positive, len(positive) - k)[len(positive) - k]))
        found = np.flatnonzero((score > 0) & (score >= (threshold or 0)))
        found = found[np.lexsort((self.place[found], -score[found]))][:k]
        return found.tolist(), score[found].tolist(), at


def _visit(k: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for b in batches:
            names = b.schema.names
            for i in range(b.num_rows):
                value = lambda c: b.column(names.index(c))[i]  # noqa: B023, E731
                if value("shard").as_py() != at:
                    shard, at = Shard({c: value(c).as_py() for c in names if c not in ("shard", "items", "salt")}), value("shard").as_py()
                out = [(x["item"], x["item_id"], d, s) for x in value("items").as_py() for d, s in zip(*shard.best(x["terms"], x["weights"], k, x["threshold"])[:2], strict=True)]
                item, item_id, place, score = zip(*out, strict=True) if out else ((), (), (), ())
                kind = b.schema.field("items").type.value_type.field("item_id").type
                docs = value("docs").values.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(item_id, kind), docs, pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return run


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Shards of all documents for the terms (a table with a column ``term``), the number of documents with a term, and of their terms."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    counted = materialise(base.mapInArrow(_count(_bitmap(terms)), f"doc_id {kind}, n bigint, terms array<string>, tfs array<bigint>"), "term_counts", compression="zstd")
    total, length, postings = (x or 0 for x in counted.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first())
    m = F.expr(f"100 - 90 + ((90 * n * {total}L) div {max(1, length)}L)")
    parts = max(1, -(-total // SHARD_DOCS), -(-postings // SHARD_POSTINGS))
    ordered = counted.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").repartitionByRange(parts, "m", "doc_id", F.monotonically_increasing_id()).sortWithinPartitions("m", "doc_id")
    return materialise(ordered.mapInArrow(_build, _SHARD.format(kind)), "term_shards", compression="zstd"), total, length


def _visits(items: DataFrame, pairs: DataFrame, shards: DataFrame, groups: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    """pairs (item, shard, threshold) -> the best documents of each pair; items that visit one shard go there in groups."""
    one = F.struct("item", "item_id", "terms", "weights", "threshold")
    salted = pairs.join(items, "item").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(groups)))
    grouped = salted.groupBy("shard", "salt").agg(F.collect_list(one).alias("items"))
    return grouped.join(shards, "shard").mapInArrow(_visit(k), f"item bigint, item_id {kinds[0]}, doc_id {kinds[1]}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item id, rank (from 1), doc_id and score of the k best documents of each item."""
    kinds = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    distinct = materialise(items.select(F.col(item_col).alias("item_id"), text_or_empty(item_text).alias("text")).distinct(), "items").withColumn("item", F.monotonically_increasing_id())
    asked = materialise(distinct.select("item", "item_id", "text").mapInArrow(_item_terms, f"item bigint, item_id {kinds[0]}, term string"), "item_terms")
    shards, total, _ = build_index(docs, asked, id_col, text_col)
    facts = shards.select("shard", F.explode(F.arrays_zip("terms", "df", "top")).alias("t")).select("shard", F.col("t.terms").alias("term"), "t.df", "t.top")
    df = facts.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((F.lit(2.0) * total + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("bigint")
    weighted = materialise(asked.join(df, "term").select("item", "item_id", "term", weight.alias("weight")), "item_weights")
    listed = materialise(weighted.groupBy("item", "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")), "item_lists")
    bounds = materialise(weighted.join(facts, "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0"), "item_bounds")
    groups = max(1, -(-listed.count() // GROUP_ITEMS))
    best = materialise(bounds.groupBy("item").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard")), "best_shards")
    shards_only = shards.drop("df", "top")
    first = materialise(_visits(listed, best.withColumn("threshold", F.lit(None).cast("bigint")), shards_only, groups, k, kinds), "first_visits")
    reached = first.groupBy("item").agg(F.count("*").alias("hits"), F.min("score").alias("least")).select("item", F.when(F.col("hits") >= k, F.col("least")).alias("threshold"))
    others = bounds.join(best, ["item", "shard"], "left_anti").join(reached, "item", "left").where("threshold is null or bound >= threshold").select("item", "shard", "threshold")
    hits = first.unionByName(_visits(listed, others, shards_only, groups, k, kinds))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
l AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0), g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM l),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM l) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * g.docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * g.docs) // g.length)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (doc_id), g GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""
