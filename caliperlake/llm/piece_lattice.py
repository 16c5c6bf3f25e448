"""SentencePiece encoding and decoding as a relational lattice.

No piece of such a model holds a space mark after another character, or a line break, so a text is cut into words at
these places without loss; and if no piece holds a letter beside another sign, a word is cut again into units at these places, as no
piece can cross them.  Distinct units are counted; their substrings of bounded length are exploded and equi-joined to the
piece table; the edges are grouped by unit; and a fold with Spark's ``aggregate`` picks the path.

The fold of a unigram model is Viterbi's: at each character the best sum of scores of a path that ends there.  The
pieces of a BPE model are not the path of the best sum, so its fold applies the model's own rule to the same edges: of all edges that
join two neighbouring pieces it takes the one of the best score, the leftmost among equals, until none is left.
Characters without a piece fall back to bytes.  The fold keeps a unit's places in one long; a unit of more than ``LONGEST`` characters has
the same lattice, and its edges are folded by the same rule in a heap.  Each unit is decoded again from its ids by the piece table and compared with itself.

The whole corpus has many more units than distinct ones, so documents are put together in two ways: the commonest
units, at most ``COMMON`` (a fixed bound), are broadcast; occurrences of others are joined to the table of units.

Defined results: a null text counts as empty and has no pieces; repeated rows each get their row; round_trip is false where decoding
does not give the text back, as for one that holds the space mark itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty

SPACE, BREAK, WHOLE = "▁", "\n", "\x01"
LONGEST, COMMON, TAKEN, HELD = 60, 200_000, 250_000, 100_000
_UNIT = re.compile(f"\n?{SPACE}*[^{SPACE}\n]+|\n?{SPACE}+|\n")
_M64 = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id and score of the pieces that can be matched in text."""
    sp = _processor(model)
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


_LOADED: dict[str, object] = {}


def _processor(model: str):
    if model not in _LOADED:
        import sentencepiece

        _LOADED[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _LOADED[model]


def words_of(text: str) -> list[str]:
    """Words of a text, in order.  A plain word after a single space is written without its space mark; all others begin with WHOLE."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and WHOLE not in text and text[0] not in " \n" and text[-1] not in " \n" and " \n" not in text and "\n " not in text and "\n\n" not in text:
        return text.replace("\n", " \n").split(" ")
    marked = SPACE + text.replace(" ", SPACE)
    return [u[1:] if u[0] == SPACE and len(u) > 1 and u[1] != SPACE and WHOLE not in u else u if u[0] == BREAK and len(u) > 1 and u[1] != SPACE and WHOLE not in u else WHOLE + u for u in _UNIT.findall(marked)]


def surface(word: str) -> str:
    """The word as it stands in the marked text."""
    return word[1:] if word[0] == WHOLE else word if word[0] == BREAK else SPACE + word


_RUNS: dict[str, re.Pattern | None] = {}


def runs_of(model: str) -> re.Pattern | None:
    """Runs of letters and runs of anything else, both with the space marks before them, if every piece of the model is one run; else nothing."""
    if model not in _RUNS:
        sp = _processor(model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        # Word characters that are neither letters nor digits, such as raised numbers, count as anything else.
        odd = re.escape("".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha()})))
        runs = re.compile(rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{odd}])+|{SPACE}+")
        _RUNS[model] = runs if all(runs.fullmatch(p) and len(runs.findall(p)) == 1 for p in pieces) else None
    return _RUNS[model]


def units_of(word: str, runs: re.Pattern | None) -> list[str]:
    """Units of a word: the runs of its surface."""
    s = surface(word)
    return [s] if runs is None or s[1:].isalpha() and s[0] != BREAK else runs.findall(s)


def _mix(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two longs, so that both ways of putting documents together agree."""

    def rotl(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def one(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
        h = seed + np.uint64(_P5 + 8 & _M64)
        h = h ^ (rotl(value * np.uint64(_P2), 31) * np.uint64(_P1))
        h = rotl(h, 27) * np.uint64(_P1) + np.uint64(_P4)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
        return h ^ (h >> np.uint64(32))

    return one(code.view(np.uint64), one(place.astype(np.uint64), np.full(len(place), np.uint64(42)))).view(np.int64)


def _list_units(model: str):
    """(unit, n) with the repeats of a task summed up to a bound of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = runs_of(model), Counter()

        def given() -> pa.RecordBatch:
            units: Counter[str] = Counter()
            for word, n in held.items():
                for u in units_of(word, runs):
                    units[u] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())], ["unit", "n"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                held.update(words_of(text))
            if len(held) > TAKEN:
                yield given()
        if held:
            yield given()

    return run


def merged(size: int, edges: dict[tuple[int, int], float]) -> list[int]:
    """The places between pieces after all merges of a BPE model: edges (start, end) of the best score first, the leftmost among equals."""
    after, before, live = list(range(1, size + 2)), list(range(-1, size + 1)), [True] * (size + 1)
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int, k: int, j: int) -> None:
        if (score := edges.get((i, j))) is not None:
            heapq.heappush(heap, (-score, i, k, j))

    for i in range(size - 1):
        offer(i, i + 1, i + 2)
    while heap:
        _, i, k, j = heapq.heappop(heap)
        if live[i] and live[k] and after[i] == k and after[k] == j:
            live[k], after[i], before[j] = False, j, i
            if i:
                offer(before[i], i, j)
            if j < size:
                offer(i, j, after[j])
    return [k for k in range(size + 1) if live[k]]


def best_path(size: int, edges: dict[tuple[int, int], float], unknown: float = -1e4) -> list[int]:
    """The places between pieces on the path of the best sum of scores of a unigram model."""
    into: dict[int, list[int]] = {}
    for i, j in edges:
        into.setdefault(j, []).append(i)
    best = [(0.0, 0)]
    for j in range(1, size + 1):
        best.append(max([(best[j - 1][0] + unknown, j - 1), *((best[i][0] + edges[i, j], i) for i in into.get(j, ()))]))
    places = [size]
    while places[-1]:
        places.append(best[places[-1]][1])
    return places[::-1]


def _fold_long(model: str, fold: str):
    """Ids of units whose places do not fit a long, from the edges of their lattice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        first_byte = sp.piece_to_id("<0x00>")

        def single(c: str) -> list[int]:
            i = sp.piece_to_id(c)
            return [i] if i != sp.unk_id() and not sp.is_byte(i) else [first_byte + x for x in c.encode()]

        for b in slices(batches, 16):
            ids = []
            for unit, edges in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                known = {(-e["back"], -e["back"] + e["len"]): e for e in edges}
                places = (merged if fold == "merge" else best_path)(len(unit), {k: e["score"] for k, e in known.items()})
                ids.append([x for i, j in zip(places[:-1], places[1:], strict=True) for x in ([known[i, j]["id"]] if (i, j) in known else single(unit[i:j]))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["unit", "n", "ids"])

    return run


def _span(i: Column, j: Column) -> Column:
    """A long with the bits i .. j - 1 set."""
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, j) - F.call_function("shiftleft", one, i)


def lattice(units: DataFrame, pieces: DataFrame, longest: int, singles: bool = True) -> DataFrame:
    """units (unit, n, s) -> the same with edges: an array of (score, back, inner, ends, id, len), one for each piece that matches a substring.

    Without ``singles``, pieces of one character below 256 are left out.  inner and ends are places as bits, of use up to ``LONGEST`` characters.
    """
    size = F.char_length("s")
    starts = units.select("unit", "n", "s", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    first = F.lit(1) if singles else F.when(F.ascii(F.substring("s", F.col("i") + 1, F.lit(1))) >= 256, 1).otherwise(2)
    last = F.least(F.lit(longest), size - F.col("i"))
    # A unit keeps one row without a piece, so that it stays if nothing matches.
    lens = F.concat(F.when(F.col("i") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    spans = starts.select("unit", "n", "s", "i", F.explode(lens).alias("len"))
    spans = spans.withColumn("sub", F.when(F.col("len") > 0, F.substring("s", F.col("i") + 1, F.col("len"))).otherwise(""))
    nothing = pieces.sparkSession.createDataFrame([("", -1, 0.0)], "piece string, id int, score double")
    table = F.broadcast(pieces.unionByName(nothing))  # as many rows as the model has pieces
    one, i, j = F.lit(1).cast("bigint"), F.col("i"), F.col("i") + F.col("len")
    ends = F.call_function("shiftleft", one, i).bitwiseOR(F.call_function("shiftleft", one, j))
    edge = F.struct(F.col("score"), (-i).alias("back"), F.when((F.col("len") > 1) & (j <= LONGEST), _span(i + 1, j)).otherwise(F.lit(0).cast("bigint")).alias("inner"), ends.alias("ends"), F.col("id"), F.col("len"))
    matched = spans.join(table, F.col("sub") == F.col("piece")).select("unit", "n", "s", edge.alias("edge"))
    return matched.groupBy("unit").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.filter(F.collect_list("edge"), lambda e: e["id"] >= 0).alias("edges"))


def merge_fold(size: Column) -> Column:
    """The places between pieces, as bits of a long, after all merges of a BPE model."""

    def step(places: Column, _: Column) -> Column:
        joins = F.filter("edges", lambda e: (places.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(places.bitwiseAND(e["inner"])) == 1))
        best = F.array_max(joins)
        return F.coalesce(places - places.bitwiseAND(best["inner"]), places)

    return F.aggregate(F.sequence(F.lit(2), size), _span(F.lit(0), size + 1), step)


def viterbi_fold(size: Column, unknown: float = -1e4) -> Column:
    """The places between pieces on the path of the best sum of scores of a unigram model."""
    one = F.lit(1).cast("bigint")
    start = F.array(F.struct(F.lit(0.0).alias("total"), one.alias("places")))

    def step(best: Column, j: Column) -> Column:
        bit = F.call_function("shiftleft", one, j)
        into = F.filter("edges", lambda e: (e["ends"].bitwiseAND(bit) != 0) & (e["ends"] < 2 * bit))
        ways = F.transform(into, lambda e: F.struct((F.element_at(best, -e["back"] + 1)["total"] + e["score"]).alias("total"), F.element_at(best, -e["back"] + 1)["places"].bitwiseOR(bit).alias("places")))
        last = F.element_at(best, -1)
        byte = F.array(F.struct((last["total"] + unknown).alias("total"), last["places"].bitwiseOR(bit).alias("places")))
        return F.concat(best, F.array(F.array_max(F.concat(ways, byte))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), size), start, step), -1)["places"]


def _decoded(ids: Column, sp) -> Column:
    """The characters of an array of ids, by the piece table; byte pieces are put together as bytes."""
    raw = [sp.id_to_piece(i)[3:5] if sp.is_byte(i) else "" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).encode().hex() for i in range(sp.get_piece_size())]
    table = F.split(F.lit(",".join(raw)), ",")  # folded to a constant
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")), "UTF-8")


def encode_units(units: DataFrame, model: str, fold: str = "merge") -> DataFrame:
    """units (unit, n) -> unit, n, ids and round_trip (the ids decode to the unit), written once."""
    spark, sp = units.sparkSession, _processor(model)
    first_byte = sp.piece_to_id("<0x00>")
    pieces = piece_table(spark, model)
    longest = max(len(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    marked = units.withColumn("s", F.col("unit"))
    size, merging = F.char_length("s"), fold == "merge"
    folded = lattice(marked, pieces, longest, singles=not merging)
    folded = folded.withColumn("places", F.when(size <= LONGEST, (merge_fold if merging else viterbi_fold)(size)))
    places = F.col("places")
    chosen = F.filter("edges", lambda e: (places.bitwiseAND(e["ends"]) == e["ends"]) & (places.bitwiseAND(e["inner"]) == 0))
    folded = folded.withColumn("chosen", F.transform(chosen, lambda e: F.struct((-e["back"]).alias("i"), (F.bit_count(e["inner"]) + 1).alias("len"), F.array(e["id"]).alias("ids"))))
    # Places that no chosen edge begins at are single characters: by a table below 256, else by their bytes.
    one = F.lit(1).cast("bigint")
    begun = F.aggregate("chosen", F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", one, c["i"])))
    folded = folded.withColumn("open", places.bitwiseXOR(begun).bitwiseXOR(F.call_function("shiftleft", one, size)))
    gaps = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.call_function("shiftright", F.col("open"), i).bitwiseAND(one) == 1)
    own = [sp.piece_to_id(chr(k)) for k in range(256)]
    table = F.array(*(F.lit(i if i != sp.unk_id() and not sp.is_byte(i) else -1) for i in own))
    raw = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda k: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), k, F.lit(1))), 16, 10).cast("int") + first_byte)
    low = lambda c: F.when(F.ascii(c) < 256, F.element_at(table, F.ascii(c) + 1)).otherwise(-1)
    single = lambda c: F.when(low(c) >= 0, F.array(low(c))).otherwise(raw(c))
    singles = F.transform(gaps, lambda i: F.struct(i.alias("i"), F.lit(1).alias("len"), single(F.substring("s", i + 1, F.lit(1))).alias("ids")))
    folded = folded.withColumn("parts", F.array_sort(F.when(F.col("open") == 0, F.col("chosen")).otherwise(F.concat("chosen", singles))))
    ids = F.when(places.isNotNull(), F.flatten(F.transform("parts", lambda p: p["ids"])))
    edges = F.when(places.isNull(), F.transform("edges", lambda e: F.struct(e["score"].alias("score"), e["back"].alias("back"), e["len"].alias("len"), e["id"].alias("id"))))
    folded = folded.select("unit", "n", ids.alias("ids"), edges.alias("edges"))
    same_text = lambda df: (_decoded(F.col("ids"), sp) == df["unit"]).alias("round_trip")
    out = materialise(folded.select("unit", "n", "ids", "edges", same_text(folded)), "units", compression="zstd")
    long = out.where("ids is null").select("unit", "n", "edges").mapInArrow(_fold_long(model, fold), "unit string, n bigint, ids array<int>")
    return out.where("ids is not null").drop("edges").unionByName(long.select("unit", "n", "ids", same_text(long)))


_PART = "uid bigint, doc_id {}, unit string, place bigint, n_pieces bigint, digest bigint, round_trip boolean"


def _put_together(model: str, common) -> object:
    """Documents from the common units; occurrences of other units as rows of their own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, sizes, good = common.value
        known, runs = {u: k for k, u in enumerate(names)}, runs_of(model)
        held: dict[str, tuple[int, ...]] = {}  # places of a word's units among the common ones, or below zero among the others
        others: dict[str, int] = {}
        by_place: list[str] = []
        uid = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            own, units, places, totals, digests, whole = [], [], [], [], [], []
            first = uid
            if len(held) > HELD:
                held.clear()
                others.clear()
                by_place.clear()
            for i, text in enumerate(b.column(1).to_pylist()):
                found = words_of(text)
                for word in set(found).difference(held):
                    ks = []
                    for u in units_of(word, runs):
                        if (k := known.get(u, others.get(u))) is None:
                            k = others[u] = -1 - len(by_place)
                            by_place.append(u)
                        ks.append(k)
                    held[word] = tuple(ks)
                k = np.fromiter(chain.from_iterable(map(held.__getitem__, found)), np.int64)
                have = np.flatnonzero(k >= 0)
                at = np.flatnonzero(k < 0)
                rest = len(at)
                own += [i] * (1 + rest)
                units.append(None)
                units.extend(map(by_place.__getitem__, (-1 - k[at]).tolist()))
                places.append(None)
                places.extend(at.tolist())
                totals += [int(sizes[k[have]].sum()), *[None] * rest]
                digests += [int(np.bitwise_xor.reduce(_mix(have, codes[k[have]]))) if len(have) else 0, *[None] * rest]
                whole += [bool(good[k[have]].all()) and SPACE not in text, *[None] * rest]
                uid += 1
            take = pa.array(own, pa.int64())
            uids = pa.array(np.asarray(own, np.int64) + first)
            columns = [pa.array(units, pa.string()), pa.array(places, pa.int64()), pa.array(totals, pa.int64()), pa.array(digests, pa.int64()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays([uids, b.column(0).take(take), *columns], ["uid", "doc_id", "unit", "place", "n_pieces", "digest", "round_trip"])

    return run


def encoded_units(base: DataFrame, model: str, fold: str) -> DataFrame:
    """The table of distinct units of a text column."""
    counted = base.select("text").mapInArrow(_list_units(model), "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return encode_units(counted, model, fold)


def commonest(coded: DataFrame, most: int) -> DataFrame:
    """The units of at least so many occurrences that at most ``most`` units have.  Counts are told apart up to 1,024, and by powers of two beyond."""
    grain = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("bigint"))
    held, least = 0, None
    for n, units in sorted(coded.groupBy(grain.alias("n")).count().collect(), reverse=True):  # some 1,080 rows at most
        held += units
        if held > most:
            break
        least = n
    return coded.where(F.lit(False) if least is None else F.col("n") >= least)


def piece_digests(docs: DataFrame, model: str, fold: str = "merge", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_pieces, ids_digest (XOR over units of a hash of place and ids) and round_trip of every row."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    units = encoded_units(base, model, fold)
    coded = units.select("unit", "n", F.xxhash64("ids").alias("code"), F.size("ids").cast("bigint").alias("n_pieces"), "round_trip")
    top = commonest(coded, COMMON).select("unit", "code", "n_pieces", "round_trip").toArrow()
    common = spark.sparkContext.broadcast((top["unit"].to_pylist(), top["code"].to_numpy(), top["n_pieces"].to_numpy(), np.array(top["round_trip"].to_pylist(), bool)))
    parts = materialise(base.mapInArrow(_put_together(model, common), _PART.format(kind)), "unit_parts", compression="zstd")
    rare = parts.where("unit is not null").select("uid", "unit", "place")
    looked = rare.join(coded.select("unit", "code", "n_pieces", "round_trip"), "unit").select("uid", "n_pieces", F.xxhash64("place", "code").alias("digest"), "round_trip")
    rest = looked.groupBy("uid").agg(F.sum("n_pieces").alias("more"), F.bit_xor("digest").alias("others"), F.bool_and("round_trip").alias("good"))
    whole = parts.where("unit is null").join(rest, "uid", "left")
    return whole.select(
        F.col("doc_id").alias(id_col),
        (F.col("n_pieces") + F.coalesce("more", F.lit(0))).alias("n_pieces"),
        F.col("digest").bitwiseXOR(F.coalesce("others", F.lit(0).cast("bigint"))).alias("ids_digest"),
        (F.col("round_trip") & F.coalesce("good", F.lit(True))).alias("round_trip"),
    )


def encode_documents(docs: DataFrame, model: str, fold: str = "merge", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids, the whole array, of every row; the ids of all occurrences are shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    units = encoded_units(base, model, fold).select("unit", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, runs = TaskContext.get().partitionId() << 33, runs_of(model)
        for b in slices(batches):
            found = [[u for word in words_of(t) for u in units_of(word, runs)] for t in b.column(1).to_pylist()]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), b.column(0), pa.array(found, pa.list_(pa.string()))], ["uid", "doc_id", "found"])
            uid += n

    listed = materialise(base.mapInArrow(run, f"uid bigint, doc_id {kind}, found array<string>"), "unit_lists", compression="zstd")
    each = listed.select("uid", F.posexplode("found").alias("place", "unit")).join(units, "unit")
    ids = each.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    return listed.select("uid", "doc_id").join(ids, "uid", "left").select(F.col("doc_id").alias(id_col), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each array of ids: ids are exploded, equi-joined to the piece table, and put together again."""
    spark, sp = encoded.sparkSession, _processor(model)
    rows = [(i, None, int(sp.id_to_piece(i)[3:5], 16)) if sp.is_byte(i) else (i, sp.id_to_piece(i), None) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    table = F.broadcast(spark.createDataFrame(rows, "id int, piece string, byte int"))
    numbered = materialise(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).withColumn("uid", F.monotonically_increasing_id()), "ids")
    raw = F.coalesce(F.hex(F.encode("piece", "UTF-8")), F.lpad(F.hex("byte"), 2, "0")).alias("raw")
    each = numbered.select("uid", F.posexplode("ids").alias("place", "id")).join(table, "id").select("uid", "place", raw)
    joined = each.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda x: x["raw"]), "").alias("raw"))
    text = F.replace(F.decode(F.unhex("raw"), "UTF-8"), F.lit(SPACE), F.lit(" "))
    text = F.when(text.startswith(" "), F.substring(text, 2, 1 << 30)).otherwise(text)
    return numbered.join(joined, "uid", "left").select(F.col("doc_id").alias(id_col), F.coalesce(text, F.lit("")).alias("text"))
