import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliperlake.llm import fill_in_middle, max_score, strata
from caliperlake.llm.fill_in_middle import Frames

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def middle(doc_id, text):
    """The contract, told once more over whole strings."""
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, mid, suffix = parts
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{mid}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{mid}"
    return len(units), form, len(prefix), len(mid), output


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    rng = random.Random(2)
    long = ["y" * 1_000_000, "é1" * 300_000, "".join(rng.choice(["word ", "\n", "ß", "<", "P", "\U0001f600"]) for _ in range(200_000)), "a <M> b", "<P", "中" * 5461 + "x"]
    rows = [*texts, *((100 + k, t) for k, t in enumerate(long)), *((200 + k, "some words, and more") for k in range(60))]
    return rows, spark.createDataFrame([(i, t, 1, b"b", 2) for i, t in rows], "doc_id long, text string, n int, body binary, first int").repartition(3)


def test_middles_are_the_contract_s(long_docs):
    rows, df = long_docs
    want = Counter((i, *middle(i, t)) for i, t in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_in_middle.fill_in_middle(df).collect())) == want
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = Counter((i, *(m := middle(i, t))[:4], sha(m[4]), sha(t)) for i, t in rows)
    assert Counter(map(tuple, fill_in_middle.fim_digests(df).collect())) == digests


def test_middles_of_empty_tables(empty):
    assert fill_in_middle.fill_in_middle(empty).count() == fill_in_middle.fim_digests(empty).count() == 0


def test_frames_cut_and_stream_anywhere():
    rng = random.Random(7)
    for size in (5, 16, 64):
        text = "".join(rng.choice(["ab", "c", " ", "é", "中", "\U0001f600", "Zz9"]) for _ in range(300))
        data = text.encode()
        frames = Frames.write([data[k : k + 7] for k in range(0, len(data), 7)], size)
        units = UNIT.findall(text)
        assert len(frames.seek) > 3 and frames.seek[-1][:3] == (len(units), len(text), len(data))
        assert all(frames.frame(k).decode() is not None for k in range(len(frames.seek) - 1))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert frames.cut(k) == (len(before.encode()), len(before))
        for _ in range(50):
            a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
            assert b"".join(frames.stream(a, b)) == data[a:b]
    marked = Frames.write([b"x" * 14 + b"<P>" + b"y" * 9 + b"<S>z"], 8)
    assert marked.find([b"<P>", b"<S>"]) == [14, 26] and marked.find([b"<S>", b"<P>"]) == [26, -1]


def test_only_cut_frames_are_decompressed(monkeypatch):
    frames, seen = Frames.write([b"ab " * 40_000]), []
    whole = Frames.frame
    monkeypatch.setattr(Frames, "frame", lambda self, k: seen.append(k) or whole(self, k))
    assert len(frames.seek) > 7
    frames.cut(30_001)
    assert len(set(seen)) <= 2


def test_an_output_of_another_form_is_refused():
    with pytest.raises(ValueError):
        list(fill_in_middle.restored(Frames.write([b"no marks"]), "psm"))


VECTORS = "vec_id long, embedding array<float>, label int, codes int, id int, shard int"


def best(rows, k):
    """All pairs."""
    code = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, a in {(i, tuple(v)) for i, v in code if i % 20 == 0}:
        found = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in code if i != q))[:k]
        out.update((q, rank, i, -s) for rank, (s, i) in enumerate(found, 1))
    return out


@pytest.mark.parametrize(("shard", "block"), [(8192, 256), (64, 5)])
def test_searches_are_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(max_score, "SHARD_ROWS", shard)
    monkeypatch.setattr(max_score, "QUERY_ROWS", block)
    monkeypatch.setattr(max_score, "SEED_ROWS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 24))
    rows = [(i, (centres[i % 4] / 3 + rng.normal(size=24) / 8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many equal vectors, and ties
    rows += [(2000, [0.0] * 24), (2020, []), (2040, [1.0, -2.0]), (2060, None), (2080, [None, 1.0]), (2100, [float("nan"), 1.0]), (2120, [float("inf")]), (None, [1.0]), (2140, [1e9, -1e9]), rows[20], rows[20]]
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], VECTORS).repartition(3)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in max_score.search(df, F.col("id") % 20 == 0, 20).collect())
    assert got == best(rows, 20)


def test_searches_of_few_and_of_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], VECTORS)
    asked = F.col("id") % 20 == 0
    assert Counter(map(tuple, max_score.search(df, asked, 20).collect())) == best(rows, 20)
    assert max_score.search(df.limit(0), asked).count() == 0
    assert max_score.search(df.where("vec_id > 0"), asked).count() == 0


def test_non_essential_terms_are_probed_for_competitive_vectors_only():
    rng = np.random.default_rng(5)
    codes = rng.integers(-20, 20, size=(64, 3000))
    codes[:, :30] = np.where(rng.random((64, 30)) < 0.1, codes[:, :30], 25)
    shard = max_score.Shard(max_score.Packed(np.arange(3000), codes))
    sizes, whole = [], np.ix_
    np_ix = lambda *a: sizes.append(len(a[1])) or whole(*a)
    max_score.np.ix_ = np_ix
    try:
        ids, scores = shard.top(-1, np.full(64, 25), 20, None)
    finally:
        max_score.np.ix_ = whole
    exact = 25 * codes.sum(0)
    order = np.lexsort((np.arange(3000), -exact))[:20]
    assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    assert sizes and sizes[-1] < 300


def ranked(docs, items, k=10):
    """The contract over dictionaries."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out.update((item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranks_are_exact(spark, texts, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(strata, "SHARD_DOCS", 4)
        monkeypatch.setattr(strata, "GROUP_ITEMS", 2)
        monkeypatch.setattr(strata, "FIRST_DOCS", 1)
        monkeypatch.setattr(strata, "CHUNK", 50)
    items = [(0, "w1 w2 w3 w4 w5 w6"), (1, "Line TEXT again"), (2, None), (3, ""), (4, "nothing that occurs"), (5, "three words w10 w10 x\tÜnïcödé ünïcödé é"), (5, "w7 w8"), (0, "w1 w2 w3 w4 w5 w6"), (None, "w9 w11 w12"), (6, " ".join(f"w{k}" for k in range(300)))]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, term string")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in strata.search(docs, asked).collect())
    assert got == ranked(texts, items)


def test_ranks_of_empty_tables(spark, docs, empty):
    asked = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert strata.search(empty, asked).count() == 0
    assert strata.search(docs, asked.limit(0)).count() == 0
    assert strata.search(docs.where("text is null"), asked).count() == 0


def test_strata_below_the_threshold_are_not_visited(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 400)))) for i in range(600)] + [(1000 + i, "rare words here") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame([(t,) for t in ("rare", "words", "here", "a")], "term string")
    shards, _, _ = strata.build_index(docs, terms)
    row = shards.where(F.array_contains("terms", "rare")).drop("df", "top").collect()[0].asDict()
    shard = strata.Shard(row)
    found, scores, visited = shard.best(["rare", "words", "here", "a"], [5000, 5000, 5000, 1], 10, None)
    assert [shard.docs[d] for d in found] == list(range(1000, 1010)) and len(set(scores)) == 1
    assert visited < len(shard.m) / 4
    assert defaultdict(int, Counter(shard.stratum.tolist()))[0] >= 12
