import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from caliperlake.llm import packing, token_counts
from caliperlake.llm.common import scratch_path, tokenizer_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_library_s(spark, docs, texts, tok):
    got = Counter(map(tuple, token_counts.count_tokens(docs, tokenizer_path()).collect()))
    assert got == Counter((i, len((t or "").encode()), len(ids(tok, t))) for i, t in texts)


def test_cache_keeps_distinct_digests_and_is_read_again(spark, docs, texts):
    cache = scratch_path(spark, "cache")
    first = sorted(map(str, token_counts.count_tokens(docs, tokenizer_path(), cache).collect()))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count() < len(texts)
    spark.createDataFrame([("x", token_counts.tokenizer_digest(tokenizer_path()), 7)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert sorted(map(str, token_counts.count_tokens(docs, tokenizer_path(), cache).collect())) == first
    assert spark.read.parquet(cache).count() == stored.count() + 1  # the row added here, and no text encoded twice


def test_a_digest_stored_twice_counts_once(spark, docs, texts):
    cache = scratch_path(spark, "cache")
    first = Counter(map(tuple, token_counts.count_tokens(docs, tokenizer_path(), cache, detail=True).collect()))
    assert not any(hit for *_, hit in first)
    again = spark.read.parquet(cache)
    again.write.mode("append").parquet(cache)  # what a second writer, or a retried append, leaves
    second = Counter(map(tuple, token_counts.count_tokens(docs, tokenizer_path(), cache, detail=True).collect()))
    assert second == Counter((*row, True) for *row, _ in first.elements())


def test_the_query_hits_a_lasting_cache(spark, tmp_path):
    from caliperlake.llm.queries import op1_token_counts

    docs = spark.createDataFrame([(i, f"text number {i % 5}") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(token_counts.CACHE_SETTING, str(tmp_path / "cache"))
    try:
        assert [op1_token_counts(spark, str(tmp_path)).where("cached").count() for _ in range(2)] == [0, 20]
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty, tokenizer_path()).count() == 0
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_pieces_and_sequences(docs, texts, tok):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    want = Counter()
    for i, t in texts:
        a = np.array([*ids(tok, t), 0], "<u4")
        for k, s in enumerate(range(0, len(a), 2048)):
            want[i, k, s, len(a[s : s + 2048]), zlib.crc32(a[s : s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_best_fit_takes_the_tightest_bin():
    assert packing.best_fit([2, 3], [6, 8, 2, 4], 10, [[0], [1]]) == [[0, 3], [1, 2]]


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    order = list(range(200))
    people = []
    for _ in range(2):
        rng.shuffle(order)
        people.append(packing.best_fit(order, sizes, 100, []))
    child = packing.crossover(people[0], people[1], sizes, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(200))
    assert all(sum(sizes[i] for i in b) <= 100 for b in child)
    child = packing.mutate(child, sizes, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(200))


def test_evolution_beats_best_fit_decreasing():
    sizes = [51, 27, 26, 23, 24, 25, 12, 12] * 40
    first = packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 100, [])
    assert len(packing.evolve(sizes, 100, random.Random(0), [])) <= len(first)


def test_many_blocks_and_islands(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(i, rng.randint(1, 700)) for i in range(600)], "uid long, length long")
    rows = packing.pack(items, 1000, block=100, islands=3, epochs=2).collect()
    assert sorted(r.uid for r in rows) == list(range(600))
    total = items.agg({"length": "sum"}).first()[0]
    assert len({r.sequence_id for r in rows}) <= 1.06 * total / 1000 + 2


def test_a_word_is_learned_once_whatever_stop_follows_it(monkeypatch):
    import numpy as np

    from caliperlake.llm.common import WordMemo, tokenizer_path

    memo, asked = WordMemo(tokenizer_path()), []
    learn = memo._learn
    monkeypatch.setattr(memo, "_learn", lambda chunks: (asked.extend(chunks), learn(chunks)))
    texts = ["zebrafish. zebrafish, zebrafish! zebrafish", "Καφές. İ. ΟΔΟΣ. ΟΔΟΣ; é. é é. '. . .. it's. x². ² ı, ﬁ: ῼ. 한국; 하. 9. a9. 東京. ١.", "", ".", " zebrafish?\n.zebrafish"]
    got = memo.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [memo.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [c for c in asked if "zebrafish" in c] == ["zebrafish", ".zebrafish"]
