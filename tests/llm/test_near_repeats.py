import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from caliperlake.llm import near_dedup, repeats
from caliperlake.llm.components import components
from caliperlake.llm.run_index import RunIndex, repeated_windows, suffix_array


def word_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d, d == (least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_components_match_brute_force(docs, texts):
    got = Counter(map(tuple, near_dedup.near_duplicates(docs).collect()))
    assert got == brute_components(texts)


def test_chains_hubs_and_the_threshold(spark):
    rng = random.Random(3)
    base = [f"t{rng.randrange(10**6)}" for _ in range(104)]
    rows = [(1, " ".join(base))]
    for k in range(2, 14):  # a chain: each is near the one before, the ends are not near
        base = base[6:] + [f"u{k}{j}" for j in range(6)]
        rows.append((k, " ".join(base)))
    hub = [f"h{i}" for i in range(150)]
    for k in range(20, 80):  # a group of near copies, each changed at another place
        copy = list(hub)
        copy[rng.randrange(150)] = f"c{k}"
        rows.append((k, " ".join(copy)))
    shared = " ".join(f"p{i}" for i in range(40))
    rows += [(k, shared + " " + " ".join(f"q{k}_{i}" for i in range(20))) for k in range(100, 140)]  # alike, but under the threshold
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, near_dedup.near_duplicates(df).collect()))
    assert got == brute_components(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    test_chains_hubs_and_the_threshold(spark)


def test_blocks_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 6000)
    test_chains_hubs_and_the_threshold(spark)


def test_blocks_give_fewer_links_than_members():
    import pandas as pd

    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(60):  # a cluster of like texts: all pairs are near
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        found = near_dedup.shingles(" ".join(words))
        samples = near_dedup.minhash(found)
        bands, sketch = near_dedup.band_keys(samples), near_dedup.odd_sketch(samples)
        bands[0] = 7
        rows.append((7, 0, 0, 2, k, k, len(found), *sketch, bands, near_dedup.odd_sketch(near_dedup.minhash(found, 1024), 2048).tobytes(), found.view(np.int64)))
    pdf = pd.DataFrame(rows, columns=["bucket", "i", "j", "side", "node", "label", "n_shingles", "s0", "s1", "s2", "s3", "bands", "wide", "shingles"])
    links = near_dedup._spanning(pdf)
    assert len(near_dedup._undecided(pdf)) == 60 and len(links) == 59


def test_odd_sketch_estimates_differences():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1800], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    far = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    s = [near_dedup.odd_sketch(near_dedup.minhash(x)).view(np.uint64) for x in (a, b, far)]
    bits = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert bits(s[0], s[0]) == 0 < bits(s[0], s[1]) < near_dedup.MOST_BITS < bits(s[0], s[2])


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert repeats.repeat_digests(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_repeats(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = Counter()
    for (d, _), x in zip(rows, data, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[d, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_match_brute_force(docs, texts):
    assert Counter(map(tuple, repeats.repeat_digests(docs).collect())) == brute_repeats(texts)


def test_repeats_in_many_shapes(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([150, 199, 200, 201, 260, 400]))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300)))]) for _ in range(4))) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "a" * 199), (102, "a" * 200), (103, "a" * 201), (104, "ab" * 100 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeat_digests(df).collect())) == brute_repeats(rows)


def test_hot_passages_are_not_indexed_by_one_task(spark, monkeypatch):
    """A passage amid differing texts: every occurrence gives its own snippets under the same anchors."""
    rng = random.Random(8)
    other = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = other(330)
    rows = [(i, other(rng.randint(40, 160)) + passage[: rng.choice([210, 330])] + other(rng.randint(40, 160))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1][20:] + "z"), (102, other(300))]
    index, bound = repeats._index, 5000

    def bounded(batches):
        sizes = Counter()
        for b in batches:
            for anchor, data in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                sizes[anchor] += len(data)
                if sizes[anchor] > bound:
                    raise ValueError("one task holds more of an anchor than the bound")
            yield from index([b])

    monkeypatch.setattr(repeats, "CHUNK_BYTES", bound)
    monkeypatch.setattr(repeats, "_index", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeat_digests(df).collect())) == brute_repeats(rows)


def test_removal_keeps_other_columns(docs, texts):
    out = repeats.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] == "" and kept[9] == "only three words" and kept[4] is None


@pytest.mark.parametrize("block", [10**6, 25])
def test_index_marks_windows_that_start_elsewhere(block):
    rng = random.Random(6)
    for _ in range(60):
        strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))})
        count = Counter(s[i : i + 6] for s in strings for i in range(len(s) - 5))
        for s, flags in zip(strings, repeated_windows(strings, 6, block), strict=True):
            assert flags.tolist() == [count[s[i : i + 6]] > 1 for i in range(len(s) - 5)]


def test_transform_is_run_compressed():
    index = RunIndex([b"abracadabra" * 30 + bytes([i]) for i in range(20)])
    assert index.runs < index.length / 10


def test_suffix_array_is_sorted():
    strings = [b"banana", b"ananas", b"nab"]
    lengths = np.array([len(s) for s in strings])
    ends = np.cumsum(lengths + 1) - 1
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    owner = np.repeat(np.arange(3), lengths + 1)
    order = suffix_array(text, owner, ends)
    key = [(bytes(text[i : ends[owner[i]]]), owner[i]) for i in order]
    assert key == sorted(key)
