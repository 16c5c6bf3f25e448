import hashlib
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caliperlake.llm import edit_fingerprints as E
from caliperlake.llm import sharding, tiff


def test_equal_texts_have_equal_fingerprints_at_any_batch():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de") for _ in range(n)) for n in (0, 1, 5, 300, 300, 9000, 70000)]
    alone = [E.fingerprints([t])[0] for t in texts]
    assert E.fingerprints(texts[::-1])[::-1] == alone
    assert alone[0] == "0:" and E.likeness(alone[0], alone[0]) == 1.0


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    few, half, other = t[:1000] + "zz" + t[1000:], t[:1500] + "".join(rng.choice("qrstuv") for _ in range(1500)), "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    a, b, c, d = E.fingerprints([t, few, half, other])
    assert E.likeness(a, b) > 0.7 > E.likeness(a, c) > 0.3 > E.likeness(a, d)


@pytest.mark.parametrize("part", [16_000_000, 3000])
def test_edits_and_next_documents(spark, docs, texts, part):
    rows = [(i, t) for i, t in dict((x for x in texts if x[0] is not None)).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in E.compare_with_edits(df, chars_a_part=part).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        e = E.edited(t, f)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert [got[i].fingerprint, got[i].edited_fingerprint] == E.fingerprints([t, e])
        assert got[i].near_edited == E.likeness(got[i].fingerprint, got[i].edited_fingerprint)
    assert E.compare_with_edits(docs).count() == len(texts)  # null ids and repeated rows stay


def naive_fingerprint(text):
    """One walker, one step after another."""
    level = 0
    while -(-2 * len(text) // (E.STRIDE * 2**level)) > E.SLOTS:
        level += 1
    moves = np.random.Generator(np.random.PCG64(E.SEED)).integers(0, 2, (4096, 256), dtype=np.int64)
    stride, at, j, out = E.STRIDE * 2**level, 0, 0, []
    while at < len(text):
        for k in range(stride):
            c = (ord(text[at]) * 2654435761 % 2**32 >> 12) % 255 + 1 if at < len(text) else 0
            if k == 0:
                out.append("0123456789abcdef"[c * 167 % 256 >> 4])
            at += int(moves[j % 4096][c]) if c else 0
            j += 1
    return f"{level}:" + "".join(out)


def naive_likeness(a, b):
    (la, x), (lb, y) = ((int(m.split(":")[0]), m.split(":")[1]) for m in (a, b))
    x, y = x[:: 2 ** max(0, lb - la)], y[:: 2 ** max(0, la - lb)]
    equal = sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y), 1)
    return 1.0 if not x and not y else max(0.0, (equal - 1 / 16) * 16 / 15)


@pytest.mark.parametrize("text_ids", [False, True])
def test_the_query_equals_a_naive_walk(spark, texts, tmp_path, text_ids):
    from caliperlake.llm.queries import op5_edit_fingerprints

    name = (lambda i: f"id{i:03}") if text_ids else (lambda i: i)
    rows = sorted({name(i): t for i, t in texts if i is not None}.items())
    spark.createDataFrame([*rows, (None, "nobody's"), (None, None)], f"doc_id {'string' if text_ids else 'long'}, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_edit_fingerprints(spark, str(tmp_path)).collect()
    want = {}
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, f = t or "", f or ""
        half = len(t) // 2
        e = t[: len(t) - half] + f[:half]
        a, b, c = (naive_fingerprint(x) for x in (t, e, f))
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, naive_likeness(a, b), naive_likeness(a, c))
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:5] == want[r.doc_id][:4]
            assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][4:])


def test_parts_have_tasks_of_their_own(spark):
    keys = E._part_keys(spark, 50)
    placed = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(50)))
    assert sorted(r[0] for r in placed.collect()) == list(range(50))


def test_similar_texts_are_grouped(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        t = "".join(rng.choice("abcdefgh ijk") for _ in range(1200))
        rows += [(10 * g, t), (10 * g + 1, t), (10 * g + 2, t[:700] + "!" + t[700:])]
    got = {r.doc_id: r.group_id for r in E.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_empty_tables(empty):
    assert E.compare_with_edits(empty).count() == 0
    assert E.similar_texts(empty).count() == 0
    assert sharding.assign_shards(empty, 100).count() == 0
    assert tiff.media_digests(empty).count() == 0


def test_shards_split_only_where_they_must(spark, docs, texts):
    rows = sharding.assign_shards(docs, 40_000).collect()
    assert len(rows) == len(texts)
    size = Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
        assert len(r.shard) == r.depth
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a prefix code: every address has one shard
    assert all(r.shard_bytes == size[r.shard] and r.over_limit == (size[r.shard] > 40_000) for r in rows)


def test_shards_match_sql_and_go_deeper_where_needed(spark):
    rows = [(i, "x" * (50 + i % 7 * 300)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(sharding.oracle(4000)).fetchall()}
    for step in (1, 6):
        assert {r.doc_id: (r.n_bytes, r.depth, r.shard, r.shard_bytes, r.over_limit) for r in sharding.assign_shards(df, 4000, step=step).collect()} == want


def test_one_id_over_the_limit_is_told(spark):
    df = spark.createDataFrame([(1, "a" * 100), (1, "a" * 100), (2, "b")], "doc_id long, text string")
    rows = sharding.assign_shards(df, 150).collect()
    assert {(r.doc_id, r.over_limit) for r in rows} == {(1, True), (2, False)}


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    some = docs.where("doc_id < 13")
    sharding.write_shards(some, str(tmp_path / "s"), 3000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == some.count()


@pytest.mark.parametrize("pack,unpack", [(tiff.lzw_encode, tiff.lzw_decode), (tiff.pack_bits, tiff.unpack_bits)])
def test_codecs_round_trip(pack, unpack):
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 127, 128, 129, 600, 5000, 30000):
        for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.choice(b"ab") for _ in range(n)), b"\0" * n):
            assert unpack(pack(data)) == data


def test_codecs_read_known_bytes():
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.lzw_decode(bytes.fromhex("80 0B 60 50 22 0C 0C 85 01")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE])
def test_pages_round_trip(compression):
    rng = np.random.default_rng(5)
    payload = rng.integers(0, 256, 576 * 2100, dtype=np.uint8)
    payload[: 576 * 1000] //= 64
    media = tiff.write_tiff(payload.tobytes(), compression=compression)
    pages = list(tiff.pages_of(media))
    assert [p.height for p in pages] == [1024, 1024, 52] and b"".join(p.samples for p in pages) == payload.tobytes()


def test_big_endian_sixteen_bits_with_predictor():
    import struct

    data = np.array([[1, 300, 5], [70, 60000, 9]], ">u2")
    stored = data.copy()
    stored[:, 1:] = data[:, 1:] - data[:, :-1]
    strip = zlib.compress(stored.tobytes())
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 1), (279, 4, len(strip)), (317, 3, 2)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    at = 8 + len(strip)
    media = b"MM\0*" + struct.pack(">I", at) + strip + struct.pack(">H", len(tags)) + entries + struct.pack(">I", at)  # the chain returns to itself
    (page,) = tiff.pages_of(media)
    assert page.samples == data.tobytes()


def test_rows_per_page_and_broken_files(spark):
    good = tiff.write_tiff(bytes(576 * 1500))
    rows = [(1, good), (2, good[:200]), (3, None), (4, b""), (5, b"II*\0\xff\xff\xff\xff"), (6, b"not a picture")]
    out = tiff.read_pages(spark.createDataFrame(rows, "k long, media binary"), "k", "media").collect()
    assert [(r.k, r.page, r.height) for r in out if r.page is not None] == [(1, 0, 1024), (1, 1, 476)]
    assert {r.k for r in out if r.error} == {2, 3, 4, 5, 6}


def test_digests_of_stored_texts(docs, texts):
    want = Counter()
    for i, t in texts:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    rows = tiff.media_digests(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature.startswith("pages=") for r in rows)


def test_bands_find_near_copies_of_other_lengths():
    """Against brute force: short texts, insertions, and pairs on two sides of a level boundary."""
    rng = random.Random(12)
    pairs = []
    for n in [60, 90, 150, 250, 380, 400, 500, 800, 1020, 1023, 1024, 2046, 2047] * 12:
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        at = rng.randrange(n)
        pairs.append((text, text[:at] + "".join(rng.choice("xyz") for _ in range(rng.randint(1, 4))) + text[at:]))
    marks = E.fingerprints([t for p in pairs for t in p])
    alike = [(a, b) for a, b in zip(marks[::2], marks[1::2], strict=True) if E.likeness(a, b) >= 0.75]
    across = [(a, b) for a, b in alike if a.split(":")[0] != b.split(":")[0]]
    met = lambda some: sum(bool(set(E.bands_of(a)) & set(E.bands_of(b))) for a, b in some) / len(some)
    assert len(alike) > 80 and len(across) > 10
    assert met(alike) >= 0.98 and met(across) >= 0.98


def test_groups_match_brute_force_in_a_band_of_half_similar_texts(spark, monkeypatch):
    """All texts meet in one band only, whose first fingerprint is like one other at most; the band has several blocks."""
    monkeypatch.setattr(E, "BLOCK", 40)
    monkeypatch.setattr(E, "bands_of", lambda mark: [7])
    rng = random.Random(21)
    other = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    template = other(560)
    rows = []
    for k in range(40):
        t = template + other(rng.choice([400, 463, 900]))
        rows += [(2 * k, t), (2 * k + 1, t[:900] + "!" + t[900:])]
    rng.shuffle(rows)
    marks = dict(zip([i for i, _ in rows], E.fingerprints([t for _, t in rows]), strict=True))
    group = {i: i for i in marks}
    for a in sorted(marks):
        for b in sorted(marks):
            if a < b and E.likeness(marks[a], marks[b]) >= 0.75:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert len(set(group.values())) > 10
    got = {r.doc_id: r.group_id for r in E.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group


def test_compression_does_not_follow_size():
    rng = random.Random(9)
    seen = {}
    for rows in (1, 3, 40, 900):
        seen[rows] = {next(tiff.pages_of(tiff.write_tiff(bytes(rng.randrange(97, 110) for _ in range(576)) * rows))).compression for _ in range(30)}
    assert all(s == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} for s in seen.values())


def test_hostile_and_unknown_files_are_error_rows(spark):
    def file(tags, body=b""):
        entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
        return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"

    huge = file({256: 1 << 21, 257: 1 << 21, 258: 8, 259: 1, 273: 8, 277: 1, 278: 1 << 21, 279: 4}, b"abcd")
    planes = file({256: 2, 257: 1, 258: 8, 259: 1, 273: 8, 277: 3, 278: 1, 279: 6, 284: 2}, b"RRGGBB")
    bomb = zlib.compress(b"\0" * 50_000_000)
    small = file({256: 10, 257: 1, 258: 8, 259: 8, 273: 8, 277: 1, 278: 1, 279: len(bomb)}, bomb)
    rows = spark.createDataFrame([(1, huge), (2, planes), (3, small), (4, None), (5, b"II*\0")], "id long, media binary")
    got = {r.id: r for r in tiff.read_pages(rows, "id", "media").collect()}
    assert "larger" in got[1].error and "planes" in got[2].error and got[4].error and got[5].error
    assert got[3].error is None and bytes(got[3].samples) == b"\0" * 10
