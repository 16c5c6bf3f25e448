import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliperlake.llm import piece_lattice as L
from caliperlake.llm import pii, toxicity
from caliperlake.llm.common import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = ["a  b", " a", "a ", "a\n b", "\na", "ＡＢ", "a\tb", "  ", "<s>x", "▁x", "ab\x00c", "ab " + "qz" * 50, "\n\n", "\n  x", "中文字 text", "a\x01b \x01", "x \n\n y"]


def test_ids_are_the_library_s(spark, texts):
    rows = list(enumerate([t for _, t in texts] + ODD))
    got = {r.doc_id: list(r.ids) for r in L.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    sp = L._processor(MODEL)
    assert got == {i: sp.encode(t or "") for i, t in rows}


def test_decoding_gives_the_text_back(spark):
    rows = list(enumerate(ODD))
    encoded = L.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL)
    got = {r.doc_id: r.text for r in L.decode_documents(encoded, MODEL).collect()}
    sp = L._processor(MODEL)
    assert got == {i: sp.decode(sp.encode(t)) for i, t in rows}


def test_digests_do_not_depend_on_which_units_are_broadcast(docs, texts, monkeypatch):
    whole = sorted(map(str, L.piece_digests(docs, MODEL).collect()))
    assert len(whole) == len(texts)
    monkeypatch.setattr(L, "COMMON", 20)
    assert sorted(map(str, L.piece_digests(docs, MODEL).collect())) == whole
    sp = L._processor(MODEL)
    rows = L.piece_digests(docs, MODEL).collect()
    assert Counter((r.doc_id, r.n_pieces) for r in rows) == Counter((i, len(sp.encode(t or ""))) for i, t in texts)
    assert all(r.round_trip for r in rows)


def test_viterbi_finds_the_best_sum(spark):
    rng = random.Random(1)
    scores = {c: -8.0 for c in "abc"} | {"".join(rng.choice("abc") for _ in range(n)): -rng.uniform(3, 14) for n in (2, 2, 3, 3, 4, 5) for _ in range(4)}
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    pieces = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(scores.items())], "piece string, id int, score double")
    units = spark.createDataFrame([(w, 1, w) for w in words], "unit string, n long, s string")
    folded = L.lattice(units, pieces, 5).withColumn("places", L.viterbi_fold(F.char_length("s")))
    for r in folded.collect():
        cuts = [i for i in range(len(r.s) + 1) if r.places >> i & 1]
        best = [0.0] + [-1e9] * len(r.s)
        for j in range(1, len(r.s) + 1):
            best[j] = max(best[i] + scores[r.s[i:j]] for i in range(j) if r.s[i:j] in scores)
        assert abs(sum(scores[r.s[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)) - best[-1]) < 1e-9


def test_empty_tables(empty):
    assert L.piece_digests(empty, MODEL).count() == 0
    assert pii.pii_digests(empty).count() == 0
    assert toxicity.score_documents(empty, toxicity.ToxicityModel(list(toxicity.SEED))).count() == 0


def plain_spans(text):
    """The base rules, word for word."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in rules for m in re.finditer(p, text) if good(m[0])]


def test_base_spans_follow_the_rules():
    rng = random.Random(2)
    parts = ["a.b@c.org", "@", ".", "x@y", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+", "12", "--", " ", "word", "é", "+49.30.1234567", "a@b@c.de", "0000.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert [f[:3] for f in pii.spans_of(text) if f[0] in pii.BASE] == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "@" * 300_000, "a@" * 100_000, "+1 " * 100_000, "A1" * 150_000):
        pii.spans_of(text)


def test_checksums_and_context_add_spans():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    kinds = lambda t: [f[0] for f in pii.spans_of(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("GB83WEST12345698765432") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []


@pytest.mark.parametrize("after", ["", " BIC COBADEFF", " 2024", " GB82WEST12345698765432", " AND 30 MORE WORDS THAT ARE IN UPPER CASE", ", 5"])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"])
def test_ibans_before_upper_case_words_and_numbers(iban, after):
    text = "REF AB12 CDEF to " + iban + after
    found = [text[s:e] for k, s, e, _ in pii.spans_of(text) if k == "iban"]
    assert found == [iban] + [after[1:]] * after.startswith(" GB82")
    assert iban not in pii.redacted(text)


def test_redaction():
    assert pii.redacted("mail a.b@c.org or +1 (743) 555-3824!") == "mail [EMAIL] or [PHONE]!"
    assert pii.redacted(None) is None and pii.redacted("clean") == "clean"


def test_digests_of_spans(docs, texts):
    want = Counter()
    for i, t in texts:
        found = plain_spans(t or "")
        want[(i, *(sum(f[0] == k for f in found) for k in pii.BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest())] += 1
    rows = pii.pii_digests(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want


def test_scores_follow_the_spans_and_their_context(spark):
    rows = [(1, "write to a.b@c.org"), (2, "x a.b@c.org x"), (3, None), (4, "ssn 123-45-6789"), (5, "a 123-45-6789 b")]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == ("", "") and got[5] == ("", "")
    for i in (1, 2, 4):
        spans, scores = (x.split(",") for x in got[i])
        assert len(spans) == len(scores) == 1 and pii.THRESHOLD <= float(scores[0]) <= 1


def naive_counts(names, text):
    """Voters by reading the text word by word."""
    low = text.lower()
    runs, start = [], None
    for k, c in enumerate(low + " "):
        if c.isalpha() and start is None:
            start = k
        elif not c.isalpha() and start is not None:
            runs.append(low[start:k])
            start = None
    out = []
    for name in names:
        stem = name.rstrip("*")
        longer = [w for w in runs if w.startswith(stem) and len(w) > len(stem)]
        out.append(sum(w == stem for w in runs) if name == stem else len(longer) if name.endswith("*") and not name.endswith("**") else max(0, len(set(longer)) - 2))
    return np.array(out, float)


def test_scores_equal_a_naive_scorer(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows[:300]:
        text = texts[r.doc_id] or ""
        c = naive_counts(model.names, text)
        fired, hits = (c > 0).sum(), c.sum()
        x = np.array([*np.minimum(c, 3), 1.0, np.log1p(fired), fired > 1, fired > 2, np.log1p(hits), np.log1p(1000 * hits / max(len(text), 50))], float)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    filler = [f"plain{i}" for i in range(400)]
    bad = ["vexa" + s for s in ("lo", "mi", "ru", "ta", "no", "pe")] + ["grumbo", "idiot"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [rng.choice(filler) for _ in range(60)]
        if toxic:
            for w in rng.sample(bad, 4):
                words.insert(rng.randrange(60), w)
        elif i % 11 == 0:
            words.insert(5, rng.choice(bad))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    out = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    right = (out["predicted"] == out["toxic"]).mean()
    assert len(out) > 200 and right > 0.95 and out["score"].between(0, 1).all()
    assert any(n.startswith("vexa") for n in model.names)


def test_labels_of_held_out_rows_do_not_matter(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.names == b.names and np.allclose(a.weights, b.weights)


def test_odd_rows_get_scores(docs, texts, spark):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y)
    poor = rng.random(4000) < 0.4
    votes = np.column_stack([good, *[poor] * 6]).astype(float)
    noisy = np.where(rng.random(4000) < 0.05, ~y, y).astype(int)
    posterior = toxicity.label_model(votes, noisy)
    assert ((posterior > 0.5) == y).mean() > 0.93
