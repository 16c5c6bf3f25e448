"""Toxicity by weak supervision.

Voters are lexicon words and word-start patterns (``stem*``: some word starts so; ``stem**``: three different words do):
a fixed seed list and those that the labelled training rows single out.  A generative label model (a latent class, with each voter's firing rate under both classes, and voters that
agree beyond the class counted as less than one each) is fitted by EM; the training label is one more voter.
Its posteriors are the targets of a logistic regression on what a text alone shows: how often each voter
fires, how many do, and how densely.

The model is fitted on at most ``SAMPLE`` labelled training rows, those with the least hashes of their ids;
voters are mined from the same rows: at most ``WORDS`` words and ``PATTERNS`` word starts, drawn from the ``MINED`` weightiest of both; a start is
held against the ``COMPARED`` weightiest words.  These bounds are on features of the model; every text is scored whole.

Defined results: null and empty texts get a score too, from no votes; without a labelled training row, or with one class only,
the seed voters and a fixed prior make the score; repeated rows get equal scores; an empty table gives an empty
table; other columns are ignored by ``score_documents``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

SAMPLE = 20_000
WORDS, PATTERNS, PREFIXES, FAMILY = 48, 64, (4, 5, 6), 3
MINED, COMPARED = 4000, 20 * WORDS
LEAST_G, LEAST_FAMILY_G, LEAST_ROWS = 18.0, 11.0, 3  # families are few, so chance makes fewer of them
THRESHOLD = 0.3
# Seed lexicon.
SEED = ("idiot", "moron", "stupid", "trash", "loser", "pathetic", "disgusting", "worthless", "scum", "clown")
PRIOR = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def _mine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic rows, clean rows): words as they are, word starts with their asterisks."""
    pos: Counter[str] = Counter()
    neg: Counter[str] = Counter()
    for b in slices(batches):
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            stems = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
            found = pos if toxic else neg
            found.update(words)
            found.update(f"{s}*" for s in stems)
            found.update(f"{s}**" for s, n in stems.items() if n >= FAMILY)
    names = list(pos | neg)
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[w] for w in part], pa.int64()), pa.array([neg[w] for w in part], pa.int64())], ["feature", "pos", "neg"])


def choose_voters(found: list[tuple[str, int, int, float]]) -> list[str]:
    """Voters from (feature, toxic rows, clean rows, weight), the weightiest first."""
    words = [f for f in found if not f[0].endswith("*")][:COMPARED]
    starts: list[str] = []
    for name, pos, _, _ in (f for f in found if f[0].endswith("*")):
        stem = name.rstrip("*")
        if len(starts) == PATTERNS:
            break
        if any(stem.startswith(s.rstrip("*")) and len(name) - len(stem) == s.count("*") for s in starts):
            continue
        if name.endswith("**") or pos >= 2 * max((p for w, p, _, _ in words if w.startswith(stem)), default=0):
            starts.append(name)
    chosen = [w for w, *_ in words[:WORDS] if not any(w.startswith(s.rstrip("*")) for s in starts)]
    return list(dict.fromkeys([*SEED, *chosen])) + starts


class Voters:
    """Finds all voters in one pass over a text."""

    def __init__(self, names: list[str]) -> None:
        import ahocorasick

        self.names = names
        self.automaton = ahocorasick.Automaton()
        for stem in {n.rstrip("*") for n in names}:
            own = [names.index(stem + stars) if stem + stars in names else None for stars in ("", "*", "**")]
            self.automaton.add_word(stem, (len(stem), *own))
        self.automaton.make_automaton()

    def counts(self, text: str) -> np.ndarray:
        """How often each voter fires: words that stand alone, words that a start begins, different words of a family beyond two."""
        out = np.zeros(len(self.names))
        text = text.lower()
        n = len(text)
        families: dict[int, set[str]] = {}
        for end, (size, word, start, family) in self.automaton.iter(text):
            before = end - size
            if before >= 0 and text[before].isalpha():
                continue
            if not (end + 1 < n and text[end + 1].isalpha()):
                if word is not None:
                    out[word] += 1
                continue
            if start is not None:
                out[start] += 1
            if family is not None:
                families.setdefault(family, set()).add(_WORD.match(text, before + 1)[0])
        for k, words in families.items():
            out[k] = max(0, len(words) - FAMILY + 1)
        return out


def features(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns of the linear classifier, from voter counts and text lengths."""
    fired = (counts > 0).sum(axis=1)
    hits = counts.sum(axis=1)
    extra = [np.ones(len(counts)), np.log1p(fired), fired > 1, fired > 2, np.log1p(hits), np.log1p(1000 * hits / np.maximum(lengths, 50))]
    return np.column_stack([np.minimum(counts, 3), *extra]).astype(float)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P(toxic) of each training row.

    votes: 0/1, a column for each voter.  The label is a voter that is right in 97 of 100 rows at first.  Voters whose votes
    are correlated within the classes share one voice.
    """
    ballots = np.column_stack([votes, labels]).astype(float)
    post = np.where(labels == 1, 0.97, 0.03)
    voice = np.ones(ballots.shape[1])
    for turn in range(rounds):
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        rate1 = (post @ ballots + 0.5) / (post.sum() + 1.0)
        rate0 = ((1 - post) @ ballots + 0.5) / ((1 - post).sum() + 1.0)
        if turn in (2, 10):
            rest = ballots - np.outer(post, rate1) - np.outer(1 - post, rate0)
            spread = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
            tied = np.clip((rest.T @ rest) / len(rest) / np.outer(spread, spread), 0, 1)
            tied[tied < 0.2] = 0
            np.fill_diagonal(tied, 0)
            voice = 1 / (1 + tied.sum(axis=0))
        log1 = ballots * np.log(rate1) + (1 - ballots) * np.log1p(-rate1)
        log0 = ballots * np.log(rate0) + (1 - ballots) * np.log1p(-rate0)
        odds = np.log(prior / (1 - prior)) + (log1 - log0) @ voice
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    names: list[str]
    weights: np.ndarray | None = None
    _voters: Voters | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"names": self.names, "weights": self.weights, "_voters": None}

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._voters = self._voters or Voters(self.names)
        return np.stack([self._voters.counts(t) for t in texts]), np.array([len(t) for t in texts])

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        counts, lengths = self.counts(texts)
        if self.weights is None:
            odds = np.log(PRIOR / (1 - PRIOR)) - 1 + 1.5 * (counts > 0).sum(axis=1)
        else:
            odds = features(counts, lengths) @ self.weights
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _votes(model: ToxicityModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, lengths = model.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths), pa.array(list(counts.astype(np.float32)), pa.list_(pa.float32()))], ["toxic", "n", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """A model from the labelled rows that are not held out."""
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    ids = ids.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    train = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    # Of rows that repeat an id the least text stands for it, so the bound on ids bounds the rows that come to the driver.
    train = train.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select("_toxic", "_text")
    sizes = {r[0]: r[1] for r in train.groupBy("_toxic").count().collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not n:
        return ToxicityModel(list(SEED))
    counted = train.mapInArrow(_mine, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = p / (p + n)
    both = F.col("pos") + F.col("neg")
    g = 2 * (F.col("pos") * F.log(F.col("pos") / (both * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0))
    rare = 3 * F.col("neg") / n < F.col("pos") / p
    strong = counted.where((F.col("pos") >= LEAST_ROWS) & rare).withColumn("g", g).where(F.col("g") >= F.when(F.col("feature").endswith("**"), LEAST_FAMILY_G).otherwise(LEAST_G))
    found = [(r["feature"], r["pos"], r["neg"], r["g"]) for r in strong.orderBy(F.desc("g"), "feature").limit(MINED).collect()]
    model = ToxicityModel(choose_voters(found))
    rows = train.mapInArrow(_votes(model), "toxic int, n bigint, counts array<float>").toPandas()
    counts, toxic = np.stack(rows["counts"].to_numpy()).astype(float), rows["toxic"].to_numpy()
    posterior = label_model((counts > 0).astype(float), toxic)
    model.weights = logistic(features(counts, rows["n"].to_numpy()), posterior)
    return model


def _score(model: ToxicityModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(b.column(2).to_pylist()))], ["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score and predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    out = base.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")
    return out.select(F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxic_score(text: Column, model: ToxicityModel) -> Column:
    """The score of a text column, for use in any select."""
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series(model.score([t or "" for t in s]), dtype=float), "double")(text)
