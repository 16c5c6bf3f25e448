"""Helpers shared by the training-data operators: scratch tables, null-safe joins, tokenizer memo."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) a folder of our own is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/caliperlake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: Column, right: Column) -> Column:
    """Equality that also matches null with null; Spark still hashes on it."""
    return left.eqNullSafe(right)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into small ones, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_TOKENIZERS: dict[str, "WordMemo"] = {}


class WordMemo:
    """Exact ids of whole texts, with the library called once for each new white-space chunk.

    Only for tokenizers whose pre-tokens never hold white space and which drop it (the
    vocabulary here): the ids of a text are then the ids of its chunks, one after another.
    Texts that may hold a special token's string go to the library whole.  Long chunks are not kept, and
    the memo has a fixed number of entries, so memory is bounded.
    """

    ENTRIES, LONGEST, GROUP = 700_000, 48, 64

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.mark = {t.content[:2] for t in added.values()}
        self.sep_id, sep = next(iter(sorted((k, t.content) for k, t in added.items())))
        self.sep = sep
        self.memo: dict[str, bytes] = {"": b""}
        self.stops = self._stops()

    @classmethod
    def of(cls, path: str) -> "WordMemo":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _stops(self) -> str:
        """The signs that this tokenizer's own pattern parts from the letters before them, none where it has another form."""
        split = next((s for s in self._rules() if s.get("type") == "Split"), {})
        pattern = split.get("pattern", {}).get("Regex", "")
        return ".,;:!?" if pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and split["behavior"] == "Removed" and split["invert"] else ""

    def _rules(self) -> list[dict]:
        rules = json.loads(self.tok.to_str())["pre_tokenizer"] or {}
        return rules.get("pretokenizers", [rules])

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        groups = [chunks[i : i + self.GROUP] for i in range(0, len(chunks), self.GROUP)]
        encoded = self.tok.encode_batch_fast([self.sep.join(g) for g in groups], add_special_tokens=False)
        for group, enc in zip(groups, encoded, strict=True):
            ids = np.asarray(enc.ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(group, [*np.flatnonzero(ids == self.sep_id).tolist(), len(ids)], strict=True):
                self.memo[chunk] = raw[4 * start : 4 * end]
                start = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        memo, split, new = self.memo, [], {}
        for text in texts:
            text = text or ""
            if any(m in text for m in self.mark):
                split.append(text)
                continue
            chunks = (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
            new.update(dict.fromkeys(set(chunks).difference(memo)))
            split.append(chunks)
        long = [c for c in new if len(c) > self.LONGEST]
        for c in long:
            del new[c]
            memo[c] = self.whole(c)
        # A word and the stop after it are never one pre-token, so only the word is asked for.
        ended = [c for c in new if c[-1] in self.stops and c[:-1].lower().isalpha()]
        for c in ended:
            del new[c]
        asked = [c for c in dict.fromkeys(chain(new, (c[:-1] for c in ended), (c[-1] for c in ended))) if c not in memo]
        if asked:
            self._learn(asked)
        for c in ended:
            memo[c] = memo[c[:-1]] + memo[c[-1]]
        fresh = [c for c in chain(asked, ended) if c]
        out = [self.whole(s) if isinstance(s, str) else b"".join(map(memo.__getitem__, s)) for s in split]
        for c in long:
            del memo[c]
        if (over := len(memo) - self.ENTRIES) > 0:
            for c in fresh[-over:]:
                del memo[c]
        return out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
