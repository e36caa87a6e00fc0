"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's words count twice: as they read in lower case without outer punctuation, and as their shape (runs of
capitals, small letters and digits, other characters as they are). Uni- and bigrams of the words, uni-, bi- and
trigrams of the shapes and repeated neighbours are hashed into 2^bits places; a place's value is its share of
the text's n-grams. A score is the sigmoid of the sparse dot product with the weights.

Training takes at most max_examples labelled rows (those of the smallest hash of doc_id, a uniform sample) that
are not held out, splits them by that hash over shards, and averages the shards' weights. The model's size is
fixed by `bits`. Scoring reads every text whole.

Defined cases: a null or empty text scores by the bias alone; null labels aren't learnt from; a doc_id labelled
twice counts twice; repeated documents are scored each; without labels every score is 0.5; an empty table gives
no rows; a null doc_id is not held out (its crc32 is null); extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import only


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_examples: int = 20_000
    shards: int = 8
    epochs: int = 3
    min_updates: int = 1500  # a shard of few rows goes over them more often
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    scale: float = 16.0
    threshold: float = 0.3


#: Words remembered by one Python worker, at about 150 bytes each.
MEMO_ENTRIES = 500_000
_OUTER = re.compile(r"^\W+|\W+$")
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[0-9]+")


class _Words(dict):
    """word -> hash of the word << 32 | hash of its shape"""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        shape = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))
        plain = _OUTER.sub("", word).lower()
        found = self[word] = zlib.crc32(plain.encode("utf-8", "replace")) << 32 | zlib.crc32(shape.encode("utf-8", "replace"))
        return found


_words = _Words()


def places(text: str | None, bits: int) -> np.ndarray:
    """Hashed places of all n-grams of a text, repeats included."""
    own = text.split() if text else []
    both = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    step = lambda x, salt: ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    pair = lambda a, b: a * np.uint64(0x100000001B3) ^ b
    grams = [step(word, 1), step(shape, 2)]
    if len(own) > 1:
        shapes = pair(shape[:-1], shape[1:])
        grams += [step(pair(word[:-1], word[1:]), 3), step(shapes, 4)]
        grams.append(step(np.full(int((word[:-1] == word[1:]).sum()), 7, np.uint64), 5))
        if len(own) > 2:
            grams.append(step(pair(shapes[:-1], shape[2:]), 6))
    return np.concatenate(grams).astype(np.int64)


def train(examples: list[tuple[np.ndarray, int]], s: Settings) -> np.ndarray:
    """FTRL-proximal weights; the last is the bias."""
    n = (1 << s.bits) + 1
    z, squares = np.zeros(n), np.zeros(n)
    prepared = []
    for found, label in examples:
        at, counts = np.unique(found, return_counts=True)
        prepared.append((np.r_[at, n - 1], np.r_[s.scale * counts / max(1, len(found)), 1.0], label))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(squares[at])) / s.alpha + s.l2)
        return np.where(np.abs(z[at]) <= s.l1, 0.0, w)

    for _ in range(max(s.epochs, -(-s.min_updates // max(1, len(prepared))))):
        for at, x, label in prepared:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / s.alpha * w
            squares[at] += g * g
    return weights(np.arange(n))


def score(found: np.ndarray, weights: np.ndarray, s: Settings) -> float:
    dot = weights[-1] + (s.scale * weights[found].sum() / len(found) if len(found) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(dot, -30, 30))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Weights from the bounded sample; one array of fixed size a shard reaches the driver."""
    ship(docs.sparkSession)
    chosen = (
        only(labels, "doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id", "quality")
        .limit(s.max_examples)
        .select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"), "h")
    )
    # At most max_examples rows of 20 bytes are broadcast.
    sample = only(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sample = sample.select(F.expr(f"cast(pmod(h, {s.shards}) as int)").alias("shard"), "h", "label", "text")

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "label", "text"], na_position="first")
        examples = [(places(t, s.bits), y) for t, y in zip(rows["text"], rows["label"], strict=True)]
        return pd.DataFrame({"n": [len(rows)], "weights": [train(examples, s).astype("<f4").tobytes()]})

    found = sample.groupBy("shard").applyInPandas(shard, "n long, weights binary").collect()
    total = sum(r["n"] for r in found) or 1
    start = np.zeros((1 << s.bits) + 1)
    return sum((np.frombuffer(r["weights"], "<f4").astype(float) * (r["n"] / total) for r in found), start)


def scored(docs: DataFrame, weights: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                scores = [score(places(t, s.bits), w, s) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= s.threshold) for x in scores], pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = only(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    return scored(docs, fit(docs, labels, s), s)
