"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, hashed_part, slices, stored, worker_cache
from cuelake.llm.linear import Ftrl, Rates, bounded_sample

DIMS = 1 << 20  # hashed features; bounds the model
TRAIN_ROWS = 24_000  # labelled documents that a model is fitted on, at most
EPOCHS = 4
RATES = Rates(alpha=1.0, beta=1.0, l1=4.0, l2=0.1)
STEM = 4  # leading letters that stand for a word's stem
THRESHOLD = 0.3
HELD_OUT = 2  # of the four parts of the ids; never learned from

_EDGES = " .,;:!?\"'()[]{}<>|#*$%&-_=+/\\@"
_KNOWN_WORDS = 300_000


class _Vocabulary:
    """Hashes of the words and stems that a worker has met."""

    def __init__(self) -> None:
        self.ids: dict[str, tuple[int, int]] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > _KNOWN_WORDS:
            self.ids = {}
        for raw in set(words) - self.ids.keys():
            word = raw.lower().strip(_EDGES)
            self.ids[raw] = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word[:STEM], seed=1))
        pairs = np.fromiter(chain.from_iterable(map(self.ids.__getitem__, words)), np.uint64, 2 * len(words))
        return pairs[0::2], pairs[1::2]


def _fold(x: np.ndarray) -> np.ndarray:
    """A feature number from 1 on; 0 is the bias."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(40)) % np.uint64(DIMS - 1)).astype(np.int32) + 1


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word, stem, pair of neighbours and pair with one word skipped."""
    vocabulary = worker_cache().setdefault("toxicity words", _Vocabulary())
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    word, stem = vocabulary([w for text in words for w in text])
    owner = np.repeat(np.arange(len(texts)), sizes)
    owners, found = [owner, owner], [_fold(word), _fold(stem)]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        both = owner[:-gap] == owner[gap:]
        pair = (word[:-gap] * np.uint64(salt) ^ (word[gap:] >> np.uint64(3))) + word[gap:]
        owners.append(owner[:-gap][both])
        found.append(_fold(pair[both]))
    return np.concatenate(owners), np.concatenate(found)


def _by_text(owner: np.ndarray, found: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct features of each text, the bias first."""
    keys = np.unique(owner * DIMS + found)
    cuts = np.searchsorted(keys, np.arange(n + 1) * DIMS)
    return [np.concatenate([[0], keys[a:b] % DIMS]) for a, b in zip(cuts, cuts[1:])]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        found = _by_text(*features(texts), len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))],
                                         names=["doc_id", "label", "features"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, rates: Rates = RATES) -> DataFrame:
    """``feature, weight``: the weights that are not zero.

    The ids of the fitted documents are chosen from the labels alone, at most ``rows`` of them and none of the held-out
    part; their texts are read whole and turned into features where they lie, and the features of that bounded sample
    pass through one task in a fixed order.
    """
    allowed = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (hashed_part(F.col("doc_id").cast("bigint")) != HELD_OUT))
    said = allowed.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(said, [F.col("toxic").cast("double").alias("label")], rows, "toxic-sample")
    texts = bare(docs, doc_id=F.col("doc_id").cast("bigint"), text=F.coalesce(F.col("text"), F.lit("")))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    sample = stored(sample.mapInArrow(_extract, "doc_id bigint, label double, features array<int>"), "toxic-features")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        model = Ftrl(DIMS, 1, rates)
        lists = table["features"].combine_chunks()
        truth = table["label"].to_numpy()
        for _ in range(epochs):
            for i in range(len(lists)):
                at = lists[i].values.to_numpy()
                w = model.weights(at)
                x = np.ones(len(at))
                error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - truth[i]
                model.step(at, x, np.array([error]), w)
        w = model.weights(slice(None))[:, 0]
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["feature", "weight"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features")
    return stored(ordered.mapInArrow(fit, "feature int, weight double"), "toxic-model")


def score(docs: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each whole text under a model of at most ``DIMS`` weights."""
    said = model.toPandas()  # bounded by DIMS, and sparse
    table = np.zeros(DIMS, dtype=np.float32)
    table[said["feature"].to_numpy(dtype=np.int64)] = said["weight"].to_numpy(dtype=np.float64)
    weights = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            owner, found = features(texts)
            telling = table[found] != 0
            keys = np.unique(owner[telling] * DIMS + found[telling])
            total = table[0] + np.bincount(keys // DIMS, weights=table[keys % DIMS], minlength=len(texts))
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("bigint")
    rows = bare(docs, doc_id=doc_id, held_out=F.coalesce(hashed_part(doc_id) == HELD_OUT, F.lit(False)), text=F.coalesce(F.col("text"), F.lit("")))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents outside the held-out part and score every document.

    Null and empty texts get the score of the bias alone.  A null id is not held out and never learned from; a
    document with several labels counts as toxic if one of them says so.  Without any label every score is 0.5.  An empty table
    gives no rows.
    """
    return score(docs, train(docs, labels))
