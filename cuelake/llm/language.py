"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import bare, forget, hashed_part, slices, stored
from cuelake.llm.linear import Ftrl, Rates, bounded_sample, softmax

DIMS = 1 << 15  # hashed n-grams of one to three letters, a word's edges counting as letters
TRAIN_ROWS = 6_000  # documents that a model is fitted and calibrated on, at most
LANGUAGE_ROWS = 100  # of each language at least, beside them
CALIBRATION = 5  # every so many-th of them sets the temperature instead
EPOCHS = 3
RATES = Rates(alpha=0.5, beta=1.0, l1=0.05, l2=0.01)
HELD_OUT = 2
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_BETWEEN = regex.compile(r"[^\p{L}\p{M}]+")


def _number(*letters: np.ndarray) -> np.ndarray:
    """The number of an n-gram from its letters, from 1 on."""
    x = np.full(len(letters[0]), len(letters), dtype=np.uint64)
    for c in letters:
        x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.maximum(x >> np.uint64(49), 1).astype(np.int64)  # 15 bits


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text and how often each occurs.

    Words are runs of letters, lower-cased, with a blank on each side; n-grams may begin or end with that blank but
    do not reach over it.
    """
    words = _BETWEEN.sub(" ", text.lower()).strip(" ")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    letter = c != 32
    inner = letter[1:-1]
    found = np.concatenate([_number(c[letter]), _number(c[:-1], c[1:]), _number(c[:-2][inner], c[1:-1][inner], c[2:][inner])])
    total = np.bincount(found, minlength=1)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each n-gram occurs; place 0 holds the number of documents.

    Every task counts its documents in one array and hands over the places that are not zero; the sums come back as
    one array of ``DIMS`` numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen = np.zeros(DIMS, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen[frequencies(text)[0]] += 1
                seen[0] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["gram", "n"])

    sums = docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMS, dtype=np.int64)
    out[sums["gram"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out


def inverse_frequencies(seen: np.ndarray) -> np.ndarray:
    idf = np.log((1 + seen[0]) / (1 + seen)) + 1
    idf[0] = 0
    return idf


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of a text, of length 1, behind the bias."""
    at, n = frequencies(text)
    x = n * idf[at]
    return np.concatenate([[0], at]), np.concatenate([[1.0], x / (np.linalg.norm(x) or 1.0)])


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits under which the truth is likeliest, by golden-section search over its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    low, high, golden = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` of documents that may be learned from."""
    doc_id = F.col("doc_id").cast("bigint")
    rows = bare(docs, doc_id=doc_id, text=F.coalesce(F.col("text"), F.lit("")), lang=F.col("lang").cast("string"))
    return rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (hashed_part(F.col("doc_id")) != HELD_OUT))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, t: float):
        self.languages, self.idf, self.weights, self.t = languages, idf, weights, t


def train(docs: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, rates: Rates = RATES) -> Model:
    """Fit on at most ``rows`` documents outside the held-out part, and ``LANGUAGE_ROWS`` of each language, so that no
    language is left out; document frequencies come from all of them.

    The sample's texts are read whole and pass through one task in a fixed order; four of five update the model, the
    fifth sets the temperature.  The model holds ``DIMS`` weights per language.
    """
    allowed = learnable(docs)
    idf = inverse_frequencies(document_frequencies(allowed))
    said = allowed.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    common = bounded_sample(said, [F.col("lang")], rows, "language-sample")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # Spark limits it before the shuffle, too
    rare = said.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= LANGUAGE_ROWS).select("doc_id", "lang")
    chosen = stored(common.unionByName(rare).distinct(), "language-sample")
    languages = sorted(r[0] for r in chosen.select("lang").distinct().collect())  # of the bounded sample
    if not languages:
        return Model([], idf, np.zeros((DIMS, 0)), 1.0)
    texts = bare(docs, doc_id=F.col("doc_id").cast("bigint"), text=F.coalesce(F.col("text"), F.lit("")))
    sample = texts.join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, truth = [], []
        for batch in slices(batches):
            vectors += [weighted(t, idf) for t in batch.column("text").to_pylist()]
            truth += [languages.index(x) for x in batch.column("lang").to_pylist()]
        model = Ftrl(DIMS, len(languages), rates)
        one = np.eye(len(languages))
        fitted = [i for i in range(len(truth)) if i % CALIBRATION or len(truth) < 2 * CALIBRATION]
        for _ in range(epochs):
            for i in fitted:
                at, x = vectors[i]
                w = model.weights(at)
                model.step(at, x, softmax(x @ w) - one[truth[i]], w)
        w = model.weights(slice(None))
        rest = [i for i in range(len(truth)) if not i % CALIBRATION]
        logits = np.array([vectors[i][1] @ w[vectors[i][0]] for i in rest]).reshape(-1, len(languages))
        at = np.flatnonzero((w != 0).any(axis=1))
        t = temperature(logits, np.array([truth[i] for i in rest], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at].tolist(), pa.list_(pa.float64())), pa.array(np.full(len(at), t))],
                                         names=["gram", "weights", "temperature"])

    said = stored(sample.mapInArrow(fit, "gram int, weights array<double>, temperature double"), "language-model").toPandas()
    weights = np.zeros((DIMS, len(languages)))
    if len(said):
        weights[said["gram"].to_numpy(dtype=np.int64)] = np.array(said["weights"].tolist())
    return Model(languages, idf, weights, float(said["temperature"].iloc[0]) if len(said) else 1.0)


def _judge(texts: list[str | None], model: tuple) -> tuple[list[str], list[float]]:
    languages, idf, weights, t = model
    names, scores = [], []
    for text in texts:
        at, x = weighted(text or "", idf)
        if len(at) < 2 or not languages or not _LETTER.search(text):
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        p = softmax((x @ weights[at]) / t)
        names.append(languages[int(p.argmax())])
        scores.append(float(p.max()))
    return names, scores


def _shared(docs: DataFrame, model: Model):
    """The model on every executor: ``DIMS`` numbers per language, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.t))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each whole text."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            names, scores = _judge(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("bigint")
    rows = bare(docs, doc_id=doc_id, held_out=F.coalesce(hashed_part(doc_id) == HELD_OUT, F.lit(False)), text="text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, all columns, whose language can be told with a score of ``least`` or more.

    Where nothing may be learned from, those with a letter.
    """
    shared, model_known = _shared(docs, model), bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if not model_known:
                stays = [bool(t) and _LETTER.search(t) is not None for t in texts]
            else:
                stays = [n != UNDETERMINED and s >= least for n, s in zip(*_judge(texts, shared.value))]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the documents with a language outside the held-out part and predict every document's language.

    A null text, or one without a letter, is ``und`` with score 0; so is every document if none may be learned from.
    A null id is not held out and never learned from.  An empty table gives no rows.
    """
    return predict(docs, train(docs))
