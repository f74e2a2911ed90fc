"""The linear models against plain loops over single examples and features."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import language, linear, toxicity


class PlainFtrl:
    """One coordinate at a time, as published: z and n per feature and output."""

    def __init__(self, outputs, rates):
        self.z, self.n, self.outputs, self.rates = defaultdict(float), defaultdict(float), outputs, rates

    def weight(self, i, k):
        z, r = self.z[i, k], self.rates
        bound = 0.0 if i == 0 else r.l1
        if abs(z) <= bound:
            return 0.0
        return -math.copysign(abs(z) - bound, z) / ((r.beta + math.sqrt(self.n[i, k])) / r.alpha + r.l2)

    def learn(self, features, predict, truth):
        w = {(i, k): self.weight(i, k) for i in features for k in range(self.outputs)}
        p = predict([sum(w[i, k] * x for i, x in features.items()) for k in range(self.outputs)])
        for i, x in features.items():
            for k in range(self.outputs):
                g = (p[k] - truth[k]) * x
                sigma = (math.sqrt(self.n[i, k] + g * g) - math.sqrt(self.n[i, k])) / self.rates.alpha
                self.z[i, k] += g - sigma * w[i, k]
                self.n[i, k] += g * g

    def table(self):
        out = {(i, k): self.weight(i, k) for i, k in list(self.z)}
        return {key: w for key, w in out.items() if w}


def logistic(logits):
    return [1 / (1 + math.exp(-max(-35, min(35, x)))) for x in logits]


def softmax(logits):
    e = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(e) for x in e]


def by_hash(spark, ids):
    """Ids in the order that the fitting task sees them."""
    return [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i"), "i").collect()]


@pytest.mark.parametrize("outputs", [1, 3])
def test_steps(outputs):
    r, rates = np.random.default_rng(outputs), linear.Rates(alpha=0.3, beta=0.7, l1=0.2, l2=0.1)
    fast, plain = linear.Ftrl(30, outputs, rates), PlainFtrl(outputs, rates)
    for _ in range(200):
        at, x = np.concatenate([[0], 1 + r.choice(29, 4, replace=False)]), r.normal(size=5)
        truth = np.eye(outputs)[r.integers(outputs)] if outputs > 1 else r.integers(0, 2, 1)
        w = fast.weights(at)
        p = linear.softmax(x @ w) if outputs > 1 else np.array(logistic(x @ w))
        fast.step(at, x, p - truth, w)
        plain.learn(dict(zip(at.tolist(), x.tolist())), softmax if outputs > 1 else logistic, truth.tolist())
    want = np.array([[plain.weight(i, k) for k in range(outputs)] for i in range(30)])
    assert np.allclose(fast.weights(slice(None)), want, atol=1e-12) and (want == 0).any()


def test_toxicity_model(spark):
    r = random.Random(5)
    texts = {i: " ".join(r.choice(["ok", "fine", "grub", "Snark!", "w1", "w2"]) for _ in range(r.randrange(12))) for i in range(120)}
    marks = {i: int("grub" in t) for i, t in texts.items()}
    twice = [(i, 1 - m) for i, m in list(marks.items())[:20]]  # contradicted: toxic if one label says so
    labels = spark.createDataFrame([*marks.items(), *twice], "doc_id long, toxic int").repartition(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rates = linear.Rates(alpha=0.4, l1=0.05, l2=0.2)
    got = {r.feature: r.weight for r in toxicity.train(docs, labels, epochs=2, rates=rates).collect()}
    said = {i: max(m, *(x for j, x in twice if j == i), 0) for i, m in marks.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    plain = PlainFtrl(1, rates)
    for _ in range(2):
        for i in by_hash(spark, said):
            features = {0: 1.0} | {int(f): 1.0 for f in toxicity.features([texts[i]])[1]}
            plain.learn(features, logistic, [said[i]])
    want = {i: w for (i, _), w in plain.table().items()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(list(want.items()), "feature int, weight double")).collect()}
    for i, t in texts.items():
        total = want.get(0, 0) + sum(want.get(int(f), 0) for f in set(toxicity.features([t])[1].tolist()))
        assert scores[i] == pytest.approx(logistic([total])[0], abs=1e-5)


def test_language_model(spark):
    r = random.Random(6)
    words = {"aa": ["haus", "und", "nicht"], "bb": ["maison", "et", "pas"], "cc": ["house", "and", "not"]}
    table = [(i, " ".join(r.choices(words[x], k=r.randrange(1, 9))), x) for i in range(90) for x in [r.choice(list(words))]]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
    rates = linear.Rates(alpha=0.5, l1=0.02, l2=0.05)
    model = language.train(docs, epochs=2, rates=rates)
    allowed = {i: (t, x) for i, t, x in table if zlib.crc32(str(i).encode()) % 4 != 2}
    grams = {i: dict(zip(*(v.tolist() for v in language.frequencies(t)))) for i, (t, _) in allowed.items()}
    seen = defaultdict(int)
    for g in grams.values():
        for i in g:
            seen[i] += 1
    idf = {i: math.log((1 + len(allowed)) / (1 + n)) + 1 for i, n in seen.items()}
    plain, order = PlainFtrl(3, rates), by_hash(spark, allowed)
    vectors = {}
    for i in order:
        x = {g: n * idf[g] for g, n in grams[i].items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        vectors[i] = {0: 1.0} | {g: v / length for g, v in x.items()}
    for _ in range(2):
        for place, i in enumerate(order):
            if place % language.CALIBRATION:
                plain.learn(vectors[i], softmax, [float(x == allowed[i][1]) for x in sorted(words)])
    want = plain.table()
    got = {(int(i), int(k)): model.weights[i, k] for i, k in zip(*np.nonzero(model.weights))}
    assert model.languages == sorted(words) and got.keys() == want.keys() and all(got[k] == pytest.approx(w, abs=1e-9) for k, w in want.items())

    def loss(t):
        p = [softmax([sum(plain.weight(g, k) * v for g, v in vectors[i].items()) / t for k in range(3)]) for i in order[::language.CALIBRATION]]
        return -sum(math.log(max(q[sorted(words).index(allowed[i][1])], 1e-12)) for q, i in zip(p, order[::language.CALIBRATION]))

    assert loss(model.t) <= min(loss(model.t * f) for f in (0.5, 0.8, 1.25, 2)) + 1e-9


def test_rare_languages_are_learned(spark, monkeypatch):
    """A language beyond the common sample still is one of the model's."""
    table = [(i, "the house and", "en") for i in range(300)] + [(1000 + i, "dům není můj", "cs") for i in range(6)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    assert language.train(docs, rows=5).languages == ["cs", "en"]


def test_texts_without_letters(spark):
    table = [(i, "the house and", "en") for i in range(20)] + [(50, "́̂ ̃", None), (51, "12 !?", None), (52, "́a", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.language_id(docs).collect()}
    assert (found[50], found[51], found[52]) == ("und", "und", "en")
    nobody = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in language.accepted(nobody, language.train(nobody), 0.3).collect()}
    assert kept == {*range(20), 52}


def test_long_texts_and_clashing_columns(spark):
    table = [(i, "der und nicht " * (1 if i else 60_000), "de", "c", "c", "c") for i in range(12)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, label string, features string, nth string")
    assert {r.lang_pred for r in language.language_id(docs).collect()} == {"de"}
    labels = spark.createDataFrame([(i, 1, "c", "c") for i in range(12)], "doc_id long, toxic int, label string, text string")
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {1}
