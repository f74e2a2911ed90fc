"""Follow-the-regularised-leader for linear models over hashed sparse features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import stored


@dataclass(frozen=True)
class Rates:
    """Per-coordinate step ``alpha / (beta + sqrt(sum of squared gradients))``, with an elastic net."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0


class Ftrl:
    """FTRL-proximal over ``dims`` features and ``outputs`` columns; feature 0 is the bias and is not shrunk to zero.

    The weights are a function of the state: zero while the summed gradient stays within the L1 bound, so that rare
    and useless features never enter the model.
    """

    def __init__(self, dims: int, outputs: int, rates: Rates):
        self.z, self.n, self.rates = np.zeros((dims, outputs)), np.zeros((dims, outputs)), rates

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, r = self.z[at], self.n[at], self.rates
        bound = np.full((len(z), 1), r.l1)
        if isinstance(at, slice):
            bound[0] = 0
        else:
            bound[at == 0] = 0
        over = np.maximum(np.abs(z) - bound, 0)
        return -np.sign(z) * over / ((r.beta + np.sqrt(n)) / r.alpha + r.l2)

    def step(self, at: np.ndarray, x: np.ndarray, error: np.ndarray, w: np.ndarray) -> None:
        """One example with features ``at`` (distinct) of values ``x``; ``error`` is prediction minus truth per output."""
        g = x[:, None] * error[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.rates.alpha * w
        self.n[at] = grown


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bounded_sample(rows: DataFrame, columns: Sequence[Column], most: int, label: str) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``doc_id``: the same ones in every run, whatever their order."""
    keyed = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), *columns)
    return stored(keyed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), label)
