"""Hard negatives: rows of another label that come close to an anchor, but not as close as its positives.

Scores are integer inner products.  A vector is cut into segments; of each segment the mean and the deviation are kept.
For two vectors the products of the means are known, and what is missing lies between plus and minus the product of the
deviations (Cauchy-Schwarz), so a few numbers bound a score from both sides.  Bounds are taken for a whole chunk of rows
first, then from few segments, then from more; only rows that still may matter to some anchor are scored exactly.

Anchors and rows meet in a grid: anchors are dealt into groups of bounded size, rows into others, and each cell of the
grid is one task's work: rows x groups of anchors and groups of anchors x groups of rows are what is shuffled.  Cells
are dealt by a hash of the row, so neither a frequent label nor thousands of copies of a vector make one larger.
A cell returns an anchor's few best rows, and these are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, stored

SCALE = 256
EVERY, SHIFTED, LABELS = 50, 7, 10  # ids that are anchors; ids whose label moves on; number of labels
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score

GROUP_ANCHORS, GROUP_ROWS, LEAST_ROWS = 1 << 16, 1 << 16, 1 << 11
CHUNK_ANCHORS, CHUNK_ROWS = 512, 4096
LEVELS = (4, 16)  # segments of a vector
_LAST = (1 << 63) - 1  # the place of a row without id among equal scores
_EXACT = float(1 << 53)  # whole numbers below it are exact as doubles
_LARGEST = 1 << 55  # of dimension times squared component; scores and their multiples fit in 64 bits then


def prepared(rows: DataFrame) -> DataFrame:
    """``u, vec_id, place, label, v, dim`` of the rows that take part; ``v`` is the vector in whole numbers."""
    component = F.col("embedding")
    whole = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = bare(rows, vec_id=F.col("vec_id").cast("bigint"), label=F.col("label").cast("bigint"),
                embedding=F.col("embedding").cast("array<double>")).where("label is not null and embedding is not null").where(whole)
    moved = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x))
    largest = F.coalesce(F.array_max(F.transform("embedding", lambda x: F.abs(SCALE * x) + 1)), F.lit(0.0))
    fits = F.size("embedding") * largest * largest < float(_LARGEST)
    return held.where(fits).select(
        F.monotonically_increasing_id().alias("u"), "vec_id", F.coalesce("vec_id", F.lit(_LAST)).alias("place"), moved.alias("label"),
        scaled.cast("array<int>").alias("v"), F.size("embedding").alias("dim"))


@dataclass
class _Rows:
    """Some vectors of one dimension with the summaries of their segments."""

    u: np.ndarray
    place: np.ndarray
    label: np.ndarray
    v: np.ndarray  # rows x dimension, int64

    def __post_init__(self) -> None:
        dim = self.v.shape[1]
        self.dense = self.v.astype(np.float64)
        self.most = int(np.abs(self.v).max(initial=0))
        self.levels = []
        for n in LEVELS:
            if not 0 < n <= dim:
                continue
            begins = np.arange(n) * dim // n
            sizes = np.diff(np.append(begins, dim)).astype(np.float64)
            sums = np.add.reduceat(self.dense, begins, axis=1)
            squares = np.add.reduceat(self.dense * self.dense, begins, axis=1)
            # Scaled so that plain products of summaries are the terms of the bound.
            self.levels.append((sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums * sums / sizes, 0))))

    def take(self, at: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        out.u, out.place, out.label, out.v, out.dense, out.most = self.u[at], self.place[at], self.label[at], self.v[at], self.dense[at], self.most
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out

    def arranged(self) -> _Rows:
        """By label, and within it rows whose segment means have the same signs next to one another."""
        signs = (self.levels[0][0] > 0) @ (1 << np.arange(self.levels[0][0].shape[1])) if self.levels else np.zeros(len(self.u), np.int64)
        return self.take(np.lexsort((self.u, signs, self.label)))


def _rows(table: pa.Table, dim: int) -> _Rows:
    table = table.combine_chunks()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dim)
    u, place, label = (table.column(c).to_numpy() for c in ("u", "place", "label"))
    return _Rows(u, place, label, v)


def _slack(a: _Rows, b: _Rows) -> float:
    return 1 + 1e-9 * a.v.shape[1] * a.most * b.most


def _chunk_may_reach(a: _Rows, b: _Rows, low: np.ndarray) -> np.ndarray:
    """Which anchors some row of ``b`` may reach ``low`` with, from the extremes of the rows' summaries."""
    if not a.levels:
        return np.ones(len(a.u), dtype=bool)
    (mean, dev), (means, devs) = a.levels[0], b.levels[0]
    above = np.maximum(mean * means.max(axis=0), mean * means.min(axis=0)).sum(axis=1) + dev @ devs.max(axis=0)
    return above + _slack(a, b) >= low


def _scores(a: _Rows, b: _Rows) -> np.ndarray:
    exact = a.v.shape[1] * a.most * b.most < _EXACT
    return (a.dense @ b.dense.T).astype(np.int64) if exact else a.v @ b.v.T


def _surviving(a: _Rows, b: _Rows, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and rows that remain: every pair outside has a score outside [low, high] of its anchor."""
    left = np.flatnonzero(_chunk_may_reach(a, b, low))
    right = np.arange(len(b.u))
    for level in range(len(a.levels)):
        if not len(left) or not len(right):
            break
        mean, dev = (x[left] for x in a.levels[level])
        means, devs = (x[right] for x in b.levels[level])
        mid, radius = mean @ means.T, dev @ devs.T + _slack(a, b)
        may = (mid + radius >= low[left, None]) & (mid - radius <= high[left, None])
        left, right = left[may.any(axis=1)], right[may.any(axis=0)]
    return left, right


_NONE = np.iinfo(np.int64).min


def _best(scores: np.ndarray, b: _Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, best first; equal scores by place.  ``_NONE`` never counts."""
    least = np.full(len(scores), _NONE + 1)
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    row, col = np.nonzero(scores >= least[:, None])
    return _first(row, scores[row, col], b.place[col], b.u[col], k, col)


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, u: np.ndarray, k: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((u, place, -score, group))
    group = group[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    rank = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    return group[rank < k], value[order][rank < k]


def _chunks(n: int, size: int):
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _positives(anchors: _Rows, rows: _Rows, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, score, place, u) of the k best rows of the anchors' labels in this cell, and perhaps a few more."""
    out = []
    rows = rows.arranged()
    for label in np.unique(anchors.label):
        own = rows.take(np.flatnonzero(rows.label == label))
        mine = np.flatnonzero(anchors.label == label)
        for part in _chunks(len(mine), CHUNK_ANCHORS):
            at = mine[part]
            a = anchors.take(at)
            low = np.full(len(at), -np.inf)
            for piece in _chunks(len(own.u), CHUNK_ROWS):
                b = own.take(np.arange(len(own.u))[piece])
                left, right = _surviving(a, b, low, np.full(len(at), np.inf))
                if not len(left) or not len(right):
                    continue
                x, y = a.take(left), b.take(right)
                scores = _scores(x, y)
                scores[x.u[:, None] == y.u[None, :]] = _NONE
                row, col = _best(scores, y, k)
                found = scores[row, col]
                out.append((at[left][row], found, y.place[col], y.u[col]))
                full = np.bincount(row, minlength=len(left)) == k
                worst = np.full(len(left), np.iinfo(np.int64).max)
                np.minimum.at(worst, row, found)
                low[left[full]] = np.maximum(low[left[full]], worst[full])
    return out


def _negatives(anchors: _Rows, rows: _Rows, scores_of: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, positive, score, place, u): per positive (a column of ``scores_of``) the k best rows within its band."""
    out = []
    rows = rows.arranged()
    floor = np.where(scores_of != _NONE, -(-LOW * scores_of // 100), np.iinfo(np.int64).max)
    roof = np.where(scores_of != _NONE, HIGH * scores_of // 100, _NONE)
    floor = np.where(floor > roof, np.iinfo(np.int64).max, floor)
    for label in np.unique(anchors.label):
        other = rows.take(np.flatnonzero(rows.label != label))
        mine = np.flatnonzero((anchors.label == label) & (floor <= roof).any(axis=1))
        for part in _chunks(len(mine), CHUNK_ANCHORS):
            at = mine[part]
            a, low, high = anchors.take(at), floor[at].copy(), roof[at]
            for piece in _chunks(len(other.u), CHUNK_ROWS):
                b = other.take(np.arange(len(other.u))[piece])
                left, right = _surviving(a, b, low.min(axis=1).astype(np.float64), high.max(axis=1).astype(np.float64))
                if not len(left) or not len(right):
                    continue
                x, y = a.take(left), b.take(right)
                scores = _scores(x, y)
                for p in range(scores_of.shape[1]):
                    inside = (scores >= low[left, p][:, None]) & (scores <= high[left, p][:, None])
                    some = np.flatnonzero(inside.any(axis=1))
                    if not len(some):
                        continue
                    row, col = _best(np.where(inside[some], scores[some], _NONE), y, k)
                    row = some[row]
                    found = scores[row, col]
                    out.append((at[left][row], np.full(len(row), p), found, y.place[col], y.u[col]))
                    full = np.bincount(row, minlength=len(left)) == k
                    worst = np.full(len(left), np.iinfo(np.int64).max)
                    np.minimum.at(worst, row, found)
                    low[left[full], p] = np.maximum(low[left[full], p], worst[full])
    return out


def _lists(anchors: _Rows, found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    """One row per anchor: its finds as a list of structs."""
    if not found:
        return _no_finds(names)
    anchor, *columns = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(anchor, kind="stable")
    counts = np.bincount(anchor, minlength=len(anchors.u))
    some = np.flatnonzero(counts)
    offsets = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(c[order].astype(np.int64)) for c in columns], names=names)
    return pa.table({"anchor": pa.array(anchors.u[some]), "found": pa.ListArray.from_arrays(pa.array(offsets), struct)})


def _no_finds(names: list[str]) -> pa.Table:
    return pa.table({"anchor": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([(n, pa.int64()) for n in names])))})


def _grid(rows: DataFrame, anchors: DataFrame) -> tuple[int, int]:
    """How many groups of anchors and of rows."""
    n, m = rows.count(), anchors.count()
    cells = -(-n // GROUP_ROWS)
    busy = min(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    return max(1, -(-m // GROUP_ANCHORS)), max(1, cells, busy)


def _dealt(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def _meet(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], work, names: list[str]) -> DataFrame:
    """``anchor, found`` of every cell; ``work`` is given the anchors' table and the two sides as arrays."""
    over, along = grid
    held = [c for c in anchors.columns if c != "dim"]
    left = (anchors.groupBy("dim", _dealt("u", over).alias("over")).agg(F.collect_list(F.struct(*held)).alias("held"))  # of bounded size: see _grid
            .withColumn("along", F.explode(F.sequence(F.lit(0), F.lit(along - 1)))))
    right = rows.select("dim", "u", "place", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias("over"), _dealt("u", along).alias("along"))
    right = right.toDF(*right.columns)  # both sides come from one table; the columns of a cogroup must differ
    keys = ["dim", "over", "along"]

    def cell(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return _no_finds(names)
        dim = one.column("dim")[0].as_py()
        table = pa.Table.from_struct_array(one.column("held").combine_chunks().flatten())
        a = _rows(table, dim)
        return _lists(a, work(table, a, _rows(other, dim)), names)

    schema = f"anchor bigint, found array<struct<{', '.join(f'{n}:bigint' for n in names)}>>"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def _merged(found: DataFrame, out: str) -> DataFrame:
    return found.groupBy("anchor").agg(F.flatten(F.collect_list("found")).alias(out))


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by 50; positives their best other rows of the same label, and the
    negatives of a positive the best rows of other labels whose score lies between 50 and 95 per cent of the positive's
    (a negative score of the positive leaves none).  Higher scores come first, equal ones by smaller ``vec_id``, rows
    without id last.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do vectors whose scores
    would not fit in 64 bits (components of about 700,000 at 64 dimensions).  Vectors of different length are never
    compared.  Repeated rows are rows of their own: each is an anchor, and one is the other's positive.  An empty table,
    and an anchor without positives, gives no rows.
    """
    held = stored(prepared(rows), "vectors")
    anchors = held.where(F.col("vec_id") % EVERY == 0)
    grid = _grid(held, anchors)
    names = ["score", "place", "u"]
    best = _meet(anchors.select("dim", "u", "place", "label", "v"), held, grid, lambda _, a, b: _positives(a, b, positives), names)
    order = F.transform("all", lambda x: F.struct((-x["score"]).alias("behind"), x["place"].alias("place"), x["u"].alias("u")))
    chosen = stored(_merged(best, "all").select("anchor", F.slice(F.array_sort(order), 1, positives).alias("positives")), "positives")

    def within(table: pa.Table, a: _Rows, b: _Rows) -> list[tuple[np.ndarray, ...]]:
        lists = table.column("positives").combine_chunks()
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        scores = np.full((len(a.u), positives), _NONE)
        row = np.repeat(np.arange(len(counts)), counts)
        scores[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = -pa.compute.struct_field(lists.flatten(), "behind").to_numpy()
        return _negatives(a, b, scores, negatives)

    with_positives = anchors.join(chosen, F.col("u") == F.col("anchor")).select("dim", "u", "vec_id", "place", "label", "v", "positives")
    near = _merged(_meet(with_positives.select("dim", "u", "place", "label", "v", "positives"), held, grid, within, ["positive", *names]), "all")

    def named(place: Column) -> Column:
        return F.when(place != _LAST, place)

    own = F.filter("all", lambda x: x["positive"] == F.col("p").cast("bigint"))
    own = F.transform(own, lambda x: F.struct((-x["score"]).alias("behind"), x["place"].alias("place"), x["u"].alias("u")))
    return (with_positives.join(near, F.col("u") == F.col("anchor"))
            .select("vec_id", "all", F.posexplode("positives").alias("p", "positive"))
            .select("vec_id", "positive", F.posexplode(F.slice(F.array_sort(own), 1, negatives)).alias("i", "negative"))
            .select(F.col("vec_id").alias("anchor_id"), named(F.col("positive.place")).alias("positive_id"), (F.col("i") + 1).alias("rank"),
                    named(F.col("negative.place")).alias("negative_id"), (-F.col("positive.behind")).alias("positive_score"),
                    (-F.col("negative.behind")).alias("negative_score")))
