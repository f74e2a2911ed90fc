"""Ordered operators that stay parallel when one key holds most of the rows.

A plain ``partitionBy(key)`` window puts a whole key into one task.  The helpers here cut every
key into blocks of its order column, work inside (key, block) and carry one summary row per block
across the key, so a task sees at most one block of rows plus the summaries.

Blocks are runs of a dense order column (``block_of``), or, where the order is of any kind, ranges of about equal
numbers of rows (``RANGES``), however the rows are spread over keys and times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.session import cut

# Rows per block of a dense order column (cue numbers, playlist positions), and per range.
BLOCK = 1 << 16
RANGES = "ranges"

_BLK = "__blk"
Blocks = Column | str | None  # a block number, RANGES, or blocks of the first order column


def block_of(order: str, width: int = BLOCK) -> Column:
    return F.expr(f"cast(floor({order} / {width}) as bigint)")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK, out: str = _BLK) -> DataFrame:
    """``df`` with the number of its range in (keys, order); ranges hold about ``rows`` rows each, and follow one another.

    The bounds are sampled by Spark's range partitioning; the result is written, so that every reader sees the same ranges.
    """
    n = -(-df.count() // rows)
    if n <= 1:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(out, F.spark_partition_id().cast("bigint")))


def _blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Blocks) -> DataFrame:
    if isinstance(block, str):
        return ranged(df, keys, order)
    return df.withColumn(_BLK, block if block is not None else block_of(order[0]))


def _within(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, _BLK).orderBy(*order)


def _across(keys: Sequence[str]):
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(_BLK)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, out: str,
                block: Blocks = None) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``."""
    value = F.col(value) if isinstance(value, str) else value
    blocked = _blocked(df, keys, order, block).withColumn("__v", value)
    sums = blocked.groupBy(*keys, _BLK).agg(F.sum("__v").alias("__s"))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, _BLK, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inner = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        blocked.join(base, [*keys, _BLK])
        .withColumn(out, (F.sum("__v").over(inner) + F.col("__base")))
        .drop(_BLK, "__v", "__base")
    )


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
            block: Blocks = None) -> DataFrame:
    """1-based position per key (over everything when ``keys`` is empty)."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, block)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
               nxt: str | None = None, prev: str | None = None, first: str | None = None,
               last: str | None = None, block: Blocks = None) -> DataFrame:
    """The next, previous, first and last ``value`` of each row's key."""
    blocked = _blocked(df, keys, order, block).withColumn("__v", F.struct(value.alias("v")))
    at = F.struct(*order)
    edges = blocked.groupBy(*keys, _BLK).agg(
        F.min_by("__v", at).alias("__head"), F.max_by("__v", at).alias("__tail"))
    across = _across(keys)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        *keys, _BLK,
        F.lead("__head").over(across).alias("__after"), F.lag("__tail").over(across).alias("__before"),
        F.first("__head").over(whole).alias("__first"), F.last("__tail").over(whole).alias("__last"))
    inner = _within(keys, order)
    joined = blocked.join(edges, [*keys, _BLK])
    if nxt:
        joined = joined.withColumn(nxt, F.coalesce(F.lead("__v").over(inner), F.col("__after"))["v"])
    if prev:
        joined = joined.withColumn(prev, F.coalesce(F.lag("__v").over(inner), F.col("__before"))["v"])
    if first:
        joined = joined.withColumn(first, F.col("__first")["v"])
    if last:
        joined = joined.withColumn(last, F.col("__last")["v"])
    return joined.drop(_BLK, "__v", "__after", "__before", "__first", "__last")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str],
                  block: Blocks) -> DataFrame:
    """Latest non-null value of each column up to and including the row: ``{source: output}``."""
    blocked = _blocked(df, keys, order, block)
    at = F.struct(*order)
    last = blocked.groupBy(*keys, _BLK).agg(*[
        F.max_by(src, F.when(F.col(src).isNotNull(), at)).alias(f"__l_{out}") for src, out in columns.items()])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, _BLK, *[
        F.last(f"__l_{out}", ignorenulls=True).over(before).alias(f"__c_{out}") for out in columns.values()])
    inner = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.join(carried, [*keys, _BLK])
    for src, out in columns.items():
        joined = joined.withColumn(
            out, F.coalesce(F.last(src, ignorenulls=True).over(inner), F.col(f"__c_{out}")))
    return joined.drop(_BLK, *[f"__c_{out}" for out in columns.values()])


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object],
                step: Callable[[object, dict[str, np.ndarray]], tuple[object, list[tuple]]], schema: str) -> DataFrame:
    """Fold each key's rows in order with constant memory.

    For folds whose every step needs the state of the row before (resetting or skipping sums).  Rows
    are hash-partitioned by key and sorted by Spark (the sort spills), then stream through in Arrow
    batches; only the running state is held, never the group.  Feed it ids and numbers, not texts.

    ``step`` takes the state and a run of the key's rows as arrays, and returns the new state and
    output rows; the key columns lead the schema and are filled in here.
    """
    keys, order = list(keys), list(order)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            changed = np.zeros(len(batch), dtype=bool)
            changed[0] = True
            for k in keys:
                changed[1:] |= columns[k][1:] != columns[k][:-1]
            bounds = [*np.flatnonzero(changed).tolist(), len(batch)]
            rows = []
            for lo, hi in zip(bounds, bounds[1:]):
                key = tuple(columns[k][lo] for k in keys)
                if key != current:
                    current, state = key, start()
                state, out = step(state, {c: v[lo:hi] for c, v in columns.items()})
                rows += [key + row for row in out]
            yield pd.DataFrame(rows, columns=names)

    arranged = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return arranged.mapInPandas(run, schema)


# Bucket widths of the interval lookup: each tier is 64 times wider than the one below.
_TIER_BITS = [16, 22, 28, 34, 40, 46, 52]


def _tier_of(length: Column) -> Column:
    """The narrowest tier in which an interval touches at most 65 buckets."""
    tier = F.lit(len(_TIER_BITS) - 1)
    for i in reversed(range(len(_TIER_BITS) - 1)):
        tier = F.when(length <= F.lit(64 << _TIER_BITS[i]), F.lit(i)).otherwise(tier)
    return tier


def _widths() -> Column:
    return F.array(*[F.lit(1 << b).cast("bigint") for b in _TIER_BITS])


def interval_lookup(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str,
                    lo: str, hi: str, how: str = "left") -> DataFrame:
    """Join each point with the interval [lo, hi) of its key that holds it.

    Both sides meet on (key, fine bucket).  Intervals up to 64 buckets long are filed under each
    bucket they touch.  Longer ones are filed only under buckets that hold points: occupied buckets
    and long intervals meet on a wider tier, so one junk interval of a thousand hours costs a few
    rows.  Nothing is compared all against all, and AQE may split a hot (key, bucket).
    """
    length = F.col(hi) - F.col(lo)
    tier, widths = _tier_of(length), _widths()

    def bucket(col: Column, tier_col: Column) -> Column:
        return F.floor(col / F.get(widths, tier_col)).cast("bigint")

    zero = F.lit(0)
    payload = [c for c in intervals.columns if c not in keys]
    tiered = (intervals.where(length > 0).withColumn("__tier", tier)
              .withColumn("__b", F.explode(F.sequence(
                  bucket(F.col(lo), F.col("__tier")), bucket(F.col(hi) - 1, F.col("__tier"))))))
    fine = tiered.where("__tier = 0").select(*keys, "__b", *payload)
    long = tiered.where("__tier > 0")
    occupied = (
        points.select(*keys, bucket(F.col(point), zero).alias("__fine")).distinct()
        .withColumn("__tier", F.explode(F.array(*[F.lit(i) for i in range(1, len(_TIER_BITS))])))
        .withColumn("__b", bucket(F.col("__fine") * F.lit(1 << _TIER_BITS[0]), F.col("__tier")))
    )
    width = F.lit(1 << _TIER_BITS[0])
    wide = (
        occupied.join(long, [*keys, "__tier", "__b"])
        .where((F.col("__fine") * width < F.col(hi)) & ((F.col("__fine") + 1) * width > F.col(lo)))
        .select(*keys, F.col("__fine").alias("__b"), *payload)
    )
    renamed = {k: f"__k_{k}" for k in keys}
    filed = fine.unionByName(wide).withColumnRenamed("__b", "__kb").withColumnsRenamed(renamed)
    cond = F.col("__pb") == F.col("__kb")
    for k in keys:
        cond = cond & (F.col(k) == F.col(renamed[k]))
    cond = cond & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    return (points.withColumn("__pb", bucket(F.col(point), zero))
            .join(filed, cond, how).drop("__pb", "__kb", *renamed.values()))


def file_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, lo: str, hi: str) -> DataFrame:
    """Stream-static variant of :func:`interval_lookup`: a left join per tier in use.

    A stream cannot be asked which buckets it fills, so the points look into every tier that the
    static side uses (one for ordinary cues, at most seven) and the caller keeps the tier that hit.
    """
    length = F.col(hi) - F.col(lo)
    tier, widths = _tier_of(length), _widths()
    tiered = intervals.where(length > 0).withColumn("__tier", tier)
    in_use = sorted(r[0] for r in tiered.select("__tier").distinct().collect()) or [0]  # at most seven numbers
    width = F.get(widths, F.col("__tier"))
    filed = tiered.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col(lo) / width).cast("bigint"), F.floor((F.col(hi) - 1) / width).cast("bigint"))))
    looked = points.withColumn("__tier", F.explode(F.array(*[F.lit(t) for t in in_use]))).withColumn(
        "__b", F.floor(F.col(point) / width).cast("bigint"))
    on = [*keys, "__tier", "__b"]
    held = filed.withColumnsRenamed({c: f"__k_{c}" for c in on})
    cond = (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__k_{c}"))
    return looked.join(held, cond, "left").drop("__tier", "__b", *[f"__k_{c}" for c in on], lo, hi)
