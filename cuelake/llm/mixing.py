"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import bare, n_words, stored

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
MOST_COPIES = 3
BINS = 1 << 10  # of the sampling rank, and again of the bin that holds a source's limit; only what is left then is put in order
FEW_SOURCES = 10_000  # targets of so many sources at most (under 1 MB) are broadcast; more are joined by shuffle


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code-point order, null last, take turns at the weights and share the sum of all sizes.  A target
    ends at ``cap`` times the size of its source and what is over is shared anew.  The end of that sharing is a water
    level: ``target = min(cap * size, weight * level)``.  With the sources in the order in which they reach their cap,
    the level is that of the first one that does not.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    per = (per.withColumn("weight", F.get(choice, F.pmod(turn, F.lit(len(weights)))))
           .withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
           .withColumn("fills_at", F.col("most") / F.col("weight")))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    whole = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    full_before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - full_before) / (F.sum("weight").over(whole) - weight_before))
    per = per.withColumn("level", F.first(F.when(F.col("fills_at") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole))
    return per.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone, from 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _limit(rows: DataFrame, part: str, before: Column) -> DataFrame:
    """Per source the part in which the running sum of sizes reaches ``lack``, and the sum before that part."""
    sums = rows.groupBy("source", part).agg(F.sum("size").alias("words"), F.first("lack").alias("lack"), F.first(before).alias("start"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(part)) + F.col("start")
    reached = sums.withColumn("upto", upto).where("upto >= lack").groupBy("source").agg(
        F.min(F.struct(F.col(part).alias("part"), (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
    return reached.select(F.col("source").alias("__source"), F.col("at.part").alias(f"limit_{part}"), F.col("at.before").alias(f"before_{part}"))


def _sized(docs: DataFrame, **more: Column) -> DataFrame:
    """``doc_id, source, size, text_key`` and what else is asked for, a row per document."""
    return bare(docs, doc_id="doc_id", source=F.col("source").cast("string"), size=n_words(F.col("text")),
                text_key=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), **more)


def _counter(sizes: DataFrame, weights: Sequence[float], cap: int, bins: int) -> Callable[[DataFrame], DataFrame]:
    """From the stored sizes of all documents: what adds ``source_size, target, copies`` to rows of ``_sized``, row by row."""
    goal = stored(targets(sizes, weights, cap), "targets")
    small = F.broadcast if goal.count() <= FEW_SOURCES else (lambda df: df)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = (goal.withColumnRenamed("source", "__source").withColumn("whole", F.floor(rate).cast("bigint"))
            .withColumn("chance", rate - F.col("whole"))
            .withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size")))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_key").cast("string"))))
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))

    def ranked(rows: DataFrame) -> DataFrame:
        return (rows.join(small(goal), _same("source", "__source")).drop("__source")
                .withColumn("rank", F.when(F.col("chance") > 0, odds / (1 + odds)))
                .withColumn("spot", F.least(F.floor(F.col("rank") * bins * bins), F.lit(bins * bins - 1)).cast("int"))
                .withColumn("bin", F.floor(F.col("spot") / bins).cast("int")).withColumn("fine", F.col("spot") % bins))

    def with_bin(rows: DataFrame) -> DataFrame:
        return rows.join(small(coarse), _same("source", "__source"), "left").drop("__source")

    coarse = _limit(ranked(sizes).where("chance > 0"), "bin", F.lit(0))
    fine = _limit(with_bin(ranked(sizes)).where("chance > 0 and bin = limit_bin"), "fine", F.col("before_bin"))

    def counted(rows: DataFrame) -> DataFrame:
        limited = with_bin(ranked(rows)).join(small(fine), _same("source", "__source"), "left").drop("__source")
        at_limit = "bin <=> limit_bin and fine <=> limit_fine"
        before = F.col("limit_bin").isNull() | (F.col("bin") < F.col("limit_bin")) | (
            (F.col("bin") == F.col("limit_bin")) & (F.col("fine") < F.coalesce("limit_fine", F.lit(bins))))
        clear = limited.where(f"chance <= 0 or not ({at_limit})").withColumn("more", F.when((F.col("chance") > 0) & before, 1).otherwise(0))
        order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
        edge = limited.where(f"chance > 0 and {at_limit}").withColumn(
            "more", F.when(F.col("before_fine") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("lack"), 1).otherwise(0))
        return clear.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("more")).cast("bigint"))

    return counted


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MOST_COPIES, bins: int = BINS) -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source_size, target, taken, copies``.

    A source is to appear ``target / source_size`` times.  The whole part of that is allocated to each of its
    documents for certain; the rest is the documents' chance of one copy more.  They are ranked by random odds
    divided by the odds of inclusion (Pareto order sampling), and the sample is the head of that order whose
    sizes come nearest to what the target still lacks.  The random number depends on ``doc_id`` alone, or on the
    text of a document without id.

    The order is found without putting a source into one task: sizes are summed by bins of the rank, then by
    the parts of the bin in which a source reaches its limit, and only the part with the limit is sorted.

    A null text has size 0; null sources are one source.  Rows that repeat a ``doc_id`` are separate documents
    with the same rank, taken in turn.  An empty table gives no rows.
    """
    sizes = stored(_sized(docs), "sizes")
    return _counter(sizes, weights, cap, bins)(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MOST_COPIES, bins: int = BINS) -> DataFrame:
    """The mix itself: every column of the documents, each row as often as ``mix`` takes it.

    The rows carry their columns through the count, so rows that share an id, or have none, are not looked up again.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    counted = _counter(stored(_sized(docs), "sizes"), weights, cap, bins)(_sized(docs, row=row)).where("copies > 0")
    return (counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
