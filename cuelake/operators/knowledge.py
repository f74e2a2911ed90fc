"""The knowledge directory: topics, focuses and videos as one view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import base_name, parent_name
from cuelake.operators.catalog import machine_topics
from cuelake.operators.ordered import ordinal
from cuelake.operators.replies import regex_line, MARK

GLOSS_CHARS = 120  # fixed value: where a gloss is cut


def _marks(*marks: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*marks)), " · ")


def topic_rows(topics: DataFrame, components: DataFrame, term_info: DataFrame, gloss: DataFrame, cached: DataFrame) -> DataFrame:
    """Topics that nothing references, titled by their term, with badge and gloss.

    ``topics`` is (name, pattern), ``term_info`` (name, term, kind, gloss), ``gloss`` (title, lines) by
    people, which wins, ``cached`` (name) of finished dives.
    """
    shown = machine_topics(topics).join(components.select("name"), "name", "left_anti")
    info = term_info.select("name", "term", F.coalesce("kind", F.lit("")).alias("kind"),
                            F.coalesce(F.col("gloss"), F.lit("")).alias("proposal"))
    rows = shown.join(info, "name", "left").join(cached.select("name", F.lit(True).alias("cached")), "name", "left")
    rows = rows.withColumn("title", F.coalesce(F.when(F.col("term") != "", F.col("term")), "name"))
    human = gloss.groupBy("title").agg(F.min_by(F.struct(F.get("lines", F.lit(0)).alias("line")), "seq").alias("h"))
    rows = rows.join(human, "title", "left")
    badge = _marks(
        F.when(F.col("kind") != "", F.col("kind")), F.when(F.col("role") != "main", F.lit("generated")),
        F.when(F.coalesce("proposal", F.lit("")) != "", F.lit("proposed")),
        F.when(F.col("cached").isNull() & (F.col("role") != "index"), F.lit("pending")))
    text = F.left(F.coalesce(F.col("h.line"), "proposal", F.lit("")), F.lit(GLOSS_CHARS))
    return rows.select(F.lit("Topics").alias("group"), "title", "pattern", badge.alias("badge"), text.alias("gloss"), "name")


def focus_rows(focuses: DataFrame) -> DataFrame:
    """Harvested threads (id, text) titled by their pattern, numbered past the first of equal ones."""
    text = F.col("text")
    head = F.regexp_replace(F.regexp_replace(
        F.substring(F.substring_index(text, "\n", 1), F.lit(len(MARK) + 1), F.length(text)), r"^[ \t]+", ""), r"[\x00-\x20]+$", "")
    pattern = F.when(text.startswith(MARK), F.when(head != "", head)).otherwise(regex_line(text))
    rows = focuses.where(~text.startswith("NONE")).select("id", pattern.alias("pattern")).where("pattern is not null")
    numbered = ordinal(rows, ["pattern"], ["id"], "n", F.pmod(F.conv(F.substring("id", 1, 4), 16, 10).cast("bigint"), F.lit(1 << 16)))
    title = F.when(F.col("n") > 1, F.concat("pattern", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("pattern"))
    return numbered.select(F.lit("Focuses").alias("group"), title.alias("title"), "pattern", F.lit("").alias("badge"),
                           F.lit("").alias("gloss"), F.col("id").alias("name"))


def video_rows(videos: DataFrame, cached: DataFrame) -> DataFrame:
    """Videos (path, srt_id); equal base names carry their folder; without a summary they are pending."""
    bases = videos.groupBy(base_name(F.col("path")).alias("base")).agg(F.count("*").alias("n"))
    rows = videos.withColumn("base", base_name(F.col("path"))).join(bases, "base").join(
        cached.select("srt_id", F.lit(True).alias("cached")), "srt_id", "left")
    title = F.when(F.col("n") > 1, F.concat("base", F.lit(" — "), parent_name(F.col("path")))).otherwise(F.col("base"))
    return rows.select(F.lit("Videos").alias("group"), title.alias("title"), F.lit("").alias("pattern"),
                       F.when(F.col("cached"), F.lit("")).otherwise(F.lit("pending")).alias("badge"),
                       F.lit("").alias("gloss"), F.col("path").alias("name"))


def directory_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.lower("title"), "name")


def directory_filter(rows: DataFrame, typed: str, valid: bool = True) -> DataFrame:
    """Rows that the typed pattern hits anywhere, case folded; empty or invalid keeps all."""
    if not typed or not valid:
        return rows
    hit = reduce(lambda a, c: a | c, [F.col(x).rlike("(?i)" + typed) for x in ("title", "badge", "gloss", "pattern")])
    return rows.where(hit)
