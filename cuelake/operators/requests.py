"""Requests to a text model: bodies, assembled context, the injected call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import CLIP_BYTES, utf8_clip

# Our own instructions per kind of task.
INSTRUCTIONS = {
    "leaf": "Summarise this transcript in a few plain sentences.",
    "node": "Merge these summaries into one, keeping what they share first.",
    "dive": "Explain what the MATCHES say about the pattern; use the other sections as background only.",
    "focus": "Say what connects FIRST and SECOND, using only MATCHES as evidence; answer NONE if nothing does.",
    "probe": "Name the search that would connect both sides as one line REGEX: <pattern>, or answer NONE.",
    "terms": "List named terms as TERM, KIND, MEANS, GLOSS, SEEN and CUES lines, blocks apart by a blank line, or NONE.",
}
ASKED = 64  # requests that are strings at once
JOINT = "\n---\n"  # fixed value: between sections


def build_requests(tasks: DataFrame, max_tokens: int = 1024, temperature: float = 0.0) -> DataFrame:
    """Chat request JSON per (id, kind, body)."""
    system = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])[F.col("kind")]
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return tasks.withColumn("request", F.to_json(F.struct(
        F.lit(False).alias("stream"), F.lit(True).alias("cache_prompt"),
        F.array(message("system", system), message("user", F.col("body"))).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))))


def ask_model(requests: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """(id, text) by a caller-supplied function; its concurrency is the number of partitions.

    Requests become Python strings ``ASKED`` at a time, so that a worker holds one Arrow batch and little else.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                said = [None if r is None else answer(r) for r in part.column("request").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(said, pa.string())], names=["id", "text"])

    return requests.select("id", "request").mapInArrow(run, "id STRING, text STRING")


def head_lines(tasks: DataFrame) -> DataFrame:
    """Artifact texts with their pattern line in front: dives and focuses that carry a note."""
    prefix = F.when(F.col("kind") == "dive", F.lit("PATTERN ")).when(F.col("kind") == "focus", F.lit("REGEX: "))
    noted = prefix.isNotNull() & (F.coalesce("note", F.lit("")) != "")
    return tasks.withColumn("text", F.when(noted, F.concat(prefix, "note", F.lit("\n\n"), "text")).otherwise(F.col("text")))


def _ordered(rows: DataFrame, joint: str) -> DataFrame:
    """(id, ord, text) to one text per id; a task's list of inputs is bounded by its excerpt."""
    return rows.groupBy("id").agg(F.count("text").alias("n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), joint).alias("text"))


def _section(before: Column, section: Column) -> Column:
    return F.when(section == "", before).when(before == "", section).otherwise(F.concat(before, F.lit(JOINT), section))


def _behind(background: Column, matches: Column, limit: int) -> Column:
    """Matches claim the window first; background is clipped to the rest, less the joint."""
    room = F.greatest(F.lit(limit) - F.octet_length(matches) - len(JOINT), F.lit(0))
    return utf8_clip(_section(utf8_clip(background, room), matches), limit)


def assemble_context(tasks: DataFrame, deps: DataFrame, refs: DataFrame, texts: DataFrame, excerpts: DataFrame,
                     limit: int = CLIP_BYTES) -> DataFrame:
    """Dive requests (id, body): OVERVIEW (optional), SUMMARIES (all or the task waits), MATCHES (required).

    ``deps`` and ``refs`` are (id, ord, dep), ``texts`` is (dep, text), ``excerpts`` (id, excerpt).
    """
    wanted = deps.groupBy("id").agg(F.count("*").alias("wanted"))
    sums = _ordered(deps.join(texts, "dep").select("id", "ord", "text"), "\n\n").join(wanted, "id").where("n = wanted")
    over = _ordered(refs.join(texts, "dep").select("id", "ord", "text"), "\n\n").select("id", F.col("text").alias("over"))
    joined = (tasks.select("id").join(excerpts.where("excerpt <> ''"), "id").join(wanted.select("id", "wanted"), "id", "left")
              .join(sums.select("id", F.col("text").alias("sums")), "id", "left").join(over, "id", "left"))
    ready = joined.where(F.col("wanted").isNull() | F.col("sums").isNotNull())
    titled = lambda title, c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(title), c))
    background = _section(titled("OVERVIEW\n", F.col("over")), titled("SUMMARIES\n", F.col("sums")))
    return ready.select("id", _behind(background, F.concat(F.lit("MATCHES\n"), "excerpt"), limit).alias("body"))


def assemble_pair(pairs: DataFrame, texts: DataFrame, snapshots: DataFrame, kind: str, limit: int = CLIP_BYTES) -> DataFrame:
    """Pair requests: FIRST and SECOND whole, then the snapshot (for a focus as MATCHES, which go first in claim).

    ``pairs`` is (id, first, second), ``texts`` (dep, text), ``snapshots`` (id, snapshot).
    """
    side = lambda name: texts.select(F.col("dep").alias(name), F.col("text").alias(f"{name}_text"))
    joined = pairs.join(side("first"), "first").join(side("second"), "second").join(
        snapshots, "id", "left" if kind == "probe" else "inner")
    pair = F.concat(F.lit("FIRST\n"), "first_text", F.lit(JOINT + "SECOND\n"), "second_text")
    if kind == "probe":
        return joined.select("id", utf8_clip(_section(pair, F.coalesce("snapshot", F.lit(""))), limit).alias("body"))
    return joined.where("snapshot <> ''").select("id", _behind(pair, F.concat(F.lit("MATCHES\n"), "snapshot"), limit).alias("body"))


def assemble_node(deps: DataFrame, texts: DataFrame, limit: int = CLIP_BYTES) -> DataFrame:
    """Node requests: the children's texts in order; a node with a missing child waits."""
    wanted = deps.groupBy("id").agg(F.count("*").alias("wanted"))
    whole = _ordered(deps.join(texts, "dep").select("id", "ord", "text"), JOINT).join(wanted, "id").where("n = wanted")
    return whole.select("id", utf8_clip(F.col("text"), limit).alias("body"))
