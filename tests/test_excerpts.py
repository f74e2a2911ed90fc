"""Excerpt budgets: the pruned fold against the plain walk, and how little of a crowded topic it reads."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import chunking


def walk(hits, videos, budget):
    out = []
    for topic in sorted({t for t, *_ in hits}):
        used, quoted = 0, set()
        for video, seq, srt, name in sorted(videos, key=lambda v: v[1]):
            lines = [len(line.encode()) + 1 for t, v, _, line in sorted(hits) if (t, v) == (topic, video)]
            head = len(f"== {name}\n".encode())
            if not lines or used >= budget or srt in quoted or head >= budget - used:
                continue
            n, size = 0, head
            while n < len(lines) and size + lines[n] <= budget - used:
                size += lines[n]
                n += 1
            if n:
                used += size
                quoted.add(srt)
                out.append((topic, seq, video, srt, n, size))
    return sorted(out)


def case(seed, n):
    r = random.Random(seed)
    videos = [(i, i * 7 % n, f"s{r.randrange(n)}", "n" * r.randrange(1, 12)) for i in range(n)]
    hits = [(t, v, c, "x" * r.randrange(0, r.choice([3, 40]))) for t in ("a", "b") for v in range(n) if r.random() < 0.7 for c in range(r.randrange(1, 4))]
    return hits, videos


@pytest.mark.parametrize(("seed", "n", "budget"), [(1, 60, 200), (2, 120, 37), (3, 120, 12), (4, 40, 5000)])
def test_against_walk(spark, seed, n, budget):
    hits, videos = case(seed, n)
    got = chunking.excerpt_sections(spark.createDataFrame(hits, "topic STRING, video_id BIGINT, cue_no INT, line STRING").repartition(3),
                                    spark.createDataFrame(videos, "video_id BIGINT, seq BIGINT, srt_id STRING, file_name STRING"), budget)
    assert sorted(tuple(r) for r in got.select("topic", "seq", "video_id", "srt_id", "n_lines", "n_bytes").collect()) == walk(hits, videos, budget)


def test_a_hundred_thousand_videos_of_one_topic(spark):
    """Room runs out slowly: each pass leaves less; what is folded stays within the budget."""
    n, budget = 100_000, 300
    lines = [" " * (7 + (i * 7919) % 60) for i in range(n)]
    rows = spark.createDataFrame([("t", i, i, f"s{i}", 6, [len(lines[i]) + 1]) for i in range(n)],
                                 "topic STRING, seq BIGINT, video_id BIGINT, srt_id STRING, head BIGINT, upto ARRAY<BIGINT>").repartition(8)
    assert chunking._still_possible(rows, budget).count() <= budget + 50


@pytest.mark.parametrize("slice_", [1, 4, 16])
def test_slices_against_walk(spark, monkeypatch, slice_):
    """Many slices of a topic, one subtitle shared by most videos, none dropped that the walk takes."""
    monkeypatch.setattr(chunking, "SLICE_VIDEOS", slice_)
    hits, videos = case(5, 60)
    videos = [(i, seq, "shared" if i % 3 else srt, name) for i, seq, srt, name in videos]
    got = chunking.excerpt_sections(spark.createDataFrame(hits, "topic STRING, video_id BIGINT, cue_no INT, line STRING").repartition(3),
                                    spark.createDataFrame(videos, "video_id BIGINT, seq BIGINT, srt_id STRING, file_name STRING"), 150)
    assert sorted(tuple(r) for r in got.select("topic", "seq", "video_id", "srt_id", "n_lines", "n_bytes").collect()) == walk(hits, videos, 150)


def test_passes_follow_the_budget_not_the_videos(spark, monkeypatch):
    """Ten times the videos are narrowed with as many writes."""
    writes, write = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **k: writes.append(1) or write(df, *a, **k))
    counts = []
    for n in (2_000, 20_000):
        size = F.lit(13) + (F.col("id") * 7919) % 600
        rows = spark.range(n).select(F.lit("t").alias("topic"), F.col("id").alias("seq"), F.col("id").alias("video_id"),
                                     F.concat(F.lit("s"), "id").alias("srt_id"), F.lit(6).cast("bigint").alias("head"), F.array(size).alias("upto"))
        writes.clear()
        assert chunking._still_possible(rows, 1_500).count() <= 1_500
        counts.append(len(writes))
    assert counts[1] <= counts[0] <= 10
