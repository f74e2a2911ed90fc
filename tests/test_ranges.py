"""Windows and folds over ranges of equal numbers of rows: one busy day, one busy session."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import ordered, timeline

DAY = 86_400


def busy(seed, n=6000, sessions=5):
    """Most rows lie in one second of one day, a third of them in one session."""
    r = random.Random(seed)
    return [(1_700_000_000 + (0 if r.random() < 0.8 else r.randrange(9 * DAY)), i, 0 if r.random() < 0.4 else r.randrange(sessions), r.randrange(9)) for i in range(n)]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 500)
    monkeypatch.setattr(ordered, "ranged", lambda df, keys, order, rows=500, out="__blk", f=ordered.ranged: f(df, keys, order, min(rows, 500), out))


def frame(spark, rows):
    return spark.createDataFrame(rows, "s BIGINT, event_id BIGINT, session BIGINT, v BIGINT").withColumn("ts", F.timestamp_seconds("s")).repartition(3)


def test_ranges_hold_no_more_than_asked(spark):
    df = ordered.ranged(frame(spark, busy(1)), [], ["ts", "event_id"], 500)
    sizes = [r["count"] for r in df.groupBy("__blk").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 1000
    bounds = sorted((r.b, r.lo, r.hi) for r in df.groupBy(F.col("__blk").alias("b")).agg(
        F.min(F.struct("s", "event_id")).alias("lo"), F.max(F.struct("s", "event_id")).alias("hi")).collect())
    assert all(x[2] < y[1] for x, y in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("keys", [[], ["session"]])
def test_keyless_and_keyed_windows(spark, small, keys):
    rows = busy(2)
    df = frame(spark, rows)
    order = ["ts", "event_id"]
    sums = {r.event_id: r.out for r in ordered.running_sum(df, keys, order, "v", "out", ordered.RANGES).collect()}
    near = {r.event_id: (r.p, r.n, r.f, r.l) for r in ordered.neighbours(df, keys, order, F.col("event_id"), "n", "p", "f", "l", ordered.RANGES).collect()}
    last = {r.event_id: r.c for r in ordered.carry_forward(
        df.withColumn("odd", F.when(F.col("v") == 3, F.col("event_id"))), keys, order, {"odd": "c"}, ordered.RANGES).collect()}
    groups = {}
    for s, e, session, v in sorted(rows):
        groups.setdefault(session if keys else 0, []).append((e, v))
    for group in groups.values():
        total, odd = 0, None
        for i, (e, v) in enumerate(group):
            total += v
            odd = e if v == 3 else odd
            ids = [x for x, _ in group]
            assert sums[e] == total and last[e] == odd
            assert near[e] == (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None, ids[0], ids[-1])


def crumbs(rows, epsilon=500):
    state, out = {}, []
    for _, event, session, video, t in sorted(rows):
        kept = state.get(session)
        if kept is None or kept[0] != video or abs(kept[1] - t) >= epsilon:
            state[session] = (video, t)
            out.append((session, event, video, t))
    return sorted(out)


def played(seed, n):
    """Playback: mostly forward in small steps, sometimes paused, sometimes elsewhere; one session has most rows."""
    r, out, at = random.Random(seed), [], {}
    for i in range(n):
        session = 7 if r.random() < 0.7 else r.randrange(5)
        video, t = at.get(session, (1, 0))
        kind = r.random()
        video, t = (r.randrange(3), r.randrange(5000)) if kind < 0.01 else (video, t + r.choice([0, 40, 100, -100, 260])) if kind < 0.95 else (video, t + r.randrange(-900, 900))
        at[session] = (video, t)
        out.append((1_700_000_000 + i // 5, i, session, video, t))
    return out


@pytest.mark.parametrize(("rows", "seed"), [(60, 1), (333, 2), (1 << 16, 3)])
def test_drift_over_ranges(spark, rows, seed):
    table = played(seed, 4000)
    df = spark.createDataFrame(table, "s BIGINT, event_id BIGINT, session BIGINT, video_id BIGINT, t_ms BIGINT").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(tuple(r) for r in timeline.drift_breadcrumbs(df.repartition(3), rows=rows).collect())
    assert got == crumbs(table)


def test_drift_when_nothing_moves(spark):
    """A pause over many ranges: each is entered and left with the same position."""
    table = [(1_700_000_000 + i, i, 1, 1, 1000 + i % 3) for i in range(900)] + [(1_700_001_000, 900, 1, 1, 1500), (1_700_001_001, 901, 2, 1, 0)]
    df = spark.createDataFrame(table, "s BIGINT, event_id BIGINT, session BIGINT, video_id BIGINT, t_ms BIGINT").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(tuple(r) for r in timeline.drift_breadcrumbs(df, rows=50).collect()) == crumbs(table)
    assert timeline.drift_breadcrumbs(df.limit(0), rows=50).count() == 0
