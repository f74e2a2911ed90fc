"""Streams in several micro-batches: expiry of state, late rows, order."""

import pytest
from pyspark.sql import functions as F

from cuelake.streaming import streams as S

DAY = 86_400


def fed(spark, folder, batches, schema):
    """A stream that takes the batches one by one."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(f"{schema}, ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(str(folder))


POSITIONS = "s BIGINT, session BIGINT, event_id BIGINT, video_id BIGINT, t_ms BIGINT"


def test_state_is_gone_after_the_horizon(spark, tmp_path):
    """Idle sessions are forgotten; at the end, only one that is younger than the horizon is held."""
    batches = [[(10 + i, i, i, 1, 1000) for i in range(20)], [(5 * DAY, 99, 100, 1, 0)], [(40 * DAY, 99, 101, 1, 0)]]
    stream = S.drift_stream(fed(spark, tmp_path, batches, POSITIONS), delay="1 hour", idle_ms=2 * DAY * 1000)
    out, said = S.drained(stream)
    assert out.count() == 22  # session 99 begins anew at the third batch
    assert said == {"n_late": 0, "n_state": 1}
    more = [[(10 + i, i, i, 1, 1000) for i in range(20)], [(5 * DAY, 99, 100, 1, 0)]]
    held = S.drained(S.drift_stream(fed(spark, tmp_path / "long", more, POSITIONS), delay="1 hour", idle_ms=90 * DAY * 1000))[1]
    assert held["n_state"] == 21


def test_late_rows_are_counted_and_dropped(spark, tmp_path):
    # A micro-batch is judged by the watermark that stood before the one ahead of it.
    batches = [[(10 * DAY, 1, 1, 1, 0)], [(10 * DAY, 7, 5, 1, 0)], [(10 * DAY - 60, 1, 2, 1, 9000), (9 * DAY, 1, 3, 1, 20_000), (DAY, 2, 4, 1, 0)]]
    out, said = S.drained(S.drift_stream(fed(spark, tmp_path, batches, POSITIONS), delay="10 minutes"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 5] and said["n_late"] == 2


@pytest.mark.parametrize("split", [1, 3, 8])
def test_expiry_does_not_depend_on_batches(spark, tmp_path, split):
    rows = [(t * DAY, 1, i, v, m) for i, (t, v, m) in enumerate(
        [(1, 1, 0), (1.5, 1, 100), (4, 1, 100), (4.2, 1, 200), (4.3, 2, 200), (7, 2, 250), (7.1, 2, 300), (20, 2, 300)])]
    rows = [(int(s), *rest) for s, *rest in rows]
    batches = [rows[i:i + -(-8 // split)] for i in range(0, 8, -(-8 // split))]
    out = S.drain(S.drift_stream(fed(spark, tmp_path, batches, POSITIONS), idle_ms=2 * DAY * 1000))
    assert sorted(r.event_id for r in out.collect()) == [0, 2, 4, 5, 7]


HITS = "s BIGINT, event_id BIGINT, video_id BIGINT, hit_ms BIGINT, aborted BOOLEAN"


def test_aborted_hits_are_accepted_again(spark, tmp_path):
    """Accepted, aborted, accepted again, over batches; an abort ahead of any hit changes nothing."""
    batches = [[(10, 1, 1, 500, False), (11, 2, 1, 500, False), (12, 3, 2, 500, True)],
               [(20, 4, 1, 500, True), (21, 5, 2, 500, False), (22, 6, 1, 600, False)],
               [(30, 7, 1, 500, False), (31, 8, 1, 500, False), (32, 9, 1, 600, False)],
               [(3 * DAY, 10, 1, 500, False), (3 * DAY, 11, 2, 500, True), (3 * DAY + 1, 12, 2, 500, False)]]
    out = S.drain(S.first_seen_hits(fed(spark, tmp_path, batches, HITS), memory_ms=DAY * 1000))
    assert sorted(r.event_id for r in out.collect()) == [1, 5, 6, 7, 10, 12]


HEAT = "s BIGINT, video_id BIGINT, n BIGINT, add DOUBLE"


def test_heat_fades_and_ends(spark, tmp_path):
    """A late contribution has faded; heat under the floor is no heat, and its state goes."""
    batches = [[(10, 1, 10, 1.0), (10, 2, 1, 1e-7)], [(11, 1, 8, 1.0), (12, 1, 12, 0.5)], [(13, 3, 1, 1.0)]]
    out, said = S.drained(S.heat_stream(fed(spark, tmp_path, batches, HEAT)), "update")
    got = {r.video_id: (r.heat, r.n) for r in out.orderBy("n").collect()}
    assert got == {1: (pytest.approx((1.0 + 0.25) * 0.25 + 0.5), 12), 2: (0.0, 1), 3: (1.0, 1)}
    assert said["n_state"] == 2
    gone = S.drained(S.heat_stream(fed(spark, tmp_path / "b", [[(10, 1, 1, 1.0)], [(9 * DAY, 2, 2, 1e-9)]], HEAT), idle_ms=DAY * 1000), "update")[1]
    assert gone["n_state"] == 0


def test_heat_is_kept_by_buckets(spark, tmp_path, monkeypatch):
    """Videos of a bucket fade, end and are forgotten each on its own; the calls of a micro-batch are as many as buckets."""
    monkeypatch.setattr(S, "HEAT_BUCKETS", 2)
    big = 1 << 60
    batches = [[(10, v, 1, 1.0) for v in range(40)] + [(10, None, 1, 1.0), (10, big + 1, 1, 1.0)],
               [(DAY, 0, 3, 1.0), (DAY, 1, 30, 1e-9), (DAY, None, 2, 1.0)], [(4 * DAY, 2, 4, 1.0), (4 * DAY, 0, 4, 1.0)]]
    out, said = S.drained(S.heat_stream(fed(spark, tmp_path, batches, HEAT), idle_ms=2 * DAY * 1000), "update")
    last = {r.video_id: (r.heat, r.n) for r in out.orderBy("n").collect()}
    assert last == {0: (1.0, 4), 1: (0.0, 30), 2: (1.0, 4), None: (1.5, 2), big + 1: (1.0, 1)} | {v: (1.0, 1) for v in range(3, 40)}
    assert said == {"n_late": 0, "n_state": len({r[0] % 2 for r in spark.sql("select xxhash64(v) from values (0L), (2L) t(v)").collect()})}
