"""Queries over time: active cues, actions, frames, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import timeline as tl
from cuelake.plans import bindings as b
from cuelake.plans.registry import query

_CUE_AT = """

, located AS (SELECT p.event_id, p.session, p.video_id, p.ts, p.t_ms,
           (SELECT CASE WHEN p.t_ms < arg_max(c.end_ms, c.cue_no) THEN max(c.cue_no) END FROM overlap c
            WHERE c.video_id = p.video_id AND c.start_ms <= p.t_ms) AS cue_no FROM positions p)
"""


@query("cue_at", _CUE_AT + "SELECT event_id, video_id, t_ms, cue_no FROM located")
def cue_at(spark, sf):
    return tl.cue_at(b.positions(spark, sf), b.overlap(spark, sf)).select("event_id", "video_id", "t_ms", "cue_no")


@query("cue_changes", _CUE_AT + """
SELECT session, event_id, cue_no FROM (
  SELECT *, CASE WHEN lag(video_id) OVER w = video_id THEN lag(coalesce(cue_no, -1)) OVER w ELSE -1 END AS was FROM located
  WINDOW w AS (PARTITION BY session ORDER BY ts, event_id))
WHERE coalesce(cue_no, -1) <> was""")
def cue_changes(spark, sf):
    at = tl.cue_at(b.positions(spark, sf), b.overlap(spark, sf))
    return tl.cue_changes(at).select("session", "event_id", "cue_no")


@query("stall_gaps", """
SELECT session, event_id, epoch_us(ts) // 1000 - epoch_us(p) // 1000 AS silence_ms FROM (
  SELECT session, event_id, ts, lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS p FROM positions)
WHERE epoch_us(ts) // 1000 - epoch_us(p) // 1000 >= 6000""")
def stall_gaps(spark, sf):
    return tl.stall_gaps(b.positions(spark, sf)).select("session", "event_id", "silence_ms")


@query("facet_state", """
SELECT session, event_id, last_value(video_id IGNORE NULLS) OVER w AS now_video_id,
       last_value(cursor IGNORE NULLS) OVER w AS now_cursor, last_value(pattern IGNORE NULLS) OVER w AS now_pattern
FROM actions WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def facet_state(spark, sf):
    return tl.facet_state(b.actions(spark, sf)).select(
        "session", "event_id", "now_video_id", "now_cursor", "now_pattern")


DRIFT_SQL = """
, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS rn FROM positions),
fold AS (
  SELECT session, event_id, video_id, t_ms, rn, t_ms AS kept, true AS keep FROM r WHERE rn = 1
  UNION ALL
  SELECT session, event_id, video_id, t_ms, rn, CASE WHEN keep THEN t_ms ELSE kept END, keep
  FROM (SELECT r.*, f.kept, f.video_id <> r.video_id OR abs(f.kept - r.t_ms) >= 500 AS keep FROM fold f JOIN r ON r.session = f.session AND r.rn = f.rn + 1))
SELECT session, event_id, video_id, t_ms FROM fold WHERE keep"""


@query("drift_breadcrumbs", DRIFT_SQL)
def drift_breadcrumbs(spark, sf):
    return tl.drift_breadcrumbs(b.positions(spark, sf))


@query("failure_latch", """
, o AS (SELECT user_id AS session, ts, event_id, event_type = 'error' AS r FROM events WHERE event_type <> 'click'),
l AS (SELECT session, ts, r AND coalesce(lag(r, 1) OVER w, false) AND coalesce(lag(r, 2) OVER w, false) AS hit FROM o
      WINDOW w AS (PARTITION BY session ORDER BY ts, event_id))
SELECT session, epoch_us(min(ts)) // 1000 AS offline_at_ms FROM l WHERE hit GROUP BY session""")
def failure_latch(spark, sf):
    kind = F.col("event_type")
    outcomes = b.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(kind == "error", F.lit("refused")).when(kind == "click", F.lit("cancel")).otherwise(F.lit("ok"))
        .alias("outcome"))
    return tl.failure_latch(outcomes).select("session", F.unix_millis("offline_at").alias("offline_at_ms"))


_BOUNDS = """
, shots AS (SELECT video_id, t_ms AS hit_ms, px FROM frames),
pairs AS (SELECT h.video_id, h.hit_ms, f.t_ms FROM shots h JOIN frames f ON f.video_id = h.video_id
            AND f.t_ms BETWEEN h.hit_ms - 30000 AND h.hit_ms + 30000
          WHERE list_sum(list_transform(range(1, len(h.px) + 1), lambda i: abs(h.px[i] - f.px[i]))) / len(h.px) >= 13),
bounds AS (SELECT s.video_id, s.hit_ms,
  coalesce(max(CASE WHEN t_ms < s.hit_ms THEN t_ms END), greatest(s.hit_ms - 30000, 0)) AS prev_ms,
  coalesce(min(CASE WHEN t_ms > s.hit_ms THEN t_ms END), s.hit_ms + 30000) AS next_ms
  FROM shots s LEFT JOIN pairs p ON p.video_id = s.video_id AND p.hit_ms = s.hit_ms GROUP BY s.video_id, s.hit_ms)
"""
_SAME = 13  # test vectors are unit vectors times 100; this value splits them


def _shots(spark, sf):
    return b.frames(spark, sf).withColumnRenamed("t_ms", "hit_ms")


@query("content_boundaries", _BOUNDS + "SELECT * FROM bounds")
def content_boundaries(spark, sf):
    return tl.content_boundaries(_shots(spark, sf), b.frames(spark, sf), _SAME)


@query("reuse_segment", _BOUNDS + """
, picks AS (SELECT b.video_id, b.hit_ms AS pick_ms, prev_ms, next_ms, px FROM bounds b JOIN shots s USING (video_id, hit_ms)),
met AS (SELECT f.video_id, f.t_ms AS hit_ms, p.pick_ms, p.prev_ms, p.next_ms FROM frames f JOIN picks p
        ON p.video_id = f.video_id AND f.t_ms > p.prev_ms AND f.t_ms < p.next_ms
        WHERE list_sum(list_transform(range(1, len(f.px) + 1), lambda i: abs(f.px[i] - p.px[i]))) / len(f.px) < 13)
SELECT video_id, hit_ms, min(pick_ms) AS pick_ms, arg_min(prev_ms, pick_ms) AS prev_ms, arg_min(next_ms, pick_ms) AS next_ms
FROM met GROUP BY video_id, hit_ms""")
def reuse_segment(spark, sf):
    shots = _shots(spark, sf)
    picks = tl.content_boundaries(shots, b.frames(spark, sf), _SAME).join(
        shots.withColumnRenamed("px", "pick_px"), ["video_id", "hit_ms"]).withColumnRenamed("hit_ms", "pick_ms")
    return tl.reuse_segment(b.frames(spark, sf).withColumnRenamed("t_ms", "hit_ms"), picks, _SAME)


@query("mru_history", """
SELECT pattern, max(event_id) AS event_id FROM search_log GROUP BY pattern""")
def mru_history(spark, sf):
    return tl.mru_history(b.search_log(spark, sf), "pattern", ["event_id"])


@query("recent_files", """
SELECT path, max(event_id) AS event_id FROM actions a JOIN videos v ON v.video_id = a.video_id
GROUP BY path ORDER BY 2 DESC LIMIT 20""")
def recent_files(spark, sf):
    opened = b.actions(spark, sf).where("video_id is not null").join(
        b.videos(spark, sf).select("video_id", "path"), "video_id")
    return tl.recent_files(opened, "path", ["event_id"])


@query("ring_travel", """
, s AS (SELECT user_id AS session, event_id % 7 AS node, event_id AS seq,
               CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS dir FROM events),
n AS (SELECT session, node, CAST(sum(dir) AS BIGINT) AS net, arg_max(dir, seq) AS heading FROM s GROUP BY ALL)
SELECT session, node, net, heading, CAST(sum(net) OVER (PARTITION BY session) AS BIGINT) AS lap FROM n""")
def ring_travel(spark, sf):
    steps = b.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), (F.col("event_id") % 7).alias("node"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "click"), F.lit(1)).otherwise(F.lit(-1)).alias("dir"))
    return tl.ring_travel(steps)


@query("session_replay")
def session_replay(spark, sf):
    """No SQL twin: the tree walk is checked against a brute-force replay in the tests."""
    acts = b.actions(spark, sf)
    payload = F.to_json(F.struct("video_id", "cursor", "pattern"))
    return tl.session_replay(acts.withColumn("payload", payload))
