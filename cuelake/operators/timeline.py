"""Time: active cues, user actions, frames, failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators import drift
from cuelake.operators.ordered import BLOCK, RANGES, block_of, carry_forward, interval_lookup, neighbours, ranged, sorted_fold

# ---- fixed values -------------------------------------------------------------------------------
STALL_MS = 6000          # silence after which a player counts as unresponsive
DRIFT_MS = 500           # smallest position change worth a breadcrumb
STRIKES = 3              # refusals in a row that latch a service offline
WINDOW_MS = 30_000       # reach of the boundary search around a hit
SAME_BELOW = 8           # mean absolute pixel difference below which frames look the same
RECENT_FILES = 20
# -------------------------------------------------------------------------------------------------


def cue_spans(cues: DataFrame) -> DataFrame:
    """Stretches in which a cue is the active one: (video_id, cue_no, lo, hi), never overlapping.

    The latest start decides, so a cue ends where the next one starts even while it is still open;
    of equal starts the highest cue number counts.
    """
    by_start = cues.groupBy("video_id", "start_ms").agg(F.max(F.struct("cue_no", "end_ms")).alias("c"))
    rows = by_start.select("video_id", "start_ms", "c.cue_no", "c.end_ms")
    nxt = neighbours(rows, ["video_id"], ["start_ms"], F.col("start_ms"), nxt="upto",
                     block=block_of("start_ms", 1 << 26))
    return nxt.select("video_id", "cue_no", F.col("start_ms").alias("lo"), F.least("end_ms", "upto").alias("hi"))


def cue_at(points: DataFrame, cues: DataFrame, point: str = "t_ms") -> DataFrame:
    """Each point with its active cue, or NULL."""
    return interval_lookup(points, cue_spans(cues), ["video_id"], point, "lo", "hi").drop("lo", "hi")


def cue_changes(at: DataFrame, order: list[str] = ["ts", "event_id"]) -> DataFrame:
    """Rows whose active cue differs from the session's previous one; a new video starts without a cue."""
    seen = F.struct("video_id", F.coalesce("cue_no", F.lit(-1)).alias("cue"))
    before = neighbours(at, ["session"], order, seen, prev="__p", block=RANGES)
    was = F.when(F.col("__p.video_id") == F.col("video_id"), F.col("__p.cue")).otherwise(F.lit(-1))
    return before.where(F.coalesce("cue_no", F.lit(-1)) != was).drop("__p")


def stall_gaps(events: DataFrame, silence_ms: int = STALL_MS) -> DataFrame:
    """Stretches without any event for at least ``silence_ms``, ended by the next event."""
    n = neighbours(events, ["session"], ["ts", "event_id"], F.col("ts"), prev="stalled_from", block=RANGES)
    gap = F.unix_millis("ts") - F.unix_millis("stalled_from")
    return n.where(gap >= silence_ms).select("session", "event_id", "stalled_from", F.col("ts").alias("answered_at"),
                                             gap.alias("silence_ms"))


def facet_state(actions: DataFrame, facets: list[str] = ["video_id", "cursor", "pattern"]) -> DataFrame:
    """State after each step: every facet at its latest recorded value."""
    return carry_forward(actions, ["session"], ["ts", "event_id"], {f: f"now_{f}" for f in facets}, RANGES)


def drift_breadcrumbs(positions: DataFrame, epsilon_ms: int = DRIFT_MS, rows: int = BLOCK) -> DataFrame:
    """Positions at least ``epsilon_ms`` away from the last kept one; a new video starts afresh.

    Every row has a successor: the first later row of its session that would be kept if it were.  A session that lies
    over several ranges enters a range with a kept position of an earlier one.  Only one within ``epsilon_ms`` of the
    range's first position matters, and positions are whole milliseconds, so a range is summed up by a bounded table:
    from entering position to leaving position.  These tables are folded along the session, and each range then
    follows its successors from where it is really entered.
    """
    held = ranged(positions.select("session", "ts", "event_id", "video_id", "t_ms"), ["session"], ["ts", "event_id"], rows, "block")
    kept = "session bigint, event_id bigint, video_id bigint, t_ms bigint"
    edge = ("session bigint, block bigint, first_video bigint, first_t bigint, end_video bigint, end_t bigint, "
            "reach array<bigint>, ends array<struct<video_id: bigint, t_ms: bigint>>")
    tables = held.groupBy("block").applyInArrow(lambda t: drift.edges(t, epsilon_ms), edge)
    spans = tables.groupBy("session").agg(F.count("*").alias("n")).where("n > 1").select("session")
    entries = sorted_fold(tables.join(spans, "session"), ["session"], ["block"], lambda: None,
                          lambda state, run: drift.walk(state, run, epsilon_ms), "session BIGINT, block BIGINT, video_id BIGINT, t_ms BIGINT")
    return held.groupBy("block").cogroup(entries.toDF("session", "at", "video_id", "t_ms").groupBy("at")).applyInArrow(
        lambda t, e: drift.kept(t, e, epsilon_ms), kept)


def failure_latch(outcomes: DataFrame, strikes: int = STRIKES) -> DataFrame:
    """Per service the moment that ``strikes`` refusals came in a row; cancels are neutral.

    ``outcomes`` is (session, ts, event_id, outcome) with outcome refused / cancel / anything else.
    """
    rows = outcomes.where("outcome <> 'cancel'").select(
        "session", "ts", "event_id", (F.col("outcome") == "refused").alias("r0"))
    for i in range(1, strikes):
        rows = neighbours(rows, ["session"], ["ts", "event_id"], F.col(f"r{i - 1}"), prev=f"r{i}", block=RANGES)
    run = reduce(lambda a, c: a & c, [F.coalesce(f"r{i}", F.lit(False)) for i in range(strikes)])
    return rows.where(run).groupBy("session").agg(F.min("ts").alias("offline_at"))


def frame_difference(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x) / F.size(a)


def content_boundaries(hits: DataFrame, frames: DataFrame, same_below: float = SAME_BELOW) -> DataFrame:
    """Per hit (video_id, hit_ms, px): the nearest frame on each side that looks different.

    Where none differs within the window, the window's edge.  A hit meets only the frames of the
    three window-wide buckets around it.
    """
    spread = hits.withColumn("b", F.explode(F.array(*[
        F.floor(F.col("hit_ms") / WINDOW_MS) + d for d in (-1, 0, 1)])))
    seen = frames.select("video_id", "t_ms", F.col("px").alias("other"), F.floor(F.col("t_ms") / WINDOW_MS).alias("b"))
    near = (F.abs(F.col("t_ms") - F.col("hit_ms")) <= WINDOW_MS)
    differs = spread.join(seen, ["video_id", "b"]).where(near).where(
        frame_difference(F.col("px"), F.col("other")) >= same_below)
    sides = differs.groupBy("video_id", "hit_ms").agg(
        F.max(F.when(F.col("t_ms") < F.col("hit_ms"), F.col("t_ms"))).alias("p"),
        F.min(F.when(F.col("t_ms") > F.col("hit_ms"), F.col("t_ms"))).alias("n"))
    return hits.select("video_id", "hit_ms").join(sides, ["video_id", "hit_ms"], "left").select(
        "video_id", "hit_ms", F.coalesce("p", F.greatest(F.col("hit_ms") - WINDOW_MS, F.lit(0))).alias("prev_ms"),
        F.coalesce("n", F.col("hit_ms") + WINDOW_MS).alias("next_ms"))


def reuse_segment(hits: DataFrame, picks: DataFrame, same_below: float = SAME_BELOW) -> DataFrame:
    """Hits strictly inside a known pick of the same look inherit its boundaries (smallest pick wins).

    ``picks`` is (video_id, pick_ms, prev_ms, next_ms, pick_px); one with an open side is not used.
    A segment is at most two windows long, which bounds how many picks a hit can meet.
    """
    spans = picks.where("prev_ms is not null and next_ms is not null").select(
        "video_id", (F.col("prev_ms") + 1).alias("lo"), F.col("next_ms").alias("hi"), "pick_ms", "pick_px", "prev_ms")
    met = interval_lookup(hits, spans, ["video_id"], "hit_ms", "lo", "hi", how="inner")
    alike = met.where(frame_difference(F.col("px"), F.col("pick_px")) < same_below)
    best = alike.groupBy("video_id", "hit_ms").agg(
        F.min(F.struct("pick_ms", "prev_ms", "hi")).alias("b"))
    return best.select("video_id", "hit_ms", "b.pick_ms", "b.prev_ms", F.col("b.hi").alias("next_ms"))


def mru_history(uses: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with their last use; empty ones are ignored."""
    return uses.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(value).agg(
        F.max(F.struct(*order)).alias("last")).select(value, "last.*")


def recent_files(opens: DataFrame, value: str, order: list[str], cap: int = RECENT_FILES) -> DataFrame:
    history = mru_history(opens, value, order)
    return history.orderBy(*[F.desc(c) for c in order]).limit(cap)


def ring_travel(steps: DataFrame) -> DataFrame:
    """Net passes and last heading per (session, node); the ring's sum is the lap position."""
    nodes = steps.groupBy("session", "node").agg(F.sum("dir").alias("net"), F.max_by("dir", "seq").alias("heading"))
    laps = nodes.groupBy("session").agg(F.sum("net").alias("lap"))
    return nodes.join(laps, "session")


class _Tree:
    """Action tree of one session: node 0 is the root."""

    def __init__(self):
        self.at, self.parent, self.last, self.depth, self.kids = 0, [None], [None], [0], {}
        self.fanout = [0]

    def apply(self, op: str, payload: str) -> bool:
        if op == "undo":
            target = self.parent[self.at]
        elif op == "redo":
            target = self.last[self.at]
        else:
            target = self.kids.get((self.at, payload))
            if target is None:
                target = len(self.parent)
                self.kids[(self.at, payload)] = target
                self.parent.append(self.at)
                self.last.append(None)
                self.fanout.append(0)
                self.depth.append(self.depth[self.at] + 1)
                self.fanout[self.at] += 1
            self.last[self.at] = target
        if target is None:
            return False
        self.at = target
        return True


def session_replay(actions: DataFrame) -> DataFrame:
    """Act / undo / redo logs over a tree: an equal action under the same node re-enters the old branch.

    ``actions`` is (session, ts, event_id, op, payload).  Result per action: node, parent, depth,
    branches below the node, and whether the step moved.  One session is sequential by nature; its
    rows stream through, only its tree is held.
    """
    def step(tree: _Tree, rows):
        out = []
        for event, op, payload in zip(rows["event_id"], rows["op"], rows["payload"]):
            moved = tree.apply(op, payload)
            at, up = tree.at, tree.parent[tree.at]
            out.append((event, at, -1 if up is None else up, tree.depth[at], tree.fanout[at], moved))
        return tree, out

    return sorted_fold(actions.select("session", "ts", "event_id", "op", "payload"), ["session"], ["ts", "event_id"],
                       _Tree, step, "session BIGINT, event_id BIGINT, node BIGINT, parent BIGINT, depth BIGINT, "
                                    "branches BIGINT, moved BOOLEAN").withColumn(
        "parent", F.when(F.col("parent") >= 0, F.col("parent")))
