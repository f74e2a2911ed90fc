"""Successors of positions in arrays: the work inside one range of :func:`cuelake.operators.timeline.drift_breadcrumbs`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class _Range:
    """The rows of a range in (session, time) order.

    ``ahead[k]`` holds the greatest and the least position of the 2^k rows after each row, so that the first row that
    leaves a band around a position is found by halving, for all rows at once.
    """

    def __init__(self, table: pa.Table, epsilon: int):
        table = table.select(["session", "ts", "event_id", "video_id", "t_ms"]).sort_by([(c, "ascending") for c in ("session", "ts", "event_id")])
        self.session, self.event, self.video, self.t = (table.column(c).to_numpy() for c in ("session", "event_id", "video_id", "t_ms"))
        self.epsilon, self.n = epsilon, table.num_rows
        new = np.ones(self.n, dtype=bool)
        new[1:] = self.session[1:] != self.session[:-1]
        self.starts = np.flatnonzero(new)
        run = new.copy()
        run[1:] |= self.video[1:] != self.video[:-1]
        begins = np.flatnonzero(run)
        self.run_end = np.repeat(np.append(begins[1:], self.n), np.diff(np.append(begins, self.n)))
        self.session_end = np.repeat(np.append(self.starts[1:], self.n), np.diff(np.append(self.starts, self.n)))
        high, low = np.append(self.t[1:], self.t[-1:]), np.append(self.t[1:], self.t[-1:])
        self.ahead = [(high, low)]
        for k in range(max(1, int(np.diff(np.append(begins, self.n)).max(initial=1)).bit_length()) - 1):
            step = np.minimum(np.arange(self.n) + (1 << k), self.n - 1)
            high, low = np.maximum(high, high[step]), np.minimum(low, low[step])
            self.ahead.append((high, low))
        self.next = self.leaving(np.arange(self.n), self.t)

    def leaving(self, at: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For each row and position: the first later row of the session that is kept after it, or -1."""
        pos, end = at.copy(), self.run_end[at]
        for k in reversed(range(len(self.ahead))):
            high, low = self.ahead[k]
            inside = (pos + (1 << k) < end) & (high[pos] < t + self.epsilon) & (low[pos] > t - self.epsilon)
            pos[inside] += 1 << k
        pos += 1
        return np.where(pos < self.session_end[at], pos, -1)

    def last(self) -> np.ndarray:
        """The row that the successors of each row end in."""
        end = np.where(self.next < 0, np.arange(self.n), self.next)
        while True:
            further = end[end]
            if (further == end).all():
                return end
            end = further

    def reached(self, begin: np.ndarray) -> np.ndarray:
        """Rows reached from the given ones."""
        mark = np.zeros(self.n + 1, dtype=bool)
        mark[begin] = True
        jump = np.append(np.where(self.next < 0, self.n, self.next), self.n)
        while True:
            mark[jump[mark]] = True
            further = jump[jump]
            if (further == jump).all():
                mark[self.n] = False
                return np.flatnonzero(mark[:-1])
            jump = further

    def entered(self, row: int, video: int, t: np.ndarray) -> np.ndarray:
        """The first row kept, from a session's first ``row`` on, after positions kept before it; -1 if none is."""
        first = np.full(len(t), row)
        near = (self.video[row] == video) & (np.abs(self.t[row] - t) < self.epsilon)
        first[near] = self.leaving(np.full(int(near.sum()), row), t[near])
        return first


def edges(table: pa.Table, epsilon: int) -> pa.Table:
    """The tables of the first and the last session of a range, which may go on in its neighbours."""
    block, r = table.column("block")[0].as_py(), _Range(table, epsilon)
    last, rows = r.last(), []
    for row in sorted({int(r.starts[0]), int(r.starts[-1])}):
        reach = np.arange(int(r.t[row]) - epsilon + 1, int(r.t[row]) + epsilon)
        first = r.entered(row, r.video[row], reach)
        end = np.where(first < 0, -1, last[first])
        keep = np.ones(len(end), dtype=bool)
        keep[1:] = end[1:] != end[:-1]  # positions next to one another mostly leave alike
        ends = [None if e < 0 else {"video_id": int(r.video[e]), "t_ms": int(r.t[e])} for e in end[keep]]
        rows.append({"session": int(r.session[row]), "block": block, "first_video": int(r.video[row]), "first_t": int(r.t[row]),
                     "end_video": int(r.video[last[row]]), "end_t": int(r.t[last[row]]), "reach": reach[keep].tolist(), "ends": ends})
    place = pa.struct([("video_id", pa.int64()), ("t_ms", pa.int64())])
    schema = pa.schema([(c, pa.int64()) for c in ("session", "block", "first_video", "first_t", "end_video", "end_t")]
                       + [("reach", pa.list_(pa.int64())), ("ends", pa.list_(place))])
    return pa.Table.from_pylist(rows, schema)


def walk(state: tuple[int, int] | None, run: dict[str, np.ndarray], epsilon: int) -> tuple[tuple[int, int], list[tuple]]:
    """Along the ranges of a session: what position each is entered with (none for the first)."""
    out = []
    for i, block in enumerate(run["block"]):
        video, t = int(run["first_video"][i]), int(run["first_t"][i])
        if state is not None:
            out.append((int(block), *state))
        if state is None or state[0] != video or abs(state[1] - t) >= epsilon:
            state = (int(run["end_video"][i]), int(run["end_t"][i]))
            continue
        end = run["ends"][i][int(np.searchsorted(run["reach"][i], state[1], side="right")) - 1]
        state = state if end is None else (int(end["video_id"]), int(end["t_ms"]))
    return state, out


def kept(table: pa.Table, entries: pa.Table, epsilon: int) -> pa.Table:
    """The rows of a range that are kept."""
    names = ["session", "event_id", "video_id", "t_ms"]
    if not table.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    r = _Range(table, epsilon)
    begin = {int(r.session[row]): int(row) for row in r.starts[:1]} | {int(r.session[row]): int(row) for row in r.starts[-1:]}
    starts = set(r.starts.tolist())
    for entry in entries.to_pylist():  # of the first session, or of the last, at most
        row = begin[entry["session"]]
        starts.discard(row)
        first = int(r.entered(row, entry["video_id"], np.array([entry["t_ms"]]))[0])
        starts |= {first} - {-1}
    at = r.reached(np.array(sorted(starts), dtype=np.int64))
    return pa.table({c: pa.array(x[at].astype(np.int64)) for c, x in zip(names, (r.session, r.event, r.video, r.t))})
