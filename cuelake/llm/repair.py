"""Repair of conversations: the cheapest edits that give a sequence of roles ``(s?(ua)+)?``, least audit first.

Rows are range-partitioned by conversation and turn, so a long conversation lies over many tasks, and cut into blocks
of bounded size.  Of a block only a 4 x 4 table matters to the rest of its conversation: from each state of the
grammar at its start to each state at its end, the least cost and the order of the least audits.  Blocks are solved many
at a time:

1. cost-to-go by dynamic programming from the end of the blocks;
2. each node (row, state) keeps its optimal arcs; nodes are ranked by the first letter of their audit, then by the
   first two, four, eight letters: the rank of a node with the rank of the node that its pointer leads to, and pointers
   doubled with it;
3. ranks order the audits, and doubled pointers spell them.

A conversation within one task and block is finished at once.  The blocks of the others are stored, their tables folded
along the conversation (numbers only), and the pieces of the audit and text joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, stored

BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs; the last is added for a row that stays cut off
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_HEAD = 64  # characters of role and text that rows of one turn are ordered by, before their hash

# States of the grammar: nothing read, after s, after u, after a.  What an inserted or new role leads to, what a row
# of role s, u, a, other leads to when kept (-1: not allowed), and what is inserted at the end to be accepted.
_NEXT = np.array([2, 2, 3, 2])
_READ = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_CLOSING = ("", "II", "I", "")
_ROLE = {2: "user", 3: "assistant"}
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)  # in ASCII order
_INF = 1 << 40
_PATHS = 1 << 22  # audit letters that are spelled at a time

STATS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: the rows with the faults that crc32 of conversation and turn deals them.

    Of 20 remainders, 0 drops the row (it stays as a mark that the conversation exists), 1 empties its text, 2 takes the
    marks ``.!?`` out, 3 repeats it, 4 makes it the user's.  Nulls become one blank.
    """
    def text_of(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = bare(turns, conv_id=F.col("conv_id").cast("bigint"), turn=F.col("turn").cast("bigint"), role=text_of("role"), text=text_of("text"), draw=draw)
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("draw") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _arranged(rows: DataFrame) -> DataFrame:
    """Ranges of (conversation, turn); equal rows may lie in several."""
    keyed = bare(rows, conv_id="conv_id", turn="turn", role="role", text="text", dropped="dropped",
                 r=F.substring("role", 1, _HEAD), t=F.substring("text", 1, _HEAD), h=F.xxhash64("role", "text"), salt=F.monotonically_increasing_id())
    order = ["conv_id", "turn", "r", "t", "h", "salt"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "dropped")


class _Blocks:
    """Some blocks: rows ``begins[b]`` to ``begins[b + 1]`` of the arrays belong to block b."""

    def __init__(self, begins: np.ndarray, turns: pa.Array, roles: list[str], texts: list[str], known: list[list[int] | None] | None = None):
        self.begins, self.roles, self.texts = begins, roles, texts
        self.sizes = np.diff(begins)
        self.block = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.initial = np.array(["sua".find(r[0]) if r and r[0] in "sua" else 3 for r in roles], dtype=np.int64)
        stripped = [t.rstrip(_BLANKS) for t in texts]
        blank = np.array([not t for t in stripped], dtype=bool)
        cut_off = np.array([bool(t) and t[-1] not in ".!?" for t in stripped], dtype=bool)
        again = np.zeros(len(roles), dtype=bool)
        seen: set = set()
        for i, key in enumerate(zip(self.block.tolist(), roles, texts)):
            if key in seen:
                again[i] = True
            seen.add(key)
        for b, held in enumerate(known or []):  # rows that an earlier block of the conversation has
            if held is not None:
                again[begins[b] + np.array(held, dtype=np.int64)] = True
        again &= ~blank
        cut_off &= ~again
        self.must_go, self.cut_off = blank | again, cut_off
        self.stats = self._stats(turns, blank, again, cut_off)

    def _stats(self, turns: pa.Array, blank: np.ndarray, again: np.ndarray, cut_off: np.ndarray) -> dict[str, np.ndarray]:
        n, begins = len(self.sizes), self.begins

        def per_block(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
            return upto[begins[1:]] - upto[begins[:-1]]

        x, y = self.initial[:-1], self.initial[1:]
        wrong = ~(((x == 0) & (y == 1)) | ((x == 1) & (y == 2)) | ((x == 2) & (y == 1))) & (self.block[:-1] == self.block[1:])
        some = self.sizes > 0
        head, tail = begins[:-1][some], begins[1:][some] - 1
        first, last = np.full(n, -1), np.full(n, -1)
        first[some], last[some] = self.initial[head], self.initial[tail]
        valid = pc.is_valid(turns).to_numpy(zero_copy_only=False)
        turn = turns.fill_null(0).to_numpy(zero_copy_only=False)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (turn[1:] != turn[:-1]) | (self.block[1:] != self.block[:-1])
        counted = per_block(new)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.flatnonzero(valid)
        low[self.block[at][::-1]], high[self.block[at]] = turn[at][::-1], turn[at]  # nulls come first, turns ascend
        return {"blank": per_block(blank), "duplicate": per_block(again), "truncated": per_block(cut_off),
                "illegal": per_block(np.append(wrong, False)[:len(self.initial)]), "first": first, "last": last, "low": low, "high": high, "turns": counted}


def _costs(sizes: np.ndarray, begins: np.ndarray, initial: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray) -> np.ndarray:
    """Cost-to-go of [target, node, state]; the nodes are the rows, then one end per block."""
    rows, n = len(initial), len(sizes)
    cost = np.full((4, rows + n, 4), _INF, dtype=np.int64)
    for t in range(4):
        cost[t, rows:, t] = 0
    order = np.argsort(-sizes, kind="stable")
    ends, falling = begins[1:][order], sizes[order]
    after = _READ[:, initial].T  # row x state
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = order[:np.searchsorted(-falling, -back, side="right")]
        at = begins[1:][live] - back
        then = cost[:, rows + live if back == 1 else at + 1, :]
        extra = np.where(must_go[at], _INF, TRUNCATED * cut_off[at])[None, :, None]
        to = after[at]
        kept = np.where(to[None] >= 0, np.take_along_axis(then, np.maximum(to, 0)[None].repeat(4, 0), 2) + KEEP, _INF)
        best = np.minimum(then + DELETE, np.minimum(kept, then[:, :, _NEXT] + REROLE) + extra)
        u, a = best[:, :, 2].copy(), best[:, :, 3].copy()
        best[:, :, 2], best[:, :, 3] = np.minimum(u, a + INSERT), np.minimum(a, u + INSERT)
        best[:, :, :2] = np.minimum(best[:, :, :2], best[:, :, 2:3] + INSERT)
        cost[:, at, :] = np.minimum(best, _INF)
    return cost


def _first_arcs(cost: np.ndarray, begins: np.ndarray, initial: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every node: the least letter of its optimal arcs (0 where there is none), and the node it leads to."""
    _, nodes, _ = cost.shape
    rows = len(initial)
    follow = np.arange(rows) + 1
    ends = begins[1:][np.diff(begins) > 0]
    follow[ends - 1] = rows + np.flatnonzero(np.diff(begins) > 0)
    number = np.arange(cost.size).reshape(cost.shape)
    letter, pointer = np.zeros(cost.shape, np.int64), number.copy()
    here, then = cost[:, :rows, :], cost[:, follow, :]
    then_number = number[:, follow, :]
    extra = np.where(must_go, _INF, TRUNCATED * cut_off)[None, :, None]
    to = _READ[:, initial].T[None].repeat(4, 0)
    held = np.maximum(to, 0)
    arcs = [  # letters from the greatest to the least, so that the least stays
        (4, then[:, :, _NEXT] + REROLE + extra, then_number[:, :, _NEXT]),
        (3, np.where(to >= 0, np.take_along_axis(then, held, 2) + KEEP + extra, _INF), np.take_along_axis(then_number, held, 2)),
        (2, here[:, :, _NEXT] + INSERT, number[:, :rows, :][:, :, _NEXT]),
        (1, then + DELETE, then_number)]
    for code, value, target in arcs:
        optimal = (value == here) & (here < _INF)
        letter[:, :rows, :][optimal] = code
        pointer[:, :rows, :][optimal] = target[optimal]
    return letter.ravel(), pointer.ravel()


def _ranked(letter: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the nodes by their whole audits, and the pointers over 1, 2, 4, ... letters."""
    rank, jumps = letter, [pointer]
    while (letter[jumps[-1]] > 0).any():
        ahead = rank[jumps[-1]]
        _, rank = np.unique(rank * (ahead.max() + 1) + ahead, return_inverse=True)
        jumps.append(jumps[-1][jumps[-1]])
    return rank, jumps


def _spelled(starts: np.ndarray, letter: np.ndarray, jumps: list[np.ndarray]) -> list[str]:
    """The audits from the given nodes."""
    path = starts[:, None]
    for jump in jumps:
        path = np.concatenate([path, jump[path]], axis=1)
    codes = _LETTERS[letter[path]]
    return [x.decode() for x in codes.view(f"S{codes.shape[1]}").ravel().tolist()]


def solve(blocks: _Blocks) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Of every block, from state (row) to state (column): the least cost, the order of the least audits, the audits."""
    n = len(blocks.sizes)
    costs, ranks, audits = np.zeros((n, 4, 4), np.int64), np.zeros((n, 4, 4), np.int64), [[""] * 16 for _ in range(n)]
    order = np.argsort(blocks.sizes, kind="stable")
    at = 0
    while at < n:  # blocks of like size together, within a bound of audit letters
        size = int(blocks.sizes[order[at]])
        most = 4 * (1 << max(size, 1).bit_length())
        like = int(np.searchsorted(blocks.sizes[order], most // 4, side="left"))
        part = order[at:max(at + 1, min(like, at + _PATHS // (16 * most)))]
        at += len(part)
        sizes = blocks.sizes[part]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        rows = np.repeat(blocks.begins[part] - begins[:-1], sizes) + np.arange(begins[-1])
        initial, must_go, cut_off = blocks.initial[rows], blocks.must_go[rows], blocks.cut_off[rows]
        cost = _costs(sizes, begins, initial, must_go, cut_off)
        letter, pointer = _first_arcs(cost, begins, initial, must_go, cut_off)
        rank, jumps = _ranked(letter, pointer)
        entry = np.where(sizes > 0, begins[:-1], begins[-1] + np.arange(len(part)))
        node = (np.arange(4)[None, None, :] * cost.shape[1] + entry[:, None, None]) * 4 + np.arange(4)[None, :, None]  # block, from, to
        costs[part], ranks[part] = cost.ravel()[node], rank[node]
        spelled = _spelled(node.ravel(), letter, jumps)
        for i, b in enumerate(part.tolist()):
            audits[b] = spelled[16 * i:16 * i + 16]
    return costs, ranks, audits


class _Fold:
    """The way through the blocks of one conversation, fed their tables in order."""

    def __init__(self) -> None:
        self.cost, self.order, self.ways = {0: 0}, {0: 0}, []
        self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last, self.low, self.high = -1, None, None

    def step(self, costs: list[int], ranks: list[int], stats: dict[str, int]) -> None:
        best: dict = {}
        for q, cost in self.cost.items():
            for r in range(4):
                if costs[4 * q + r] < _INF:
                    best[r] = min(best.get(r, (_INF, 0, 0, 0)), (cost + costs[4 * q + r], self.order[q], ranks[4 * q + r], q))
        # Audits that end in different states differ before either ends, so their order is that of what was read so far.
        places = {key: i for i, key in enumerate(sorted({(order, rank) for _, order, rank, _ in best.values()}))}
        self.cost = {r: b[0] for r, b in best.items()}
        self.order = {r: places[b[1], b[2]] for r, b in best.items()}
        self.ways.append(tuple(best[r][3] if r in best else -1 for r in range(4)))
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.total[name] += stats[name]
        if stats["first"] >= 0:
            self.total["illegal"] += self.last >= 0 and (self.last, stats["first"]) not in ((0, 1), (1, 2), (2, 1))
            self.last = stats["last"]
        if stats["turns"]:
            self.total["turns"] -= self.high == stats["low"]
            self.low, self.high = stats["low"] if self.low is None else self.low, stats["high"]

    def finish(self) -> tuple[list[tuple[int, int]], dict[str, int]]:
        """(state before, state after) of each block, and the figures of the conversation."""
        end = min(self.cost, key=lambda r: (self.cost[r] + INSERT * len(_CLOSING[r]), self.order[r]))
        cost, states = self.cost[end] + INSERT * len(_CLOSING[end]), [end]
        for way in reversed(self.ways):
            states.append(way[states[-1]])
        states.reverse()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.total["turns"]
        return list(zip(states, states[1:])), {"gaps": gaps, "cost": cost, **{k: self.total[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


def _lines(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows that an audit makes of a block, begun in a state."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            state = int(_READ[state, "sua".find(roles[i][0])])
            out.append(f"{roles[i]}:{texts[i]}")
        else:
            state = int(_NEXT[state])
            out.append(f"{_ROLE[state]}:{texts[i] if letter == 'R' else ''}")
        i += letter != "I"
    return out


_FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_RESULT = f"conv_id bigint, {_FIGURES}, audit string, repaired_sha256 string, repaired string"
_NAMES = [part.split()[0] for part in _FIGURES.split(", ")]
_FIRST = f"{_RESULT}, block bigint, turns array<bigint>, roles array<string>, texts array<string>, digests array<binary>"


_TYPES = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
          "array<binary>": pa.list_(pa.binary())}


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of the first pass; columns that are not given are null."""
    fields = [(name, _TYPES[kind]) for name, kind in (part.split() for part in _FIRST.split(", "))]
    values = [columns.get(name, pa.nulls(n, kind)) for name, kind in fields]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) if isinstance(v, list) else v for v, (_, kind) in zip(values, fields)], names=[f for f, _ in fields])


def _starts(conv: pa.Array, bytes_of: np.ndarray, rows: int, most: int) -> np.ndarray:
    """Row numbers at which blocks begin."""
    n = len(conv)
    valid, value = pc.is_valid(conv).to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy(zero_copy_only=False)
    change = np.ones(n, dtype=bool)
    change[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
    first = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    upto = np.cumsum(bytes_of)
    before = upto - bytes_of
    filled = (before - before[first]) // most
    return np.flatnonzero(change | ((np.arange(n) - first) % rows == 0) | np.concatenate([[False], filled[1:] != filled[:-1]]))


def _first_pass(texts_too: bool, block_rows: int, block_bytes: int):
    def finished(conv: list, blocks: _Blocks, which: list[int]) -> dict[str, list]:
        costs, ranks, audits = solve(blocks)
        out: dict[str, list] = {name: [] for name in ("conv_id", *_NAMES, "audit", "repaired_sha256", "repaired")}
        for b in which:
            fold = _Fold()
            fold.step(costs[b].ravel().tolist(), ranks[b].ravel().tolist(), {k: int(v[b]) for k, v in blocks.stats.items()})
            ((_, end),), figures = fold.finish()
            audit = audits[b][end] + _CLOSING[end]
            part = slice(int(blocks.begins[b]), int(blocks.begins[b + 1]))
            text = "\n".join(_lines(audit, 0, blocks.roles[part], blocks.texts[part]))
            for name, value in {"conv_id": conv[b], **figures, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
                                "repaired": text if texts_too else None}.items():
                out[name].append(value)
        return out

    def cut(held: pa.Table, starts: np.ndarray, to: int) -> tuple[list, np.ndarray, pa.Table]:
        """The conversation of each block up to row ``to``, and its rows without the dropped ones."""
        conv = held.column("conv_id").combine_chunks().take(pa.array(starts)).to_pylist()
        stays = ~held.column("dropped").combine_chunks().to_numpy(zero_copy_only=False)[:to]
        begins = np.concatenate([[0], np.cumsum(stays)])[np.append(starts, to)]
        return conv, begins, held.slice(0, to).filter(pa.array(stays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: pa.Table | None = None
        opening: object = ()  # the conversation that the task's first row belongs to; its beginning may lie elsewhere
        split: object = ()  # the conversation whose earlier block has left already

        def emit(starts: np.ndarray, to: int, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            conv, begins, rows = cut(held, starts, to)
            following = held.column("conv_id")[to].as_py() if to < held.num_rows else None
            roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
            turns = rows.column("turn").combine_chunks()
            n = len(conv)
            alone = [conv[b] != opening and not (last and b == n - 1)
                     and (b == 0 or conv[b - 1] != conv[b]) and (b == n - 1 or conv[b + 1] != conv[b]) for b in range(n)]
            alone[0] &= conv[0] != split
            alone[-1] &= following != conv[-1] or to >= held.num_rows
            whole = [b for b in range(n) if alone[b]]
            rest = [b for b in range(n) if not alone[b]]
            size = np.diff(begins)

            def rows_of(which: list[int]) -> tuple[np.ndarray, list[int]]:
                index = [i for b in which for i in range(int(begins[b]), int(begins[b + 1]))]
                return np.concatenate([[0], np.cumsum(size[which])]).astype(np.int64), index

            if whole:
                own, index = rows_of(whole)
                blocks = _Blocks(own, turns.take(pa.array(index, pa.int64())), [roles[i] for i in index], [texts[i] for i in index])
                out = finished([conv[b] for b in whole], blocks, list(range(len(whole))))
                yield _batch(out, len(whole))
            if rest:
                own, index = rows_of(rest)
                keys = [conv[b] for b in rest for _ in range(int(size[b]))]
                digests = [xxhash.xxh3_128_digest(f"{k}\0{len(roles[i])}\0{roles[i]}{texts[i]}".encode()) for k, i in zip(keys, index)]
                offsets = pa.array(own.astype(np.int32))
                lists = {"turns": turns.take(pa.array(index, pa.int64())), "roles": pa.array([roles[i] for i in index], pa.string()),
                         "texts": pa.array([texts[i] for i in index], pa.string()), "digests": pa.array(digests, pa.binary())}
                out = {"conv_id": [conv[b] for b in rest], "block": list(range(number, number + len(rest))),
                       **{k: pa.ListArray.from_arrays(offsets, v) for k, v in lists.items()}}
                number += len(rest)
                yield _batch(out, len(rest))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if held is None:
                opening = new.column("conv_id")[0].as_py()
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            lengths = pc.add(pc.binary_length(held.column("text")), pc.binary_length(held.column("role"))).to_numpy()
            starts = _starts(held.column("conv_id").combine_chunks(), lengths, block_rows, block_bytes)
            if len(starts) > 1:
                to = int(starts[-1])
                yield from emit(starts[:-1], to, last=False)
                left, ahead = (held.column("conv_id")[i].as_py() for i in (to - 1, to))
                split = left if left == ahead else split
                held = held.slice(to).combine_chunks()
        if held is not None:
            yield from emit(np.array([0]), held.num_rows, last=True)

    return run


def _repeats(blocks: DataFrame) -> DataFrame:
    """``block, known``: positions of rows whose role and text an earlier block of the conversation has."""
    rows = blocks.select("block", F.posexplode("digests").alias("pos", "digest"))
    first = rows.groupBy("digest").agg(F.min("block").alias("first"), F.max("block").alias("to")).where("first < to").select("digest", "first")
    return (rows.join(first, "digest").where("first < block").groupBy("block").agg(F.collect_list("pos").alias("known")))


_TABLE = "conv_id bigint, block bigint, costs array<bigint>, ranks array<bigint>, audits array<string>, " + ", ".join(f"{s} bigint" for s in STATS)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        roles = batch.column("roles")
        sizes = roles.value_lengths().to_numpy().astype(np.int64)
        blocks = _Blocks(np.concatenate([[0], np.cumsum(sizes)]), batch.column("turns").flatten(), roles.flatten().to_pylist(),
                         batch.column("texts").flatten().to_pylist(), batch.column("known").to_pylist())
        costs, ranks, audits = solve(blocks)
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id"), batch.column("block"), pa.array(costs.reshape(-1, 16).tolist(), pa.list_(pa.int64())),
            pa.array(ranks.reshape(-1, 16).tolist(), pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())),
            *[pa.array(blocks.stats[s].astype(np.int64)) for s in STATS]], names=[part.split()[0] for part in _TABLE.split(", ")])


_WAY = f"block bigint, conv_id bigint, entry int, exit int, final boolean, {_FIGURES}"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their conversations: the state before and after each, and the figures at the last."""
    conv: object = ()
    fold, numbers = _Fold(), []

    def finish() -> pa.RecordBatch:
        ways, figures = fold.finish()
        n = len(ways)
        final = [False] * (n - 1) + [True]
        return pa.RecordBatch.from_arrays([
            pa.array(numbers, pa.int64()), pa.array([conv] * n, pa.int64()), pa.array([w[0] for w in ways], pa.int32()), pa.array([w[1] for w in ways], pa.int32()),
            pa.array(final), *[pa.array([figures[name] if f else None for f in final], pa.int64()) for name in _NAMES]],
            names=[part.split()[0] for part in _WAY.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                if numbers:
                    yield finish()
                conv, fold, numbers = row["conv_id"], _Fold(), []
            fold.step(row["costs"], row["ranks"], row)
            numbers.append(row["block"])
    if numbers:
        yield finish()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = [
            "\n".join(_lines(audit, entry, roles, texts)) for audit, entry, roles, texts in
            zip(*(batch.column(c).to_pylist() for c in ("audit", "entry", "roles", "texts")))]
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in ("conv_id", "block", "final", *_NAMES, "audit")], pa.array(pieces, pa.string())],
            names=["conv_id", "block", "final", *_NAMES, "audit", "piece"])


def _assembled(texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audits, texts, begun = hashlib.sha256(), [], [], False
        for batch in batches:
            for row in batch.to_pylist():
                audits.append(row["audit"])
                if row["piece"]:
                    sha.update((("\n" if begun else "") + row["piece"]).encode())
                    begun = True
                    if texts_too:
                        texts.append(row["piece"])
                if row["final"]:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["conv_id"]], pa.int64()), *[pa.array([row[name]], pa.int64()) for name in _NAMES], pa.array(["".join(audits)]),
                        pa.array([sha.hexdigest()]), pa.array(["\n".join(texts) if texts_too else None], pa.string())],
                        names=["conv_id", *_NAMES, "audit", "repaired_sha256", "repaired"])
                    sha, audits, texts, begun = hashlib.sha256(), [], [], False
    return run


def repair(rows: DataFrame, texts_too: bool = False, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired`` per conversation.

    ``rows`` has ``conv_id, turn, role, text`` without nulls in role and text, and ``dropped`` for rows of which only
    the conversation counts.  Rows go by turn, nulls first, and within a turn by role and text (their first 64
    characters, then a hash).  Rows without a conversation id are one conversation.  A conversation without rows has
    zeros, an empty audit and the hash of nothing.  ``repaired`` is null unless ``texts_too``.  Repeated rows are
    duplicates of one another; an empty table gives no rows.

    One conversation's audit and hash are values of one row, and SHA-256 runs from front to back: the pieces of a very
    long conversation pass through one task at the end, one by one, whatever their number.
    """
    first = stored(_arranged(rows).mapInArrow(_first_pass(texts_too, block_rows, block_bytes), _FIRST), "repaired")
    result = [part.split()[0] for part in _RESULT.split(", ")]
    whole = first.where("block is null").select(*result)
    blocks = first.where("block is not null").select("conv_id", "block", "turns", "roles", "texts", "digests")
    tables = stored(blocks.join(_repeats(blocks), "block", "left").drop("digests").mapInArrow(_tables, _TABLE), "repair-tables")
    ways = (tables.drop("audits").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_ways, _WAY))
    closing = F.when(F.col("final"), F.get(F.array(*[F.lit(c) for c in _CLOSING]), F.col("exit"))).otherwise("")
    chosen = ways.join(tables.select("block", "audits"), "block").withColumn(
        "audit", F.concat(F.get("audits", 4 * F.col("entry") + F.col("exit")), closing)).drop("audits", "exit")
    pieces = chosen.join(blocks.select("block", "roles", "texts"), "block").mapInArrow(
        _pieces, f"conv_id bigint, block bigint, final boolean, {_FIGURES}, audit string, piece string")
    return whole.unionByName(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_assembled(texts_too), _RESULT))
