"""Byte-bounded chunks: term windows and excerpt budgets."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cuelake.functions.text import numbered_line, sha_head
from cuelake.operators.ordered import BLOCK, RANGES, interval_lookup, neighbours, ordinal, running_sum, sorted_fold
from cuelake.session import cut, cut_counted

# ---- fixed values -------------------------------------------------------------------------------
WINDOW_BYTES = 10 * 1024   # a window closes with the line that reaches this size
EXCERPT_BYTES = 48 * 1024  # per topic
PAIR_FAN = 3               # partners a new scan may take
# -------------------------------------------------------------------------------------------------

BLOCK_BYTES = 16 << 20  # transcripts beyond this are cut into blocks of this size
SLICE_VIDEOS = 256      # videos of a topic folded at once; each task sends so many of a topic at most


def window_ranges(sizes: DataFrame, window_bytes: int = WINDOW_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Greedy windows over (video_id, cue_no, n_bytes): (video_id, window_no, first_cue, last_cue).

    The sum restarts at every boundary, so a boundary depends on the one before it.  A transcript of
    ordinary size is folded in one go; a longer one in blocks side by side (:func:`_split_ranges`).
    Only numbers pass through either way.
    """
    sizes = sizes.select("video_id", F.col("cue_no").cast("bigint").alias("cue_no"), "n_bytes")
    totals = sizes.groupBy("video_id").agg(F.sum("n_bytes").alias("t")).where(F.col("t") > block_bytes).select("video_id")
    huge = cut(totals)  # transcripts beyond one block: few, usually none
    if huge.isEmpty():
        return _fold_ranges(sizes, window_bytes)
    long = sizes.join(huge, "video_id", "left_semi")
    return _fold_ranges(sizes.join(huge, "video_id", "left_anti"), window_bytes).unionByName(
        _split_ranges(long, window_bytes, block_bytes))


def _fold_ranges(sizes: DataFrame, window_bytes: int) -> DataFrame:
    def step(state, rows):
        window, first, used = state
        upto, cues = np.cumsum(rows["n_bytes"]), rows["cue_no"]
        out, at = [], 0
        while at < len(cues):
            base = upto[at - 1] if at else 0
            stop = int(np.searchsorted(upto, base + window_bytes - used))
            first = int(cues[at]) if first is None else first
            if stop >= len(cues):
                used += int(upto[-1] - base)
                out.append((window, first, int(cues[-1])))
                break
            out.append((window, first, int(cues[stop])))
            window, first, used, at = window + 1, None, 0, stop + 1
        return (window, first, used), out

    parts = sorted_fold(sizes, ["video_id"], ["cue_no"], lambda: (0, None, 0), step,
                        "video_id BIGINT, window_no BIGINT, first_cue BIGINT, last_cue BIGINT")
    # A window that spans several Arrow batches reports once per batch.
    return parts.groupBy("video_id", "window_no").agg(
        F.min("first_cue").alias("first_cue"), F.max("last_cue").alias("last_cue"))


def _next_start(upto: np.ndarray, window_bytes: int) -> np.ndarray:
    """For a window starting at each row, the row after the one that closes it."""
    before = np.concatenate(([0], upto[:-1]))
    return np.searchsorted(upto, before + window_bytes) + 1


def _split_ranges(sizes: DataFrame, window_bytes: int, block_bytes: int) -> DataFrame:
    """The same windows for transcripts of any length, block by block in parallel.

    What crosses a block's edge is one number, the bytes of the window still open.  It can only
    matter within the first window's worth of rows, so a block sums up as a short table from that
    number to the one at its other edge.  Walking the tables of one transcript is the only serial
    part; then every block knows where its windows start.
    """
    placed = running_sum(sizes, ["video_id"], ["cue_no"], "n_bytes", "upto")
    placed = cut(placed.withColumn("block", F.floor((F.col("upto") - F.col("n_bytes")) / block_bytes).cast("bigint"))
                 .select("video_id", "block", "cue_no", "n_bytes"))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        upto = np.cumsum(pdf.sort_values("cue_no")["n_bytes"].to_numpy())
        nxt, n = _next_start(upto, window_bytes), len(upto)
        # exits[i]: bytes open at the end when a window starts at i; found by doubling the jumps.
        jump = np.append(np.where(nxt > n, np.arange(n), nxt), n)
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        open_bytes = np.where(jump < n, upto[-1] - np.concatenate(([0], upto))[np.minimum(jump, n)], 0)
        reach = min(int(np.searchsorted(upto, window_bytes)) + 1, n)
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[:1], "block": pdf["block"].iloc[:1], "total": int(upto[-1]),
                             "head": [upto[:reach].tolist()], "exits": [open_bytes[:reach + 1].tolist()]})

    tables = placed.groupBy("video_id", "block").applyInPandas(
        table, "video_id BIGINT, block BIGINT, total BIGINT, head ARRAY<BIGINT>, exits ARRAY<BIGINT>")

    def walk(used, rows):
        out = []
        for block, total, head, exits in zip(rows["block"], rows["total"], rows["head"], rows["exits"]):
            out.append((block, used))
            if used == 0:
                used = int(exits[0])
            elif used + total < window_bytes:
                used += int(total)
            else:
                used = int(exits[int(np.searchsorted(head, window_bytes - used)) + 1])
        return used, out

    entered = sorted_fold(tables, ["video_id"], ["block"], lambda: 0, walk, "video_id BIGINT, block BIGINT, used BIGINT")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cue_no")
        upto, used = np.cumsum(pdf["n_bytes"].to_numpy()), int(pdf["used"].iloc[0])
        nxt, n = _next_start(upto, window_bytes), len(upto)
        at = int(np.searchsorted(upto, window_bytes - used)) + 1 if used else 0
        found = []
        while at < n:
            found.append(at)
            at = int(nxt[at])
        return pdf.iloc[found][["video_id", "cue_no"]].rename(columns={"cue_no": "first_cue"})

    begun = placed.join(entered, ["video_id", "block"]).groupBy("video_id", "block").applyInPandas(
        starts, "video_id BIGINT, first_cue BIGINT")
    begun = ordinal(cut(begun), ["video_id"], ["first_cue"], "n")
    ends = sizes.groupBy("video_id").agg(F.max("cue_no").alias("end_cue"))
    ranged = neighbours(begun, ["video_id"], ["first_cue"], F.col("first_cue"), nxt="after").join(ends, "video_id")
    return ranged.select("video_id", (F.col("n") - 1).alias("window_no"), "first_cue",
                         F.coalesce(F.col("after") - 1, F.col("end_cue")).alias("last_cue"))


def term_windows(cues: DataFrame, sources: DataFrame, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """Windows with their numbered text and content id; windows of equal id are staged once.

    ``sources`` is (video_id, seq, srt_id).
    """
    text = F.concat(numbered_line(F.col("cue_no"), F.col("start_ms"), F.col("line")), F.lit("\n"))
    sizes = cues.select("video_id", "cue_no", F.octet_length(text).cast("bigint").alias("n_bytes"))
    spans = window_ranges(sizes, window_bytes).select(
        "video_id", "window_no", "first_cue", "last_cue", (F.col("first_cue") * 16).alias("lo"),
        ((F.col("last_cue") + 1) * 16).alias("hi"))
    placed = interval_lookup(cues.select("video_id", "cue_no", text.alias("t"), (F.col("cue_no").cast("bigint") * 16).alias("__p")),
                             spans, ["video_id"], "__p", "lo", "hi", how="inner")
    joined = placed.groupBy("video_id", "window_no", "first_cue", "last_cue").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("cue_no", "t"))), lambda x: x["t"]), "").alias("text"))
    named = joined.join(sources, "video_id").withColumn("id", sha_head(F.concat(
        F.lit("terms\n"), "srt_id", F.lit("\n"), F.col("first_cue").cast("string"), F.lit("-"),
        F.col("last_cue").cast("string"), F.lit("\n"), "text")))
    # Equal windows keep their first place; aggregated, so copies combine before the shuffle.  The id stands for the text,
    # which is not part of the place: a reader that does not want it has no text shuffled here.
    staged = named.groupBy("id").agg(F.min(F.struct("seq", "window_no", "video_id", "srt_id", "first_cue", "last_cue")).alias("w"),
                                     F.first("text").alias("text"))
    return staged.select("id", "w.*", "text")


def excerpt_sections(hits: DataFrame, videos: DataFrame, budget: int = EXCERPT_BYTES) -> DataFrame:
    """Sections each topic quotes: (topic, seq, video_id, srt_id, n_lines, n_bytes).

    Videos are taken in playlist order while the budget lasts: a section is ``== name`` and the hit
    lines that still fit; a video of which no line fits is passed over whole, later ones may fit; one
    section per subtitle.  Every quoted line takes at least one byte, so the first ``budget`` hits of
    a video are all that can matter: that limit is exact and applies before the shuffle.
    """
    order = Window.partitionBy("topic", "video_id").orderBy("cue_no")
    lines = hits.select("topic", "video_id", "cue_no", (F.octet_length("line") + 1).cast("bigint").alias("b"))
    lines = lines.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= budget)
    upto = lines.withColumn("upto", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.where(F.col("upto") - F.col("b") < budget)
    per_video = upto.groupBy("topic", "video_id").agg(F.array_sort(F.collect_list("upto")).alias("upto"))
    head = F.octet_length(F.concat(F.lit("== "), "file_name", F.lit("\n"))).cast("bigint")
    rows = per_video.join(videos.select("video_id", "seq", "srt_id", head.alias("head")), "video_id")
    # One row per topic and hit video: small beside the lines it came from, and read several times.
    return _fold_sections(_still_possible(cut(rows), budget), budget)


def _fold_sections(rows: DataFrame, budget: int) -> DataFrame:
    """The sections of each topic, its videos taken one by one in playlist order."""
    def step(state, batch):
        used, quoted = state
        out = []
        for seq, video, srt, head, upto in zip(*(batch[c] for c in ("seq", "video_id", "srt_id", "head", "upto"))):
            room = budget - used
            if used >= budget or srt in quoted or head >= room:
                continue
            fit = int(np.searchsorted(np.asarray(upto), room - head, side="right"))
            if fit == 0:
                continue
            size = int(head + upto[fit - 1])
            used += size
            quoted.add(srt)
            out.append((seq, video, srt, fit, size))
        return (used, quoted), out

    return sorted_fold(rows.select("topic", "seq", "video_id", "srt_id", "head", "upto"), ["topic"], ["seq"],
                       lambda: (0, set()), step,
                       "topic STRING, seq BIGINT, video_id BIGINT, srt_id STRING, n_lines BIGINT, n_bytes BIGINT")


def _still_possible(rows: DataFrame, budget: int) -> DataFrame:
    """Drops videos that cannot get a section, so that the fold reads few rows of any topic.

    The next ``SLICE_VIDEOS`` videos of each topic are folded behind those before them.  The room they leave only shrinks,
    so a later video whose heading and first line exceed it is out, and so is one whose subtitle is quoted by then; what
    remains is sliced again.  The first video of a slice always gets a section, and room runs out: how many slices there
    are follows from the budget, not from the number of videos.
    """
    slice_ = min(SLICE_VIDEOS, budget)
    need = F.col("head") + F.get("upto", F.lit(0))
    nth = F.row_number().over(Window.partitionBy("topic").orderBy("seq"))
    left, taken = rows.where(need <= budget), None
    while True:
        # A full slice may have videos behind it; the others are at their end.
        part, full = cut_counted(left.withColumn("__nth", nth).where(F.col("__nth") <= slice_),
                                 F.count_if(F.col("__nth") == slice_).alias("n"))
        taken = part.drop("__nth") if taken is None else taken.unionByName(part.drop("__nth"))
        if not full.n:
            return taken
        ends = part.where(F.col("__nth") == slice_).select("topic", F.col("seq").alias("__from"))
        sections = cut(_fold_sections(taken.join(F.broadcast(ends), "topic", "left_semi"), budget))
        room = sections.groupBy("topic").agg((F.lit(budget) - F.sum("n_bytes")).alias("__room"))
        # A row per topic with a full slice: at most one in ``slice_`` of the rows.
        known = F.broadcast(ends.join(room, "topic"))
        left = left.join(known, "topic").where((F.col("seq") > F.col("__from")) & (need <= F.col("__room"))).drop("__from", "__room")
        quoted = sections.select(F.col("topic").alias("__topic"), F.col("srt_id").alias("__srt"), F.lit(True).alias("__gone"))
        # An anti join would be moved below the room and shuffle every video.
        left = left.join(quoted, (F.col("topic") == F.col("__topic")) & F.col("srt_id").eqNullSafe(F.col("__srt")), "left")
        left = cut(left.where("__gone is null").drop("__topic", "__srt", "__gone"))


def excerpt_text(hits: DataFrame, sections: DataFrame, videos: DataFrame) -> DataFrame:
    """The excerpt of each topic, at most the budget long: (topic, n_sections, excerpt)."""
    order = Window.partitionBy("topic", "video_id").orderBy("cue_no")
    quoted = hits.join(sections.select("topic", "video_id", "seq", "n_lines"), ["topic", "video_id"])
    quoted = quoted.withColumn("nth", F.row_number().over(order)).where("nth <= n_lines")
    body = quoted.groupBy("topic", "video_id", "seq").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("cue_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("l"))
    body = body.join(videos.select("video_id", "file_name"), "video_id")
    text = F.concat(F.lit("== "), "file_name", F.lit("\n"), "l")
    return body.groupBy("topic").agg(
        F.count("*").alias("n_sections"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), text.alias("t")))),
                                 lambda x: x["t"]), "").alias("excerpt"))


RARE = 64  # scans that share a key of the first pass
GROUP_LATER, GROUP_EARLIER, KEYS_AT_ONCE = 1 << 10, 1 << 14, 512  # of a cell of the second pass
GROUP_LISTED = 1 << 23  # keys, repeats counted, that the lists of a group hold about


def pair_overlap(scans: DataFrame, keys: DataFrame, fan: int = PAIR_FAN, rare: int = RARE) -> DataFrame:
    """Each scan with its best earlier partners by shared quoted subtitles: (later, earlier, overlap, nth).

    ``scans`` is (seq, name, generated); generated ones neither look for partners nor are any.  ``keys`` is (name, key).
    More shared keys come first, then the younger partner.

    Keys of at most ``rare`` scans are paired; each pair's whole overlap is then the pairs it has plus what the scans share
    of their frequent keys, listed per scan.  Where pairs and the lists beside them would take more room than cells over
    all keys, fewer keys count as rare (``_rare_limit``).  A partner that shares no rare key cannot have more than the scan's frequent
    keys, so a scan whose ``fan`` partners all have more is done.  Only the others count their frequent keys against all
    earlier scans, in cells of bounded size that keep ``fan`` per scan; no key of n scans makes n^2 rows.
    """
    live = scans.where("not generated").select("seq", "name")
    n_live = live.count()
    # A catalogue of ordinary size goes to the keys; else all keys of a frequent name meet in one task, shuffled once more.
    held = cut(keys.join(F.broadcast(live) if n_live <= BLOCK else live, "name").select("key", "seq").distinct())
    sizes = held.groupBy("key").agg(F.count("*").alias("n"))
    marked = held.join(sizes.where("n > 1"), "key")
    rare = _rare_limit(sizes, n_live, rare)
    # Frequent keys go by number, in order: a list packs into about a byte a key on its way to the cells.
    numbers = ordinal(sizes.where(F.col("n") > rare).select("key"), [], ["key"], "id", RANGES).select("key", "id")
    frequent = cut(held.join(numbers, "key").groupBy("seq").agg(F.array_sort(F.collect_list("id")).alias("often")))
    sets = marked.where(F.col("n") <= rare).groupBy("key").agg(F.array_sort(F.collect_list("seq")).alias("s"))
    pairs = sets.select(F.explode("s").alias("later"), "s").select(
        "later", F.explode(F.filter("s", lambda x: x < F.col("later"))).alias("earlier"))
    counted = pairs.groupBy("later", "earlier").agg(F.count("*").alias("n"))
    often = lambda side: frequent.select(F.col("seq").alias(side), F.col("often").alias(f"of_{side}"))
    shared = F.coalesce(F.size(F.array_intersect("of_later", "of_earlier")), F.lit(0))
    near = counted.join(often("later"), "later", "left").join(often("earlier"), "earlier", "left").select(
        "later", "earlier", (F.col("n") + F.when(F.col("of_later").isNull() | F.col("of_earlier").isNull(), 0).otherwise(shared)).alias("overlap"))
    near = cut(_best(near, fan))
    settled = near.where(F.col("nth") == fan).select(F.col("later").alias("seq"), F.col("overlap").alias("least"))
    open_ = frequent.join(settled, "seq", "left").where("least is null or least <= size(often)").select("seq", "often")
    far = _frequent_overlap(open_, frequent, fan)
    return _best(near.drop("nth").unionByName(far).groupBy("later", "earlier").agg(F.max("overlap").alias("overlap")), fan)


def _rare_limit(sizes: DataFrame, n_scans: int, most: int) -> int:
    """Up to how many scans of a key are paired: the limit, ``most`` or below, at which pairs, lists beside pairs and cells take least bytes."""
    limits = [most] + [1 << i for i in reversed(range(most.bit_length())) if 1 << i < most]
    n = F.col("n")
    seen = sizes.agg(*[c for limit in limits for c in (
        F.coalesce(F.sum(F.when(n <= limit, n * (n - 1) / 2)), F.lit(0.0)), F.coalesce(F.sum(F.when(n > limit, n)), F.lit(0)))]).first()  # one row

    def room(i: int) -> float:
        pairs, listed = float(seen[2 * i]), int(seen[2 * i + 1])
        return pairs * (24 + 16 * listed / max(n_scans, 1)) + 8 * listed * sum(_cells(n_scans, listed, n_scans, listed))
    return limits[min(range(len(limits)), key=room)]


def _cells(n_later: int, in_later: int, n_earlier: int, in_earlier: int) -> tuple[int, int]:
    """Groups of later and of earlier scans: so many that neither the scans nor the keys of a group are too many."""
    return (max(-(-n_later // GROUP_LATER), -(-in_later // GROUP_LISTED)), max(-(-n_earlier // GROUP_EARLIER), -(-in_earlier // GROUP_LISTED)))


def _best(pairs: DataFrame, fan: int) -> DataFrame:
    rank = Window.partitionBy("later").orderBy(F.desc("overlap"), F.desc("earlier"))
    return pairs.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= fan)


def _frequent_overlap(later: DataFrame, earlier: DataFrame, fan: int) -> DataFrame:
    """(later, earlier, overlap): of every cell of later and earlier scans, the ``fan`` that share most."""
    counts = [F.count(F.lit(1)), F.coalesce(F.sum(F.size("often")), F.lit(0))]
    over, along = _cells(*later.agg(*counts).first(), *earlier.agg(*counts).first())
    schema = "later bigint, earlier bigint, overlap bigint"
    if not over or not along:
        return later.sparkSession.createDataFrame([], schema)

    def dealt(n: int):
        return F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int")

    later, earlier = (side.select(F.col("seq").cast("bigint").alias("seq"), _packed("often").alias("often")) for side in (later, earlier))
    left = later.select("seq", "often", dealt(over).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(along - 1))).alias("b"))
    right = earlier.select("seq", "often", F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias("a"), dealt(along).alias("b"))
    right = right.toDF(*right.columns)

    def cell(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("later", "earlier", "overlap")})
        mine, theirs = one.sort_values("seq"), other.sort_values("seq", ascending=False)
        left_, right_ = _by_key(mine["often"]), _by_key(theirs["often"])
        known = np.unique(left_[0])
        counts = np.zeros((len(mine), len(theirs)), dtype=np.float32)  # whole numbers below 2^24
        for begin in range(0, len(known), KEYS_AT_ONCE):
            part = known[begin:begin + KEYS_AT_ONCE]
            counts += _incidence(*left_, len(mine), part) @ _incidence(*right_, len(theirs), part).T
        x, y = mine["seq"].to_numpy(), theirs["seq"].to_numpy()
        counts[y[None, :] >= x[:, None]] = 0
        top = np.argsort(-counts, axis=1, kind="stable")[:, :fan]  # equal counts: the younger stands in front
        row = np.repeat(np.arange(len(x)), top.shape[1])
        found = counts[row, top.ravel()]
        some = found > 0
        return pd.DataFrame({"later": x[row][some], "earlier": y[top.ravel()][some], "overlap": found[some].astype(np.int64)})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(cell, schema)


@F.pandas_udf(BinaryType())
def _packed(lists: pd.Series) -> pd.Series:
    """Numbers in order as the steps between them, compressed."""
    return lists.map(lambda x: zlib.compress(np.diff(np.asarray(x, dtype=np.int64), prepend=0).tobytes(), 1))


def _by_key(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All keys of packed lists in order, and whose they are."""
    each = [np.cumsum(np.frombuffer(zlib.decompress(x), dtype=np.int64)) for x in lists]
    flat, owner = np.concatenate(each), np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    order = np.argsort(flat)
    return flat[order], owner[order]


def _incidence(flat: np.ndarray, owner: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    lo, hi = np.searchsorted(flat, keys[0], "left"), np.searchsorted(flat, keys[-1], "right")
    at = np.searchsorted(keys, flat[lo:hi])
    held = keys[at] == flat[lo:hi]
    out = np.zeros((n, len(keys)), dtype=np.float32)
    out[owner[lo:hi][held], at[held]] = 1
    return out
