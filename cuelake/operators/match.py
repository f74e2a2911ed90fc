"""Matching cues against the pattern catalogue, and what is counted from the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators import catalog
from cuelake.operators.ordered import (
    BLOCK, block_of, carry_forward, interval_lookup, neighbours, ordinal, running_sum)
from cuelake.session import cut

# Catalogue size up to which each pattern becomes a constant of the scan.
UNROLL_ROWS = 256
UNROLL_BYTES = 1 << 20
# Size of one broadcast slice of a larger catalogue.
SLICE_BYTES = 8 << 20

EVIDENCE_CAP = 500  # listing cap per video; counts are never capped


def pattern_text(typed: Column, is_regex: bool = True, case_sensitive: bool = True) -> Column:
    """What the user typed as a pattern: literal text is quoted, case folding is a prefix."""
    body = typed if is_regex else F.concat(F.lit(r"\Q"), F.replace(typed, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return body if case_sensitive else F.concat(F.lit("(?i)"), body)


def pattern_filter(cues: DataFrame, typed: str, is_regex: bool = True, case_sensitive: bool = True) -> DataFrame:
    return cues.where(F.rlike("line", pattern_text(F.lit(typed), is_regex, case_sensitive)))


def pattern_guard(plan: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Adds ``valid`` and ``problem``: syntax by the JVM's own compiler, then the dialect lint.

    Constructs that the JVM accepts with another meaning are reported, not guessed at.
    """
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(pattern))
    text = F.col(pattern)
    bare = F.regexp_replace(text, r"\\.", "_")  # an escaped bracket opens no class
    problem = (
        F.when(text.isNull(), F.lit("no pattern"))
        .when(compiled.isNull(), F.lit("invalid syntax"))
        .when(bare.rlike(r"\[\[:\^?[a-z]+:\]"), F.lit("POSIX class"))
        .when(bare.rlike(r"\[[^\]]*\[[^\]]*\]"), F.lit("nested class")))
    return plan.withColumn("problem", problem).withColumn("valid", problem.isNull())


def match_join(cues: DataFrame, plan: DataFrame, line: str = "line") -> DataFrame:
    """One row per (pattern row, cue) whose line matches; carries ``name`` from the plan.

    A catalogue of checked size is unrolled into the scan: every pattern is a constant, compiled once
    per task, and the cues pass through without a join or a shuffle.  A larger one is cut into slices
    of bounded size, each broadcast against one pass over the cues; the union is the same result.
    """
    small = plan.select("name", "pattern")
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("b")).first()
    if size.n <= UNROLL_ROWS and size.b <= UNROLL_BYTES:
        rows = small.collect()  # at most UNROLL_ROWS rows
        if not rows:
            return cues.withColumn("name", F.lit("")).where("false")
        fired = F.array_compact(F.array(*[
            F.when(F.col(line).rlike(r["pattern"]), F.lit(r["name"])) for r in rows]))
        return cues.withColumn("name", F.explode(fired))
    return match_slices(cues, small, line)


def match_slices(cues: DataFrame, plan: DataFrame, line: str = "line") -> DataFrame:
    """Theta join on "line matches", one pass over the cues per slice of the catalogue.

    Slices are cut in the order of a hash of the name, so that their sizes add up in even blocks.
    """
    sized = plan.withColumn("__b", (F.octet_length("pattern") + F.octet_length("name")).cast("bigint")).withColumn("__h", F.xxhash64("name"))
    upto = running_sum(sized, [], ["__h", "name"], "__b", "__upto", F.shiftright("__h", 52))
    sliced = cut(upto.select("name", "pattern", F.floor((F.col("__upto") - 1) / SLICE_BYTES).alias("__slice")))
    last = sliced.agg(F.max("__slice")).first()[0]
    out = cues.withColumn("name", F.lit("")).where("false")
    for i in range(0 if last is None else last + 1):
        # A slice ends with the pattern that crosses the mark, so it exceeds it by one pattern at most.
        part = F.broadcast(sliced.where(F.col("__slice") == i).drop("__slice"))
        out = out.unionByName(cues.join(part, F.rlike(line, F.col("pattern"))).drop("pattern"))
    return out


def scan_hits(cues: DataFrame, plan: DataFrame) -> DataFrame:
    """Hits of the valid patterns: (topic, video_id, cue_no, start_ms, line)."""
    good = pattern_guard(plan).where("valid")
    return match_join(cues, good).select(F.col("name").alias("topic"), "video_id", "cue_no", "start_ms", "line")


def topic_scope(hits: DataFrame, video_topics: DataFrame) -> DataFrame:
    """A video that lists topics takes part only in those, one that lists none in all."""
    listed = video_topics.groupBy("video_id").agg(F.collect_set("topic").alias("__topics"))
    joined = hits.join(listed, "video_id", "left")
    return joined.where(F.col("__topics").isNull() | F.array_contains("__topics", F.col("topic"))).drop("__topics")


def videos_matching(cues: DataFrame, videos: DataFrame, typed: str) -> DataFrame:
    return videos.join(pattern_filter(cues, typed).select("video_id"), "video_id", "left_semi")


def tally(cues: DataFrame, pattern: str) -> DataFrame:
    """Matches per video, zero-length ones included; videos without a match count zero."""
    return cues.groupBy("video_id").agg(F.sum(F.regexp_count("line", F.lit(pattern)).cast("bigint")).alias("n_matches"))


def match_offsets(cues: DataFrame, pattern: str) -> DataFrame:
    """Non-empty matches with their start offset: (video_id, cue_no, nth, offset, match).

    Each match is wrapped in marks; cutting there leaves gaps and matches in turn, and the lengths
    in front of a match add up to its offset.  A rendered line has no line break, which the mark begins with.
    """
    mark = "\n\u0000"
    pieces = F.split(F.regexp_replace("line", F.lit(pattern), F.lit(f"{mark}$0{mark}")), mark)
    cut = cues.where(F.col("line").rlike(pattern)).select("video_id", "cue_no", pieces.alias("p")).where(F.size("p") > 2)
    at = cut.select("video_id", "cue_no", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))).alias("i"))
    before = F.aggregate(F.slice("p", F.lit(1), F.col("i")), F.lit(0), lambda acc, x: acc + F.length(x))
    rows = at.select("video_id", "cue_no", F.expr("(i + 1) div 2").cast("int").alias("piece"),
                     before.alias("offset"), F.get("p", F.col("i")).alias("match"))
    return rows.where("match <> ''")


def visible_match_count(cues: DataFrame, pattern: str) -> DataFrame:
    count = F.size(F.filter(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda m: m != ""))
    return cues.groupBy("video_id").agg(F.sum(count.cast("bigint")).alias("n_visible"))


def evidence_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("topic", "video_id").agg(F.count("*").alias("n_hits"))


def evidence_cap(hits: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """First ``cap`` hits per (topic, video); the limit is applied before and after the shuffle."""
    order = Window.partitionBy("topic", "video_id").orderBy("cue_no")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap)


def context_snippet(hits: DataFrame, cues: DataFrame) -> DataFrame:
    """Hits with the lines before and after, and with their own where they come with its ``line_key`` (xxhash64) only.

    Hits and cues go through one shuffle, by video and block of cue numbers, and one window over both: a hit reads the
    lines one cue number below and above its own.  A cue beside the end of a block stands in both blocks.
    """
    block = lambda d: F.expr(f"cast(floor((cue_no + {d}) / {BLOCK}) as bigint)")
    spoken = cues.where("video_id is not null and cue_no is not null and line is not null").select(
        "video_id", "cue_no", F.col("line").alias("__l"), F.explode(F.array_distinct(F.array(block(0), block(2)))).alias("__blk"))
    asked = hits.withColumn("__blk", block(1)).withColumn("__hit", F.lit(True))
    near = Window.partitionBy("video_id", "__blk").orderBy("cue_no")
    both = asked.unionByName(spoken, allowMissingColumns=True)
    sides = both.withColumn("prev_line", F.max("__l").over(near.rangeBetween(-1, -1))).withColumn(
        "next_line", F.max("__l").over(near.rangeBetween(1, 1)))
    if "line" not in hits.columns:
        own = F.collect_list("__l").over(near.rangeBetween(0, 0))  # one, unless a number was given twice
        sides = sides.withColumn("line", F.get(F.filter(own, lambda x: F.xxhash64(x) == F.col("line_key")), F.lit(0))).drop("line_key")
    return sides.where("__hit").drop("__l", "__blk", "__hit")


def match_ordinals(cues: DataFrame, videos: DataFrame, pattern: str) -> DataFrame:
    """Each visible match with its 1-based index in the video and in the corpus (playlist order)."""
    rows = match_offsets(cues, pattern)
    inside = ordinal(rows, ["video_id"], ["cue_no", "offset"], "in_video")
    counts = rows.groupBy("video_id").agg(F.count("*").alias("n"))
    ranked = running_sum(videos.select("video_id", "seq").join(counts, "video_id"), [], ["seq"], "n", "upto")
    before = ranked.select("video_id", (F.col("upto") - F.col("n")).alias("before"))
    return inside.join(before, "video_id").select(
        "video_id", "cue_no", "offset", "in_video", (F.col("before") + F.col("in_video")).alias("in_corpus"))


def next_hit(hits: DataFrame) -> DataFrame:
    """Next and previous hit of each hit in its video, wrapping at the ends."""
    n = neighbours(hits, ["topic", "video_id"], ["cue_no"], F.col("cue_no"), "nxt", "prv", "fst", "lst")
    return n.select(
        "topic", "video_id", "cue_no", F.coalesce("nxt", "fst").alias("next_cue"),
        F.col("nxt").isNull().alias("next_wrapped"), F.coalesce("prv", "lst").alias("prev_cue"),
        F.col("prv").isNull().alias("prev_wrapped"))


def landing_hit(anchors: DataFrame, hits: DataFrame) -> DataFrame:
    """First hit at or after the anchor's cue, else the first hit of the video.

    ``anchors`` is (anchor_id, video_id, anchor_cue).  The hits of a video tile its cue numbers into
    half-open stretches (previous hit, hit], so the lookup is an equi-join on cue blocks.
    """
    h = neighbours(hits.select("video_id", F.col("cue_no").cast("bigint").alias("hit")), ["video_id"], ["hit"],
                   F.col("hit"), prev="prv")
    # Cue numbers are scaled so that one lookup bucket spans one block of cues.
    spans = h.select("video_id", (F.coalesce(F.col("prv") + 1, F.lit(0)) * 16).alias("lo"),
                     ((F.col("hit") + 1) * 16).alias("hi"), "hit")
    points = anchors.withColumn("__p", F.col("anchor_cue").cast("bigint") * 16)
    found = interval_lookup(points, spans, ["video_id"], "__p", "lo", "hi").drop("__p", "lo", "hi")
    firsts = hits.groupBy("video_id").agg(F.min("cue_no").cast("bigint").alias("__first"))
    return (found.join(firsts, "video_id", "left")
            .select("anchor_id", "video_id", "anchor_cue", F.coalesce("hit", "__first").alias("landing_cue"),
                    (F.col("hit").isNull() & F.col("__first").isNotNull()).alias("wrapped")))


def hop_video(videos: DataFrame, hit_videos: DataFrame) -> DataFrame:
    """Nearest playlist neighbour with a hit, cyclically, in both directions, never the video itself."""
    marked = videos.select("video_id", "seq").join(
        hit_videos.select("video_id", F.lit(True).alias("hit")), "video_id", "left")
    target = F.when(F.col("hit"), F.struct("seq", "video_id"))
    known = _hits_around(marked.withColumn("target", target))
    return known.select("video_id", "seq", F.col("after.video_id").alias("next_video"),
                        F.col("before.video_id").alias("prev_video"))


def _hits_around(marked: DataFrame) -> DataFrame:
    """Nearest non-null target strictly behind and in front of each row, wrapping around."""
    only = marked.where("target is not null")
    near = neighbours(only, [], ["seq"], F.col("target"), "nxt", "prv", "fst", "lst").select(
        "seq", F.coalesce("nxt", "fst").alias("after"), F.coalesce("prv", "lst").alias("before"),
        F.col("target").alias("own"))
    # A row without a hit takes the last hit in front of it; what follows that hit follows the row.
    spread = carry_forward(marked.join(near.select("seq", F.struct("own", "after", "before").alias("n")), "seq", "left"),
                           [], ["seq"], {"n": "last_n"}, block_of("seq"))
    edges = only.agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    full = spread.join(F.broadcast(edges))  # one row
    own = F.col("n").isNotNull()
    after = F.when(own, F.col("n.after")).otherwise(F.coalesce(F.col("last_n.after"), F.col("lo")))
    before = F.when(own, F.col("n.before")).otherwise(F.coalesce(F.col("last_n.own"), F.col("hi")))
    strange = lambda c: F.when(c["seq"] != F.col("seq"), c)
    return full.select("video_id", "seq", strange(after).alias("after"), strange(before).alias("before"))


def step_video(videos: DataFrame) -> DataFrame:
    n = neighbours(videos.select("video_id", "seq"), [], ["seq"], F.col("video_id"), "nxt", "prv", "fst", "lst")
    return n.select("video_id", "seq", F.coalesce("nxt", "fst").alias("next_video"),
                    F.coalesce("prv", "lst").alias("prev_video"))


def with_components(hits: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``parts``: the components that fired in the hit's line, each once; NULL or empty where none did.

    A component fired when its group took part in any of the successive matches of the line, be it with nothing in it.
    A plan of at most ``SLICE_BYTES`` goes to the hits, which stay where they are, however many there are of a topic; a larger
    one meets them by topic.
    """
    named = plan.where(F.size("parts") > 0).select(
        F.col("name").alias("topic"), "pattern", F.col("parts").alias("__parts"), catalog.capture_count(F.col("pattern")).alias("n"))
    named = named.select("topic", F.struct("pattern", "n", participation("pattern", "__parts").alias("probe"), _notes("__parts", "n").alias("notes"),
                                           F.col("__parts").alias("parts")).alias("__plan"))
    room = named.agg(F.coalesce(F.sum(F.octet_length("__plan.probe") + F.octet_length("__plan.notes") + 64 * F.size("__plan.parts")), F.lit(0))).first()[0]
    of, line = lambda name: F.col(f"__plan.{name}"), F.col("line")

    def some(group: Column) -> Column:
        return F.exists(F.regexp_extract_all("line", of("probe"), group), lambda x: x != "")

    def nothing(part: Column) -> Column:
        return (line == "") & F.rlike(line, F.concat(F.lit("(?>"), of("pattern"), F.lit(")(?=\\"), part["group_idx"].cast("string"), F.lit(")")))

    def by_groups(part: Column, i: Column) -> Column:
        return some(part["group_idx"]) | some(of("n") + 2 * i + 1) | some(of("n") + 2 * i + 2) | nothing(part)

    def noted(notes: Column):
        def fired(part: Column, i: Column) -> Column:
            mark = F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002"))
            return F.contains(F.replace(notes, F.concat(mark, F.lit("\u0003")), F.lit("")), mark) | nothing(part)
        return fired

    # One pass over a line notes all groups of all its matches; a line that holds the marks itself is read group by group.
    notes = F.when(~line.rlike("[\u0001-\u0003]"), F.regexp_replace(line, of("probe"), of("notes")))
    fired = F.get(F.transform(F.array(notes), lambda n: F.when(n.isNull(), F.filter(of("parts"), by_groups)).otherwise(
        F.filter(of("parts"), noted(n)))), F.lit(0))
    return hits.join(F.broadcast(named) if room <= SLICE_BYTES else named, "topic", "left").withColumn(
        "parts", F.array_distinct(F.transform(fired, lambda p: p["part"]))).drop("__plan")


def _notes(parts: str, n: str) -> Column:
    """What replaces a match of the probe: per part its mark, and between two more what its group and its two notes hold."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(
        F.lit("\u0001"), i.cast("string"), F.lit("\u0002$"), p["group_idx"].cast("string"), F.lit("$"), (F.col(n) + 2 * i + 1).cast("string"),
        F.lit("$"), (F.col(n) + 2 * i + 2).cast("string"), F.lit("\u0003"))), "")


def attribute_components(hits: DataFrame, plan: DataFrame) -> DataFrame:
    """Components that fired in a hit line: (topic, video_id, cue_no, part), each once."""
    # The outer form keeps Catalyst from pushing a second copy of the matching below as a filter.
    return with_components(hits, plan).select("topic", "video_id", "cue_no", F.explode_outer("parts").alias("part")).where("part is not null")


def participation(pattern: str, parts: str) -> Column:
    """The pattern with two groups more per part, one of which holds a character where the part took part with nothing.

    A reference back to a group fails if the group took no part.  Behind the whole pattern (atomic, so that its matches
    stay what they are) each part's reference is tried; if it holds, the character in front of it or behind it is noted.
    Only an empty line has neither.
    """
    note = F.transform(parts, lambda p: F.concat(F.lit("(?:(?=\\"), p["group_idx"].cast("string"), F.lit(r")(?:(?<=((?s:.)))|(?=((?s:.))))|)")))
    return F.concat(F.lit("(?>"), pattern, F.lit(")"), F.array_join(note, ""))
