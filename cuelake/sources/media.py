"""File listings: pairing videos with subtitles, frame picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.ordered import interval_lookup
from cuelake.session import cut


def _without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def _has_extension(path: Column) -> Column:
    return path.rlike(r"\.[^./]*$")


def srt_for_video(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, srt): ``V.EXT.srt`` first, ``V.srt`` second, NULL when neither is listed."""
    wanted = videos.select("path", F.explode(F.array(
        F.struct(F.lit(1).alias("priority"), F.concat("path", F.lit(".srt")).alias("srt")),
        F.struct(F.lit(2).alias("priority"), F.when(_has_extension(F.col("path")), F.concat(
            _without_extension(F.col("path")), F.lit(".srt"))).alias("srt")))).alias("w")).select("path", "w.*")
    found = wanted.join(listing.select(F.col("file").alias("srt")).distinct(), "srt")
    best = found.groupBy("path").agg(F.min_by("srt", "priority").alias("srt"))
    return videos.select("path").join(best, "path", "left")


def video_for_srt(listing: DataFrame) -> DataFrame:
    """Per listed subtitle: (srt, video, status, n_candidates); several siblings are ambiguous.

    Every other file offers each of its dotted prefixes as a key, so the sibling search is an equi-join.
    """
    files = listing.select("file").distinct()
    srts = files.where(F.col("file").endswith(".srt")).select(
        F.col("file").alias("srt"), F.regexp_replace("file", r"\.srt$", "").alias("stem"))
    exact = files.select(F.col("file").alias("stem"), F.col("file").alias("exact"))
    others = files.where(~F.col("file").endswith(".srt"))
    name = F.substring_index("file", "/", -1)
    folder = F.expr("left(file, length(file) - length(substring_index(file, '/', -1)))")
    dots = F.expr("length(substring_index(file, '/', -1)) - length(replace(substring_index(file, '/', -1), '.', ''))")
    prefixes = (others.select("file", folder.alias("folder"), name.alias("base"), dots.alias("dots")).where("dots > 0")
                .withColumn("n", F.explode(F.sequence(F.lit(1), F.col("dots")))))
    keyed = prefixes.select("file", F.concat("folder", F.expr("substring_index(base, '.', n)")).alias("stem"))
    siblings = keyed.groupBy("stem").agg(F.count("*").alias("n"), F.min("file").alias("sibling"))
    joined = srts.join(exact, "stem", "left").join(siblings, "stem", "left")
    status = (F.when(F.col("exact").isNotNull(), F.lit("exact")).when(F.col("n") == 1, F.lit("sibling"))
              .when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("missing")))
    return joined.select(
        "srt", F.coalesce("exact", F.when(F.col("n") == 1, F.col("sibling"))).alias("video"), status.alias("status"),
        F.when(F.col("exact").isNotNull(), F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint")
        .alias("n_candidates"))


def picks_scan(raw: DataFrame, key: str = "video_id") -> DataFrame:
    """Pick lines ``hit prev next`` to (key, hit_ms, prev_ms, next_ms); the last write of a hit wins.

    ``raw`` is (key, line_no, value).  Lines without exactly three columns are dropped, a number that
    does not parse counts as 0, and -1 means no pick on that side.
    """
    cols = F.split(F.btrim(F.regexp_replace("value", r"\s+", " ")), " ")
    num = lambda i: F.coalesce(F.get(cols, F.lit(i)).try_cast("bigint"), F.lit(0))
    side = lambda c: F.when(c >= 0, c)
    rows = raw.where(F.size(cols) == 3).select(key, "line_no", num(0).alias("hit_ms"),
                                               F.struct(num(1).alias("p"), num(2).alias("n")).alias("pick"))
    last = rows.groupBy(key, "hit_ms").agg(F.max_by("pick", "line_no").alias("pick"))
    return last.select(key, "hit_ms", side(F.col("pick.p")).alias("prev_ms"), side(F.col("pick.n")).alias("next_ms"))


def line_to_time(requests: DataFrame, stamps: DataFrame) -> DataFrame:
    """Start time of the last timestamp line at or before a file line, minus the preroll, never below 0.

    ``requests`` is (request_id, video_id, top, zero_based, preroll_ms); ``stamps`` is
    :func:`cuelake.sources.srt.line_times`.  Lookup bucket: 4096 file lines.
    """
    stamps = cut(stamps)  # read for short and for long spans; the files are cut into lines once
    spans = stamps.select("video_id", (F.col("line_no") * 16).alias("lo"),
                          F.coalesce(F.col("until") * 16, F.col("line_no") * 16 + F.lit(1 << 57)).alias("hi"), "t_ms")
    top = F.col("top") + F.when(F.col("zero_based"), F.lit(1)).otherwise(F.lit(0))
    points = requests.withColumn("__p", (top * 16).cast("bigint"))
    found = interval_lookup(points, spans, ["video_id"], "__p", "lo", "hi")
    return found.select("request_id", "video_id", F.greatest(
        F.coalesce("t_ms", F.lit(0)) - F.col("preroll_ms"), F.lit(0)).cast("bigint").alias("seek_ms"))
