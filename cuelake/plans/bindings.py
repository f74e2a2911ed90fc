"""Inputs of the registered queries, derived by Spark from the given tables.

Every binding has a twin of the same name in :mod:`cuelake.plans.oracle`.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import base_name, sha_head
from cuelake.operators.ordered import RANGES, ordinal
from cuelake.session import spread

# A small literal catalogue: (seq, name, fragments).
TOPICS = [
    (0, "english", ["(that|than)"]),
    (1, "german", ["(?:nicht|", "auf)"]),
    (2, "mixed", [r"(\{english:})|(\{german:})|[Pp]our"]),
    (3, "article", ["(?i:the |les |der )"]),
    (4, "broken", ["(unclosed"]),
    (5, "nohit", ["qqqzz"]),
    (6, "term1", ["(?i:wh)"]),
    (7, "focus1", ["ou[eu]x?"]),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One cue per document line, three seconds apart."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    cues = docs.select(F.col("doc_id").alias("video_id"),
                       F.posexplode(F.split("text", "\n")).alias("cue_no", "line"))
    start = F.col("cue_no").cast("bigint") * 3000
    return cues.select("video_id", "cue_no", start.alias("start_ms"), (start + 2500).alias("end_ms"), "line")


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    """``lines`` where every fifth cue stays open over its successors."""
    longer = F.when(F.col("cue_no") % 5 == 0, F.col("end_ms") + 4000).otherwise(F.col("end_ms"))
    return lines(spark, sf).withColumn("end_ms", longer)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("turn") * 5000
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("cue_no"),
        start.alias("start_ms"), (start + 4000).alias("end_ms"),
        F.btrim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """The playlist: one entry per document; names collide and subtitles are shared on purpose."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    ranked = ordinal(docs, [], ["doc_id"], "pos", RANGES)
    pair = F.expr("doc_id div 2")
    stem = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("Clip né ")).otherwise(F.lit("clip né ")),
                    pair.cast("string"))
    path = F.concat_ws("/", F.lit("/v"), "lang", "source", F.concat(stem, F.lit(".final.mp4")))
    srt = F.concat(F.lit("/s/"), F.col("lang"), F.lit("/clip"), F.expr("doc_id div 4").cast("string"), F.lit(".srt"))
    return ranked.select(F.col("doc_id").alias("video_id"), (F.col("pos") - 1).alias("seq"),
                         path.alias("path"), base_name(path).alias("file_name"), srt.alias("srt_path"),
                         sha_head(srt).alias("srt_id"))


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "seq INT, name STRING, fragments ARRAY<STRING>")


def video_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth video takes part in one topic only; the others are unrestricted."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id")).where("video_id % 4 = 0")
    return docs.select("video_id", F.when(F.col("video_id") % 8 == 0, F.lit("mixed"))
                       .otherwise(F.lit("article")).alias("topic"))


@cache
def n_documents(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "documents").count()


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Playback positions: one per event, each day of a session in another video."""
    return positions_of(table(spark, sf, "events"), n_documents(spark, sf))


def positions_of(events: DataFrame, n: int) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id"), F.col("user_id").alias("session"),
        ((F.col("user_id") * 13 + F.floor(F.unix_micros(ts) / 86_400_000_000)) % n).alias("video_id"), ts.alias("ts"),
        F.floor(F.col("value") * 100).cast("bigint").alias("t_ms"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """User actions: a facet that the action left untouched is NULL."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(kind == "error", F.lit("undo")).when(kind == "purchase", F.lit("redo"))
        .otherwise(F.lit("act")).alias("op"),
        F.when(kind == "view", F.col("event_id") % n_documents(spark, sf)).alias("video_id"),
        F.when(kind == "click", F.floor(F.col("value") * 10).cast("bigint")).alias("cursor"),
        F.when(kind == "signup", F.get(F.array(*[F.lit(p) for p in SEARCHES]), (F.col("event_id") % len(SEARCHES))
                                       .cast("int"))).alias("pattern"))


# Search patterns drawn by the derived search log.
SEARCHES = [
    "that|than", "than|that", "(?i:That|than)", "(?:that|than)", "[Tt]han", "(?i:than)", "nicht|auf",
    "(auf)|nicht", "pour", " pour", "[a-c]x|[cab]x", "(a)\\1",
]


def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """Committed searches in time order: (seq, pattern)."""
    return actions(spark, sf).where("pattern is not null").select("event_id", "ts", "session", "pattern")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame vectors, one per second of a video (the vectors are brought to the 0..255 range)."""
    e = ordinal(table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("video_id"),
                                                      "embedding"),
                ["video_id"], ["vec_id"], "pos", RANGES)
    return e.select("video_id", ((F.col("pos") - 1) * 1000).alias("t_ms"),
                    F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int")).alias("px"))


def srt_files(spark: SparkSession, sf: str, canonical: bool = False) -> DataFrame:
    """Documents rendered as subtitle files: (video_id, content), one cue per line.

    Layout by ``video_id % 6``: canonical; CRLF; no counters; bare CR and period stamps; no blank
    lines; banner and trailing junk.  Encoding by ``video_id % 5``: UTF-8, UTF-8 with mark, UTF-16LE,
    UTF-16BE, Latin text as Windows-1252.
    """
    return render_srt(spread(table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), "text")), canonical)


def render_srt(docs: DataFrame, canonical: bool = False) -> DataFrame:
    mode = F.lit(0) if canonical else F.col("video_id") % 6
    encoding = F.lit(0) if canonical else F.col("video_id") % 5

    def stamp(ms):
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"),
                        two(F.floor(ms / 1000) % 60), F.when(mode == 3, F.lit(".")).otherwise(F.lit(",")),
                        F.lpad((ms % 1000).cast("string"), 3, "0"))

    def cue(line, at):
        start = at.cast("bigint") * 3000
        return F.concat(
            F.when(mode == 2, F.lit("")).otherwise(F.concat((at + 1).cast("string"), F.lit("\n"))),
            stamp(start), F.lit(" --> "), stamp(start + 2500), F.when(mode == 5, F.lit(" X1:0 Y2:9")).otherwise(F.lit("")),
            F.lit("\n"), line, F.when(mode == 4, F.lit("\n")).otherwise(F.lit("\n\n")))

    body = F.array_join(F.transform(F.split("text", "\n"), cue), "")
    files = docs.select("video_id", F.concat(F.when(mode == 5, F.lit("ripped by nobody\n\n")).otherwise(F.lit("")), body).alias("srt"))
    broken = F.when(mode == 1, F.replace("srt", F.lit("\n"), F.lit("\r\n"))).when(
        mode == 3, F.replace("srt", F.lit("\n"), F.lit("\r"))).otherwise(F.col("srt"))
    files = files.select("video_id", broken.alias("srt"))
    return files.select("video_id", encode_text(F.col("srt"), encoding).alias("content"))


def encode_text(text, encoding):
    latin = text.rlike("^[\\x00-\\x7f\\xa0-\\xff]*$")
    mark = lambda digits: F.unhex(F.lit(digits))
    return (
        F.when(encoding == 1, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")))
        .when(encoding == 2, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")))
        .when(encoding == 3, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .when((encoding == 4) & latin, F.encode(text, "ISO-8859-1"))
        .otherwise(F.encode(text, "UTF-8")))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A directory listing: videos, subtitles under either naming, a few stray siblings."""
    v = videos(spark, sf).select("video_id", "path")
    stem = F.regexp_replace("path", r"\.mp4$", "")
    k = F.col("video_id")
    files = F.array_compact(F.array(
        F.when(k % 13 != 0, F.col("path")),
        F.when((k % 3 == 0) | (k % 5 == 0), F.concat("path", F.lit(".srt"))),
        F.when((k % 3 == 1) | (k % 5 == 0), F.concat(stem, F.lit(".srt"))),
        F.when(k % 7 == 0, F.concat(stem, F.lit(".jpg")))))
    return v.select(F.explode(files).alias("file")).distinct()


def doc_words(spark: SparkSession, sf: str, all_of: Column | None = None) -> DataFrame:
    """The first, the middle and the last word of each whole text; where ``all_of`` does not hold, only the first.

    Cutting a text into all its words is most of the cost, and its first one is found without that.
    """
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    if all_of is not None:
        first = F.regexp_extract("text", "[a-z]+", 0)
        words = F.when(all_of, words).otherwise(F.when(first != "", F.array(first)))
    docs = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    pick = lambda i, other: F.coalesce(F.get("w", i), F.lit(other))
    picked = F.struct(pick(F.lit(0), "xx").alias("w1"), pick(F.expr("cast(size(w) div 2 as int)"), "yy").alias("w2"),
                      pick(F.size("w") - 1, "zz").alias("w3"))
    if all_of is not None:
        picked = F.struct(picked["w1"].alias("w1"), *[F.when(all_of, picked[c]).alias(c) for c in ("w2", "w3")])
    # Behind a generator no reader, and no filter pushed below, cuts the texts into words once more.
    return docs.select("doc_id", F.inline_outer(F.array(picked)))


def doc_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """One pattern per document, in four spellings: (seq, pattern)."""
    k, w1, w2, w3 = F.col("doc_id") % 4, F.col("w1"), F.col("w2"), F.col("w3")
    first = F.substring("w1", 1, 1)
    pattern = (
        F.when(k == 0, F.concat_ws("|", w1, w2))
        .when(k == 1, F.concat(F.lit("(?i:"), F.initcap(w1), F.lit("|"), w3, F.lit(")")))
        .when(k == 2, F.concat(F.lit("(?:"), w2, F.lit("|"), w1, F.lit("|"), w2, F.lit(")")))
        .otherwise(F.concat(F.lit("["), F.upper(first), first, F.lit("]"), F.expr("substring(w1, 2)"))))
    return doc_words(spark, sf).select(F.col("doc_id").alias("seq"), pattern.alias("pattern"))


def topic_files(spark: SparkSession, sf: str) -> DataFrame:
    """A topic file per document; half of them carry one of the mistakes, by ``doc_id % 16``."""
    k = F.col("doc_id") % 16
    n = F.col("doc_id").cast("string")
    c = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = c(
        F.when(k == 8, F.lit("  - stray\n")).otherwise(F.lit("")),
        "# words of ", n, "\n- base", n, "\n  - (", F.col("w1"), "|", F.col("w2"), ")\n- pair\n  - \\{base", n,
        ":}\n  - -?", F.col("w3"), "\n- file://clip", n, ".mp4\n  - file://clip", n, ".srt\n  - pair\n- file://other", n,
        ".mp4\n",
        F.when(k == 1, F.lit("junk line\n")).when(k == 2, F.lit("- pair\n  - again\n")).when(k == 3, F.lit("- empty\n"))
        .when(k == 4, F.lit("- lone\n  - \\{nobody:}\n")).when(k == 5, F.lit("- a\n  - x\\{b:}\n- b\n  - \\{a:}y\n"))
        .when(k == 6, F.lit("- bad name\n  - x\n"))
        .when(k == 7, c("- file://clip", n, ".mp4\n  - file://x.srt\n  - file://y.srt\n  - pair\n  - pair\n"))
        .otherwise(F.lit("")))
    text = F.when(F.col("doc_id") % 2 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return doc_words(spark, sf).select(F.col("doc_id").alias("file"), text.alias("text"))


def gloss_files(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("\ufeff  - orphan\nnoise\n- term"), n, F.lit("\n  - about "), "w1", F.lit("\n# note\n  - and "), "w2",
                    F.lit("\n- \n  - tail\n- none"), n, F.lit("\n"))
    return doc_words(spark, sf).select(F.col("doc_id").alias("file"), text.alias("text"))


@cache
def task_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, tasks, deps): a leaf per subtitle, the pyramid over them, a dive per topic.

    A dive depends on the subtitles it quotes; states follow the position.
    """
    from cuelake.operators import chunking, match, tasks as T
    from cuelake.plans.matching import plan
    from cuelake.session import cut
    listed = videos(spark, sf)
    leaves = cut(T.unique_sources(listed))
    nodes = T.fold_pyramid(leaves, "id", T.tree_id).where("tier > 0")
    nodes = nodes.withColumn("spot", F.expr("j * 7 + tier"))
    state = lambda c: F.get(F.array(*[F.lit(s) for s in ("done", "done", "pending", "done", "parked", "pending")]),
                            (c % 6).cast("int"))
    hits = match.scan_hits(lines(spark, sf), plan(spark))
    quoted = cut(chunking.excerpt_sections(hits, listed, 3000))
    dive = sha_head(F.concat(F.lit("dive\n"), "topic"))
    tasks = (
        leaves.select("id", F.lit("leaf").alias("kind"), F.lit(0).alias("tier"), F.lit(True).alias("exported"),
                      F.col("pos").alias("seq"), state(F.col("pos")).alias("state"))
        .unionByName(nodes.select("id", F.lit("node").alias("kind"), "tier", F.lit(True).alias("exported"),
                                  (F.lit(1 << 40) + F.col("tier") * F.lit(1 << 32) + F.col("j")).alias("seq"),
                                  state(F.col("spot")).alias("state")))
        .unionByName(quoted.select("topic").distinct().select(
            dive.alias("id"), F.lit("dive").alias("kind"), F.lit(0).alias("tier"),
            (~F.col("topic").startswith("focus")).alias("exported"),
            (F.lit(1 << 50) + F.octet_length("topic")).alias("seq"), F.lit("pending").alias("state"))))
    side = lambda ord_, c: nodes.select("id", F.lit(ord_).cast("bigint").alias("ord"), F.col(c).alias("dep"))
    deps = side(0, "left_value").unionByName(side(1, "right_value")).unionByName(
        quoted.select(dive.alias("id"), F.col("seq").alias("ord"), F.col("srt_id").alias("dep")))
    return leaves, cut(tasks), cut(deps)
