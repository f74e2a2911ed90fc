"""Topic files, gloss files: reading, checking, writing.

A file is one row.  It is cut in front of every head line, so a block carries its head and children
without a window over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.patterns import REFERENCE
from cuelake.operators.catalog import closure
from cuelake.sources.srt import normal_breaks

# ---- fixed values: the shapes of the list format -------------------------------------------------
FILE_PREFIX = "file://"
HEAD = r"- [ \t]*[^ \t\n]"
GOOD_NAME = r"^(?!\.{1,2}$)[^ \t{}:/\\]+$"
# -------------------------------------------------------------------------------------------------


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t"))


def _blocks(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    body = F.regexp_replace(normal_breaks(F.col(text)), "^\ufeff", "")
    return files.select(*keep, F.posexplode(F.split(body, rf"(?md)^(?={HEAD})")).alias("block_no", "block"))


def _lines(blocks: DataFrame, keep: list[str]) -> DataFrame:
    raw = blocks.select(*keep, "block_no", F.posexplode(F.split("block", "\n")).alias("pos", "raw"))
    s = _strip(F.col("raw"))
    return raw.select(
        "*", s.alias("s"),
        F.when((s == "") | s.startswith("#"), F.lit("skip")).when(~s.startswith("- "), F.lit("other"))
        .when(F.col("raw").startswith("-"), F.lit("head")).otherwise(F.lit("child")).alias("role"),
        F.when(s.startswith("- "), _strip(F.substring(s, F.lit(3), F.length(s)))).alias("content"))


def read_items(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Item lines: (key, block_no, pos, role, content, head); head is NULL in front of the first block."""
    lines = _lines(_blocks(files, text, [key]).withColumn("head", F.regexp_extract("block", r"(?d)^- ([^\n]*)", 1)),
                   [key, "head"])
    head = F.when(F.col("head") != "", _strip(F.col("head")))
    return lines.where("role in ('head', 'child')").select(key, "block_no", "pos", "role", "content", head.alias("head"))


def load_topics(items: DataFrame, key: str = "file") -> DataFrame:
    """(key, seq, name, fragments)."""
    rows = items.where(~F.col("head").startswith(FILE_PREFIX))
    grouped = rows.groupBy(key, "block_no", F.col("head").alias("name")).agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "child", F.struct("pos", "content")))).alias("f"))
    return grouped.select(key, F.col("block_no").alias("seq"), "name",
                          F.transform("f", lambda x: x["content"]).alias("fragments"))


def load_videos(items: DataFrame, key: str = "file") -> DataFrame:
    """(key, seq, path, srt, topics)."""
    cut = lambda c: F.substring(c, F.lit(len(FILE_PREFIX) + 1), F.length(c))
    rows = items.where(F.col("head").startswith(FILE_PREFIX))
    child = F.col("role") == "child"
    is_path = F.col("content").startswith(FILE_PREFIX)
    grouped = rows.groupBy(key, "block_no", cut(F.col("head")).alias("path")).agg(
        F.min_by(cut(F.col("content")), F.when(child & is_path, F.col("pos"))).alias("srt"),
        F.array_sort(F.collect_list(F.when(child & ~is_path, F.struct("pos", "content")))).alias("t"))
    return grouped.select(key, F.col("block_no").alias("seq"), "path", "srt",
                          F.transform("t", lambda x: x["content"]).alias("topics"))


def lint(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """All violations: (key, line, rule, detail), lines from 1."""
    blocks = _blocks(files, text, [key])
    size = F.length("block") - F.length(F.replace("block", F.lit("\n"), F.lit("")))
    # One file came from one row, so this window never sees more than that row held.
    before = Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    placed = placed.withColumn("head", _strip(F.regexp_extract("block", r"(?d)^- ([^\n]*)", 1)))
    lines = _lines(placed, [key, "start", "head"]).withColumn("line", (F.col("start") + F.col("pos") + 1).cast("bigint"))
    is_path = F.col("content").startswith(FILE_PREFIX)
    empty_path = F.col("content") == FILE_PREFIX
    video = F.col("head").startswith(FILE_PREFIX)

    def found(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
        return rows.select(key, "line", F.lit(rule).alias("rule"), detail.alias("detail"))

    heads = lines.where("role = 'head'")
    topics = heads.where(~is_path)
    videos = heads.where(is_path)
    children = lines.where("role = 'child' and head <> ''")
    frags = children.where(~video)
    details = children.where(video)
    names = topics.where(F.col("content").rlike(GOOD_NAME))
    refs = frags.select(key, "line", F.col("head").alias("name"), F.explode(
        F.regexp_extract_all("content", F.lit(REFERENCE), F.lit(1))).alias("ref"))
    used = details.where(~is_path & F.col("content").rlike(GOOD_NAME))
    wanted = refs.select(key, "line", "ref").unionByName(used.select(key, "line", F.col("content").alias("ref")))
    known = names.select(key, F.col("content").alias("ref")).distinct()

    def repeats(rows: DataFrame, *by: str) -> DataFrame:
        first = rows.groupBy(key, *by, "content").agg(F.min("line").alias("first_line"))
        return rows.join(first, [key, *by, "content"]).where("line > first_line")

    with_pattern = frags.select(key, "block_no").distinct()
    loops = closure(refs, [key], "name", "ref").where("name = ref").select(key, F.col("name").alias("content"))
    content = F.col("content")
    parts = [
        found(lines.where("role = 'other'"), "not an item", F.col("s")),
        found(lines.where("role = 'child' and head = ''"), "orphan item", content),
        found(topics.where(~content.rlike(GOOD_NAME)), "bad name", content),
        found(details.where(~is_path & ~content.rlike(GOOD_NAME)), "bad name", content),
        found(videos.where(empty_path).unionByName(details.where(empty_path)), "empty path", content),
        found(repeats(names), "duplicate topic", content),
        found(repeats(videos), "duplicate video", content),
        found(repeats(details.where(~is_path), "block_no"), "duplicate topic reference", content),
        found(_later(details.where(is_path), key), "second subtitle file", content),
        found(names.join(with_pattern, [key, "block_no"], "left_anti"), "no pattern", content),
        found(wanted.join(known, [key, "ref"], "left_anti"), "unknown topic", F.col("ref")),
        found(names.join(loops, [key, "content"], "left_semi"), "circular reference", content),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _later(rows: DataFrame, key: str) -> DataFrame:
    first = rows.groupBy(key, "block_no").agg(F.min("line").alias("first_line"))
    return rows.join(first, [key, "block_no"]).where("line > first_line")


def accepted(files: DataFrame, violations: DataFrame, key: str = "file") -> DataFrame:
    return files.join(violations.select(key).distinct(), key, "left_anti")


def load_gloss(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, seq, name, lines); junk, comments, orphans and empty heads are skipped."""
    rows = read_items(files, key, text).where(F.col("head").isNotNull())
    grouped = rows.groupBy(key, "block_no", "head").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "child", F.struct("pos", "content")))).alias("l"))
    return grouped.select(key, F.col("block_no").alias("seq"), F.col("head").alias("name"),
                          F.transform("l", lambda x: x["content"]).alias("lines"))


def _block_lines(head: Column, children: Column) -> Column:
    return F.concat(F.array(F.concat(F.lit("- "), head)),
                    F.transform(children, lambda c: F.concat(F.lit("  - "), c)), F.array(F.lit("")))


def corpus_lines(topics: DataFrame, videos: DataFrame, key: str = "file") -> DataFrame:
    """Canonical text, one row per line: topics first, then videos, a blank line between blocks."""
    t = topics.select(key, F.lit(0).alias("section"), "seq", _block_lines(F.col("name"), F.col("fragments")).alias("l"))
    path = lambda c: F.concat(F.lit(FILE_PREFIX), c)
    srt = F.when(F.coalesce(F.col("srt"), F.lit("")) != "", F.array(path(F.col("srt")))).otherwise(
        F.array().cast("array<string>"))
    v = videos.select(key, F.lit(1).alias("section"), "seq",
                      _block_lines(path(F.col("path")), F.concat(srt, "topics")).alias("l"))
    rows = t.unionByName(v).select(key, "section", "seq", F.posexplode("l").alias("ord", "text"))
    last = rows.groupBy(key).agg(F.max(F.struct("section", "seq", "ord")).alias("last"))
    here = F.struct("section", "seq", "ord")
    return rows.join(last, key).where(here < F.col("last")).drop("last")


def gloss_lines(gloss: DataFrame, key: str = "file") -> DataFrame:
    rows = gloss.where(F.col("name") != "").select(
        key, F.lit(0).alias("section"), "seq", F.posexplode(_block_lines(F.col("name"), F.col("lines"))).alias("ord", "text"))
    last = rows.groupBy(key).agg(F.max(F.struct("section", "seq", "ord")).alias("last"))
    return rows.join(last, key).where(F.struct("section", "seq", "ord") < F.col("last")).drop("last")
