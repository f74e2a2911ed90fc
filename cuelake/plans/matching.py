"""Queries of the matching core."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import format_time
from cuelake.operators import catalog, match
from cuelake.plans import bindings as b
from cuelake.plans.registry import query
from cuelake.session import cut


@cache
def plan(spark: SparkSession) -> DataFrame:
    """The export plan of the literal catalogue, computed once per session."""
    return cut(catalog.export_plan(b.topics(spark)))


@cache
def expanded(spark: SparkSession) -> DataFrame:
    """The literal catalogue with its references filled in, once per session."""
    return cut(catalog.expand_topics(b.topics(spark)))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return match.scan_hits(b.lines(spark, sf), plan(spark))


@query("match_join", "SELECT topic, video_id, cue_no, start_ms, line FROM hits")
def match_join(spark, sf):
    return hits(spark, sf)


@query("match_join_theta", "SELECT topic, video_id, cue_no, start_ms, line FROM hits")
def match_join_theta(spark, sf):
    """The form for catalogues too large to unroll."""
    good = match.pattern_guard(plan(spark)).where("valid").select("name", "pattern")
    found = match.match_slices(b.lines(spark, sf), good)
    return found.select(F.col("name").alias("topic"), "video_id", "cue_no", "start_ms", "line")


@query("topic_digest", """
SELECT s.topic, s.video_id, s.cue_no, n.n_hits, s.prev_line, s.line, s.next_line, s.at FROM (
  SELECT h.topic, h.video_id, h.cue_no, h.line, p.line AS prev_line, x.line AS next_line,
         (h.start_ms // 60000) || ':' || lpad(CAST(h.start_ms // 1000 % 60 AS VARCHAR), 2, '0')
           || '.' || lpad(CAST(h.start_ms % 1000 AS VARCHAR), 3, '0') AS at,
         row_number() OVER (PARTITION BY h.topic, h.video_id ORDER BY h.cue_no) AS nth
  FROM scoped h LEFT JOIN lines p ON p.video_id = h.video_id AND p.cue_no = h.cue_no - 1
  LEFT JOIN lines x ON x.video_id = h.video_id AND x.cue_no = h.cue_no + 1) s
JOIN (SELECT topic, video_id, count(*) AS n_hits FROM scoped GROUP BY ALL) n
  ON n.topic = s.topic AND n.video_id = s.video_id
WHERE s.nth <= 3""")
def topic_digest(spark, sf):
    """Per topic and video: number of hits and the first three with context."""
    cues = b.lines(spark, sf)
    # The hits are read twice; the scan that finds them should run once.
    found = cut(match.topic_scope(match.scan_hits(cues, plan(spark)), b.video_topics(spark, sf)))
    top = match.evidence_cap(found, 3)
    return (match.context_snippet(top, cues).join(match.evidence_counts(found), ["topic", "video_id"])
            .select("topic", "video_id", "cue_no", "n_hits", "prev_line", "line", "next_line",
                    format_time(F.col("start_ms"), True).alias("at")))


@query("pattern_filter", """
SELECT video_id, cue_no, CAST('literal' AS VARCHAR) AS mode FROM lines WHERE contains(lower(line), 'the .')
   OR contains(lower(line), 'or,')
UNION ALL SELECT video_id, cue_no, 'regex' FROM lines WHERE regexp_matches(line, 'th[ae]t? ')""")
def pattern_filter(spark, sf):
    cues = b.lines(spark, sf)
    lit = [match.pattern_filter(cues, t, is_regex=False, case_sensitive=False) for t in ("the .", "or,")]
    both = lit[0].unionByName(lit[1]).select("video_id", "cue_no").distinct().withColumn("mode", F.lit("literal"))
    regex = match.pattern_filter(cues, "th[ae]t? ").select("video_id", "cue_no", F.lit("regex").alias("mode"))
    return both.unionByName(regex)


@query("videos_matching", "SELECT video_id, seq, path FROM videos v WHERE EXISTS "
                          "(SELECT 1 FROM lines l WHERE l.video_id = v.video_id AND regexp_matches(line, 'nicht|pour'))")
def videos_matching(spark, sf):
    return match.videos_matching(b.lines(spark, sf), b.videos(spark, sf), "nicht|pour").select(
        "video_id", "seq", "path")


@query("topic_scope", "SELECT topic, video_id, cue_no FROM scoped")
def topic_scope(spark, sf):
    return match.topic_scope(hits(spark, sf), b.video_topics(spark, sf)).select("topic", "video_id", "cue_no")


@query("pattern_guard", """
, pats AS (SELECT event_id AS seq, pattern || CASE WHEN event_id % 5 = 0 THEN '(' WHEN event_id % 7 = 0 THEN '[[:alpha:]]'
                                                  WHEN event_id % 11 = 0 THEN '[a[b]]' ELSE '' END AS pattern
           FROM search_log)
SELECT seq, pattern, CASE WHEN seq % 5 = 0 THEN 'invalid syntax' WHEN seq % 7 = 0 THEN 'POSIX class'
                          WHEN seq % 11 = 0 THEN 'nested class' END AS problem FROM pats""")
def pattern_guard(spark, sf):
    tail = (F.when(F.col("event_id") % 5 == 0, F.lit("(")).when(F.col("event_id") % 7 == 0, F.lit("[[:alpha:]]"))
            .when(F.col("event_id") % 11 == 0, F.lit("[a[b]]")).otherwise(F.lit("")))
    pats = b.search_log(spark, sf).select(F.col("event_id").alias("seq"), F.concat("pattern", tail).alias("pattern"))
    return match.pattern_guard(pats).select("seq", "pattern", "problem")


@query("evidence_lines", """
SELECT v.seq, l.video_id, l.cue_no, l.start_ms, l.line FROM lines l JOIN videos v ON v.video_id = l.video_id
WHERE regexp_matches(line, '(?i:wh)[aeiou]')""")
def evidence_lines(spark, sf):
    found = match.pattern_filter(b.lines(spark, sf), "(?i:wh)[aeiou]")
    return found.join(b.videos(spark, sf).select("video_id", "seq"), "video_id").select(
        "seq", "video_id", "cue_no", "start_ms", "line")


@query("tally", """
SELECT video_id, CAST(sum(len(regexp_extract_all(line, 'o*u'))) AS BIGINT) AS n_matches
FROM lines GROUP BY video_id""")
def tally(spark, sf):
    return match.tally(b.lines(spark, sf), "o*u")


@query("tally_zero_length", """
SELECT video_id, CAST(sum(len(regexp_extract_all(line, 'x*'))) AS BIGINT) AS n_matches
FROM lines GROUP BY video_id""")
def tally_zero_length(spark, sf):
    return match.tally(b.lines(spark, sf), "x*")


@query("visible_match_count", """
SELECT video_id, CAST(sum(len(list_filter(regexp_extract_all(line, 'o*'), lambda m: m <> ''))) AS BIGINT) AS n_visible
FROM lines GROUP BY video_id""")
def visible_match_count(spark, sf):
    return match.visible_match_count(b.lines(spark, sf), "o*")


@query("evidence_counts", "SELECT topic, video_id, count(*) AS n_hits FROM hits GROUP BY ALL")
def evidence_counts(spark, sf):
    return match.evidence_counts(hits(spark, sf))


@query("evidence_cap", """
SELECT topic, video_id, cue_no, CAST(nth AS INTEGER) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, video_id ORDER BY cue_no) AS nth FROM hits) WHERE nth <= 4""")
def evidence_cap(spark, sf):
    return match.evidence_cap(hits(spark, sf), 4).select("topic", "video_id", "cue_no", "nth")


@query("context_snippet", """
SELECT h.topic, h.video_id, h.cue_no, p.line AS prev_line, h.line, x.line AS next_line
FROM hits h LEFT JOIN lines p ON p.video_id = h.video_id AND p.cue_no = h.cue_no - 1
LEFT JOIN lines x ON x.video_id = h.video_id AND x.cue_no = h.cue_no + 1""")
def context_snippet(spark, sf):
    cues = b.lines(spark, sf)
    return match.context_snippet(match.scan_hits(cues, plan(spark)), cues).select(
        "topic", "video_id", "cue_no", "prev_line", "line", "next_line")


_OFFSETS = """
, pieces AS (SELECT video_id, cue_no, string_split(regexp_replace(line, '(ou+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p
             FROM lines WHERE regexp_matches(line, 'ou+')),
found AS (SELECT video_id, cue_no, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS INTEGER) AS "offset"
          FROM (SELECT video_id, cue_no, p, unnest(range(1, len(p), 2)) AS i FROM pieces))
"""


@query("match_ordinals", _OFFSETS + """
SELECT f.video_id, f.cue_no, f."offset",
       row_number() OVER (PARTITION BY f.video_id ORDER BY cue_no, "offset") AS in_video,
       row_number() OVER (ORDER BY seq, cue_no, "offset") AS in_corpus
FROM found f JOIN videos v ON v.video_id = f.video_id""")
def match_ordinals(spark, sf):
    return match.match_ordinals(b.lines(spark, sf), b.videos(spark, sf), "ou+")


@query("next_hit", """
SELECT topic, video_id, cue_no,
       coalesce(lead(cue_no) OVER w, first_value(cue_no) OVER w) AS next_cue, lead(cue_no) OVER w IS NULL AS next_wrapped,
       coalesce(lag(cue_no) OVER w, max(cue_no) OVER (PARTITION BY topic, video_id)) AS prev_cue,
       lag(cue_no) OVER w IS NULL AS prev_wrapped
FROM hits WINDOW w AS (PARTITION BY topic, video_id ORDER BY cue_no)""")
def next_hit(spark, sf):
    return match.next_hit(hits(spark, sf))


@query("landing_hit", """
, anchors AS (SELECT event_id AS anchor_id, event_id % n AS video_id, CAST(floor(value) % 40 AS INTEGER) AS anchor_cue
              FROM events, n_docs),
h AS (SELECT video_id, CAST(cue_no AS BIGINT) AS hit FROM hits WHERE topic = 'article')
SELECT anchor_id, a.video_id, anchor_cue,
       coalesce((SELECT min(hit) FROM h WHERE h.video_id = a.video_id AND hit >= anchor_cue),
                (SELECT min(hit) FROM h WHERE h.video_id = a.video_id)) AS landing_cue,
       (SELECT min(hit) FROM h WHERE h.video_id = a.video_id AND hit >= anchor_cue) IS NULL
         AND (SELECT min(hit) FROM h WHERE h.video_id = a.video_id) IS NOT NULL AS wrapped
FROM anchors a""")
def landing_hit(spark, sf):
    anchors = b.table(spark, sf, "events").select(
        F.col("event_id").alias("anchor_id"), (F.col("event_id") % b.n_documents(spark, sf)).alias("video_id"),
        (F.floor("value") % 40).cast("int").alias("anchor_cue"))
    return match.landing_hit(anchors, hits(spark, sf).where("topic = 'article'"))


@query("hop_video", """
, hv AS (SELECT DISTINCT v.seq, v.video_id FROM videos v JOIN hits h ON h.video_id = v.video_id AND topic = 'mixed')
SELECT v.video_id, v.seq,
  coalesce((SELECT min_by(video_id, seq) FROM hv WHERE hv.seq > v.seq),
           (SELECT min_by(video_id, seq) FROM hv WHERE hv.seq < v.seq)) AS next_video,
  coalesce((SELECT max_by(video_id, seq) FROM hv WHERE hv.seq < v.seq),
           (SELECT max_by(video_id, seq) FROM hv WHERE hv.seq > v.seq)) AS prev_video
FROM videos v""")
def hop_video(spark, sf):
    found = hits(spark, sf).where("topic = 'mixed'").select("video_id").distinct()
    return match.hop_video(b.videos(spark, sf), found)


@query("step_video", """
SELECT video_id, seq, coalesce(lead(video_id) OVER w, first_value(video_id) OVER w) AS next_video,
       coalesce(lag(video_id) OVER w, max_by(video_id, seq) OVER ()) AS prev_video
FROM videos WINDOW w AS (ORDER BY seq)""")
def step_video(spark, sf):
    return match.step_video(b.videos(spark, sf))


@query("attribute_components", """
SELECT topic, video_id, cue_no, part FROM (
  SELECT topic, video_id, cue_no, 'english' AS part FROM scoped WHERE topic = 'mixed' AND
    len(list_filter(regexp_extract_all(line, '((?:(that|than)))|((?:(?:nicht|auf)))|[Pp]our', 1), lambda x: x <> '')) > 0
  UNION ALL
  SELECT topic, video_id, cue_no, 'german' FROM scoped WHERE topic = 'mixed' AND
    len(list_filter(regexp_extract_all(line, '((?:(that|than)))|((?:(?:nicht|auf)))|[Pp]our', 3), lambda x: x <> '')) > 0)""")
def attribute_components(spark, sf):
    items = plan(spark)
    found = match.topic_scope(match.scan_hits(b.lines(spark, sf), items), b.video_topics(spark, sf))
    return match.attribute_components(found, items)


# Two components that may take part with nothing in front of the letter that decides.
EMPTY_PARTS = ("vowels", "(?<g0>o*)u|(?<g1>(?:e(e))*)nt|q", [("round", 1), ("even", 2)])


@query("attribute_empty_components", """
, m AS (SELECT video_id, cue_no, regexp_extract_all(line, 'o*u|(?:ee)*nt|q') AS found FROM lines)
SELECT 'vowels' AS topic, video_id, cue_no, 'round' AS part FROM m WHERE len(list_filter(found, lambda x: suffix(x, 'u'))) > 0
UNION ALL SELECT 'vowels', video_id, cue_no, 'even' FROM m WHERE len(list_filter(found, lambda x: suffix(x, 't'))) > 0""")
def attribute_empty_components(spark, sf):
    items = spark.createDataFrame([(0, *EMPTY_PARTS)], "seq INT, name STRING, pattern STRING, parts ARRAY<STRUCT<part: STRING, group_idx: INT>>")
    return match.attribute_components(match.scan_hits(b.lines(spark, sf), items), items)
