"""Queries of the digest export."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from cuelake.operators import export, match
from cuelake.plans import bindings as b
from cuelake.plans.matching import expanded, plan
from cuelake.plans.registry import query
from cuelake.session import checkpoint_root
from cuelake.sources import sinks


def _picks(spark, sf):
    """Known picks: every hit time that is a multiple of 9 s, with one open side now and then."""
    cues = b.lines(spark, sf).where("start_ms % 9000 = 0")
    return cues.select("video_id", F.col("start_ms").alias("hit_ms"),
                       F.when(F.col("start_ms") % 27000 != 0, F.col("start_ms") - 1500).alias("prev_ms"),
                       (F.col("start_ms") + 1500).alias("next_ms"))


@query("stem_collisions", """
SELECT stem, count(*) AS n_videos FROM (
  SELECT lower(regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}.-]', '_', 'g')) AS stem FROM videos)
GROUP BY stem HAVING count(*) > 1""")
def stem_collisions(spark, sf):
    return export.stem_collisions(b.videos(spark, sf))


_STEMS = """
, st AS (SELECT video_id, seq, file_name, srt_id, regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}.-]', '_', 'g') AS stem
         FROM videos),
named AS (SELECT video_id, seq, file_name, stem || CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN '-' || srt_id ELSE '' END AS stem FROM st)
"""


@query("frame_names", _STEMS + "SELECT h.topic, h.video_id, h.cue_no, n.stem || '-' || h.start_ms || '.png' AS frame "
                              "FROM hits h JOIN named n USING (video_id)")
def frame_names(spark, sf):
    hits = match.scan_hits(b.lines(spark, sf), plan(spark)).withColumnRenamed("start_ms", "ms")
    return export.frame_names(hits, b.videos(spark, sf)).select("topic", "video_id", "cue_no", "frame")


@query("content_collapse", """
SELECT lang AS topic, doc_id AS seq, 'f' || doc_id || '.png' AS name,
       'f' || min(doc_id) OVER (PARTITION BY lang, text) || '.png' AS canonical FROM documents""")
def content_collapse(spark, sf):
    frames = b.table(spark, sf, "documents").select(
        F.col("lang").alias("topic"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), F.sha2("text", 256).alias("hash"))
    return export.content_collapse(frames).select("topic", "seq", "name", "canonical")


@query("export_stats", """
SELECT topic, count(DISTINCT video_id) AS n_videos, count(*) AS n_hits, count(*) FILTER (WHERE start_ms % 9000 = 0) AS n_framed,
       count(*) FILTER (WHERE start_ms % 9000 <> 0) AS n_pending FROM scoped GROUP BY topic""")
def export_stats(spark, sf):
    found = match.topic_scope(match.scan_hits(b.lines(spark, sf), plan(spark)), b.video_topics(spark, sf))
    return export.export_stats(found, _picks(spark, sf))


@query("digest_export", _STEMS + """
, txt AS (SELECT h.topic, n.seq, h.video_id, h.cue_no, n.file_name, h.line AS hit_line,
  chr(10) || '### ' || (h.start_ms // 60000) || ':' || lpad((h.start_ms // 1000 % 60)::VARCHAR, 2, '0') || '.'
    || lpad((h.start_ms % 1000)::VARCHAR, 3, '0') || chr(10) || chr(10)
    || coalesce('> ' || p.line || chr(10), '') || '> **' || h.line || '**' || chr(10) || coalesce('> ' || x.line || chr(10), '')
    || chr(10) || CASE WHEN h.start_ms % 9000 = 0 THEN
        CASE WHEN h.start_ms % 27000 <> 0 THEN '![](frames/' || n.stem || '-' || (h.start_ms - 1500) || '.png) ' ELSE '' END
        || '![](frames/' || n.stem || '-' || h.start_ms || '.png) ![](frames/' || n.stem || '-' || (h.start_ms + 1500) || '.png) '
      ELSE '*(frames pending)*' END || chr(10) AS text
  FROM scoped h JOIN named n ON n.video_id = h.video_id
  LEFT JOIN lines p ON p.video_id = h.video_id AND p.cue_no = h.cue_no - 1
  LEFT JOIN lines x ON x.video_id = h.video_id AND x.cue_no = h.cue_no + 1),
owned AS (SELECT topic AS digest, * FROM txt
  UNION ALL SELECT 'english', * FROM txt WHERE topic = 'mixed' AND
    len(list_filter(regexp_extract_all(hit_line, '((?:(that|than)))|((?:(?:nicht|auf)))|[Pp]our', 1), lambda x: x <> '')) > 0
  UNION ALL SELECT 'german', * FROM txt WHERE topic = 'mixed' AND
    len(list_filter(regexp_extract_all(hit_line, '((?:(that|than)))|((?:(?:nicht|auf)))|[Pp]our', 3), lambda x: x <> '')) > 0),
titles(digest, text) AS (VALUES
  ('mixed', '# mixed' || chr(10) || chr(10) || 'Pattern: `(?<g0>(?:(that|than)))|(?<g1>(?:(?:nicht|auf)))|[Pp]our`' || chr(10)),
  ('article', '# article' || chr(10) || chr(10) || 'Pattern: `(?i:the |les |der )`' || chr(10)),
  ('broken', '# broken' || chr(10) || chr(10) || 'Pattern: `(unclosed`' || chr(10) || chr(10) || '(invalid pattern: invalid syntax)' || chr(10)),
  ('nohit', '# nohit' || chr(10) || chr(10) || 'Pattern: `qqqzz`' || chr(10)),
  ('term1', '# term1' || chr(10) || chr(10) || 'Pattern: `(?i:wh)`' || chr(10)),
  ('focus1', '# focus1' || chr(10) || chr(10) || 'Pattern: `ou[eu]x?`' || chr(10)),
  ('english', '# english' || chr(10) || chr(10) || 'Component; frames link into `mixed`.' || chr(10) || chr(10) || 'Pattern: `(that|than)`' || chr(10)),
  ('german', '# german' || chr(10) || chr(10) || 'Component; frames link into `mixed`.' || chr(10) || chr(10) || 'Pattern: `(?:nicht|auf)`' || chr(10)))
SELECT digest, seq, video_id, cue_no, text FROM owned
UNION ALL SELECT digest, seq, video_id, min(cue_no), chr(10) || '## ' || file_name || chr(10) FROM owned GROUP BY digest, seq, video_id, file_name
UNION ALL SELECT digest, -1, -1, -1, text FROM titles""")
def digest_export(spark, sf):
    parts = expanded(spark).select("name", "pattern")
    rows = export.digest_lines(b.lines(spark, sf), b.videos(spark, sf), plan(spark), b.video_topics(spark, sf),
                               _picks(spark, sf), parts)
    return rows.select("digest", "seq", "video_id", "cue_no", "text")


def _journal_tasks(spark, sf):
    k = F.col("doc_id") % 3
    return b.table(spark, sf, "documents").select(
        "doc_id", F.when(k == 0, F.lit("leaf")).when(k == 1, F.lit("node")).otherwise(F.lit("dive")).alias("kind"),
        (F.col("doc_id") % 5).alias("tier"), F.substring(F.sha2("text", 256), 1, 16).alias("id"),
        F.when(k == 2, F.col("lang")).alias("note"), (F.col("doc_id") % 2 == 0).alias("exported"),
        F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("deps"))


_JOURNAL = """
, j AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'leaf ' WHEN 1 THEN 'node.' || (doc_id % 5) || ' ' ELSE 'dive ' END || left(sha256(text), 16)
  || CASE WHEN doc_id % 3 = 2 THEN ' [' || lang || ']' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' (supportive)' END
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' <- ' || lang || ' ' || source END AS line FROM documents)
"""


@query("provenance_lines", _JOURNAL + "SELECT doc_id, line FROM j")
def provenance_lines(spark, sf):
    return sinks.journal_line(_journal_tasks(spark, sf)).select("doc_id", "line")


@query("provenance_append", _JOURNAL + "SELECT CAST(doc_id % 3 + 1 AS INTEGER) AS run, line AS value FROM j")
def provenance_append(spark, sf):
    """Three runs append to one journal, the second one twice (a retry); read back."""
    tasks, path = _journal_tasks(spark, sf), f"{checkpoint_root(spark)}/journal-{uuid4().hex}"
    runs = [sinks.append_journal(tasks.where(F.col("doc_id") % 3 == k), path) for k in range(3)]
    sinks.append_journal(tasks.where("doc_id % 3 = 1"), path, run=runs[1])
    return sinks.read_journal(spark, path)


@query("versioned_write", """
SELECT version, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents, (VALUES (1), (2), (3)) v(version)
WHERE version = 1 OR doc_id % version = 0 GROUP BY ALL""")
def versioned_write(spark, sf):
    """Three versions, one claimed number without a version between them (a writer that died), as they lie there."""
    docs, root = b.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), f"{checkpoint_root(spark)}/versions-{uuid4().hex}"
    numbers = [sinks.write_version(docs, root), sinks.write_version(docs.where("doc_id % 2 = 0"), root)]
    sinks.claim(spark, root)
    numbers.append(sinks.write_version(docs.where("doc_id % 3 = 0"), root))
    place = F.array_position(F.array(*[F.lit(n) for n in numbers]), F.col("version")).cast("int")
    return sinks.read_versions(spark, root, "doc_id BIGINT, lang STRING, n_chars BIGINT").groupBy(place.alias("version"), "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
