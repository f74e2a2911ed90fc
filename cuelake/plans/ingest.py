"""Queries of the sources and the scalar text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans import bindings as b
from cuelake.plans.registry import query
from cuelake.sources import media, srt


@query("srt_scan", "SELECT video_id, cue_no, start_ms, end_ms, line AS text, line FROM lines")
def srt_scan(spark, sf):
    return srt.srt_scan(srt.decode_text(b.srt_files(spark, sf)))


@query("decode_text", "SELECT doc_id, sha256(text) AS text_sha FROM documents")
def decode_text(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        "doc_id", b.encode_text(F.col("text"), F.col("doc_id") % 5).alias("content"))
    return srt.decode_text(docs).select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query("encoding_audit", """
SELECT encoding, count(*) AS n_files FROM (
  SELECT CASE doc_id % 5 WHEN 1 THEN 'utf8-bom' WHEN 2 THEN 'utf16le' WHEN 3 THEN 'utf16be'
         WHEN 4 THEN CASE WHEN regexp_matches(text, '^[\\x00-\\x7f\\x{a0}-\\x{ff}]*$')
                               AND regexp_matches(text, '[^\\x00-\\x7f]') THEN 'cp1252' ELSE 'utf8' END
         ELSE 'utf8' END AS encoding FROM documents) GROUP BY encoding""")
def encoding_audit(spark, sf):
    docs = b.table(spark, sf, "documents").select(b.encode_text(F.col("text"), F.col("doc_id") % 5).alias("content"))
    return srt.encoding_audit(docs)


@query("quarantine_split", """
SELECT doc_id AS video_id, CASE WHEN doc_id % 7 = 0 THEN 'unreadable' ELSE 'no cue' END AS reason
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def quarantine_split(spark, sf):
    files = b.srt_files(spark, sf).join(
        b.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.col("text").alias("plain")), "video_id")
    damaged = F.when(F.col("video_id") % 7 == 0, F.lit(None).cast("binary")).when(
        F.col("video_id") % 11 == 0, F.encode("plain", "UTF-8")).otherwise(F.col("content"))
    files = files.select("video_id", damaged.alias("content"))
    return srt.quarantine_split(srt.decode_text(files))


@query("scan_with_sink", """
SELECT video_id, CAST(max(length(line)) AS BIGINT) AS longest FROM lines GROUP BY video_id""")
def scan_with_sink(spark, sf):
    def sink(video_id, start_ms, end_ms, text):
        yield {"video_id": video_id, "n": len(text)}
    files = srt.decode_text(b.srt_files(spark, sf))
    return srt.scan_with_sink(files, sink, "video_id BIGINT, n BIGINT").groupBy("video_id").agg(
        F.max("n").alias("longest"))


@query("render_line", """
SELECT video_id, cue_no, CASE cue_no % 4 WHEN 2 THEN line || ' <x>' WHEN 3 THEN line || ' ' || line ELSE line END AS line
FROM lines""")
def render_line(spark, sf):
    line = F.col("line")
    marked = (F.when(F.col("cue_no") % 4 == 0, F.concat(F.lit("<i>"), line, F.lit("</i>")))
              .when(F.col("cue_no") % 4 == 1, F.concat(F.lit(r"{\an8}"), line))
              .when(F.col("cue_no") % 4 == 2, F.concat(F.lit('<font color="red"><B >'), line, F.lit("</font>  <x>")))
              .otherwise(F.concat(line, F.lit("\n"), line)))
    return b.lines(spark, sf).select("video_id", "cue_no", T.render_line(marked).alias("line"))


@query("sanitize_markup", """
SELECT page_id, sha256(regexp_replace(
  replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<br>'),
  '&lt;[\\x00-\\x20]*(/?[ibuIBU]|/[fF][oO][nN][tT])[\\x00-\\x20]*&gt;', '<\\1>', 'g')) AS html_sha FROM pages""")
def sanitize_markup(spark, sf):
    return b.spread(b.table(spark, sf, "pages")).select(
        "page_id", F.sha2(T.sanitize_markup(F.col("html")), 256).alias("html_sha"))


@query("markup_audit", """
SELECT tag, verdict, count(*) AS n FROM (
  SELECT lower(regexp_extract(t, '^<[\\x00-\\x20]*(/?[A-Za-z0-9!]*)', 1)) AS tag,
         CASE WHEN regexp_matches(t, '^<[\\x00-\\x20]*(/?[ibuIBU]|/[fF][oO][nN][tT])[\\x00-\\x20]*>$') THEN 'kept'
              ELSE 'escaped' END AS verdict
  FROM (SELECT unnest(regexp_extract_all(html, '<[^<>]*>')) AS t FROM pages)) GROUP BY ALL""")
def markup_audit(spark, sf):
    tags = b.spread(b.table(spark, sf, "pages")).select(F.explode(T.markup_verdicts(F.col("html"))).alias("t"))
    return tags.groupBy("t.tag", "t.verdict").agg(F.count("*").alias("n"))


@query("format_time", """
SELECT event_id, CASE WHEN ms >= 3600000 THEN (ms // 3600000) || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0')
                      ELSE (ms // 60000 % 60)::VARCHAR END || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0')
                 || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS at
FROM (SELECT event_id, CAST(floor((event_id * 3.7 + value) * 1000 + 0.5) AS BIGINT) AS ms FROM events)""")
def format_time(spark, sf):
    seconds = F.col("event_id") * F.lit(3.7) + F.col("value")
    return b.table(spark, sf, "events").select("event_id", T.format_time(T.to_ms(seconds), True).alias("at"))


@query("numbered_lines", """
SELECT video_id, cue_no, '#' || cue_no || ' [' || (start_ms // 60000) || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0')
       || '.' || lpad((start_ms % 1000)::VARCHAR, 3, '0') || '] ' || line AS numbered FROM lines""")
def numbered_lines(spark, sf):
    return b.lines(spark, sf).select("video_id", "cue_no", T.numbered_line(
        F.col("cue_no"), F.col("start_ms"), F.col("line")).alias("numbered"))


@query("transcript_text", "SELECT doc_id AS video_id, sha256(text) AS text_sha FROM documents")
def transcript_text(spark, sf):
    """One string per transcript; a transcript came from one file, so its size is bounded by that row."""
    rows = b.lines(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", "line"))).alias("l"))
    return rows.select("video_id", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("text_sha"))


@query("content_ids", """
, w AS (SELECT video_id, srt_id, lead(srt_id, 1, srt_id) OVER (ORDER BY seq) AS other FROM videos)
SELECT video_id, left(sha256('dive' || chr(10) || srt_id), 16) AS dive_id,
       left(sha256('tree' || srt_id || other), 16) AS tree_id,
       left(sha256('focus' || least(srt_id, other) || greatest(srt_id, other)), 16) AS focus_id FROM w""")
def content_ids(spark, sf):
    from cuelake.operators.ordered import neighbours
    v = neighbours(b.videos(spark, sf), [], ["seq"], F.col("srt_id"), nxt="other")
    own, other = F.col("srt_id"), F.coalesce("other", "srt_id")
    return v.select("video_id", T.content_id("dive\n", own).alias("dive_id"),
                    T.content_id("tree", own, other).alias("tree_id"), T.pair_id("focus", own, other).alias("focus_id"))


@query("safe_stem", """
SELECT video_id, regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}.-]', '_', 'g') AS stem FROM videos""")
def safe_stem(spark, sf):
    return b.videos(spark, sf).select("video_id", T.safe_stem(F.col("path")).alias("stem"))


@query("utf8_clip", """
, chars AS (SELECT doc_id, unnest(string_split(left(text, 1000), '')) AS c,
                   generate_subscripts(string_split(left(text, 1000), ''), 1) AS i FROM documents),
run AS (SELECT doc_id, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM chars)
SELECT d.doc_id, sha256(left(text, coalesce(n, 0))) AS clip_sha
FROM documents d LEFT JOIN (SELECT doc_id, max(i) AS n FROM run WHERE b <= 1000 GROUP BY doc_id) r USING (doc_id)""")
def utf8_clip(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.sha2(T.utf8_clip(F.col("text"), 1000), 256).alias("clip_sha"))


@query("sample_head", """
, run AS (SELECT video_id, cue_no, sum(strlen(line) + 1) OVER (PARTITION BY video_id ORDER BY cue_no) AS upto,
                 count(*) OVER (PARTITION BY video_id) AS n FROM lines)
SELECT doc_id, CAST(CASE WHEN strlen(text) <= 2000 THEN strlen(text) ELSE coalesce(k, 0) END AS BIGINT) AS n_bytes
FROM documents LEFT JOIN (SELECT video_id, max(upto) AS k FROM run WHERE upto <= 2001 AND cue_no < n - 1 GROUP BY video_id) r
  ON r.video_id = doc_id""")
def sample_head(spark, sf):
    head = T.sample_head(F.col("text"), 2000)
    return b.table(spark, sf, "documents").select("doc_id", F.octet_length(head).cast("bigint").alias("n_bytes"))


@query("id_parse", """
, raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(left(sha256(text), 16)) WHEN 1 THEN left(sha256(text), 15)
                         WHEN 2 THEN repeat('0', 16) ELSE 'g' || left(sha256(text), 15) END AS raw FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lower(raw) END AS id FROM raw""")
def id_parse(spark, sf):
    head = F.sha2("text", 256)
    raw = (F.when(F.col("doc_id") % 4 == 0, F.upper(F.substring(head, 1, 16)))
           .when(F.col("doc_id") % 4 == 1, F.substring(head, 1, 15))
           .when(F.col("doc_id") % 4 == 2, F.lit("0" * 16)).otherwise(F.concat(F.lit("g"), F.substring(head, 1, 15))))
    return b.table(spark, sf, "documents").select("doc_id", T.parse_id(raw).alias("id"))


@query("resolve_paths", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/lib/' || source || '/rel/' || lang || '.mp4' WHEN 1 THEN '/abs/' || lang
       ELSE '' END AS path FROM documents""")
def resolve_paths(spark, sf):
    raw = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rel/"), "lang", F.lit(".mp4")))
           .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/abs/"), "lang")).otherwise(F.lit("")))
    return b.table(spark, sf, "documents").select(
        "doc_id", T.resolve_path(raw, F.concat(F.lit("/lib/"), F.col("source"))).alias("path"))


@query("line_to_time", """
SELECT event_id AS request_id, video_id, greatest(CASE WHEN top < 2 THEN 0
         ELSE least((top - 2) // 4, n - 1) * 3000 END - 500, 0)::BIGINT AS seek_ms
FROM (SELECT event_id, event_id % n AS video_id,
             CAST(floor(value) AS BIGINT) % 60 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS top FROM events, n_docs) e
JOIN (SELECT video_id, count(*) AS n FROM lines GROUP BY video_id) l USING (video_id)""")
def line_to_time(spark, sf):
    requests = b.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), (F.col("event_id") % b.n_documents(spark, sf)).alias("video_id"),
        (F.floor("value") % 60).alias("top"), (F.col("event_id") % 2 == 0).alias("zero_based"),
        F.lit(500).alias("preroll_ms"))
    return media.line_to_time(requests, srt.line_times(srt.decode_text(b.srt_files(spark, sf, canonical=True))))


_LISTING = """
, stems AS (SELECT video_id AS k, path, regexp_replace(path, '\\.mp4$', '') AS stem FROM videos),
listing AS (SELECT DISTINCT file FROM (
  SELECT path AS file FROM stems WHERE k % 13 <> 0 UNION ALL
  SELECT path || '.srt' FROM stems WHERE k % 3 = 0 OR k % 5 = 0 UNION ALL
  SELECT stem || '.srt' FROM stems WHERE k % 3 = 1 OR k % 5 = 0 UNION ALL
  SELECT stem || '.jpg' FROM stems WHERE k % 7 = 0))
"""


@query("srt_for_video", _LISTING + """
SELECT DISTINCT path, CASE WHEN path || '.srt' IN (SELECT file FROM listing) THEN path || '.srt'
                           WHEN stem || '.srt' IN (SELECT file FROM listing) THEN stem || '.srt' END AS srt FROM stems""")
def srt_for_video(spark, sf):
    return media.srt_for_video(b.videos(spark, sf).select("path").distinct(), b.listing(spark, sf))


@query("video_for_srt", _LISTING + """
, srts AS (SELECT file AS srt, regexp_replace(file, '\\.srt$', '') AS x FROM listing WHERE suffix(file, '.srt')),
cand AS (SELECT s.srt, count(l.file) AS n, min(l.file) AS f FROM srts s
         LEFT JOIN (SELECT file FROM listing WHERE NOT suffix(file, '.srt')) l
           ON starts_with(l.file, s.x || '.') AND strpos(substr(l.file, length(s.x) + 1), '/') = 0
         GROUP BY s.srt),
ex AS (SELECT s.srt, l.file AS e FROM srts s LEFT JOIN listing l ON l.file = s.x)
SELECT srt, CASE WHEN e IS NOT NULL THEN e WHEN n = 1 THEN f END AS video,
       CASE WHEN e IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'sibling' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
       CASE WHEN e IS NOT NULL THEN 1 ELSE n END AS n_candidates
FROM cand JOIN ex USING (srt)""")
def video_for_srt(spark, sf):
    return media.video_for_srt(b.listing(spark, sf))


@query("picks_scan", """
, rows AS (SELECT user_id AS video_id, event_id, CAST(floor(value) AS BIGINT) * 1000 AS hit_ms, event_id % 4 - 1 AS p,
                  event_id * 10 AS n FROM events WHERE event_id % 9 <> 0),
l AS (SELECT video_id, hit_ms, arg_max(p, event_id) AS p, arg_max(n, event_id) AS n FROM rows GROUP BY ALL)
SELECT video_id, hit_ms, CASE WHEN p >= 0 THEN p END AS prev_ms, n AS next_ms FROM l""")
def picks_scan(spark, sf):
    hit = (F.floor("value") * 1000).cast("string")
    value = F.when(F.col("event_id") % 9 == 0, F.concat(hit, F.lit(" 1"))).otherwise(
        F.concat(F.lit(" "), hit, F.lit("  "), (F.col("event_id") % 4 - 1).cast("string"), F.lit("\t"),
                 (F.col("event_id") * 10).cast("string")))
    raw = b.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("line_no"),
                                              value.alias("value"))
    return media.picks_scan(raw)
