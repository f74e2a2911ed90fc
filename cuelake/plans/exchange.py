"""Queries of the model exchange and the knowledge directory."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cuelake.functions.text import sha_head
from cuelake.operators import catalog, chunking, knowledge, match, replies as R, requests as Q
from cuelake.plans import bindings as b
from cuelake.plans.catalogue import _catalogue
from cuelake.plans.matching import plan
from cuelake.plans.oracle import EXCERPT
from cuelake.plans.registry import query
from cuelake.plans.worklist import WINDOWS, window_spans, windows

_REPLIES = WINDOWS + """
, told AS MATERIALIZED (
  SELECT s.id, s.seq, s.window_no, s.video_id, s.first_cue, s.last_cue, (s.seq + s.window_no) % 5 AS k,
         regexp_extract(l.line, '[a-z]+') AS word
  FROM staged s JOIN lines l ON l.video_id = s.video_id AND l.cue_no = s.first_cue)
"""


def term_replies(spark, sf):
    """A reply per window, in five shapes: none, sound, wrong cue, unsaid spelling, one sound of two."""
    w = window_spans(spark, sf)
    first = b.lines(spark, sf).select("video_id", F.col("cue_no").cast("bigint").alias("first_cue"), "line")
    w = w.join(first, ["video_id", "first_cue"]).withColumn("word", F.regexp_extract("line", "[a-z]+", 0))
    c = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    k, word, cue = (F.col("seq") + F.col("window_no")) % 5, F.col("word"), F.col("first_cue").cast("string")
    term = c("T", F.substring("word", 1, 2))
    sound = lambda cues: c("TERM: ", term, "\nKIND: Word\nGLOSS: about ", word, "\nSEEN: ", word, " | never said\nCUES: ", cues)
    text = (F.when(k == 0, F.lit("NONE")).when(k == 1, sound(c("#", cue)))
            .when(k == 2, sound(c("#", cue, " #", (F.col("last_cue") + 1).cast("string"))))
            .when(k == 3, c("TERM: x\nKIND: y\nGLOSS: z\nSEEN: qq zz qq\nCUES: ", cue))
            .otherwise(c(sound(cue), "\nMEANS: more\n\nTERM: lost\nSEEN: ", word, "\nCUES: ", cue)))
    return w.select("id", "seq", "window_no", "video_id", "first_cue", "last_cue", text.alias("text"))


@query("parse_term_replies", _REPLIES + """
SELECT id, CAST(0 AS INTEGER) AS block_no, CASE k WHEN 3 THEN 'x' ELSE 'T' || word[1:2] END AS term, CASE k WHEN 3 THEN 'y' ELSE 'word' END AS kind,
  CASE k WHEN 4 THEN 'more' ELSE '' END AS means, CASE WHEN k = 3 THEN 'z' ELSE trim('about ' || word) END AS gloss,
  array_to_string(CASE WHEN k = 3 THEN ['qq zz qq'] WHEN word = '' THEN ['never said'] ELSE [word, 'never said'] END, '|') AS seen,
  CASE WHEN k = 2 THEN first_cue || ' ' || (last_cue + 1) ELSE CAST(first_cue AS VARCHAR) END AS cues FROM told WHERE k <> 0
UNION ALL SELECT id, 1, 'lost', '', '', '', word, CAST(first_cue AS VARCHAR) FROM told WHERE k = 4""")
def parse_term_replies(spark, sf):
    out = R.parse_term_replies(term_replies(spark, sf), ["id"])
    return out.withColumn("seen", F.array_join("seen", "|")).withColumn("cues", F.array_join(F.col("cues").cast("array<string>"), " "))


@query("validate_terms", _REPLIES + """
SELECT id, CAST(0 AS INTEGER) AS block_no, 'T' || word[1:2] AS term, word AS kept, '(?i:' || word || ')' AS pattern
FROM told WHERE k IN (1, 4) AND word <> ''""")
def validate_terms(spark, sf):
    replies = term_replies(spark, sf)
    held = R.validate_terms(R.parse_term_replies(replies, ["id"]), replies, b.lines(spark, sf))
    return held.select("id", "block_no", "term", F.array_join("kept", "|").alias("kept"),
                       R.literal_union(F.col("kept")).alias("pattern"))


# Term topics that cover frequent words: with common words, by hand, in two fragments, without case folding.
TERM_TOPICS = [
    (0, "by_hand", ["(?i:in|er)"]), (1, "term1", ["(?i:wh|he|nd)"]), (2, "term2", ["(?i:he|the|es)"]), (3, "term3", ["(?i:as", "|le)"]),
    (4, "term4", ["re|and|que"]), (5, "term7", ["(?i:eux|hat|on)"])]

# A reply per window names a word of every eighth line: (n, folded, term, kind, gloss, w) in staging order.
_TOLD_WORDS = WINDOWS + """
, picked AS (SELECT s.seq, s.window_no, l.cue_no, regexp_extract(l.line, '[a-z]{2,}') AS word
             FROM staged s JOIN lines l ON l.video_id = s.video_id AND l.cue_no BETWEEN s.first_cue AND s.last_cue AND l.cue_no % 8 = 0),
ent AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq, window_no) AS n, seq, window_no, list(word ORDER BY cue_no) AS said FROM picked WHERE word <> '' GROUP BY seq, window_no
                     HAVING (seq + window_no) % 5 <> 0),
e AS MATERIALIZED (SELECT n, 'T' || said[1][1:2] AS term, lower('T' || said[1][1:2]) AS folded, CASE WHEN (seq + window_no) % 5 = 1 THEN '' ELSE 'word' END AS kind,
  CASE WHEN (seq + window_no) % 5 = 2 THEN 'T' || said[1][1:2] || ' = more. about ' || said[1] ELSE 'about ' || said[1] END AS gloss,
  list_filter(said, lambda x, i: list_position(said, x) = i) AS w FROM ent)
"""


def told_words(spark, sf):
    """Replies to all windows: a term block over the words of its lines, behind it one that fails; every fifth says NONE."""
    w = window_spans(spark, sf).select("id", "seq", "window_no", "video_id", "first_cue", "last_cue")
    lines = b.lines(spark, sf).where("cue_no % 8 = 0").select("video_id", "cue_no", F.regexp_extract("line", "[a-z]{2,}", 0).alias("word")).where("word <> ''")
    said = w.join(lines, "video_id").where("cue_no between first_cue and last_cue").groupBy(*w.columns).agg(
        F.array_sort(F.collect_list(F.struct("cue_no", "word"))).alias("said"))
    k, first = (F.col("seq") + F.col("window_no")) % 5, F.get("said", F.lit(0))["word"]
    seen = F.array_join(F.transform("said", lambda x: x["word"]), " | ")
    cues = F.array_join(F.transform("said", lambda x: F.concat(F.lit("#"), x["cue_no"].cast("string"))), " ")
    block = F.concat(F.lit("TERM: T"), F.substring(first, 1, 2), F.when(k == 1, F.lit("")).otherwise(F.lit("\nKIND: Word")),
                     F.when(k == 2, F.lit("\nMEANS: more")).otherwise(F.lit("")), F.lit("\nGLOSS: about "), first, F.lit("\nSEEN: never said | "), seen,
                     F.lit("\nCUES: "), cues, F.lit("\n\nTERM: lost\nSEEN: "), seen, F.lit("\nCUES: "), cues)
    return said.select(*w.columns, F.when(k == 0, F.lit("NONE")).otherwise(block).alias("text"))


@query("consolidate_terms", _TOLD_WORDS + """
, walk AS (
  SELECT CAST(0 AS BIGINT) AS n, 'none' AS act, CAST(-1 AS BIGINT) AS owner, CAST([] AS VARCHAR[]) AS put, CAST([] AS VARCHAR[]) AS idx_f, CAST([] AS BIGINT[]) AS idx_o,
    [{'k': 'in', 'o': CAST(-1 AS BIGINT)}, {'k': 'er', 'o': -1}, {'k': 'wh', 'o': 1}, {'k': 'he', 'o': 1}, {'k': 'nd', 'o': 1}, {'k': 'he', 'o': 2}, {'k': 'the', 'o': 2},
     {'k': 'es', 'o': 2}, {'k': 'as', 'o': 3}, {'k': 'le', 'o': 3}, {'k': 'eux', 'o': 5}, {'k': 'hat', 'o': 5}, {'k': 'on', 'o': 5}] AS pairs
  UNION ALL
  SELECT n, act, owner, put, CASE WHEN act IN ('new', 'attach') THEN list_append(idx_f, folded) ELSE idx_f END,
    CASE WHEN act IN ('new', 'attach') THEN list_append(idx_o, owner) ELSE idx_o END,
    list_concat(pairs, list_transform(put, lambda x: {'k': x, 'o': owner}))
  FROM (SELECT *, CASE WHEN act IN ('new', 'grow') THEN novel ELSE CAST([] AS VARCHAR[]) END AS put FROM (
    SELECT n, folded, pairs, idx_f, idx_o, novel,
      CASE WHEN own IS NOT NULL THEN CASE WHEN own <> 3 AND len(novel) > 0 THEN 'grow' ELSE 'none' END
           WHEN len(novel) > 0 THEN 'new'
           WHEN cover BETWEEN 0 AND 999 AND NOT list_contains(idx_o, cover) THEN 'attach' ELSE 'none' END AS act,
      CASE WHEN own IS NOT NULL THEN own WHEN len(novel) > 0 THEN 1000 + n ELSE cover END AS owner
    FROM (SELECT *, CASE WHEN len(os) > 0 THEN (list_min(list_transform(list_distinct(os), lambda o: o - 1000000000 * len(list_filter(os, lambda y: y = o))))
                         % 1000000000 + 1000000000) % 1000000000 END AS cover
      FROM (SELECT e.n, e.folded, w.pairs, w.idx_f, w.idx_o, w.idx_o[list_position(w.idx_f, e.folded)] AS own,
              list_filter(e.w, lambda x: NOT list_contains(list_transform(w.pairs, lambda p: p.k), x)) AS novel,
              list_transform(list_filter(w.pairs, lambda p: p.o >= 0 AND list_contains(e.w, p.k)), lambda p: p.o) AS os
            FROM walk w JOIN e ON e.n = w.n + 1)))))
, since AS (SELECT e.folded, w.owner, w.n, w.act FROM walk w JOIN e USING (n) WHERE w.act IN ('new', 'attach')),
numbered AS (SELECT *, CASE WHEN act = 'new' THEN row_number() OVER (PARTITION BY act ORDER BY n) END AS k FROM since),
grown AS (SELECT owner, string_agg(array_to_string(put, '|'), '|' ORDER BY n) AS added FROM walk WHERE len(put) > 0 GROUP BY owner),
info AS (SELECT s.folded, arg_min(term, e.n) AS term, arg_min(gloss, e.n) AS gloss, coalesce(arg_min(kind, e.n) FILTER (kind <> ''), '') AS kind
         FROM since s JOIN e ON e.folded = s.folded AND e.n >= s.n GROUP BY s.folded),
old(owner, name, own, mid) AS (VALUES (1, 'term1', '(?i:wh|he|nd)', 'wh|he|nd'), (2, 'term2', '(?i:he|the|es)', 'he|the|es'), (3, 'term3', '(?i:as|le)', ''),
     (5, 'term7', '(?i:eux|hat|on)', 'eux|hat|on'))
SELECT CASE WHEN act = 'new' THEN 'term' || CASE WHEN k <= 2 THEN k + 4 ELSE k + 5 END ELSE old.name END AS name, term, kind, gloss,
  CASE WHEN act = 'new' THEN '(?i:' || added || ')' WHEN added IS NULL THEN old.own ELSE '(?i:' || old.mid || '|' || added || ')' END AS pattern, act = 'attach' AS attached
FROM numbered s JOIN info USING (folded) LEFT JOIN grown g ON g.owner = s.owner LEFT JOIN old ON old.owner = s.owner""")
def consolidate_terms(spark, sf):
    replies = told_words(spark, sf)
    held = R.validate_terms(R.parse_term_replies(replies, ["id"]), replies, b.lines(spark, sf))
    held = held.join(replies.select("id", "seq", "window_no"), "id")
    topics = spark.createDataFrame(TERM_TOPICS, "seq INT, name STRING, fragments ARRAY<STRING>")
    return R.consolidate_terms(held, topics, ["seq", "window_no", "block_no"])


@query("prefix_replay", _REPLIES + """
, missing AS (SELECT min(seq * 100000 + window_no) AS stop FROM told WHERE seq % 400 = 399)
SELECT id, seq, window_no FROM told, missing WHERE stop IS NULL OR seq * 100000 + window_no < stop""")
def prefix_replay(spark, sf):
    w = window_spans(spark, sf)
    return R.prefix_replay(w, w.where("seq % 400 <> 399"), ["seq", "window_no"]).select("id", "seq", "window_no")


_PATTERN_LIST = "[" + ", ".join("'" + p + "'" for p in b.SEARCHES[:6]) + "]"
_TIDY = {"that|than": "that|than", "than|that": "than|that", "(?i:That|than)": "(?i:That|than)", "(?:that|than)": "that|than",
         "[Tt]han": "[Tt]han", "(?i:than)": "(?i:than)"}
_TIDY_LIST = "[" + ", ".join("'" + _TIDY[p] + "'" for p in b.SEARCHES[:6]) + "]"


def probe_texts(spark, sf):
    n, k = F.col("doc_id"), F.col("doc_id") % 9
    pat = F.get(F.array(*[F.lit(p) for p in b.SEARCHES[:6]]), (F.expr("doc_id div 9") % 6).cast("int"))
    text = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("NONE of it")).when(k == 2, F.concat(F.lit("note REGEX: x\nREGEX: \t"), pat))
            .when(k == 3, F.lit("no answer line")).when(k == 4, F.concat(F.lit("REGEX: that\nsay REGEX: "), pat))
            .when(k == 5, F.lit("REGEX: (open")).when(k == 6, F.lit("REGEX: qqqzz\n"))
            .when(k == 7, F.concat(F.lit("REGEX: "), pat, F.lit(" \r\nbye"))).otherwise(F.lit("REGEX:\n")))
    return b.doc_words(spark, sf).select(n.alias("id"), (n % 2 + 1).alias("attempt"), text.alias("text"))


@query("classify_probe_replies", f"""
SELECT doc_id AS id, CASE WHEN k = 0 THEN 'waiting' WHEN k = 1 THEN 'retired' WHEN k IN (2, 7) THEN 'search' WHEN doc_id % 2 = 1 THEN 'retired'
  WHEN k IN (3, 4, 8) THEN 'retry: no line' WHEN k = 5 THEN 'retry: invalid' ELSE 'retry: no match' END AS verdict,
  CASE WHEN k IN (2, 7) THEN ({_TIDY_LIST})[doc_id // 9 % 6 + 1] WHEN k = 5 THEN '(open' WHEN k = 6 THEN 'qqqzz' END AS pattern
FROM (SELECT doc_id, doc_id % 9 AS k FROM words)""")
def classify_probe_replies(spark, sf):
    def count_hits(patterns):
        hits = match.match_join(b.lines(spark, sf), patterns)
        return hits.groupBy("name").agg(F.count("*").alias("n_hits"))
    return R.classify_probe_replies(probe_texts(spark, sf), count_hits)


@query("harvest_focus_replies", """
, t AS (SELECT doc_id AS seq, w1, w2, doc_id % 5 AS k FROM words),
br AS (SELECT seq, 0 AS branch_no, w1 AS text FROM t WHERE k IN (0, 2) UNION ALL SELECT seq, 1, w2 FROM t WHERE k = 0),
f AS (SELECT text, min(seq * 10 + branch_no) AS at FROM br WHERE text NOT IN ('that', 'than', 'nicht', 'auf', 'aa', 'bb', 'qqqzz') GROUP BY text)
SELECT b.seq, CASE WHEN t.k = 0 THEN t.w1 || '|' || t.w2 ELSE t.w1 END AS pattern, string_agg(b.text, '|' ORDER BY branch_no) AS rebuilt
FROM br b JOIN f ON f.text = b.text AND f.at = b.seq * 10 + b.branch_no JOIN t ON t.seq = b.seq GROUP BY b.seq, t.k, t.w1, t.w2""")
def harvest_focus_replies(spark, sf):
    k = F.col("doc_id") % 5
    text = (F.when(k == 0, F.concat(F.lit("REGEX: "), "w1", F.lit("|"), "w2", F.lit("\n\nprose")))
            .when(k == 1, F.concat(F.lit("REGEX: "), "w1", F.lit("\n\nNONE")))
            .when(k == 2, F.concat(F.lit("prose\nREGEX: "), "w1"))
            .when(k == 3, F.lit("NONE")).otherwise(F.lit("REGEX: (open\n\nprose")))
    replies = b.doc_words(spark, sf, k == 0).select(F.col("doc_id").alias("seq"), text.alias("text"))  # others name the first word or none
    waiting = b.table(spark, sf, "labels").where("quality < 0")
    return R.harvest_focus_replies(replies, catalog.corpus_keys(_catalogue(spark)), waiting)


@query("build_requests", """
SELECT id, sha256(text) AS user_sha, 1024 AS max_tokens, 0.0::DOUBLE AS temperature, false AS stream,
       'List named terms as TERM, KIND, MEANS, GLOSS, SEEN and CUES lines, blocks apart by a blank line, or NONE.' AS system
FROM staged""".replace("SELECT id", WINDOWS + "SELECT id", 1))
def build_requests(spark, sf):
    w = windows(spark, sf).select("id", F.lit("terms").alias("kind"), F.col("text").alias("body"))
    got = F.from_json("request", "stream BOOLEAN, messages ARRAY<STRUCT<role: STRING, content: STRING>>, max_tokens INT, temperature DOUBLE")
    r = Q.build_requests(w).select("id", got.alias("r"))
    return r.select("id", F.sha2(F.col("r.messages")[1]["content"], 256).alias("user_sha"), "r.max_tokens", "r.temperature",
                    "r.stream", F.col("r.messages")[0]["content"].alias("system"))


def first_line_of_user(request: str) -> str:
    """A stand-in model: answers with the first line it was asked about."""
    return json.loads(request)["messages"][-1]["content"].split("\n", 1)[0]


@query("ask_model", WINDOWS + "SELECT id, split_part(text, chr(10), 1) AS text FROM staged")
def ask_model(spark, sf):
    w = windows(spark, sf).select("id", F.lit("terms").alias("kind"), F.col("text").alias("body"))
    return Q.ask_model(Q.build_requests(w), first_line_of_user)


@query("read_responses", """
SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'http error' WHEN doc_id % 5 = 0 THEN 'ok' ELSE 'unreadable' END AS status,
  CASE doc_id % 5 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256('no ' || lang) WHEN 2 THEN sha256('bad ' || lang) WHEN 3 THEN sha256('') END AS text_sha FROM documents""")
def read_responses(spark, sf):
    k = F.col("doc_id") % 5
    good = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    body = (F.when(k == 0, good).when(k == 1, F.to_json(F.struct(F.struct(F.concat(F.lit("no "), "lang").alias("message")).alias("error"))))
            .when(k == 2, F.to_json(F.struct(F.concat(F.lit("bad "), "lang").alias("error")))).when(k == 3, F.lit("{}"))
            .otherwise(F.lit("{\"choices\":[]}")))
    docs = b.table(spark, sf, "documents").select("doc_id", F.when(k.isin(1, 2, 3), F.lit(500)).otherwise(F.lit(200)).alias("http_status"),
                                                  body.alias("body"))
    return R.read_responses(docs).select("doc_id", "status", F.sha2("text", 256).alias("text_sha"))


_CURRENT = """
SELECT event_id, CASE WHEN event_id % 3 = user_id % 3 AND event_id % 4 <> 1 THEN 'current' ELSE 'obsolete' END AS fate FROM events"""


@query("current_replies", _CURRENT)
def current_replies(spark, sf):
    e = b.table(spark, sf, "events")
    owed = e.select(F.col("user_id").alias("task_id"), (F.col("user_id") % 3).alias("epoch"), F.lit("t").alias("target")).distinct()
    replies = e.select("event_id", F.col("user_id").alias("task_id"), (F.col("event_id") % 3).alias("epoch"),
                       F.when(F.col("event_id") % 4 == 1, F.lit("old")).otherwise(F.lit("t")).alias("target"))
    current, obsolete = R.current_replies(replies, owed)
    return current.select("event_id", F.lit("current").alias("fate")).unionByName(
        obsolete.select("event_id", F.lit("obsolete").alias("fate")))


@query("head_lines", """
SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN 'PATTERN ' || lang || chr(10) || chr(10) WHEN doc_id % 4 = 1 THEN 'REGEX: ' || lang || chr(10) || chr(10) ELSE '' END || text) AS text_sha FROM documents""")
def head_lines(spark, sf):
    k = F.col("doc_id") % 4
    rows = b.table(spark, sf, "documents").select(
        "doc_id", F.when(k.isin(0, 3), F.lit("dive")).when(k == 1, F.lit("focus")).otherwise(F.lit("leaf")).alias("kind"),
        F.when(k != 3, F.col("lang")).alias("note"), "text")
    return Q.head_lines(rows).select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query("assemble_context", EXCERPT.replace("BUDGET", "3000") + """
, numbered AS (SELECT h.topic, h.video_id, h.cue_no, h.line, row_number() OVER (PARTITION BY topic, video_id ORDER BY cue_no) AS nth FROM hits h),
body AS (SELECT s.topic, s.seq, '== ' || v.file_name || chr(10) || string_agg(n.line || chr(10), '' ORDER BY n.cue_no) AS t
         FROM sections s JOIN numbered n ON n.topic = s.topic AND n.video_id = s.video_id AND n.nth <= s.n_lines
         JOIN videos v ON v.video_id = s.video_id GROUP BY s.topic, s.seq, v.file_name),
ex AS (SELECT topic, 'MATCHES' || chr(10) || string_agg(t, '' ORDER BY seq) AS m FROM body GROUP BY topic),
sums AS (SELECT topic, 'SUMMARIES' || chr(10) || string_agg('summary of ' || srt_id, chr(10) || chr(10) ORDER BY seq) AS s,
                bool_and(srt_id >= '4' OR topic <> 'term1') AS whole FROM sections GROUP BY topic),
ctx AS (SELECT topic, m, CASE WHEN topic = 'mixed' THEN 'OVERVIEW' || chr(10) || 'the whole' || chr(10) || '---' || chr(10) ELSE '' END || s AS c
        FROM ex JOIN sums USING (topic) WHERE whole)
SELECT topic AS id, sha256(CASE WHEN left(c, greatest(4000 - strlen(m) - 5, 0)) = '' THEN m
   ELSE left(c, greatest(4000 - strlen(m) - 5, 0)) || chr(10) || '---' || chr(10) || m END) AS body_sha FROM ctx""")
def assemble_context(spark, sf):
    """Dive requests from the excerpts; one topic waits while a summary it needs is missing."""
    hits, videos = match.scan_hits(b.lines(spark, sf), plan(spark)), b.videos(spark, sf)
    sections = chunking.excerpt_sections(hits, videos, 3000)
    excerpts = chunking.excerpt_text(hits, sections, videos).select(F.col("topic").alias("id"), "excerpt")
    # The dependency key carries the topic, so that a summary can be missing for one of them.
    dep = F.concat_ws("/", "topic", "srt_id")
    deps = sections.select(F.col("topic").alias("id"), F.col("seq").alias("ord"), dep.alias("dep"))
    texts = sections.where("not (srt_id < '4' and topic = 'term1')").select(
        dep.alias("dep"), F.concat(F.lit("summary of "), "srt_id").alias("text")).distinct()
    roots = deps.select(F.lit("root").alias("dep"), F.lit("the whole").alias("text")).distinct()
    refs = deps.where("id = 'mixed'").select("id", F.lit(0).cast("bigint").alias("ord"), F.lit("root").alias("dep")).distinct()
    out = Q.assemble_context(excerpts.select("id"), deps, refs, texts.unionByName(roots), excerpts, 4000)
    return out.select("id", F.sha2("body", 256).alias("body_sha"))


@query("assemble_pair", """
, p AS (SELECT doc_id, 'FIRST' || chr(10) || w1 || chr(10) || '---' || chr(10) || 'SECOND' || chr(10) || w2 AS pair, w1 || chr(10) || w3 AS snap FROM words)
SELECT 'focus' || doc_id AS id, pair || chr(10) || '---' || chr(10) || 'MATCHES' || chr(10) || snap AS body FROM p
UNION ALL SELECT 'probe' || doc_id, pair || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '---' || chr(10) || snap ELSE '' END FROM p
UNION ALL SELECT 'node' || doc_id, w1 || chr(10) || '---' || chr(10) || w2 FROM words""")
def assemble_pair(spark, sf):
    w = b.doc_words(spark, sf)
    n = F.col("doc_id").cast("string")
    pairs = w.select(n.alias("id"), F.concat(F.lit("a"), n).alias("first"), F.concat(F.lit("b"), n).alias("second"))
    texts = w.select(F.concat(F.lit("a"), n).alias("dep"), F.col("w1").alias("text")).unionByName(
        w.select(F.concat(F.lit("b"), n).alias("dep"), F.col("w2").alias("text")))
    snaps = w.select(n.alias("id"), F.concat("w1", F.lit("\n"), "w3").alias("snapshot"), "doc_id")
    named = lambda df, kind: df.select(F.concat(F.lit(kind), "id").alias("id"), "body")
    deps = pairs.select("id", F.lit(0).alias("ord"), F.col("first").alias("dep")).unionByName(
        pairs.select("id", F.lit(1).alias("ord"), F.col("second").alias("dep")))
    focus = named(Q.assemble_pair(pairs, texts, snaps.drop("doc_id"), "focus"), "focus")
    probe = named(Q.assemble_pair(pairs, texts, snaps.where("doc_id % 2 = 0").drop("doc_id"), "probe"), "probe")
    return focus.unionByName(probe).unionByName(named(Q.assemble_node(deps, texts), "node"))


# ---- knowledge directory ------------------------------------------------------------------------

_DIRECTORY = """
, tp AS (SELECT seq, w1, CASE seq % 4 WHEN 0 THEN 'term' WHEN 1 THEN 'focus' ELSE 'topic' END || seq AS name, pattern FROM patterns WHERE seq % 7 <> 0),
trow AS (SELECT name, pattern, CASE WHEN seq % 4 = 0 AND seq % 8 = 0 THEN w1 ELSE name END AS title,
   array_to_string(list_filter([CASE WHEN seq % 8 = 0 AND seq % 3 = 0 THEN 'person' END,
      CASE WHEN seq % 4 < 2 THEN 'generated' END, CASE WHEN seq % 8 = 0 THEN 'proposed' END,
      CASE WHEN seq % 3 <> 0 AND seq % 4 <> 0 THEN 'pending' END], lambda x: x IS NOT NULL), ' · ') AS badge,
   CASE WHEN seq % 4 = 2 AND seq % 10 = 0 THEN 'human ' || w1 WHEN seq % 8 = 0 THEN left('gloss ' || repeat(w1, 40), 120) ELSE '' END AS gloss FROM tp),
frow AS (SELECT id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY id) AS n FROM (
   SELECT left(sha256(doc_id::VARCHAR), 16) AS id, w1 AS pattern FROM words WHERE doc_id % 3 <> 0)),
vrow AS (SELECT path, srt_id, file_name, count(*) OVER (PARTITION BY file_name) AS n, string_split(path, '/')[-2] AS folder FROM videos),
dir AS (
  SELECT 'Topics' AS "group", title, pattern, badge, gloss, name FROM trow
  UNION ALL SELECT 'Focuses', CASE WHEN n > 1 THEN pattern || ' (' || n || ')' ELSE pattern END, pattern, '', '', id FROM frow
  UNION ALL SELECT 'Videos', CASE WHEN n > 1 THEN file_name || ' — ' || folder ELSE file_name END, '', CASE WHEN srt_id[1] < '8' THEN '' ELSE 'pending' END, '', path FROM vrow)
"""


def _directory(spark, sf):
    words, pats = b.doc_words(spark, sf), b.doc_patterns(spark, sf)
    k, n = F.col("seq"), F.col("seq").cast("string")
    name = F.concat(F.when(k % 4 == 0, F.lit("term")).when(k % 4 == 1, F.lit("focus")).otherwise(F.lit("topic")), n)
    t = pats.join(words.withColumnRenamed("doc_id", "seq"), "seq").withColumn("name", name)
    info = t.where("seq % 8 = 0").select("name", F.col("w1").alias("term"), F.when(k % 3 == 0, F.lit("person")).alias("kind"),
                                         F.concat(F.lit("gloss "), F.repeat("w1", 40)).alias("gloss"))
    human = t.where("seq % 4 = 2 and seq % 10 = 0").select(
        "seq", F.col("name").alias("title"), F.array(F.concat(F.lit("human "), "w1"), F.lit("more")).alias("lines"))
    topics = knowledge.topic_rows(t.select("name", "pattern"), t.where("seq % 7 = 0").select("name"), info, human,
                                  t.where("seq % 3 = 0").select("name"))
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.lit("NONE")).when(k % 3 == 1, F.concat(F.lit("REGEX: "), "w1", F.lit("\n\nprose"))).otherwise(
        F.concat(F.lit("prose\nREGEX: "), "w1"))
    focuses = knowledge.focus_rows(words.select(sha_head(k.cast("string")).alias("id"), text.alias("text")))
    v = b.videos(spark, sf)
    videos = knowledge.video_rows(v.select("path", "srt_id"), v.where("srt_id < '8'").select("srt_id").distinct())
    return topics.unionByName(focuses).unionByName(videos)


@query("knowledge_directory", _DIRECTORY + "SELECT * FROM dir")
def knowledge_directory(spark, sf):
    return knowledge.directory_order(_directory(spark, sf))


@query("directory_filter", _DIRECTORY + """
SELECT * FROM dir WHERE regexp_matches(title, '(?i)person|^The') OR regexp_matches(badge, '(?i)person|^The')
  OR regexp_matches(gloss, '(?i)person|^The') OR regexp_matches(pattern, '(?i)person|^The')""")
def directory_filter(spark, sf):
    return knowledge.directory_filter(_directory(spark, sf), "person|^The")
