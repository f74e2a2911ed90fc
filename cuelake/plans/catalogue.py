"""Queries of the topic catalogue: files, checks, references, branch algebra, growth."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from cuelake.operators import catalog
from cuelake.plans import bindings as b
from cuelake.plans.registry import query
from cuelake.session import cut
from cuelake.sources import sinks, topics


@query("topics_load", """
SELECT doc_id AS file, 'base' || doc_id AS name, ['(' || w1 || '|' || w2 || ')'] AS fragments FROM words
UNION ALL SELECT doc_id, 'pair', ['\\{base' || doc_id || ':}', '-?' || w3] FROM words
UNION ALL SELECT doc_id, CASE doc_id % 16 WHEN 2 THEN 'pair' WHEN 3 THEN 'empty' WHEN 4 THEN 'lone' WHEN 5 THEN 'a' ELSE 'bad name' END,
  CASE doc_id % 16 WHEN 2 THEN ['again'] WHEN 3 THEN CAST([] AS VARCHAR[]) WHEN 4 THEN ['\\{nobody:}'] WHEN 5 THEN ['x\\{b:}'] ELSE ['x'] END
  FROM words WHERE doc_id % 16 BETWEEN 2 AND 6
UNION ALL SELECT doc_id, 'b', ['\\{a:}y'] FROM words WHERE doc_id % 16 = 5""")
def topics_load(spark, sf):
    return topics.load_topics(topics.read_items(b.topic_files(spark, sf))).select("file", "name", "fragments")


@query("corpus_videos_load", """
SELECT doc_id AS file, 'clip' || doc_id || '.mp4' AS path, 'clip' || doc_id || '.srt' AS srt, ['pair'] AS topics FROM words
UNION ALL SELECT doc_id, 'other' || doc_id || '.mp4', NULL, CAST([] AS VARCHAR[]) FROM words
UNION ALL SELECT doc_id, 'clip' || doc_id || '.mp4', 'x.srt', ['pair', 'pair'] FROM words WHERE doc_id % 16 = 7""")
def corpus_videos_load(spark, sf):
    return topics.load_videos(topics.read_items(b.topic_files(spark, sf))).select("file", "path", "srt", "topics")


@query("topics_lint", """
, n AS (SELECT doc_id AS file, doc_id % 16 AS k FROM words)
SELECT file, CAST(11 AS BIGINT) AS line, CASE k WHEN 1 THEN 'not an item' WHEN 2 THEN 'duplicate topic' WHEN 3 THEN 'no pattern'
  WHEN 5 THEN 'circular reference' WHEN 6 THEN 'bad name' ELSE 'duplicate video' END AS rule,
  CASE k WHEN 1 THEN 'junk line' WHEN 2 THEN 'pair' WHEN 3 THEN 'empty' WHEN 5 THEN 'a' WHEN 6 THEN 'bad name'
         ELSE 'file://clip' || file || '.mp4' END AS detail FROM n WHERE k IN (1, 2, 3, 5, 6, 7)
UNION ALL SELECT file, 12, 'unknown topic', 'nobody' FROM n WHERE k = 4
UNION ALL SELECT file, 13, 'circular reference', 'b' FROM n WHERE k = 5
UNION ALL SELECT file, 13, 'second subtitle file', 'file://y.srt' FROM n WHERE k = 7
UNION ALL SELECT file, 15, 'duplicate topic reference', 'pair' FROM n WHERE k = 7
UNION ALL SELECT file, 1, 'orphan item', 'stray' FROM n WHERE k = 8""")
def topics_lint(spark, sf):
    return topics.lint(b.topic_files(spark, sf))


@query("gloss_load", """
SELECT doc_id AS file, 'term' || doc_id AS name, ['about ' || w1, 'and ' || w2, 'tail'] AS lines FROM words
UNION ALL SELECT doc_id, 'none' || doc_id, CAST([] AS VARCHAR[]) FROM words""")
def gloss_load(spark, sf):
    return topics.load_gloss(b.gloss_files(spark, sf)).select("file", "name", "lines")


@query("gloss_write", """
SELECT doc_id AS file, count(*) AS n_lines, string_agg(t, chr(10) ORDER BY o) AS text FROM (
  SELECT doc_id, unnest(['- term' || doc_id, '  - about ' || w1, '  - and ' || w2, '  - tail', '', '- none' || doc_id]) AS t,
         unnest([1, 2, 3, 4, 5, 6]) AS o FROM words) GROUP BY doc_id""")
def gloss_write(spark, sf):
    rows = topics.gloss_lines(topics.load_gloss(b.gloss_files(spark, sf)))
    return _joined(rows)


def _joined(rows):
    """Lines back to one text per file, to compare them."""
    whole = F.array_sort(F.collect_list(F.struct("section", "seq", "ord", "text")))
    return rows.groupBy("file").agg(F.count("*").alias("n_lines"), whole.alias("l")).select(
        "file", "n_lines", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


@query("corpus_write", """
, rows AS (SELECT doc_id, unnest(['- base' || doc_id, '  - (' || w1 || '|' || w2 || ')', '', '- pair', '  - \\{base' || doc_id || ':}',
  '  - -?' || w3, '', '- file://clip' || doc_id || '.mp4', '  - file://clip' || doc_id || '.srt', '  - pair', '',
  '- file://other' || doc_id || '.mp4']) AS t, unnest(range(12)) AS o FROM words WHERE doc_id % 16 = 0 OR doc_id % 16 > 8)
SELECT doc_id AS file, count(*) AS n_lines, string_agg(t, chr(10) ORDER BY o) AS text FROM rows GROUP BY doc_id""")
def corpus_write(spark, sf):
    files = b.topic_files(spark, sf)
    items = cut(topics.read_items(topics.accepted(files, cut(topics.lint(files)))))
    return _joined(topics.corpus_lines(topics.load_topics(items), topics.load_videos(items)))


@query("topic_closure", """
, n AS (SELECT doc_id AS file, doc_id % 16 AS k FROM words)
SELECT file, 'pair' AS name, 'base' || file AS ref, 1 AS depth, false AS cyclic FROM n
UNION ALL SELECT file, 'lone', 'nobody', 1, false FROM n WHERE k = 4
UNION ALL SELECT file, unnest(['a', 'b', 'a', 'b']), unnest(['b', 'a', 'a', 'b']), unnest([1, 1, 2, 2]),
                 unnest([false, false, true, true]) FROM n WHERE k = 5""")
def topic_closure(spark, sf):
    return catalog.topic_closure(topics.load_topics(topics.read_items(b.topic_files(spark, sf))), ["file"]).select(
        "file", "name", "ref", "depth", "cyclic")


@query("expand_topics", """
SELECT doc_id AS file, 'base' || doc_id AS name, '(' || w1 || '|' || w2 || ')' AS pattern FROM words WHERE doc_id % 16 = 0 OR doc_id % 16 > 8
UNION ALL SELECT doc_id, 'pair', '(?:(' || w1 || '|' || w2 || '))-?' || w3 FROM words WHERE doc_id % 16 = 0 OR doc_id % 16 > 8""")
def expand_topics(spark, sf):
    files = b.topic_files(spark, sf)
    items = cut(topics.read_items(topics.accepted(files, cut(topics.lint(files)))))
    return catalog.expand_topics(topics.load_topics(items), ["file"]).select("file", "name", "pattern")


@query("components", "SELECT doc_id AS file, 'base' || doc_id AS name FROM words "
                     "UNION ALL SELECT doc_id, unnest(['a', 'b']) FROM words WHERE doc_id % 16 = 5")
def components(spark, sf):
    return catalog.components(topics.load_topics(topics.read_items(b.topic_files(spark, sf))), ["file"]).select("file", "name")


@query("export_plan_hits", """
SELECT name, pattern, parts, n FROM (VALUES
  ('mixed', '(?<g0>(?:(that|than)))|(?<g1>(?:(?:nicht|auf)))|[Pp]our', 'english:1 german:3'),
  ('article', '(?i:the |les |der )', ''), ('nohit', 'qqqzz', ''), ('term1', '(?i:wh)', ''),
  ('focus1', 'ou[eu]x?', '')) p(name, pattern, parts)
JOIN (SELECT p.name, count(h.topic) AS n FROM plan p LEFT JOIN hits h ON h.topic = p.name GROUP BY p.name) USING (name)""")
def export_plan_hits(spark, sf):
    """The export plan with each grouping's hit count over the corpus."""
    from cuelake.operators import match
    from cuelake.plans.matching import plan
    items = match.pattern_guard(plan(spark)).where("valid")
    counts = match.scan_hits(b.lines(spark, sf), items).groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("n"))
    parts = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["part"], p["group_idx"].cast("string"))), " ")
    return items.join(counts, "name", "left").select("name", "pattern", parts.alias("parts"),
                                                     F.coalesce("n", F.lit(0)).alias("n"))


@query("topics_exportable", """
SELECT name, exported, generated, n FROM (VALUES ('mixed', true, false), ('article', true, false),
  ('nohit', true, false), ('focus1', false, true), ('english', false, false), ('german', false, false)) p(name, exported, generated)
JOIN (SELECT name, count(line) AS n FROM (VALUES ('mixed', '((?:(that|than)))|((?:(?:nicht|auf)))|[Pp]our'),
  ('article', '(?i:the |les |der )'), ('nohit', 'qqqzz'), ('focus1', 'ou[eu]x?'), ('english', '(that|than)'),
  ('german', '(?:nicht|auf)')) q(name, pattern) LEFT JOIN lines ON regexp_matches(line, pattern) GROUP BY name) USING (name)""")
def topics_exportable(spark, sf):
    """Scans owed by the catalogue, with their hit counts."""
    from cuelake.operators import match
    scans = match.pattern_guard(catalog.topics_exportable(b.topics(spark))).where("valid")
    scans = cut(scans)
    counts = match.match_join(b.lines(spark, sf), scans).groupBy("name").agg(F.count("*").alias("n"))
    return scans.join(counts, "name", "left").select("name", "exported", "generated", F.coalesce("n", F.lit(0)).alias("n"))


@query("machine_topics", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'index' WHEN doc_id % 4 = 1 THEN 'supportive' ELSE 'main' END AS role FROM words""")
def machine_topics(spark, sf):
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = (F.when(k == 0, F.concat(F.lit("term"), n)).when(k == 1, F.concat(F.lit("focus"), n))
            .when(k == 2, F.lit("focus")).otherwise(F.concat(F.lit("term"), n, F.lit("x"))))
    return catalog.machine_topics(b.doc_words(spark, sf).select("doc_id", name.alias("name"))).select("doc_id", "role")


@query("pattern_branches", "SELECT seq, CAST(branch_no AS INTEGER) AS branch_no, text, key FROM branches")
def pattern_branches(spark, sf):
    return catalog.pattern_branches(b.doc_patterns(spark, sf), ["seq"]).select("seq", "branch_no", "text", "key")


@query("normal_key", """
SELECT seq, string_agg(key, '|' ORDER BY encode(key)) AS normal_key FROM (SELECT DISTINCT seq, key FROM branches) GROUP BY seq""")
def normal_key(spark, sf):
    return catalog.normal_key(catalog.pattern_branches(b.doc_patterns(spark, sf), ["seq"]), ["seq"])


@query("searches_by_meaning", """
, k(pattern, key) AS (VALUES ('that|than', 'than|that'), ('than|that', 'than|that'), ('(?i:That|than)', chr(10) || 'than|' || chr(10) || 'that'),
  ('(?:that|than)', 'than|that'), ('[Tt]han', chr(10) || 'than'), ('(?i:than)', chr(10) || 'than'), ('nicht|auf', 'auf|nicht'),
  ('(auf)|nicht', 'auf|nicht'), ('pour', 'pour'), (' pour', ' pour'), ('[a-c]x|[cab]x', '[a-c]x'), ('(a)\\1', '(a)\\1'))
SELECT key AS normal_key, count(*) AS n_searches, count(DISTINCT pattern) AS n_spellings FROM search_log JOIN k USING (pattern) GROUP BY key""")
def searches_by_meaning(spark, sf):
    log = b.search_log(spark, sf).groupBy("pattern").agg(F.count("*").alias("n"))
    keyed = catalog.normal_key(catalog.pattern_branches(log, ["pattern"]), ["pattern"]).join(log, "pattern")
    return keyed.groupBy("normal_key").agg(F.sum("n").alias("n_searches"), F.count("*").alias("n_spellings"))


@query("tidy", """
SELECT seq, CASE WHEN folds THEN '(?i:' || string_agg(text, '|' ORDER BY branch_no) || ')'
            ELSE string_agg(text, '|' ORDER BY branch_no) END AS tidied
FROM (SELECT seq, folds, arg_min(text, branch_no) AS text, min(branch_no) AS branch_no FROM branches
      GROUP BY seq, folds, CASE WHEN folds THEN key ELSE text END) GROUP BY seq, folds""")
def tidy(spark, sf):
    return catalog.tidy(catalog.pattern_branches(b.doc_patterns(spark, sf), ["seq"]), ["seq"])


@cache
def _catalogue(spark):
    return cut(catalog.expand_topics(b.topics(spark)).unionByName(
        spark.createDataFrame([(90, "search2", "aa|bb")], "seq INT, name STRING, pattern STRING")))


@query("adopt", """
, keyed AS (SELECT seq, string_agg(key, '|' ORDER BY encode(key)) AS nk FROM (SELECT DISTINCT seq, key FROM branches) GROUP BY seq),
first AS (SELECT min(seq) AS seq FROM keyed WHERE nk NOT IN ('aa|bb') GROUP BY nk),
ranked AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM first)
SELECT r.seq, pattern, 'search' || CASE WHEN k = 1 THEN k ELSE k + 1 END AS name FROM ranked r JOIN patterns p USING (seq)""")
def adopt(spark, sf):
    return catalog.adopt(b.doc_patterns(spark, sf), _catalogue(spark)).select("seq", "pattern", "name")


_NOVEL = """
, novel AS (SELECT key, min(seq * 10 + branch_no) AS at FROM branches
            WHERE key NOT IN ('that', 'than', 'nicht', 'auf', 'aa', 'bb', 'qqqzz', chr(10) || 'wh', chr(10) || 'pour') GROUP BY key),
kept AS (SELECT b.* FROM branches b JOIN novel n ON n.key = b.key AND n.at = b.seq * 10 + b.branch_no),
rebuilt AS (SELECT seq, CASE WHEN folds THEN '(?i:' || string_agg(text, '|' ORDER BY branch_no) || ')'
            ELSE string_agg(text, '|' ORDER BY branch_no) END AS rebuilt FROM kept GROUP BY seq, folds)
"""


@query("adopt_novel", _NOVEL + "SELECT seq, pattern, rebuilt FROM rebuilt JOIN patterns USING (seq)")
def adopt_novel(spark, sf):
    return catalog.adopt_novel(b.doc_patterns(spark, sf), catalog.corpus_keys(_catalogue(spark)))


@query("cover_of", _NOVEL + """
, held AS (SELECT key, seq AS owner FROM kept),
wanted AS (SELECT seq, branch_no, key FROM branches),
counts AS (SELECT w.seq, h.owner, count(*) AS n FROM wanted w JOIN held h USING (key) GROUP BY ALL)
SELECT seq, 'term' || arg_max(owner, n * 1000000000 - owner) AS owner, max(n) AS n_covered FROM counts GROUP BY seq""")
def cover_of(spark, sf):
    """Every pattern against the term topics that adoption made of them (each key has one owner)."""
    incoming = b.doc_patterns(spark, sf)
    grown = cut(catalog.adopt_novel(incoming, catalog.corpus_keys(_catalogue(spark))))
    owners = grown.select("seq", F.concat(F.lit("term"), F.col("seq").cast("string")).alias("name"),
                          F.col("rebuilt").alias("pattern"))
    return catalog.cover_of(incoming, owners, "term")


@query("extend", """
, own AS (SELECT w.doc_id, w.w3 AS pattern FROM words w WHERE doc_id % 4 = 0),
req AS (SELECT b.seq, b.branch_no, b.text, b.key FROM branches b WHERE NOT folds AND seq % 4 IN (0, 2, 3)),
cov AS (SELECT DISTINCT pattern AS key FROM own),
new AS (SELECT key, min(seq * 10 + branch_no) AS at FROM req WHERE key NOT IN (SELECT key FROM cov) GROUP BY key),
kept AS (SELECT r.seq, r.branch_no, r.text, r.seq - r.seq % 4 AS owner FROM req r JOIN new n ON n.key = r.key AND n.at = r.seq * 10 + r.branch_no)
SELECT 'term' || o.doc_id AS name, pattern, pattern || '|' || string_agg(text, '|' ORDER BY seq, branch_no) AS grown
FROM kept JOIN own o ON o.doc_id = owner GROUP BY o.doc_id, pattern""")
def extend(spark, sf):
    words = b.doc_words(spark, sf).where("doc_id % 4 = 0")
    owned = words.select(F.concat(F.lit("term"), F.col("doc_id").cast("string")).alias("name"), F.array("w3").alias("fragments"))
    covered = catalog.corpus_keys(owned.select("name", F.get("fragments", F.lit(0)).alias("pattern")))
    requests = b.doc_patterns(spark, sf).select("seq", F.concat(
        F.lit("term"), (F.col("seq") - F.col("seq") % 4).cast("string")).alias("name"), "pattern")
    return catalog.extend(requests, owned, covered)


@query("branches_union", "SELECT DISTINCT key FROM branches")
def branches_union(spark, sf):
    return catalog.corpus_keys(b.doc_patterns(spark, sf).select(F.col("seq").alias("name"), "pattern"))


@query("branches_except", """
SELECT DISTINCT key FROM branches WHERE key NOT IN ('that', 'than', 'nicht', 'auf', 'aa', 'bb', 'qqqzz', chr(10) || 'wh', chr(10) || 'pour')""")
def branches_except(spark, sf):
    mine = catalog.corpus_keys(b.doc_patterns(spark, sf).select(F.col("seq").alias("name"), "pattern"))
    return mine.join(catalog.corpus_keys(_catalogue(spark)), "key", "left_anti")


@query("keys_union", """
SELECT doc_id, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform([w1, w2, w1, w3], lambda x: [x])),
  lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS keys FROM words""")
def keys_union(spark, sf):
    return b.doc_words(spark, sf).select("doc_id", F.array_union(F.array("w1", "w2"), F.array("w1", "w3")).alias("keys"))


@query("keys_overlap", """
SELECT doc_id, CAST(len(list_intersect(list_distinct([w1, w2]), list_distinct([w2, w3]))) AS INTEGER) AS n FROM words""")
def keys_overlap(spark, sf):
    return b.doc_words(spark, sf).select(
        "doc_id", F.size(F.array_intersect(F.array("w1", "w2"), F.array("w2", "w3"))).alias("n"))


@query("next_version", """
SELECT source || '/' || lang AS target, max(quality) + 2 AS version FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL""")
def next_version(spark, sf):
    v = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id").select(
        F.concat_ws("/", "source", "lang").alias("target"), (F.col("quality") + 1).alias("version"))
    return sinks.next_version(v)
