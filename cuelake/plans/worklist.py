"""Queries of chunking, the summary pyramid, task states, scores and artifacts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from cuelake.functions.text import sha_head
from cuelake.operators import catalog, chunking, match, tasks as T
from cuelake.operators.ordered import RANGES, neighbours, ordinal, running_sum
from cuelake.plans import bindings as b
from cuelake.plans.matching import plan
from cuelake.plans.oracle import EXCERPT, GRAPH, TIERS, TREE
from cuelake.plans.registry import query
from cuelake.session import cut

WINDOWS = """
, sized AS MATERIALIZED (SELECT video_id, cue_no, '#' || cue_no || ' [' || (start_ms // 60000) || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0')
       || '.' || lpad((start_ms % 1000)::VARCHAR, 3, '0') || '] ' || line || chr(10) AS t FROM lines),
walkw AS (
  SELECT video_id, cue_no, CAST(0 AS BIGINT) AS window_no, CAST(strlen(t) AS BIGINT) AS used FROM sized WHERE cue_no = 0
  UNION ALL
  SELECT s.video_id, s.cue_no, CASE WHEN w.used >= 4000 THEN w.window_no + 1 ELSE w.window_no END,
         CASE WHEN w.used >= 4000 THEN strlen(s.t) ELSE w.used + strlen(s.t) END
  FROM walkw w JOIN sized s ON s.video_id = w.video_id AND s.cue_no = w.cue_no + 1)
, win AS (SELECT w.video_id, window_no, CAST(min(w.cue_no) AS BIGINT) AS first_cue, CAST(max(w.cue_no) AS BIGINT) AS last_cue,
            string_agg(t, '' ORDER BY w.cue_no) AS text FROM walkw w JOIN sized s ON s.video_id = w.video_id AND s.cue_no = w.cue_no
          GROUP BY w.video_id, window_no),
named_win AS (SELECT left(sha256('terms' || chr(10) || srt_id || chr(10) || first_cue || '-' || last_cue || chr(10) || text), 16) AS id,
                seq, v.video_id, srt_id, window_no, first_cue, last_cue, text FROM win JOIN videos v ON v.video_id = win.video_id),
staged AS (SELECT * FROM named_win QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq, window_no) = 1)
"""


@cache
def windows(spark, sf):
    """Staged windows, computed once per session for the queries that build on them."""
    return cut(chunking.term_windows(b.lines(spark, sf), b.videos(spark, sf).select("video_id", "seq", "srt_id"), 4000))


@cache
def window_spans(spark, sf):
    """Staged windows without their text, for the queries that only place replies."""
    return cut(chunking.term_windows(b.lines(spark, sf), b.videos(spark, sf).select("video_id", "seq", "srt_id"), 4000).drop("text"))


@query("term_windows", WINDOWS + "SELECT id, seq, video_id, window_no, first_cue, last_cue, sha256(text) AS text_sha FROM staged")
def term_windows(spark, sf):
    staged = chunking.term_windows(b.lines(spark, sf), b.videos(spark, sf).select("video_id", "seq", "srt_id"), 4000)
    return staged.select("id", "seq", "video_id", "window_no", "first_cue", "last_cue", F.sha2("text", 256).alias("text_sha"))


@query("excerpt_budget", EXCERPT.replace("BUDGET", "49152") + """
SELECT topic, seq, video_id, srt_id, n_lines, n_bytes FROM sections""")
def excerpt_budget(spark, sf):
    return chunking.excerpt_sections(match.scan_hits(b.lines(spark, sf), plan(spark)), b.videos(spark, sf))


@query("excerpt_text", EXCERPT.replace("BUDGET", "3000") + """
, numbered AS (SELECT h.topic, h.video_id, h.cue_no, h.line, row_number() OVER (PARTITION BY topic, video_id ORDER BY cue_no) AS nth FROM hits h),
body AS (SELECT s.topic, s.seq, '== ' || v.file_name || chr(10) || string_agg(n.line || chr(10), '' ORDER BY n.cue_no) AS t
         FROM sections s JOIN numbered n ON n.topic = s.topic AND n.video_id = s.video_id AND n.nth <= s.n_lines
         JOIN videos v ON v.video_id = s.video_id GROUP BY s.topic, s.seq, v.file_name)
SELECT topic, count(*) AS n_sections, sha256(string_agg(t, '' ORDER BY seq)) AS excerpt_sha FROM body GROUP BY topic""")
def excerpt_text(spark, sf):
    hits, videos = match.scan_hits(b.lines(spark, sf), plan(spark)), b.videos(spark, sf)
    out = chunking.excerpt_text(hits, chunking.excerpt_sections(hits, videos, 3000), videos)
    return out.select("topic", "n_sections", F.sha2("excerpt", 256).alias("excerpt_sha"))


_PARTNERS = """
c AS (SELECT b.seq AS later, a.seq AS earlier, count(*) AS overlap FROM k a JOIN k b ON a.srt_id = b.srt_id AND a.seq < b.seq GROUP BY ALL)
SELECT later, earlier, overlap, CAST(nth AS INTEGER) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY later ORDER BY overlap DESC, earlier DESC) AS nth FROM c) WHERE nth <= 3"""


@query("pair_overlap", EXCERPT.replace("BUDGET", "49152") + """
, k AS (SELECT DISTINCT p.seq, s.srt_id FROM sections s JOIN plan p ON p.name = s.topic AND p.kind = 'main'),""" + _PARTNERS)
def pair_overlap(spark, sf):
    """Dives of the catalogue by the subtitles they quote; generated scans stay out."""
    quoted = chunking.excerpt_sections(match.scan_hits(b.lines(spark, sf), plan(spark)), b.videos(spark, sf))
    scans = catalog.machine_topics(plan(spark)).select("seq", "name", (F.col("role") != "main").alias("generated"))
    return chunking.pair_overlap(scans, quoted.select(F.col("topic").alias("name"), F.col("srt_id").alias("key")))


@query("pair_overlap_words", """
, said AS (SELECT DISTINCT word AS name, srt_id FROM (SELECT video_id, unnest(regexp_extract_all(line, '[a-z]{2,3}')) AS word FROM lines WHERE cue_no % 4 = 0)
           JOIN videos USING (video_id)),
num AS (SELECT name, row_number() OVER (ORDER BY encode(name)) AS seq FROM (SELECT DISTINCT name FROM said)),
k AS (SELECT seq, srt_id FROM said JOIN num USING (name) WHERE seq % 5 <> 3),""" + _PARTNERS)
def pair_overlap_words(spark, sf):
    """A scan per short word, many of them with thousands of subtitles in common; every fifth is generated."""
    lines = b.lines(spark, sf).where("cue_no % 4 = 0")
    words = lines.select("video_id", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[a-z]{2,3}"), F.lit(0)))).alias("name"))
    # A video is shuffled as one row with its words, once; the words to number come from the lines alone.
    spoken = words.groupBy("video_id").agg(F.collect_set("name").alias("names")).join(b.videos(spark, sf).select("video_id", "srt_id"), "video_id")
    said = spoken.select(F.explode("names").alias("name"), F.col("srt_id").alias("key"))
    scans = ordinal(cut(words.where("video_id is not null").select("name").distinct()), [], ["name"], "seq", RANGES)
    return chunking.pair_overlap(scans.select("seq", "name", (F.col("seq") % 5 == 3).alias("generated")), said)


@query("unique_sources", "SELECT srt_id AS id, min(seq) AS first_seq, row_number() OVER (ORDER BY min(seq)) - 1 AS pos "
                         "FROM videos GROUP BY srt_id")
def unique_sources(spark, sf):
    return T.unique_sources(b.videos(spark, sf))


@query("append_videos", """
, inc AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_id % 1500 ELSE event_id + 1000000 END AS video_id, event_id AS seq, '/new/' || event_id AS path FROM events),
fresh AS (SELECT video_id, min(seq) AS seq, arg_min(path, seq) AS path FROM inc WHERE video_id NOT IN (SELECT video_id FROM videos) GROUP BY video_id)
SELECT video_id, seq, path FROM videos
UNION ALL SELECT video_id, (SELECT max(seq) FROM videos) + row_number() OVER (ORDER BY seq), path FROM fresh""")
def append_videos(spark, sf):
    e = F.col("event_id")
    incoming = b.table(spark, sf, "events").select(
        F.when(e % 3 == 0, e % 1500).otherwise(e + 1000000).alias("video_id"), e.alias("seq"),
        F.concat(F.lit("/new/"), e.cast("string")).alias("path"))
    return T.append_videos(b.videos(spark, sf), incoming)


@query("pyramid", TREE + "SELECT tier, j, first_pos, upto_pos, left_tier, left_j, right_tier, right_j FROM nodes")
def pyramid(spark, sf):
    return T.pyramid(T.unique_sources(b.videos(spark, sf)))


@query("pyramid_ids", TREE + f"SELECT tier, j, id, l AS left_id, r AS right_id FROM ids{TIERS}")
def pyramid_ids(spark, sf):
    leaves = T.unique_sources(b.videos(spark, sf))
    return T.fold_pyramid(leaves, "id", T.tree_id).withColumnsRenamed(
        {"left_value": "left_id", "right_value": "right_id"})


@query("tiered_summaries", TREE + """
, per AS (SELECT l.pos, CAST(sum(strlen(x.line)) AS BIGINT) AS v FROM leaves l JOIN videos w ON w.srt_id = l.id
          JOIN lines x ON x.video_id = w.video_id GROUP BY l.pos)
SELECT tier, j, CAST(sum(v) AS BIGINT) AS n_bytes FROM nodes n JOIN per p ON p.pos >= n.first_pos AND p.pos < n.upto_pos GROUP BY tier, j""")
def tiered_summaries(spark, sf):
    """Bytes of text under every node of the pyramid."""
    leaves = T.unique_sources(b.videos(spark, sf))
    sizes = b.lines(spark, sf).groupBy("video_id").agg(F.sum(F.octet_length("line").cast("bigint")).alias("n"))
    per = b.videos(spark, sf).join(sizes, "video_id").groupBy(F.col("srt_id").alias("id")).agg(F.sum("n").alias("bytes"))
    leaves = leaves.join(per, "id")
    return T.range_totals(leaves, T.pyramid(leaves), "bytes").select("tier", "j", F.col("total_bytes").alias("n_bytes"))


_EVENTS = """
, log AS (SELECT user_id AS plan, event_id % 20 AS id, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'take' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'fail'
         ELSE CASE WHEN event_id % 10 = 0 THEN 'reset' ELSE 'add' END END AS op FROM events),
live AS (SELECT l.* FROM log l LEFT JOIN (SELECT plan, max(seq) AS r FROM log WHERE op = 'reset' GROUP BY plan) x USING (plan)
         WHERE op <> 'reset' AND (r IS NULL OR seq > r)),
states AS (SELECT plan, id, coalesce(arg_max(CASE op WHEN 'take' THEN 'running' WHEN 'done' THEN 'done' ELSE 'parked' END,
             CASE WHEN op <> 'add' THEN seq END) FILTER (WHERE op <> 'add'), 'pending') AS state FROM live GROUP BY plan, id)
"""


def task_log(spark, sf):
    kind, e = F.col("event_type"), F.col("event_id")
    op = (F.when(kind == "view", F.lit("add")).when(kind == "click", F.lit("take")).when(kind == "signup", F.lit("done"))
          .when(kind == "error", F.lit("fail")).when(e % 10 == 0, F.lit("reset")).otherwise(F.lit("add")))
    return b.table(spark, sf, "events").select(F.col("user_id").alias("plan"), (e % 20).alias("id"), e.alias("seq"),
                                               op.alias("op"))


@query("task_states", _EVENTS + "SELECT plan, id, state FROM states")
def task_states(spark, sf):
    return T.task_states(task_log(spark, sf))


@query("backlog", _EVENTS + "SELECT plan, count(*) FILTER (WHERE state IN ('pending', 'running')) AS backlog, "
                            "count(*) AS n_tasks, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS n_{s}" for s in ("pending", "running", "done", "parked"))
       + " FROM states GROUP BY plan")
def backlog(spark, sf):
    return T.backlog(T.task_states(task_log(spark, sf)))


_READY = """
, ready AS (SELECT t.* FROM tasks t WHERE state = 'pending' AND NOT EXISTS (
    SELECT 1 FROM deps d LEFT JOIN tasks s ON s.id = d.dep WHERE d.id = t.id AND coalesce(s.state, '') <> 'done'))
"""


@query("ready_tasks", GRAPH + _READY + "SELECT id, kind, tier FROM ready")
def ready_tasks(spark, sf):
    _, tasks, deps = b.task_graph(spark, sf)
    return T.ready_tasks(tasks, deps).select("id", "kind", "tier")


_SCORE = """
, scored AS MATERIALIZED (SELECT *, CASE kind WHEN 'leaf' THEN 3.0 WHEN 'node' THEN 2.0 ELSE 1.0 END - tier / 32.0
            + CASE WHEN exported THEN 0.25 ELSE 0 END + CASE WHEN kind = 'node' AND seq % 5 = 0 THEN 2.5 ELSE 0 END AS own FROM tasks),
pend AS MATERIALIZED (SELECT d.id, d.dep FROM deps d JOIN tasks a ON a.id = d.id AND a.state = 'pending' JOIN tasks c ON c.id = d.dep AND c.state = 'pending'),
up AS (SELECT id, own, id AS src FROM scored WHERE state = 'pending'
       UNION SELECT p.dep, u.own, u.src FROM up u JOIN pend p ON p.id = u.id)
, eff AS (SELECT id, CAST(max(own) AS DOUBLE) AS eff FROM up GROUP BY id)
"""


def scored(tasks):
    heat = F.when((F.col("kind") == "node") & (F.col("seq") % 5 == 0), F.lit(2.5)).otherwise(F.lit(0.0))
    tasks = tasks.withColumn("heat", heat)
    return tasks.withColumn("own", T.own_score(tasks)).drop("heat")


@query("inherited_score", GRAPH + _SCORE + "SELECT s.id, CAST(own AS DOUBLE) AS own, eff FROM scored s LEFT JOIN eff USING (id)")
def inherited_score(spark, sf):
    _, tasks, deps = b.task_graph(spark, sf)
    return T.inherited_score(scored(tasks), deps).select("id", "own", "eff")


@query("ready_ranking", GRAPH + _READY + _SCORE + """
SELECT r.id, r.kind, CAST(s.own AS DOUBLE) AS own, eff, r.seq FROM ready r JOIN scored s USING (id) JOIN eff USING (id)""")
def ready_ranking(spark, sf):
    _, tasks, deps = b.task_graph(spark, sf)
    return T.ready_ranking(scored(tasks), deps).select("id", "kind", "own", "eff", "seq")


@query("search_heat", """
, pats(pattern, re) AS (VALUES ('that|than', 'that|than'), ('than|that', 'than|that'), ('(?i:That|than)', '(?i:That|than)'),
  ('(?:that|than)', '(?:that|than)'), ('[Tt]han', '[Tt]han'), ('(?i:than)', '(?i:than)'), ('nicht|auf', 'nicht|auf'),
  ('(auf)|nicht', '(auf)|nicht'), ('pour', 'pour'), (' pour', ' pour'), ('[a-c]x|[cab]x', '[a-c]x|[cab]x'), ('(a)\\1', 'aa')),
tallies AS (SELECT pattern, video_id, sum(len(regexp_extract_all(line, re))) AS m FROM lines JOIN pats ON regexp_matches(line, re) GROUP BY ALL),
marked AS (SELECT *, pattern IS NOT NULL AND pattern IS DISTINCT FROM lag(pattern) OVER (PARTITION BY pattern IS NULL ORDER BY ts, event_id) AS change FROM actions),
numbered AS (SELECT *, sum(CASE WHEN change THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS n FROM marked),
last AS (SELECT max(n) AS nn FROM numbered),
w AS (SELECT pattern, sum(pow(0.5, CAST(nn - n AS DOUBLE))) AS weight FROM numbered, last WHERE change GROUP BY pattern),
h AS (SELECT video_id, 2.0 * m / sum(m) OVER (PARTITION BY pattern) * weight AS h FROM tallies JOIN w USING (pattern)
      UNION ALL SELECT video_id, 0.5 * pow(0.5, CAST(nn - n AS DOUBLE)) FROM numbered, last WHERE video_id IS NOT NULL)
SELECT video_id, round(sum(h), 6) AS heat FROM h GROUP BY video_id HAVING sum(h) >= 1e-6""")
def search_heat(spark, sf):
    acts = b.actions(spark, sf)
    order = ["ts", "event_id"]
    searched = neighbours(acts.where("pattern is not null"), [], order, F.col("pattern"), prev="was", block=RANGES)
    changes = searched.where(~F.col("pattern").eqNullSafe(F.col("was"))).select("event_id", F.lit(1).alias("c"))
    numbered = running_sum(acts.join(changes, "event_id", "left"), [], order, F.coalesce("c", F.lit(0)).cast("bigint"), "n", RANGES)
    plan_ = spark.createDataFrame([(p, p) for p in b.SEARCHES], "name STRING, pattern STRING")
    hits = match.match_join(b.lines(spark, sf), plan_)
    counts = F.lit(0)
    for p in b.SEARCHES:
        counts = F.when(F.col("name") == p, F.regexp_count("line", F.lit(p))).otherwise(counts)
    tallies = hits.groupBy(F.col("name").alias("pattern"), "video_id").agg(F.sum(counts.cast("bigint")).alias("n_matches"))
    heat = T.search_heat(tallies, numbered.where("c = 1").select("n", "pattern"),
                         numbered.where("video_id is not null").select("n", "video_id"))
    return heat.select("video_id", F.round("heat", 6).alias("heat"))


# ---- artifacts ----------------------------------------------------------------------------------

def _chain_inputs(spark, sf):
    """Witness per leaf, and an artifact for all but every fifth task."""
    leaves, tasks, deps = b.task_graph(spark, sf)
    witness = F.when(F.col("kind") == "leaf", F.when(F.col("seq") % 11 != 10, sha_head(F.concat(F.lit("w"), "id"))))
    tasks = tasks.select("id", "kind", witness.alias("witness"), "seq", "tier")
    made = tasks.where((F.col("seq") + F.col("tier")) % 37 != 3)
    artifacts = made.select(F.col("id").alias("plan_id"), sha_head(F.concat(F.lit("b"), "id")).alias("bytes_hash"))
    return tasks, deps, artifacts


_CHAIN_TIERS = ",\n".join(f"""c{t} AS MATERIALIZED (SELECT * FROM c{t - 1} UNION ALL
  SELECT t.id, left(sha256('node' || t.id || string_agg(c.suffix || left(sha256('b' || c.id), 16), '' ORDER BY d.ord)), 16)
  FROM ct t JOIN deps d ON d.id = t.id JOIN c{t - 1} c ON c.id = d.dep JOIN ct dt ON dt.id = d.dep AND (dt.seq + dt.tier) % 37 <> 3
  WHERE t.kind = 'node' AND t.tier = {t} GROUP BY t.id HAVING count(*) = 2)""" for t in range(1, TIERS + 1))

CHAIN = GRAPH + f"""
, ct AS MATERIALIZED (SELECT id, kind, tier, seq FROM tasks),
c0 AS MATERIALIZED (SELECT id, left(sha256('leaf' || left(sha256('w' || id), 16)), 16) AS suffix FROM ct WHERE kind = 'leaf' AND seq % 11 <> 10),
{_CHAIN_TIERS},
cd AS (SELECT t.id, left(sha256('dive' || t.id || string_agg(c.suffix || left(sha256('b' || c.id), 16), '' ORDER BY d.ord)), 16) AS suffix
  FROM ct t JOIN deps d ON d.id = t.id LEFT JOIN (SELECT c.id, c.suffix FROM c0 c JOIN ct dt ON dt.id = c.id AND (dt.seq + dt.tier) % 37 <> 3) c ON c.id = d.dep
  WHERE t.kind = 'dive' GROUP BY t.id HAVING count(*) = count(c.id)),
chain AS MATERIALIZED (SELECT t.id, t.kind, t.seq, t.tier, coalesce(c.suffix, cd.suffix) AS suffix FROM ct t LEFT JOIN c{TIERS} c USING (id) LEFT JOIN cd USING (id))
, files AS MATERIALIZED (
  SELECT id AS plan_id, kind, unnest(CASE (seq + tier) % 5 WHEN 0 THEN [id || '.' || coalesce(suffix, 'none') || '.txt'] WHEN 1 THEN [id || '.txt']
    WHEN 2 THEN [id || '.ffff.txt'] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE [id || '.txt', id || '.0000.txt'] END) AS file_name FROM chain)
"""


@query("content_chain", CHAIN + "SELECT id, kind, suffix FROM chain")
def content_chain(spark, sf):
    tasks, deps, artifacts = _chain_inputs(spark, sf)
    return T.content_chain(tasks, deps, artifacts).select("id", "kind", "suffix")


def _listing(chain):
    i, k = F.col("id"), (F.col("seq") + F.col("tier")) % 5
    names = (F.when(k == 0, F.array(F.concat(i, F.lit("."), F.coalesce("suffix", F.lit("none")), F.lit(".txt"))))
             .when(k == 1, F.array(F.concat(i, F.lit(".txt")))).when(k == 2, F.array(F.concat(i, F.lit(".ffff.txt"))))
             .when(k == 4, F.array(F.concat(i, F.lit(".txt")), F.concat(i, F.lit(".0000.txt")))))
    return chain.select(i.alias("plan_id"), "kind", F.explode(names).alias("file_name"))


def _chain_and_listing(spark, sf):
    tasks, deps, artifacts = _chain_inputs(spark, sf)
    chain = cut(T.content_chain(tasks, deps, artifacts))
    return chain, _listing(chain.join(tasks.select("id", "seq", "tier"), "id"))


_STALE = """
, rep AS (SELECT c.id, c.kind, CASE WHEN suffix IS NOT NULL THEN c.id || '.' || suffix || '.txt' END AS target,
   bool_or(f.file_name = c.id || '.' || suffix || '.txt') AS present, min(f.file_name) AS first_name
   FROM chain c LEFT JOIN files f ON f.plan_id = c.id AND f.kind = c.kind GROUP BY c.id, c.kind, c.suffix),
verdicts AS (SELECT *, CASE WHEN coalesce(present, false) THEN 'hit' WHEN target IS NULL OR first_name IS NULL THEN 'miss'
   WHEN first_name = id || '.txt' THEN 'adopt' ELSE 'content' END AS verdict FROM rep)
"""


@query("staleness_report", CHAIN + _STALE + """
SELECT id, kind, target, verdict, CASE verdict WHEN 'hit' THEN target WHEN 'miss' THEN NULL ELSE first_name END AS file_name FROM verdicts""")
def staleness_report(spark, sf):
    return T.staleness_report(*_chain_and_listing(spark, sf))


@query("retention_sweep", CHAIN + _STALE + """
SELECT f.plan_id, f.kind, f.file_name FROM files f JOIN verdicts v ON v.id = f.plan_id AND v.kind = f.kind WHERE f.file_name <> v.target""")
def retention_sweep(spark, sf):
    chain, listing = _chain_and_listing(spark, sf)
    return T.retention_sweep(T.staleness_report(chain, listing), listing)


@query("locate_any", CHAIN + "SELECT plan_id, kind, min(file_name) AS file_name FROM files GROUP BY ALL")
def locate_any(spark, sf):
    return T.locate_any(_chain_and_listing(spark, sf)[1])


@query("invalidate_descendants", GRAPH + """
, reach AS (SELECT id, 0 AS depth FROM tasks WHERE kind = 'leaf' AND seq % 50 = 7
            UNION SELECT d.id, r.depth + 1 FROM reach r JOIN deps d ON d.dep = r.id)
SELECT id, min(depth) AS depth FROM reach GROUP BY id""")
def invalidate_descendants(spark, sf):
    _, tasks, deps = b.task_graph(spark, sf)
    changed = tasks.where("kind = 'leaf' and seq % 50 = 7")
    return T.invalidate_descendants(changed, deps)


@query("todo_anti", """
SELECT DISTINCT video_id, start_ms FROM hits WHERE (video_id, start_ms) NOT IN (
  SELECT (video_id, start_ms) FROM lines WHERE start_ms % 9000 = 0)""")
def todo_anti(spark, sf):
    hits = match.scan_hits(b.lines(spark, sf), plan(spark)).select("video_id", "start_ms")
    return T.todo_anti(hits, b.lines(spark, sf).where("start_ms % 9000 = 0"), ["video_id", "start_ms"])
