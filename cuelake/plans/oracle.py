"""SQL twins of the bindings: one WITH prefix shared by the oracle queries."""

from __future__ import annotations

from cuelake.plans.bindings import SEARCHES

_LINES = "string_split(text, chr(10))"
_SEARCHES = "[" + ", ".join("'" + p + "'" for p in SEARCHES) + "]"

BASE = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id AS video_id, CAST(p - 1 AS INTEGER) AS cue_no, CAST((p - 1) * 3000 AS BIGINT) AS start_ms,
         CAST((p - 1) * 3000 + 2500 AS BIGINT) AS end_ms, line
  FROM (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS p FROM documents)),
overlap AS (
  SELECT video_id, cue_no, start_ms, CASE WHEN cue_no % 5 = 0 THEN end_ms + 4000 ELSE end_ms END AS end_ms, line
  FROM lines),
turns AS (
  SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS cue_no, turn * 5000 AS start_ms,
         turn * 5000 + 4000 AS end_ms, trim(replace(text, chr(10), ' ')) AS line
  FROM conversations),
videos AS (
  SELECT doc_id AS video_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq,
         '/v/' || lang || '/' || source || '/' || file AS path, file AS file_name, srt AS srt_path,
         left(sha256(srt), 16) AS srt_id
  FROM (SELECT doc_id, lang, source,
               CASE WHEN doc_id % 3 = 0 THEN 'Clip né ' ELSE 'clip né ' END || (doc_id // 2) || '.final.mp4' AS file,
               '/s/' || lang || '/clip' || (doc_id // 4) || '.srt' AS srt
        FROM documents)),
plan(seq, name, pattern, kind) AS (
  VALUES (2, 'mixed', '((?:(that|than)))|((?:(?:nicht|auf)))|[Pp]our', 'main'),
         (3, 'article', '(?i:the |les |der )', 'main'), (5, 'nohit', 'qqqzz', 'main'),
         (6, 'term1', '(?i:wh)', 'index'), (7, 'focus1', 'ou[eu]x?', 'supportive')),
video_topics AS (
  SELECT doc_id AS video_id, CASE WHEN doc_id % 8 = 0 THEN 'mixed' ELSE 'article' END AS topic
  FROM documents WHERE doc_id % 4 = 0),
hits AS (
  SELECT p.name AS topic, l.video_id, l.cue_no, l.start_ms, l.line
  FROM lines l JOIN plan p ON regexp_matches(l.line, p.pattern)),
scoped AS (
  SELECT h.* FROM hits h LEFT JOIN video_topics s ON s.video_id = h.video_id
  WHERE s.video_id IS NULL OR s.topic = h.topic),
n_docs AS (SELECT count(*) AS n FROM documents),
positions AS (
  SELECT event_id, user_id AS session, (user_id * 13 + epoch_us(ts) // 86400000000) % n AS video_id, ts,
         CAST(floor(value * 100) AS BIGINT) AS t_ms
  FROM events, n_docs),
actions AS (
  SELECT user_id AS session, ts, event_id,
         CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'act' END AS op,
         CASE WHEN event_type = 'view' THEN event_id % n END AS video_id,
         CASE WHEN event_type = 'click' THEN CAST(floor(value * 10) AS BIGINT) END AS cursor,
         CASE WHEN event_type = 'signup' THEN ({_SEARCHES})[event_id % {len(SEARCHES)} + 1] END AS pattern
  FROM events, n_docs),
search_log AS (SELECT event_id, ts, session, pattern FROM actions WHERE pattern IS NOT NULL),
words AS (
  SELECT doc_id, coalesce(w[1], 'xx') AS w1, coalesce(w[len(w) // 2 + 1], 'yy') AS w2, coalesce(w[len(w)], 'zz') AS w3
  FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents)),
patterns AS (
  SELECT doc_id AS seq, w1, w2, w3, CASE doc_id % 4 WHEN 0 THEN w1 || '|' || w2
         WHEN 1 THEN '(?i:' || upper(w1[1]) || w1[2:] || '|' || w3 || ')'
         WHEN 2 THEN '(?:' || w2 || '|' || w1 || '|' || w2 || ')'
         ELSE '[' || upper(w1[1]) || w1[1] || ']' || w1[2:] END AS pattern FROM words),
branches AS (
  SELECT seq, 0 AS branch_no, w1 AS text, w1 AS key, false AS folds FROM patterns WHERE seq % 4 = 0
  UNION ALL SELECT seq, 1, w2, w2, false FROM patterns WHERE seq % 4 = 0
  UNION ALL SELECT seq, 0, upper(w1[1]) || w1[2:], chr(10) || w1, true FROM patterns WHERE seq % 4 = 1
  UNION ALL SELECT seq, 1, w3, chr(10) || w3, true FROM patterns WHERE seq % 4 = 1
  UNION ALL SELECT seq, 0, w2, w2, false FROM patterns WHERE seq % 4 = 2
  UNION ALL SELECT seq, 1, w1, w1, false FROM patterns WHERE seq % 4 = 2
  UNION ALL SELECT seq, 2, w2, w2, false FROM patterns WHERE seq % 4 = 2
  UNION ALL SELECT seq, 0, '[' || upper(w1[1]) || w1[1] || ']' || w1[2:], chr(10) || w1, false FROM patterns WHERE seq % 4 = 3),
frames AS (
  SELECT CAST(label AS BIGINT) AS video_id,
         (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 1000 AS t_ms,
         list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS px
  FROM embeddings)
"""


def with_base(sql: str) -> str:
    """``sql`` behind the shared prefix; text starting with a comma adds further CTEs."""
    return BASE.rstrip() + ("" if sql.lstrip().startswith(",") else "\n") + sql


TIERS = 17  # enough for 131,072 subtitles

_FOLD_TIERS = ",\n".join(f"""ids{t} AS MATERIALIZED (SELECT * FROM ids{t - 1} UNION ALL
  SELECT n.tier, n.j, left(sha256('tree' || l.id || r.id), 16), l.id, r.id FROM nodes n
  JOIN ids{t - 1} l ON l.tier = n.left_tier AND l.j = n.left_j JOIN ids{t - 1} r ON r.tier = n.right_tier AND r.j = n.right_j
  WHERE n.tier = {t})""" for t in range(1, TIERS + 1))

TREE = f"""
, leaves AS MATERIALIZED (SELECT srt_id AS id, min(seq) AS first_seq, row_number() OVER (ORDER BY min(seq)) - 1 AS pos
                          FROM videos GROUP BY srt_id),
mids AS (SELECT pos AS mid, CAST(bit_count(CAST((pos & -pos) - 1 AS BIGINT)) + 1 AS INTEGER) AS tier,
                (SELECT count(*) FROM leaves) AS n FROM leaves WHERE pos > 0),
spans AS (SELECT *, mid >> tier AS j, (mid >> tier) << tier AS first_pos, least(((mid >> tier) + 1) << tier, n) AS upto_pos FROM mids),
nodes AS MATERIALIZED (SELECT tier, j, first_pos, upto_pos, tier - 1 AS left_tier, j * 2 AS left_j, rt AS right_tier, mid >> rt AS right_j
  FROM (SELECT *, CAST(ceil(log2(upto_pos - mid)) AS INTEGER) AS rt FROM spans)),
ids0 AS MATERIALIZED (SELECT 0 AS tier, pos AS j, id, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS r FROM leaves),
{_FOLD_TIERS}
"""

EXCERPT = """
, cum AS MATERIALIZED (SELECT topic, video_id, sum(strlen(line) + 1) OVER (PARTITION BY topic, video_id ORDER BY cue_no) AS upto FROM hits),
per AS MATERIALIZED (SELECT c.topic, v.seq, c.video_id, v.srt_id, strlen(v.file_name) + 4 AS head, list(upto ORDER BY upto) AS upto,
               row_number() OVER (PARTITION BY c.topic ORDER BY v.seq) AS rn
        FROM cum c JOIN videos v ON v.video_id = c.video_id GROUP BY c.topic, v.seq, c.video_id, v.srt_id, v.file_name),
walk AS (
  SELECT topic, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS quoted, CAST(NULL AS BIGINT) AS video_id,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS srt_id, CAST(0 AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS n_bytes
  FROM (SELECT DISTINCT topic FROM per)
  UNION ALL
  SELECT topic, rn, used + take, CASE WHEN take > 0 THEN list_append(quoted, srt_id) ELSE quoted END, video_id, seq, srt_id,
         len(list_filter(upto, lambda x: x <= take - head)), take
  FROM (SELECT w.topic, p.rn, w.used, w.quoted, p.video_id, p.seq, p.srt_id, p.upto, p.head,
          CASE WHEN w.used < BUDGET AND NOT list_contains(w.quoted, p.srt_id) AND p.head < BUDGET - w.used
                    AND p.upto[1] <= BUDGET - w.used - p.head
               THEN CAST(p.head + list_max(list_filter(p.upto, lambda x: x <= BUDGET - w.used - p.head)) AS BIGINT) ELSE 0 END AS take
        FROM walk w JOIN per p ON p.topic = w.topic AND p.rn = w.rn + 1))
, sections AS (SELECT topic, seq, video_id, srt_id, n_lines, n_bytes FROM walk WHERE n_bytes > 0)
"""

_STATES = "['done', 'done', 'pending', 'done', 'parked', 'pending']"

GRAPH = TREE + EXCERPT.replace("BUDGET", "3000") + f"""
, tree AS (SELECT *, CASE WHEN tier = 0 THEN j ELSE j * 7 + tier END AS spot FROM ids{TIERS}),
tasks AS MATERIALIZED (
  SELECT id, CASE WHEN tier = 0 THEN 'leaf' ELSE 'node' END AS kind, tier, true AS exported,
         CASE WHEN tier = 0 THEN j ELSE 1099511627776 + tier * 4294967296 + j END AS seq, ({_STATES})[spot % 6 + 1] AS state FROM tree
  UNION ALL SELECT left(sha256('dive' || chr(10) || topic), 16), 'dive', 0, NOT starts_with(topic, 'focus'),
         1125899906842624 + strlen(topic), 'pending' FROM (SELECT DISTINCT topic FROM sections)),
deps AS MATERIALIZED (
  SELECT id, 0 AS ord, l AS dep FROM tree WHERE tier > 0 UNION ALL SELECT id, 1, r FROM tree WHERE tier > 0
  UNION ALL SELECT left(sha256('dive' || chr(10) || topic), 16), seq, srt_id FROM sections)
"""
