"""The queries of the training-data operators, each over the whole of its table, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import exact, hardneg, language, mixing, neardup, quality, repair, substrings, tokens, toxicity, urls
from cuelake.llm.common import documents
from cuelake.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op2_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM d""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def _limits() -> str:
    checks = []
    for rule in quality.RULES:
        value = {"mean_word_length": "word_chars / nullif(n_words, 0)", "n_words": "n_words", "symbol_ratio": "n_symbols / nullif(n_words, 0)",
                 "shout_ratio": "n_shouts / nullif(n_words, 0)", "stop_ratio": "n_stop / nullif(n_words, 0)",
                 "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "repeat_ratio": "n_repeat_words / nullif(n_words, 0)"}[rule.measure]
        checks += [f"coalesce({value} < {rule.low}, false)"] if rule.low is not None else []
        checks += [f"coalesce({value} > {rule.high}, false)"] if rule.high is not None else []
    return " OR ".join(checks)


@query("op5_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) s(o) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(lower(x), '^({"|".join(sorted(set(quality.STOP_WORDS)))})[.,;:!?]?$'))) AS n_stop
      FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_limits()} AS rule_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM v""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_mix_sources", rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
                  (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
turn AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM per),
lev AS (SELECT *, most / weight AS fills_at, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
        FROM turn WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(most, weight * (SELECT arg_min(level, (fills_at, source)) FROM lev WHERE fills_at >= level)) AS target FROM lev),
r AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
      FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS chance FROM r),
k AS (SELECT *, target - whole * source_size AS lack, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM c),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN chance > 0 AND before + size / 2 <= lack THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM s""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_bpe_encode_decode")
def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(documents(spark, sf_dir)).drop("kept_text")


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(documents(spark, sf_dir)).drop("text_key")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


def _host_words() -> str:
    return " OR ".join(f"contains(host, '{r.glob.strip('*')}')" for r in urls.GLOB_RULES)


@query("op13_url_filter", f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
fits AS (SELECT p.*, r.host || r.path AS rule, r.action FROM p, (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(action, host, path)
         WHERE (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM fits GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.action, CASE WHEN {_host_words()} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id""")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("glob")


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("repaired")
