"""Quality rules: measures of a whole text and a threshold table, in column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import SPACE, WORD, bare

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with for is was are this from by as in on at it or an a he she not you "
    "le la les des et que qui est une un dans pour pas sur avec au de du en par plus "
    "der die das und ist nicht ein eine zu den von mit auf im dem für sich des auch als "
    "el los las una por con para del se no su al lo como más y o es").split()


@dataclass(frozen=True)
class Rule:
    """A document fails where the measure lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Measures are columns of `measures`; a ratio over nothing is null and passes.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("long_text", "n_words", None, 1_000_000),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("shouting", "shout_ratio", None, 0.2),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("repeated_words", "repeat_ratio", None, 0.4),
)
LEAST_WORDS, MOST_REPEATED = 50, 0.5  # of the base verdict


CLOSING_MARKS = [".", ",", ";", ":", "!", "?"]  # one of them may stand behind a stop word


def _is_stop_word(word: Column, stop_words: tuple[str, ...] | list[str]) -> Column:
    unmarked = F.when(F.right(word, F.lit(1)).isin(CLOSING_MARKS), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    return F.lower(unmarked).isin(sorted(set(stop_words)))


def measures(docs: DataFrame, stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """Counts and ratios of each whole text, a row per document; everything happens inside the row.

    Repeated 3-word windows are found by sorting the windows' 64-bit hashes with their positions, so that equal
    windows are neighbours; no window leaves its row.

    The counts leave through a generator (of one row).  Filters on them stop there; pushed further down, they would
    carry the splitting and sorting into each other, once per word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = bare(docs, doc_id="doc_id", text=text)
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint")).withColumn("n_lines", F.size("lines").cast("bigint"))
    numbered = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")))
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= 3, F.sort_array(numbered)))
    again = F.filter(F.col("windows"), lambda w, i: (w["h"] == F.get("windows", i - 1)["h"]) | (w["h"] == F.get("windows", i + 1)["h"]))
    rows = rows.withColumn("again", F.transform(again, lambda w: w["p"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("again", lambda p: F.array(p, p + 1, p + 2)))))
    counts = {
        "n_words": F.col("n_words"), "n_lines": F.col("n_lines"), "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(f"[{SYMBOLS}]")), "n_dup_lines": F.col("n_lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("windows").isNotNull(), covered).otherwise(0),
        "n_shouts": F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit(""))),
        "n_stop_words": F.size(F.filter("words", lambda w: _is_stop_word(w, stop_words)))}
    counted = rows.select("doc_id", F.inline(F.array(F.struct(*[c.cast("bigint").alias(name) for name, c in counts.items()]))))

    def ratio(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))

    return counted.select(
        "*", ratio("word_chars", "n_words").alias("mean_word_length"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_shouts", "n_words").alias("shout_ratio"), ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"))


def verdicts(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The threshold table as one projection: a column per rule that failed, and what they come to."""
    def fails(rule: Rule) -> Column:
        value = F.col(rule.measure)
        outside = [value < rule.low] if rule.low is not None else []
        outside += [value > rule.high] if rule.high is not None else []
        failed = outside[0]
        for more in outside[1:]:
            failed = failed | more
        return F.coalesce(failed, F.lit(False))

    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda name: name.isNotNull())
    return measured.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measures of the whole text, ``base_failed``, ``failed_rules`` and ``kept``.

    A null or empty text has no words, fails the base and is dropped.  Ratios over nothing are null and fail no rule.
    Repeated rows are judged each for itself; an empty table gives no rows.
    """
    return verdicts(measures(docs), rules)
