"""Components that take part with nothing in them, and catalogues of many groupings."""

import re

from cuelake.operators import match

PLAN = "seq INT, name STRING, pattern STRING, parts ARRAY<STRUCT<part: STRING, group_idx: INT>>"


def brute(plan, lines):
    """Python's matcher tells an empty group from one that took no part; its matches step on like Java's on these patterns."""
    out = set()
    for _, name, pattern, parts in plan:
        for m in ((i, m) for i, line in enumerate(lines) for m in re.finditer(pattern.replace("(?<g", "(?P<g"), line)):
            out |= {(name, m[0], part) for part, group in parts if m[1].start(group) >= 0}
    return out


def found(spark, plan, lines):
    hits = spark.createDataFrame([(name, i, 0, line) for _, name, pattern, _ in plan for i, line in enumerate(lines)
                                  if re.search(pattern.replace("(?<g", "(?P<g"), line)], "topic STRING, video_id BIGINT, cue_no INT, line STRING")
    got = [tuple(r) for r in match.attribute_components(hits, spark.createDataFrame(plan, PLAN)).select("topic", "video_id", "part").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_empty_participation(spark):
    plan = [(0, "a", "(?<g0>x*)y|z", [("p", 1)]), (1, "b", "(?<g0>q?)(?<g1>r?)|(s)", [("q", 1), ("r", 2)]), (2, "c", "(u(v)?)|(?<g1>(w)?)t", [("u", 1), ("w", 3)]),
            (3, "d", "(?<g0>x)|(?<g1>y)", [("same", 1), ("same", 2)]), (4, "e", "^(?<g0>)$|a(?<g1>b*)", [("nothing", 1), ("bs", 2)]),
            (5, "f", "(?i:(?<g0>m*)N)|(\\d)\\2", [("m", 1)])]
    lines = ["y only", "z one", "xy", "", "t", "wt u", "uv", "qrs", "n", "MN", "77", "a", "ab", "x", "yz y", "line\n break y", "é y", "😀"]
    want = brute(plan, lines)
    assert ("a", 0, "p") in want and ("a", 1, "p") not in want and ("e", 3, "nothing") in want
    assert found(spark, plan, lines) == want


def test_a_thousand_groupings(spark):
    plan = [(i, f"t{i}", f"(?<g0>k{i}x*)y|(?<g1>w*)v{i}z", [(f"p{i}", 1), (f"q{i}", 2)]) for i in range(1000)]
    lines = [f"k{i}xy v{i + 1}z wv{i + 2}z" for i in range(0, 990, 7)]
    hits = spark.createDataFrame([(f"t{i + d}", i, 0, f"k{i}xy v{i + 1}z wv{i + 2}z") for i in range(0, 990, 7) for d in (0, 1, 2)],
                                 "topic STRING, video_id BIGINT, cue_no INT, line STRING")
    df = match.attribute_components(hits, spark.createDataFrame(plan, PLAN))
    assert len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 40
    got = {(r.topic, r.part) for r in df.collect()}
    assert got == {(f"t{i + d}", f"{'p' if d == 0 else 'q'}{i + d}") for i in range(0, 990, 7) for d in (0, 1, 2)} and len(lines) * 3 == len(got)


def test_hits_of_a_topic_stay_where_they_are(spark):
    """One topic with all the hits is no one task's: the plan goes to the hits, and no line is matched twice."""
    plan = spark.createDataFrame([(0, "a", "(?<g0>x*)y|z", [("p", 1)])], PLAN)
    hits = spark.range(100).selectExpr("'a' AS topic", "id AS video_id", "0 AS cue_no", "'xy' AS line")
    df = match.attribute_components(hits, plan)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("regexp_replace") == 1
    assert df.count() == 100


def test_lines_that_hold_the_marks(spark):
    plan = [(0, "a", "(?<g0>x*)y|(?<g1>\x03)|z", [("p", 1), ("three", 2)]), (1, "b", "(?<g0>q?)(?<g1>r?)|(s)", [("q", 1), ("r", 2)])]
    lines = ["\x010\x02x\x03z", "\x010\x02\x03 y", "z\x03", "\x011\x02z", "z", "xy\x01"]
    want = brute(plan, lines)
    assert ("a", 2, "three") in want and ("a", 3, "p") not in want
    assert found(spark, plan, lines) == want
