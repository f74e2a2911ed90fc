"""Catalogues, chains and plans beyond any fixed number of levels."""

import random

from pyspark.sql import functions as F

from cuelake.operators import catalog, match, tasks


def test_forty_levels_of_references(spark):
    rows = [(0, "t0", ["x"])] + [(i, f"t{i}", [r"\{t%d:}" % (i - 1)]) for i in range(1, 41)]
    got = {r.name: r.pattern for r in catalog.expand_topics(spark.createDataFrame(rows, "seq long, name string, fragments array<string>")).collect()}
    assert got["t40"] == "(?:" * 40 + "x" + ")" * 40 and not any(r"\{" in p for p in got.values())


def test_seventy_dependencies_deep(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 71)], "id string, dep string")
    changed = spark.createDataFrame([("n0",)], "id string")
    depth = {r.id: r.depth for r in tasks.invalidate_descendants(changed, edges).collect()}
    assert depth["n70"] == 70
    t = spark.createDataFrame([("n0", "leaf", "w")] + [(f"n{i}", "node", None) for i in range(1, 71)], "id string, kind string, witness string")
    deps = edges.withColumn("ord", F.lit(0))
    files = t.select(F.col("id").alias("plan_id"), F.lit("h").alias("bytes_hash"))
    chain = {r.id: r.suffix for r in tasks.content_chain(t, deps, files).collect()}
    assert all(chain[f"n{i}"] for i in range(71))


def test_three_hundred_groupings(spark):
    plan = spark.createDataFrame([(f"g{i}", f"(a{i};)|b", [("part", 1)]) for i in range(300)], "name string, pattern string, parts array<struct<part:string,group_idx:int>>")
    hits = spark.createDataFrame([(f"g{i}", 1, i, f"a{i};") for i in range(300)] + [("g7", 1, 999, "b")], "topic string, video_id long, cue_no int, line string")
    got = {(r.topic, r.cue_no, r.part) for r in match.attribute_components(hits, plan).collect()}
    assert got == {(f"g{i}", i, "part") for i in range(300)}


def test_offsets_with_groups_of_the_pattern(spark):
    cues = spark.createDataFrame([(1, 0, "xaab aa"), (1, 1, "none")], "video_id long, cue_no int, line string")
    for pattern in (r"(a)\1", r"(?<one>a)a", "a{2}|q*"):
        got = sorted((r.cue_no, r.offset, r.match) for r in match.match_offsets(cues, pattern).collect())
        assert got == [(0, 1, "aa"), (0, 5, "aa")]


def test_escaped_bracket_is_no_class(spark):
    df = spark.createDataFrame([(r"\[a[bc]",), ("[a[b]]",), ("[[:alpha:]]",)], "pattern string")
    assert {r.pattern: r.problem for r in match.pattern_guard(df).collect()} == {
        r"\[a[bc]": None, "[a[b]]": "nested class", "[[:alpha:]]": "POSIX class"}


def walk(rows):
    """One pattern after the other; a rebuilt pattern that fails the hygiene rules leaves no trace."""
    known, out = set(), {}
    for seq, pattern in rows:
        novel = [b for b in dict.fromkeys(pattern.split("|")) if b not in known]
        rebuilt = "|".join(novel)
        if novel and not (rebuilt[0] in " \t" or rebuilt[-1] in " \t"):
            known |= set(novel)
            out[seq] = rebuilt
    return out


def test_adoption_is_one_after_the_other(spark):
    r = random.Random(9)
    cases = [[(1, " e|f"), (2, "f| g")], [(1, " e|f"), (2, "f| g"), (3, " g|h")]]
    words = ["a", "b", "c", " d", " e", "f ", "g ", "h"]
    cases += [[(i, "|".join(r.sample(words, r.randint(1, 3)))) for i in range(1, 9)] for _ in range(3)]
    none = spark.createDataFrame([], "key string")
    for rows in cases:
        got = {x.seq: x.rebuilt for x in catalog.adopt_novel(spark.createDataFrame(rows, "seq long, pattern string"), none).collect()}
        assert got == walk(rows), rows


def test_every_slice_of_a_large_catalogue_is_matched(spark, monkeypatch):
    monkeypatch.setattr(match, "SLICE_BYTES", 200)
    plan = spark.createDataFrame([(f"term{i}", f"word{i};") for i in range(60)], "name string, pattern string")
    cues = spark.createDataFrame([(i, f"say word{i}; now") for i in range(60)], "cue_no int, line string")
    got = {(r.cue_no, r.name) for r in match.match_slices(cues, plan).collect()}
    assert got == {(i, f"term{i}") for i in range(60)}


def rounds_of(monkeypatch, run):
    """The result of ``run`` and how many loop levels were written."""
    written, real = [], catalog.cut_counted
    monkeypatch.setattr(catalog, "cut_counted", lambda *args: written.append(1) or real(*args))
    return run(), len(written)


def test_failing_patterns_of_one_branch_fall_together(spark, monkeypatch):
    """Each has a line's end of its own and one common branch: none depends on another, all go in one round."""
    rows = [(i, f"own{i}\nend|common") for i in range(40)] + [(99, "common|last")]
    none = spark.createDataFrame([], "key string")
    got, rounds = rounds_of(monkeypatch, lambda: {x.seq: x.rebuilt for x in catalog.adopt_novel(
        spark.createDataFrame(rows, "seq long, pattern string"), none).collect()})
    assert got == {99: "common|last"} and rounds <= 3


def test_adoption_with_long_dependence(spark):
    """Random patterns full of edge blanks, so that fates hang on one another."""
    r, words = random.Random(4), [" a", "b ", "c", " d", "e ", "f", " g ", "h", "i", " j"]
    rows = [(i, "|".join(r.sample(words, r.randint(1, 4)))) for i in range(60)]
    got = {x.seq: x.rebuilt for x in catalog.adopt_novel(spark.createDataFrame(rows, "seq long, pattern string"), spark.createDataFrame([], "key string")).collect()}
    assert got == walk(rows)


def test_chain_with_dependencies_of_all_levels(spark):
    """Against the plain recursion; some artifacts and witnesses are missing."""
    import hashlib
    r = random.Random(2)
    kinds = ["leaf" if i < 20 else r.choice(["node", "focus", "dive"]) for i in range(140)]
    deps = {i: r.sample(range(max(0, i - 40), i), 2 if kinds[i] != "dive" else r.randint(1, 5)) for i in range(140) if kinds[i] != "leaf"}
    made = {i for i in range(140) if r.random() < 0.97}
    name = lambda i: f"t{i:03}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    want = {}
    for i in range(140):
        if kinds[i] == "leaf":
            want[i] = None if i % 9 == 4 else sha("leaf" + f"w{i}")
        elif all(want[d] and d in made for d in deps[i]):
            order = sorted(deps[i]) if kinds[i] == "focus" else deps[i]
            want[i] = sha(kinds[i] + name(i) + "".join(want[d] + f"b{d}" for d in order))
        else:
            want[i] = None
    t = spark.createDataFrame([(name(i), kinds[i], None if kinds[i] != "leaf" or i % 9 == 4 else f"w{i}") for i in range(140)], "id string, kind string, witness string")
    d = spark.createDataFrame([(name(i), o, name(x)) for i, xs in deps.items() for o, x in enumerate(xs)], "id string, ord int, dep string")
    files = spark.createDataFrame([(name(i), f"b{i}") for i in made], "plan_id string, bytes_hash string")
    assert {x.id: x.suffix for x in tasks.content_chain(t, d, files).collect()} == {name(i): s for i, s in want.items()}
