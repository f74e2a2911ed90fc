"""Ordered helpers and folds against brute force, on skewed random fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import chunking, match, ordered, tasks, timeline
from cuelake.streaming import streams

random.seed(7)
# One key holds most of the rows.
ROWS = sorted({(0 if random.random() < .7 else random.randint(1, 5), random.randint(0, 5000)) for _ in range(1500)})


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame([(k, o, (k * 31 + o) % 17) for k, o in ROWS], "k BIGINT, o BIGINT, v BIGINT").cache()


def by_key():
    out = {}
    for k, o in ROWS:
        out.setdefault(k, []).append((o, (k * 31 + o) % 17))
    return out


@pytest.mark.parametrize("width", [7, 100, 1 << 16])
def test_blocked_windows_equal_plain_ones(skewed, width):
    block = ordered.block_of("o", width)
    total = {(r.k, r.o): r.t for r in ordered.running_sum(skewed, ["k"], ["o"], "v", "t", block).collect()}
    near = {(r.k, r.o): (r.n, r.p, r.f, r.l) for r in ordered.neighbours(
        skewed, ["k"], ["o"], F.col("o"), "n", "p", "f", "l", block).collect()}
    sparse = skewed.withColumn("w", F.when(F.col("v") > 12, F.col("v")))
    carried = {(r.k, r.o): r.c for r in ordered.carry_forward(sparse, ["k"], ["o"], {"w": "c"}, block).collect()}
    for k, rows in by_key().items():
        run, last = 0, None
        for i, (o, v) in enumerate(rows):
            run += v
            last = v if v > 12 else last
            assert total[k, o] == run and carried[k, o] == last
            assert near[k, o] == (rows[i + 1][0] if i + 1 < len(rows) else None, rows[i - 1][0] if i else None, rows[0][0], rows[-1][0])


def test_interval_lookup_with_long_and_empty_intervals(spark):
    spans, at = [], 0
    for i in range(60):
        at += random.choice([0, 1, 50_000])
        length = random.choice([0, 1, 900, 70_000, 9_000_000, 3_600_000_000_000])
        spans.append((i % 3, i, at, at + length))
        at += length
    points = [(p, random.randint(0, 2), random.choice(spans)[2] + random.randint(-5, 5_000_000)) for p in range(400)]
    s = spark.createDataFrame(spans, "k BIGINT, no BIGINT, lo BIGINT, hi BIGINT")
    p = spark.createDataFrame(points, "id BIGINT, k BIGINT, t BIGINT")
    want = {i: next((n for kk, n, lo, hi in spans if kk == k and lo <= t < hi), None) for i, k, t in points}
    got = ordered.interval_lookup(p, s, ["k"], "t", "lo", "hi").collect()
    assert len(got) == len(points) and {r.id: r.no for r in got} == want
    static = ordered.file_intervals(p, s, ["k"], "t", "lo", "hi").groupBy("id").agg(F.max("no").alias("no")).collect()
    assert {r.id: r.no for r in static} == want


@pytest.mark.parametrize("batch, block", [(3, 1 << 20), (10_000, 1 << 20), (10_000, 300), (10_000, 37)])
def test_windows_across_batches_and_blocks(spark, batch, block):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        sizes = [(k, i, random.choice([1, 5, 40, 99, 250]) if i else 100) for k in range(3) for i in range(120)]
        df = spark.createDataFrame(sizes, "video_id BIGINT, cue_no INT, n_bytes BIGINT")
        want = set()
        for k in range(3):
            first, used, no = None, 0, 0
            for kk, i, n in sizes:
                if kk != k:
                    continue
                first, used = (i if first is None else first), used + n
                if used >= 100:
                    want.add((k, no, first, i))
                    first, used, no = None, 0, no + 1
            if first is not None:
                want.add((k, no, first, 119))
        assert {tuple(r) for r in chunking.window_ranges(df, 100, block).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("budget", [60, 200, 5000])
def test_excerpt_budget_against_the_plain_walk(spark, budget):
    videos = [(v, v, f"name{'x' * (v % 9)}", f"s{v // 2}") for v in range(80)]
    hits = [("t", v, c, "y" * random.randint(1, 30)) for v in range(80) for c in range(random.randint(0, 6))]
    parts, deps, want = 0, set(), {}
    for v, seq, name, srt in videos:
        room = budget - parts
        lines = [len(h[3]) + 1 for h in hits if h[1] == v]
        head = len(name) + 4
        if parts >= budget or not lines or srt in deps or head >= room:
            continue
        fit, used = 0, 0
        for n in lines:
            if used + n > room - head:
                break
            fit, used = fit + 1, used + n
        if fit:
            deps.add(srt)
            parts += head + used
            want[v] = (fit, head + used)
    h = spark.createDataFrame(hits, "topic STRING, video_id BIGINT, cue_no INT, line STRING")
    d = spark.createDataFrame(videos, "video_id BIGINT, seq BIGINT, file_name STRING, srt_id STRING")
    got = {r.video_id: (r.n_lines, r.n_bytes) for r in chunking.excerpt_sections(h, d, budget).collect()}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 65, 200])
def test_pyramid_shapes(spark, n):
    level, want, tier = [(str(i), (i,)) for i in range(n)], set(), 0
    while len(level) > 1:
        tier += 1
        nxt = []
        for i in range(0, len(level) - 1, 2):
            a, b = level[i], level[i + 1]
            nxt.append((f"({a[0]}{b[0]})", a[1] + b[1]))
            want.add((tier, a[0], b[0], min(a[1] + b[1]), max(a[1] + b[1]) + 1))
        level = nxt + level[len(level) - len(level) % 2:]
    leaves = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"))
    folded = tasks.fold_pyramid(leaves, "id", lambda a, b: F.concat(F.lit("("), a, b, F.lit(")"))).where("tier > 0")
    nodes = tasks.pyramid(leaves)
    got = {(r.tier, r.left_value, r.right_value, r.first_pos, r.upto_pos) for r in folded.join(nodes, ["tier", "j"]).collect()}
    assert got == want and nodes.count() == max(n - 1, 0)


def test_session_replay_against_a_plain_tree(spark):
    acts = [(s, i, random.choice(["act", "act", "undo", "redo"]), random.choice("abc")) for s in range(3) for i in range(80)]
    df = spark.createDataFrame(acts, "session BIGINT, event_id BIGINT, op STRING, payload STRING").withColumn(
        "ts", F.timestamp_seconds("event_id"))
    got = {(r.session, r.event_id): (r.depth, r.branches, r.moved) for r in timeline.session_replay(df).collect()}
    for s in range(3):
        root = {"up": None, "kids": {}, "last": None, "d": 0}
        cur = root
        for _, i, op, payload in [a for a in acts if a[0] == s]:
            to = cur["up"] if op == "undo" else cur["last"] if op == "redo" else cur["kids"].setdefault(
                payload, {"up": cur, "kids": {}, "last": None, "d": cur["d"] + 1})
            if op == "act":
                cur["last"] = to
            moved, cur = to is not None, to or cur
            assert got[s, i] == (cur["d"], len(cur["kids"]), moved)


def test_scores_gate_and_inherit(spark):
    t = spark.createDataFrame([("l1", "leaf", 0, "pending", 0, 3.0), ("l2", "leaf", 0, "done", 1, 3.0), ("n", "node", 1, "pending", 2, 9.0),
                               ("d", "dive", 0, "pending", 3, 1.0), ("x", "dive", 0, "pending", 4, 1.0)],
                              "id STRING, kind STRING, tier INT, state STRING, seq BIGINT, own DOUBLE")
    deps = spark.createDataFrame([("n", "l1"), ("n", "l2"), ("d", "l2"), ("x", "nobody")], "id STRING, dep STRING")
    rows = tasks.ready_ranking(t, deps).select("id", "eff").collect()
    assert [(r.id, r.eff) for r in rows] == [("l1", 9.0), ("d", 1.0)]


def test_lift_against_walk_writes_only_what_rose(spark, monkeypatch):
    r = random.Random(7)
    n, passes = 400, 5
    rows = [(f"i{i}", r.choice(["pending", "pending", "pending", "done"]), float(r.randrange(9))) for i in range(n)]
    edges = [(f"i{i}", f"i{r.randrange(i)}") for i in range(1, 60) for _ in range(2)] + [("i5", "nobody")]
    own = {i: score for i, state, score in rows if state == "pending"}
    eff, rose = dict(own), 0
    for _ in range(passes):
        offers = {}
        for a, b in edges:
            if a in eff and b in eff and eff[a] > eff[b]:
                offers[b] = max(offers.get(b, 0.0), eff[a])
        eff |= offers
        rose += len(offers)
    frame = type(spark.range(1))
    write, written = frame.checkpoint, []
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: written.append(write(df, *a, **k)) or written[-1])
    t = spark.createDataFrame(rows, "id STRING, state STRING, own DOUBLE")
    got = tasks.inherited_score(t, spark.createDataFrame(edges, "id STRING, dep STRING"), passes)
    assert {x.id: x.eff for x in got.collect()} == {i: eff.get(i) for i, _, _ in rows}
    assert sum(df.count() for df in written) <= len(edges) + rose


def test_chain_pair_order_and_loops(spark):
    t = spark.createDataFrame([("a", "leaf", "w1"), ("b", "leaf", "w2"), ("m", "leaf", None), ("f", "focus", None), ("g", "focus", None),
                               ("n", "node", None), ("p", "node", None), ("q", "node", None), ("r", "node", None)],
                              "id STRING, kind STRING, witness STRING")
    deps = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("g", 0, "b"), ("g", 1, "a"), ("n", 0, "a"), ("n", 1, "m"),
                                  ("p", 0, "q"), ("q", 0, "p"), ("r", 0, "b"), ("r", 1, "a")], "id STRING, ord INT, dep STRING")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("m", "3")], "plan_id STRING, bytes_hash STRING")
    got = {r.id: r.suffix for r in tasks.content_chain(t, deps, files, hash_fn=lambda c: c).collect()}
    assert got == {"a": "leafw1", "b": "leafw2", "m": None, "f": "focusfleafw11leafw22", "g": "focusgleafw11leafw22", "n": None,
                   "p": None, "q": None, "r": "noderleafw22leafw11"}


def test_sliced_catalogue_equals_unrolled(spark, monkeypatch):
    cues = spark.createDataFrame([(i, f"line {i} {'abc'[i % 3]}") for i in range(60)], "cue_no INT, line STRING")
    plan = spark.createDataFrame([(f"t{i}", f"{i}|{'abc'[i % 3]}$") for i in range(30)], "name STRING, pattern STRING")
    key = lambda df: sorted((r.name, r.cue_no) for r in df.collect())
    unrolled = key(match.match_join(cues, plan))
    monkeypatch.setattr(match, "UNROLL_ROWS", 5)
    monkeypatch.setattr(match, "SLICE_BYTES", 20)
    assert key(match.match_join(cues, plan)) == unrolled
    assert match.match_join(cues, plan.where("false")).count() == 0


def test_guard_and_literals(spark):
    df = spark.createDataFrame([("a",), ("(",), ("[[:alpha:]]",), ("[a[b]]",), ("(?P<n>a)",), (None,)], "pattern STRING")
    got = {r.pattern: r.problem for r in match.pattern_guard(df).collect()}
    assert got == {"a": None, "(": "invalid syntax", "[[:alpha:]]": "POSIX class", "[a[b]]": "nested class",
                   "(?P<n>a)": "invalid syntax", None: "no pattern"}
    lines = spark.createDataFrame([(r"a\Eb (x",), ("axb",)], "line STRING")
    assert match.pattern_filter(lines, r"\eB (", is_regex=False, case_sensitive=False).count() == 1


def test_streams_carry_state_between_batches(spark, tmp_path):
    schema = "session BIGINT, event_id BIGINT, video_id BIGINT, ts TIMESTAMP, t_ms BIGINT"
    rows = [(1, i, 1, i * 10, v) for i, v in enumerate([0, 100, 600, 900, 1100, 1200, 1700, 1750])]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    df = spark.createDataFrame([(s, e, v, None, t) for s, e, v, _, t in rows], schema).withColumn("ts", F.timestamp_seconds("event_id"))
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for part in (df.where("event_id < 4"), df.where("event_id >= 4")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (streams.drift_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start().awaitTermination())
    got = sorted(r.t_ms for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0, 600, 1100, 1700]
    assert got == sorted(r.t_ms for r in timeline.drift_breadcrumbs(df).collect())
