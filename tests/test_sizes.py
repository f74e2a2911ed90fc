"""Findings of the third review: tables as folders, texts read once, and steps whose cost grew faster than their input."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuelake.plans import bindings as b

SF = "/root/testdata/sf0.001"


def folders(spark, tmp_path, *tables):
    """The given tables, each a folder of three parts."""
    for t in tables:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    sf = folders(spark, tmp_path, "documents", "events")
    assert entry.queries()["incremental_ingest"](spark, sf).count() == b.lines(spark, SF).count() > 0
    states = lambda at: sorted(map(tuple, entry.queries()["task_state_stream"](spark, at).collect()))
    assert states(sf) == states(SF) != []


def test_words_of_a_text_are_cut_once(spark):
    from cuelake.operators import catalog
    patterns = b.doc_patterns(spark, SF)
    plan = patterns.where(catalog.hygienic(F.col("pattern")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    from cuelake.sources import versions
    for i in range(200):
        (tmp_path / f"{i}.srt").write_text("x")
    read = lambda: spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    with versions._many_small_files(spark):
        assert read() <= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_signatures_hold_little_at_once():
    import random
    import tracemalloc

    import pyarrow as pa

    from cuelake.llm import neardup
    rng, n = random.Random(1), 4500
    texts = [" ".join(str(rng.randrange(10**5)) for _ in range(150)) for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({"text": texts} | {c: list(range(n)) for c in ("doc_id", "place", "text_key")})
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in neardup._signed(iter([batch]), 5, 32, 4))
        assert rows == n and tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()


def test_few_scans_with_many_keys_form_few_pairs(spark):
    """A thousand keys of sixty scans each are 1,770,000 pairs; in cells they are 60,000 listed keys."""
    from cuelake.operators import chunking
    sizes = spark.range(1000).select(F.col("id").alias("key"), F.lit(60).cast("bigint").alias("n"))
    assert chunking._rare_limit(sizes, 100, 64) < 60
    assert chunking._rare_limit(sizes.select("key", F.lit(2).cast("bigint").alias("n")), 100_000, 64) >= 2


def test_context_needs_one_shuffle_and_meets_lines_across_blocks(spark):
    from cuelake.operators import match
    from cuelake.operators.ordered import BLOCK
    numbers = [0, 1, 2, BLOCK - 2, BLOCK - 1, BLOCK, BLOCK + 1, BLOCK + 5]
    cues = spark.createDataFrame([(v, n, f"{v}:{n}") for v in (1, 2) for n in numbers] + [(None, 1, "lost")], "video_id long, cue_no int, line string")
    hits = cues.where("video_id is null or video_id = 1 or cue_no = 0").withColumn("topic", F.lit("t"))
    context = match.context_snippet(hits, cues)
    known = {(v, n) for v in (1, 2) for n in numbers}
    say = lambda v, n: f"{v}:{n}" if (v, n) in known else None
    assert {(r.video_id, r.cue_no, r.prev_line, r.line, r.next_line) for r in context.collect()} == {
        (v, n, say(v, n - 1), say(v, n), say(v, n + 1)) for v, n in known if v == 1 or n == 0} | {(None, 1, None, "lost", None)}
    plan = context._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_utf16_reaches_python_only_with_surrogates(spark):
    from cuelake.sources import srt
    texts = {"plain": "Ø a\nß Ü", "wide": "\u4e2d\ud7ff\ue000", "pair": "x\U0001f600", "long": "Øß" * 50_000}
    marks = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
    rows = [(f"{k} {c}", bytearray(m + t.encode(c)), t) for k, t in texts.items() for c, m in marks.items()]
    rows += [(f"stray {c}", bytearray(m + "a\ud800b".encode(c, "surrogatepass")), "a\ufffdb") for c, m in marks.items()]
    rows += [(f"odd {c}", bytearray(m + "ab".encode(c) + b"\xd8"), "ab") for c, m in marks.items()]
    files = spark.createDataFrame(rows, "name string, content binary, said string")
    read = srt.decode_text(files)
    assert [r.name for r in read.collect() if r.text != r.said] == []
    little = F.col("name").endswith("le")
    asked = files.where(F.when(little, srt._needs_python(F.col("content"), True)).otherwise(srt._needs_python(F.col("content"), False)))
    assert {r.name.split()[0] for r in asked.collect()} == {"pair", "stray", "odd"}


def test_requests_are_strings_a_few_at_a_time(spark):
    from cuelake.operators import requests
    asked = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 != 3, F.concat(F.lit("q"), "id")).alias("request"))
    got = {r.id: r.text for r in requests.ask_model(asked.coalesce(1), str.upper).collect()}
    assert got == {str(i): None if i % 10 == 3 else f"Q{i}" for i in range(1000)}
    assert "MapInArrow" in requests.ask_model(asked, str.upper)._jdf.queryExecution().executedPlan().toString()


def test_replies_of_a_focus_read_the_texts_once(spark):
    """What is adopted goes back to patterns that were written down, not to the texts; only replies that name two words cut a text."""
    out = entry.queries()["harvest_focus_replies"](spark, SF)
    assert out.count() > 0 and "documents" not in out._jdf.queryExecution().optimizedPlan().toString()
    named = F.col("doc_id") % 5 == 0
    whole, some = b.doc_words(spark, SF), b.doc_words(spark, SF, named)
    wanted = whole.select("doc_id", "w1", *[F.when(named, F.col(c)).alias(c) for c in ("w2", "w3")])
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_next_stamp_is_found_inside_its_file(spark):
    """No window over the stamps of a video: a file is one row, and tells each stamp where the next one is."""
    from cuelake.sources import media, srt
    files = spark.createDataFrame([(1, "x\n00:00:01,000 --> a\ny\n00:00:02,500 --> b\nz"), (2, "no stamp"), (3, ""), (4, None)], "video_id long, text string")
    stamps = srt.line_times(files)
    assert sorted(map(tuple, stamps.collect())) == [(1, 2, 1000, 4), (1, 4, 2500, None)]
    assert "Exchange" not in stamps._jdf.queryExecution().executedPlan().toString()
    asked = [(0, 1, 1), (1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 1, 10**7), (5, 2, 1), (6, 9, 1)]
    requests = spark.createDataFrame(asked, "request_id long, video_id long, top long").selectExpr("*", "false as zero_based", "500 as preroll_ms")
    found = media.line_to_time(requests, stamps)
    assert {r.request_id: r.seek_ms for r in found.collect()} == {0: 0, 1: 500, 2: 500, 3: 2000, 4: 2000, 5: 0, 6: 0}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_windows_without_text_shuffle_it_no_third_time(spark):
    from cuelake.operators import chunking
    cues = spark.createDataFrame([(v, n, n * 3000, f"line {n}") for v in range(6) for n in range(9)], "video_id long, cue_no int, start_ms long, line string")
    sources = spark.createDataFrame([(v, v + 1, f"s{v // 3}") for v in range(6)], "video_id long, seq long, srt_id string")
    staged = chunking.term_windows(cues, sources, 60)
    bare = staged.drop("text")
    assert sorted(map(tuple, bare.collect())) == sorted(tuple(r)[:-1] for r in staged.collect())
    assert {(r.video_id, r.seq) for r in staged.collect()} == {(0, 1), (3, 4)} and all(r.text.startswith("#") for r in staged.collect())
    top = next(line for line in bare._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [id" in line)
    assert "first(text" not in top and ", text#" not in top
