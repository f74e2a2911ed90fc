"""Files that change, break and come back; writers that meet."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from cuelake.sources import sinks, versions


def cue(*lines):
    return "".join(f"{i + 1}\n00:00:0{i},000 --> 00:00:0{i},900\n{line}\n\n" for i, line in enumerate(lines))


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (at, at))


def state(spark, root):
    lines = {}
    for r in versions.ingested(spark, root).orderBy("file.path", "cue_no").collect():
        lines.setdefault(r.file.path.rsplit("/", 1)[1], []).append(r.line)
    return lines, sorted(r.file.path.rsplit("/", 1)[1] for r in versions.quarantined(spark, root).collect())


def test_changed_and_broken_files(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lake")
    now = int(time.time()) - 1000
    put(folder / "a.srt", cue("one", "two"), now)
    put(folder / "deep" / "b.srt", cue("bee"), now)
    put(folder / "c.srt", "nothing", now)
    assert versions.ingest_changes(spark, str(folder), root, most_files=2) == 3
    assert state(spark, root) == ({"a.srt": ["one", "two"], "b.srt": ["bee"]}, ["c.srt"])
    assert versions.ingest_changes(spark, str(folder), root) == 1  # the broken one is tried again
    put(folder / "a.srt", cue("new"), now + 10)  # changed under its old path
    put(folder / "deep" / "b.srt", b"\x00\x00", now + 10)  # broken by a bad write: the good version stays
    put(folder / "c.srt", b"\xff\xfe" + cue("mended").encode("utf-16-le"), now + 10)
    put(folder / "d.srt", cue("dee"), now + 10)
    assert versions.ingest_changes(spark, str(folder), root, most_files=1) == 4
    assert state(spark, root) == ({"a.srt": ["new"], "b.srt": ["bee"], "c.srt": ["mended"], "d.srt": ["dee"]}, ["b.srt"])
    put(folder / "deep" / "b.srt", cue("bee", "again"), now + 20)
    assert versions.ingest_changes(spark, str(folder), root) == 1
    assert state(spark, root)[0]["b.srt"] == ["bee", "again"] and state(spark, root)[1] == []
    assert versions.ingest_changes(spark, str(folder), root) == 0


def test_a_run_that_died_leaves_nothing_visible(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lake")
    put(folder / "a.srt", cue("one"), 1_700_000_000)
    versions.ingest_changes(spark, str(folder), root)
    lost = spark.read.parquet(f"{root}/cues").where("batch <> 'none'").drop("batch")
    lost.write.parquet(f"{root}/cues/batch=lost")
    assert state(spark, root) == ({"a.srt": ["one"]}, [])


def test_watch(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lake")
    put(folder / "a.srt", cue("one"), 1_700_000_000)
    query = versions.watch(spark, str(folder), root, every="1 second")
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not (query.lastProgress and query.lastProgress["batchId"] >= 1 and state(spark, root)[0]):
            time.sleep(1)
    finally:
        query.stop()
    assert state(spark, root) == ({"a.srt": ["one"]}, [])


def test_no_number_is_claimed_twice(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: sinks.claim(spark, str(tmp_path)), range(40)))
    assert sorted(numbers) == list(range(1, 41))


def test_incomplete_versions_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.write_version(spark.range(3), root) == 1 and sinks.claim(spark, root) == 2
    (tmp_path / "version=2").mkdir()
    assert sinks.write_version(spark.range(5), root) == 3
    got = {r.version: r.n for r in sinks.read_versions(spark, root, "id BIGINT").groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 3, 3: 5}


def test_readers_write_nothing(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert state(spark, root) == ({}, []) and not os.path.exists(root)


def test_a_file_per_row(spark, tmp_path):
    uri = sinks.arrow_uri(spark, f"{tmp_path}/out")
    rows = spark.createDataFrame([(str(i % 3), f"{i}.txt", None if i == 5 else f"é{i}\n") for i in range(20)], "folder STRING, name STRING, content STRING")
    assert sinks.write_files(rows, uri) == 20
    assert sinks.write_files(rows.where("name = '7.txt'").withColumn("content", F.lit("new")), uri) == 1
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert got == {f"{i % 3}/{i}.txt": "" if i == 5 else "new" if i == 7 else f"é{i}\n" for i in range(20)}
