"""Subtitle files, encodings, markup, topic files: small cases of our own."""

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.sources import media, sinks, srt, topics
from cuelake.streaming import streams

CASES = {
    "plain": ("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n",
              [(1000, 2500, "Hello\nthere"), (3000, 4000, "Bye")]),
    "no counters, no blanks": ("00:00:01,000 --> 00:00:02,000\nA\n00:00:02,000 --> 00:00:03,000\nB",
                               [(1000, 2000, "A"), (2000, 3000, "B")]),
    "counter without blank": ("90\n0:10:07.3 --> 0:10:09.04\nfirst\n91\n0:10:11.600 --> 0:10:12.000\nsecond",
                              [(607300, 609040, "first"), (611600, 612000, "second")]),
    "digits are a caption": ("00:00:01,000 --> 00:00:02,000\n42\n\n2\n00:00:03,000 --> 00:00:04,000\n43\n",
                             [(1000, 2000, "42"), (3000, 4000, "43")]),
    "digits then text": ("00:00:01,000 --> 00:00:02,000\n42\nmore\n", [(1000, 2000, "42\nmore")]),
    "two digit lines": ("00:00:01,000 --> 00:00:02,000\n42\n2\n00:00:03,000 --> 00:00:04,000\nx",
                        [(1000, 2000, "42"), (3000, 4000, "x")]),
    "old mac breaks": ("5\r00:07:00,250 --> 00:07:01,750\rtwo\rlines\r\r00:07:08,000 --> 00:07:09,500\rno counter",
                       [(420250, 421750, "two\nlines"), (428000, 429500, "no counter")]),
    "windows breaks": ("1\r\n00:00:01,000 --> 00:00:02,000\r\n  A \r\n\r\n", [(1000, 2000, "A")]),
    "junk around": ("WEB TITLE\nby nobody\n\n00:02:30,000 --> 00:02:31,000 align:start\nkept\n\nlost\n3\nlost too\n", [(150000, 151000, "kept")]),
    "empty cue kept": ("00:03:00,000 --> 00:03:01,000\n\t \n00:03:02,000 --> 00:03:03,000\n\n00:03:04,000 --> 00:03:05,000\nend",
                       [(180000, 181000, ""), (182000, 183000, ""), (184000, 185000, "end")]),
    "file order": ("00:00:09,000 --> 00:00:10,000\nlate\n\n00:00:01,000 --> 00:00:02,000\nearly", [(9000, 10000, "late"), (1000, 2000, "early")]),
    "long hours": ("123:00:00,000 --> 123:00:01,000\nA", [(442800000, 442801000, "A")]),
    "one digit minutes are no stamp": ("0:1:00,000 --> 0:02:00,000\nA", []),
    "four millis before the arrow are no stamp": ("00:00:01,0000 --> 00:00:02,000\nA", []),
    "nothing": ("no cues here\n", []), "empty": ("", []),
}


def test_parser_cases(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "video_id STRING, text STRING")
    got = {k: [] for k in CASES}
    for r in srt.srt_scan(files).orderBy("video_id", "cue_no").collect():
        got[r.video_id].append((r.start_ms, r.end_ms, r.text))
    assert got == {k: v[1] for k, v in CASES.items()}


def test_encodings(spark):
    text = "é 漢 𝄞 x"
    rows = {
        "utf8": text.encode(), "mark": b"\xef\xbb\xbf" + text.encode(), "le": b"\xff\xfe" + text.encode("utf-16-le"),
        "be": b"\xfe\xff" + text.encode("utf-16-be"), "cp1252": b"\x84Gr\xfc\xdfe\x93 \x96 \x8d", "overlong": b"\xc0\xaf",
        "surrogate": b"\xed\xa0\x80", "stray": b"\xff\xfe" + b"a\x00\x00\xd8b\x00", "odd": b"\xff\xfea\x00b", "cut": b"ab\xe2\x82",
        "mark, invalid": b"\xef\xbb\xbf\xe9",
    }
    want = {"utf8": text, "mark": text, "le": text, "be": text, "cp1252": "„Grüße“ – \x8d", "overlong": "À¯",
            "surrogate": "í\xa0€", "stray": "a\ufffdb", "odd": "a", "cut": "abâ‚", "mark, invalid": "é"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "k STRING, content BINARY")
    assert {r.k: r.text for r in srt.decode_text(files).collect()} == want
    clean = files.where("k in ('le', 'be', 'utf8')")
    assert {r.text for r in srt.decode_text(clean, strict_utf16=True).collect()} == {text}


MARKUP = [
    ("<i>a</i> & b", "<i>a</i> &amp; b", "a & b"), ("<I>a</I>", "<I>a</I>", "a"), ("< b >x", "<b>x", "x"),
    ("<script>x", "&lt;script&gt;x", "<script>x"), ("{\\an8}up", "up", "up"), ("{\\an8 up", "{\\an8 up", "{\\an8 up"),
    ("a\nb", "a<br>b", "a b"), ('<font color="#fff">x</font>', '<font color="#fff">x</font>', "x"),
    ("<FONT Color=red size='2'>x", '<font color="red" size="2">x', "x"),
    ('<font face="Arial é-x">x', '<font face="Arial é-x">x', "x"),
    ("<font color=javascript:1>x", "&lt;font color=javascript:1&gt;x", "<font color=javascript:1>x"),
    ("<font color =red>x", "&lt;font color =red&gt;x", "<font color =red>x"), ("<font>x", "&lt;font&gt;x", "<font>x"),
    ("<a <b>x", "&lt;a <b>x", "<a x"), ("<" + "b" * 3 + ">", "&lt;bbb&gt;", "<bbb>"),
    ("<b" + " " * 100 + ">x", "&lt;b" + " " * 100 + "&gt;x", "<b >x"), ('say "hi"', "say &quot;hi&quot;", 'say "hi"'),
]


def test_markup(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(MARKUP)], "i INT, t STRING")
    rows = df.select("i", T.sanitize_markup(F.col("t")).alias("h"), T.render_line(F.col("t")).alias("l")).orderBy("i").collect()
    assert [(r.h, r.l) for r in rows] == [(h, line) for _, h, line in MARKUP]


def test_clips(spark):
    text = "aé€x𝄞" * 3
    df = spark.range(0, 40).select(F.col("id"), F.lit(text).alias("t"))
    for r in df.select("id", "t", T.utf8_clip(F.col("t"), F.col("id").cast("int")).alias("c")).collect():
        raw = text.encode()[:r.id]
        assert r.c == raw.decode("utf-8", "ignore")
    lines = spark.createDataFrame([("abc\ndef\ng",), ("abcdefghij",), ("ab",), ("abcd\nef",)], "t STRING")
    assert [r.s for r in lines.select(T.sample_head(F.col("t"), 4).alias("s")).collect()] == ["abc\n", "", "ab", "abcd\n"]


def test_topic_round_trip_and_order(spark, tmp_path):
    text = "- one\n  - a|b\n  - c\n\n- two\n  - \\{one:}x\n\n- file://v.mp4\n  - file://v.srt\n  - two\n\n- file://w.mp4"
    files = spark.createDataFrame([("f", text + "\n")], "file STRING, text STRING")
    assert topics.lint(files).count() == 0
    items = topics.read_items(files)
    rows = topics.corpus_lines(topics.load_topics(items), topics.load_videos(items))
    out = str(tmp_path / "corpus")
    sinks.write_lines(rows, out, ["section", "seq", "ord"], by=["file"])
    written = [p.read_text() for p in sorted((tmp_path / "corpus" / "file=f").glob("*.txt"))]
    assert "".join(written) == text + "\n"


def test_lint_lines(spark):
    cases = {
        "- t\n": (1, "no pattern"), "x\n": (1, "not an item"), "  - x\n": (1, "orphan item"), "- a:b\n  - x": (1, "bad name"),
        "- .\n  - x": (1, "bad name"), "- t\n  - \\{u:}": (2, "unknown topic"), "- t\n  - \\{t:}": (1, "circular reference"),
        "- t\n  - x\n- t\n  - y": (3, "duplicate topic"), "- file://\n": (1, "empty path"),
        "- file://a\n- file://a": (2, "duplicate video"), "# only\n\n- t\n  - \\{ :}": None,
    }
    files = spark.createDataFrame([(k, k) for k in cases], "file STRING, text STRING")
    got = {}
    for r in topics.lint(files).collect():
        got.setdefault(r.file, set()).add((r.line, r.rule))
    assert got == {k: {v} for k, v in cases.items() if v}


def test_versions_and_journal(spark, tmp_path):
    df = spark.range(3)
    sinks.write_version(df, str(tmp_path), 1)
    with pytest.raises(Exception):
        sinks.write_version(df, str(tmp_path), 1)
    task = spark.createDataFrame([("node", 2, "ab", None, False, ["x", "y"])],
                                 "kind STRING, tier INT, id STRING, note STRING, exported BOOLEAN, deps ARRAY<STRING>")
    for _ in range(2):
        sinks.append_journal(task, str(tmp_path / "journal"))
    assert [r.value for r in spark.read.text(str(tmp_path / "journal")).collect()] == ["node.2 ab (supportive) <- x y"] * 2


def test_file_stream_ingests_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text(CASES["plain"][0])
    files = streams.read_file_stream(spark, str(tmp_path / "in"))
    run = lambda: (streams.incremental_ingest(files, "path").writeStream.format("parquet")
                   .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk"))
                   .trigger(availableNow=True).start().awaitTermination())
    run()
    (tmp_path / "in" / "b.srt").write_bytes(b"\xff\xfe" + CASES["no counters, no blanks"][0].encode("utf-16-le"))
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 4 and rows.select("path").distinct().count() == 2


def test_binary_files_and_pairing(spark, tmp_path):
    (tmp_path / "a.srt").write_text(CASES["plain"][0])
    (tmp_path / "b.srt").write_text("nothing")
    files = srt.decode_text(srt.read_files(spark, str(tmp_path)))
    assert srt.srt_scan(files, "path").count() == 2
    assert [r.reason for r in srt.quarantine_split(files, "path").collect()] == ["no cue"]
    listing = spark.createDataFrame([(f,) for f in ("/v/a.mp4", "/v/a.srt", "/v/a.mp4.srt", "/v/b.srt", "/v/b.x.mkv", "/v/b.jpg",
                                                    "/w/b.mp4", "/v/c.srt")], "file STRING")
    got = {r.srt: (r.video, r.status) for r in media.video_for_srt(listing).collect()}
    assert got == {"/v/a.mp4.srt": ("/v/a.mp4", "exact"), "/v/a.srt": ("/v/a.mp4", "sibling"), "/v/b.srt": (None, "ambiguous"),
                   "/v/c.srt": (None, "missing")}


def test_hash_is_a_parameter(spark):
    import hashlib
    df = spark.createDataFrame([("a",), (None,)], "t STRING")
    got = [r.h for r in df.select(T.content_id("dive\n", F.col("t"), hash_fn=T.blake_head).alias("h")).collect()]
    assert got == [hashlib.blake2b(b"dive\na", digest_size=32).hexdigest()[:16], None]
