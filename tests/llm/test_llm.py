"""The training-data operators against brute force, on small tables full of odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cuelake.llm import bpe, exact, language, linear, mixing, neardup, quality, substrings, tokens, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

# Extra columns that carry the names of working columns.
CLASH = ["digest", "place", "h", "pos", "words", "lines", "windows", "size", "rank", "bin", "copies", "label", "bucket", "n_words", "offset", "shard",
         "component", "held_out", "keep_id", "n"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASH])


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + (".\n" if r.random() < 0.05 else "") for _ in range(n))


def rows():
    base, long = prose(1, 200), prose(2, 30_000, 5000)
    passage = prose(3, 60)
    near = base.split(" ")
    near[100] = "changed"
    texts = [
        None, "", "  \t\n ", "one", "ONE", "a b c", base, base, " ".join(near), base.upper(), long, long, prose(4, 80) + " " + passage,
        passage + " " + prose(5, 90), prose(6, 40) + " " + passage + " " + prose(7, 40) + " " + passage, "same " * 300, "same " * 299,
        "x\x1cy z z q", "Ünï Straße ÉÀ İ ς 中文 <|endoftext|> it's", passage, prose(8, 49), prose(9, 50), prose(9, 50) + " tail", "!" * 500,
        "\n".join(["line one here"] * 5), "a" * 3000 + " " + "ab" * 700, "the cat the cat the cat"]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2", "s3"][i % 4], None) for i, t in enumerate(texts)]
    out += [(7, base, "en", "s1", 5), (None, base, "en", None, 5), (None, "no id", None, "s1", None), (100, base, "de", "s9", 1), (3, "one", "fr", None, 0)]
    return [r + tuple("clash" for _ in CLASH) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def ordered(found):
    return sorted(found, key=key)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return (text or "").encode().split()


# Exact deduplication


def exact_brute(table):
    groups = defaultdict(list)
    for doc_id, text, *_ in table:
        groups[ascii_lower(text)].append(doc_id)
    out = []
    for doc_id, text, *_ in table:
        group = groups[ascii_lower(text)]
        keep = max((i for i in group if i is not None), default=None)
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(ascii_lower(text).encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("arriving", [None, "true", "false", "doc_id % 2 = 0"])
def test_exact(docs, arriving):
    got = collected(exact.exact_dedup(docs, None if arriving is None else F.expr(arriving)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_brute(rows())


def test_exact_stays(docs, nothing):
    got = Counter((r.doc_id, r.text) for r in exact.one_of_each(docs).collect())
    last = {}
    for doc_id, text, *_ in rows():
        last[ascii_lower(text)] = max(last.get(ascii_lower(text), -1), -1 if doc_id is None else doc_id)
    want = {(d, t) for d, t, *_ in rows() if (-1 if d is None else d) == last[ascii_lower(t)]}
    assert set(got) == want and set(got.values()) == {1}
    assert exact.one_of_each(nothing).count() == 0
    assert exact.exact_dedup(nothing).count() == 0


@given(st.sets(st.binary(min_size=32, max_size=32), min_size=0, max_size=300))
@settings(max_examples=30, deadline=None)
def test_minimal_perfect_hash(digests):
    raw = np.frombuffer(b"".join(sorted(digests)), dtype=np.uint8).reshape(-1, 32)
    sizes, bits = exact.build_hash(raw)
    assert sorted(exact.slots_of(raw, sizes, bits)) == list(range(len(raw)))


# Substring deduplication


def substring_brute(table, window=50):
    first = {}
    for doc_id, text, *_ in table:
        w = words_of(text)
        place = (1 << 63) - 1 if doc_id is None else doc_id
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            first[x] = min(first.get(x, place), place)
    out = []
    for doc_id, text, *_ in table:
        w = words_of(text)
        place = (1 << 63) - 1 if doc_id is None else doc_id
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < place:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return ordered(out)


def test_substrings(docs, nothing):
    found = substrings.substring_dedup(docs, texts_too=True).cache()
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == substring_brute(rows())
    for r in found.where("kept_text is not null").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substrings.substring_dedup(nothing).count() == 0


def test_substrings_at_every_offset(spark):
    passage = prose(11, 50)
    table = [(i, prose(100 + i, i) + " " + passage + " " + prose(200 + i, 3)) for i in range(0, 64, 3)]
    table += [(900, prose(5, 7) + " " + prose(11, 50).rsplit(" ", 1)[0] + " other " + prose(6, 60))]
    table.append((901, table[0][1]))
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert collected(substrings.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256") == substring_brute(table)


def test_substrings_of_many_documents_without_id(spark):
    """They share a place, but each has marks and windows of its own; copies among them remove nothing."""
    passage = prose(31, 55)
    table = [(None, prose(300 + i, 30) + " " + (passage + " " if i % 3 else "") + prose(600 + i, 30)) for i in range(60)]
    table += [(None, table[1][1])] * 20 + [(4, prose(32, 10) + " " + passage), (7, prose(33, 80)), (7, passage + " tail"), (7, prose(34, 70))]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert collected(substrings.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256") == substring_brute(table)


def test_difference_cover():
    assert substrings.covers(substrings.COVER, substrings.PERIOD)
    assert not substrings.covers((1, 2, 3), 31)


# Near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(table):
    ids = sorted({r[0] for r in table}, key=lambda d: (d is None, d))
    sets = defaultdict(list)
    for r in table:
        sets[r[0]].append(shingles(r[1]))
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)), key=lambda d: (d is None, d))
                parent[rb] = ra
    return ordered((r[0], len(shingles(r[1])), root(r[0]), root(r[0]) == r[0]) for r in table)


def test_near_duplicates(docs, nothing):
    got = collected(neardup.near_dedup(docs.where("doc_id is not null")), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute([r for r in rows() if r[0] is not None])
    assert neardup.near_dedup(nothing).count() == 0


def test_near_duplicates_without_id(docs):
    """A document without id is linked like any other, and comes after all of them; one that is unlike all others stays."""
    found = {(r.doc_id, r.text) for r in neardup.one_of_each(docs).select("doc_id", "text").collect()}
    assert not {d for d, _ in found} & {8, 100} and {0, 1, 2, 5, 6} <= {d for d, _ in found}
    assert {t for d, t in found if d is None} == {"no id"}


def test_near_duplicates_by_text(spark):
    """Texts without id, or of one id, are linked each for itself: none is lost, none is taken along by another."""
    def near(text):
        w = text.split()
        w[len(w) // 2] = "changed"
        return " ".join(w)

    a, b, c, d, e, f, g = (prose(400 + i, 90 + i, 5000) for i in range(7))
    table = [(5, a), (None, near(a)), (None, b), (6, e), (None, near(e)), (3, c), (7, near(c)), (7, d), (8, near(d)), (2, f), (2, near(g)), (9, g)]
    table += [(None, prose(500 + i, 60, 5000)) for i in range(5)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = {near(a): (5, False), near(e): (6, False), near(c): (3, False), near(d): (7, False), g: (2, False)}
    found = neardup.near_dedup(df)
    key = df.select("text", F.xxhash64("text").alias("text_key"))
    got = {(r.doc_id, r.text): (r.component_id, r.kept) for r in found.join(key, "text_key").collect()}
    assert got == {(i, t): want.get(t, (i, True)) for i, t in table}
    assert ordered((r.doc_id, r.text) for r in neardup.one_of_each(df).collect()) == ordered((i, t) for i, t in table if t not in want)


def test_near_duplicates_that_the_first_member_misses(spark):
    """Copies of one text with own edits: many are linked with others but not with the first of their bucket."""
    r, base = random.Random(3), [f"v{i}" for i in range(150)]
    table = []
    for i in range(70):
        w = list(base)
        for j in r.sample(range(150), 1 + i % 6):
            w[j] = f"e{i}_{j}"
        table.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert collected(neardup.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == near_brute(table)


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    errors = []
    for n in (1, 3, 20, 100, 400, 1500):
        for shared in (0.2, 0.5, 0.75, 0.95):
            k = max(1, int(n * shared))
            a, b = pool[:n], np.concatenate([pool[:k], pool[n:2 * n - k]])
            s = neardup.superminhash([a, b], 128)
            assert (s != np.iinfo(np.uint64).max).all()
            errors.append(abs((s[0] == s[1]).mean() - k / len(np.union1d(a, b))))
    assert max(errors) < 0.17 and np.mean(errors) < 0.05


def test_superminhash_by_steps():
    """Against the algorithm one element and one step at a time."""
    r, m = np.random.default_rng(6), 16
    for n in (1, 2, 5, 40):
        elements = r.integers(0, 1 << 63, n).astype(np.uint64)
        want = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
        for e in elements:
            places = list(range(m))
            for j in range(m):
                seed = np.array([e], dtype=np.uint64)
                draw = neardup._mix(seed + np.uint64((2 * j + 1) * neardup._BASE % (1 << 64)))[0]
                k = j + int(neardup._mix(seed + np.uint64((2 * j + 2) * neardup._BASE % (1 << 64)))[0] % np.uint64(m - j))
                places[j], places[k] = places[k], places[j]
                want[places[j]] = min(want[places[j]], np.uint64(j << 56) | (draw >> np.uint64(8)))
        assert (neardup.superminhash([elements], m)[0] == want).all()


# Quality rules


def quality_brute(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality(docs, nothing):
    found = quality.quality_rules(docs)
    got = collected(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == ordered((r[0], *quality_brute(r[1])) for r in rows())
    assert found.where("base_failed and kept").count() == 0
    assert quality.quality_rules(nothing).count() == 0


def test_quality_rules_decide(spark):
    good = " ".join(["The house of the man and his dog is there, and it was for them."] + [f"he{i} said it{i} with number{i} was" for i in range(20)])
    table = [(1, good), (2, good.replace(" ", "$$$ ")), (3, good.upper().replace(" ", "!! ")), (4, prose(1, 100))]
    got = dict(quality.quality_rules(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "kept").collect())
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_quality_filters(spark):
    """Filters, joins and counts on the result cost what the result costs: the measures are made once per text."""
    import time
    table = [(i, prose(50 + i, 40 * i, 90)) for i in range(12)] + [(99, prose(9, 100_000, 9000))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = quality.quality_rules(df)
    want = {r.doc_id: (r.kept, r.n_repeat_words) for r in found.collect()}
    assert want[99][1] == quality_brute(table[-1][1])[4]
    started = time.monotonic()
    assert {r.doc_id for r in found.where("kept").collect()} == {i for i, (k, _) in want.items() if k}
    assert {r.doc_id for r in found.where("n_repeat_words > 30 and not base_failed").collect()} == {
        r.doc_id for r in found.collect() if r.n_repeat_words > 30 and not r.base_failed}
    assert found.join(df, "doc_id").where("kept").count() == sum(k for k, _ in want.values())
    assert found.where("symbol_ratio < 0.1").count() == len([1 for i, t in table if t.split()])
    assert time.monotonic() - started < 60


def test_stop_words(spark):
    texts = ["The of, AND! the.. (the) the-the l' für Für? DIE: y y. y,, é als", "", None, "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = set(quality.STOP_WORDS)
    want = {i: sum(w.lower() in held or (w[-1] in ".,;:!?" and w[:-1].lower() in held) for w in (t or "").split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_stop_words for r in quality.measures(df).collect()} == want


# Tokens

ODD = "abcdefgthe  ing'sXYZÉéßÖñ0123.,!?#-'\n\t\r\x0b\x1c\x85\xa0 İςΣﬁǺ½中文字😀<|endoftext|>"


def odd_texts():
    r = random.Random(7)
    out = ["".join(r.choices(ODD, k=r.randint(0, 60))) for _ in range(300)]
    out += ["".join(r.choices("ab'sÉ  \n\t\r.,1", k=r.randint(0, 12))) for _ in range(300)]
    out += ["".join(r.choices(["<|endoftext|>", "<|startoftext|>", " ", "a", "the", "\n", "'s", "É", "  "], k=r.randint(0, 12))) for _ in range(100)]
    return out + ["a" * 5000, "the" * 3000, "ab" * 777 + " " + "x" * 333, "".join(r.choices("abcdeth", k=20000)), "é" * 1000, "aaaa" * 50 + "!" * 300]


@pytest.mark.parametrize("encoder", [lambda w: bpe.TreeEncoder(w), lambda w: bpe.TreeEncoder(w, leaf=4, window=1), lambda w: bpe.RankMerger(w)])
def test_word_bpe_encoders(encoder):
    import pyarrow as pa
    words, texts = bpe.word_bpe(WORD), odd_texts()
    pieces = bpe.word_pieces(pa.array(texts), words)
    memo = bpe.Memo(words.filler(encoder(words), lambda ids: ids.tobytes(), b"".join), most=200)
    ids, sizes = pieces.joined(memo.get(pieces.distinct))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_text(texts):
    import pyarrow as pa
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    words = bpe.word_bpe(WORD)
    pieces = bpe.word_pieces(pa.array(texts), words)
    for (ids, sizes), path in ((pieces.joined(bpe.Memo(words.filler(bpe.RankMerger(words), lambda ids: ids.tobytes(), b"".join)).get(pieces.distinct)), WORD),
                               (bpe.SpacedEncoder(bpe.tokenizer_at(BYTE)).encode(pa.array(texts, pa.string())), BYTE)):
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [
            e.ids for e in bpe.tokenizer_at(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("most", [10, 300, 1_500_000])
def test_spaced_encoder_over_slices(most):
    """Slice after slice, with pieces remembered, dropped and met again; sliced arrays, long and odd pieces."""
    import pyarrow as pa
    texts = odd_texts() + [prose(i, 60, 300) for i in range(60)] + [" lead", "", "a", " ", "trail ", "x" * 200 + " y " + "x" * 200, "Привет мир это текст"] * 3
    r, encoder, tokenizer = random.Random(1), bpe.SpacedEncoder(bpe.tokenizer_at(BYTE), most), Tokenizer.from_file(BYTE)
    for _ in range(12):
        part = r.sample(texts, 70)
        ids, sizes = encoder.encode(pa.array(["cut off", *part], pa.string()).slice(1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert len(encoder.keys) <= max(most, 10) and (np.diff(encoder.keys.astype(object)) > 0).all()


def library(path, table):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([r[1] or "" for r in table], add_special_tokens=False)]


def test_token_counts(docs, nothing):
    got = collected(tokens.token_counts(docs, WORD), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == ordered((r[0], len((r[1] or "").encode()), len(i), len(i) > 2048) for r, i in zip(rows(), library(WORD, rows())))
    assert tokens.token_counts(nothing, WORD).count() == 0


def test_encode_decode(docs, nothing):
    tokenizer = Tokenizer.from_file(WORD)
    found = tokens.encode_decode(docs, WORD).collect()
    want = [(r[0], i, tokenizer.decode(i, skip_special_tokens=False)) for r, i in zip(rows(), library(WORD, rows()))]
    assert ordered((r.doc_id, r.ids, r.decoded) for r in found) == ordered(want)
    for r in found:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert tokens.encode_decode(nothing, WORD).count() == 0


def test_token_files(docs, nothing, spark, tmp_path):
    found = tokens.token_file_report(docs, BYTE, str(tmp_path / "files"))
    table = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r, ids in zip(table, library(BYTE, table)):
        ids = [*ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert collected(found, "doc_id", "start", "n_tokens", "ids_crc32") == ordered(want)
    assert tokens.token_file_report(nothing, BYTE, str(tmp_path / "none")).count() == 0


def test_token_file_layout(docs, spark, tmp_path):
    """Encodings, page indexes, and reads that leave the token column alone."""
    import pyarrow.parquet as pq
    tokens.write_token_files(docs, str(tmp_path / "files"), BYTE, shards=2)
    names = [p for p in (tmp_path / "files/tokens").glob("part-*.parquet")]
    columns = {c.path_in_schema: c for p in names for c in [pq.ParquetFile(p).metadata.row_group(0).column(i) for i in range(5)]}
    assert "RLE_DICTIONARY" in str(columns["tokens.list.element"].encodings) and columns["tokens.list.element"].has_offset_index
    assert "DELTA_BINARY_PACKED" in str(columns["doc_id"].encodings) and columns["doc_id"].has_column_index
    plan = tokens.read_token_files(spark, str(tmp_path / "files")).where("doc_id = 7").select("doc_id", "start")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line and "doc_id" in line)
    assert "EqualTo(doc_id,7)" in scan and "tokens:" not in scan.split("ReadSchema")[1]


# Mixing


def test_mix(docs, nothing):
    found = mixing.mix(docs).collect()
    assert ordered((r.doc_id, r.size) for r in found) == ordered((r[0], len(words_of(r[1]))) for r in rows())
    total = sum(r.size for r in found)
    per = Counter()
    for r in rows():
        per[r[3]] += len(words_of(r[1]))
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        rest = total - sum(3 * per[s] for s in capped)
        goal = {s: 3 * per[s] if s in capped else rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if goal[s] > 3 * per[s] + 1e-9}
        if not over:
            break
        capped |= over
    sizes = {}
    for r in found:
        sizes.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    assert {(per[s], round(goal[s], 6)) for s in names} == set(sizes)
    for (size, target), of in sizes.items():
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in of)
        assert abs(sum(r.taken for r in of) - target) <= max(r.size for r in of)
    assert ordered(tuple(r) for r in mixing.mix(docs).collect()) == ordered(tuple(r) for r in found)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_mix_comes_near(spark):
    table = [(i, "w " * random.Random(i).randrange(1, 60), "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    per_source = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source", "target")  # sources may share a target
    found = per_source.agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 60 for r in found)
    mixed = mixing.mixed(df)
    assert mixed.columns == ["doc_id", "text", "source"]
    assert abs(mixed.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] - sum(len(t.split()) for _, t, _ in table)) < 500


def test_mixed_takes_each_row_as_often_as_the_mix(spark):
    """Rows without id, and rows of one id in several sources: none is lost for another one's sake."""
    table = [(None if i % 2 else i // 6, "w " * (20 + i), "abc"[i % 3], i) for i in range(240)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string, size long").repartition(3)
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(df).collect()}
    assert len(copies) == len(table) and {0, 1} < {n for (d, _), n in copies.items() if d is None}
    mixed = mixing.mixed(df)
    got = Counter((r.doc_id, r.text, r.source, r.size) for r in mixed.collect())
    assert mixed.columns == df.columns and got == {r: copies[r[0], 20 + r[3]] for r in table if copies[r[0], 20 + r[3]]}
    rest = [(r[3], copies[r[0], 20 + r[3]]) for r in table if r[0] is None and r[2] == "c"]
    assert max(n for n, c in rest if c) > min(n for n, c in rest if not c)  # not the shortest ones first


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# Classifiers


def test_language(spark, nothing, docs):
    r = random.Random(1)
    words = {"en": ["the", "and", "that", "with", "house", "water"], "fr": ["le", "une", "être", "avec", "maison", "déjà"], "de": ["der", "und", "nicht", "über", "haus", "straße"]}
    table = [(i, " ".join(r.choices(words[x], k=30)), x) for i in range(240) for x in [("en", "fr", "de")[i % 3]]]
    table += [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !!", None), (1003, "x", None), (None, "the and that", "en")]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    found = {x.doc_id: x for x in language.language_id(df).collect()}
    assert len(found) == len(table)
    said = {d: x for d, _, x in table}
    held = [d for d, x in found.items() if x.held_out and d < 1000]
    assert held and all(found[d].lang_pred == said[d] and found[d].score > 0.5 for d in held)
    assert all(found[d].lang_pred == "und" and found[d].score == 0 for d in (1000, 1001, 1002))
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, x in found.items() if d is not None)
    assert found[None].held_out is False
    assert language.language_id(nothing).count() == 0
    assert language.language_id(docs).count() == len(rows())
    assert {x.lang_pred for x in language.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_temperature_sharpens_and_softens():
    truth = np.array([0, 1] * 50)
    sure = np.where(np.eye(2)[truth] > 0, 1.0, 0.0)
    assert language.temperature(sure, truth) < 0.2
    r = np.random.default_rng(2)
    wrong = np.where(np.eye(2)[r.integers(0, 2, 100)] > 0, 8.0, 0.0)
    assert language.temperature(wrong, truth) > 5


def test_toxicity(spark, nothing, docs):
    r = random.Random(2)
    table, labels = [], []
    for i in range(900):
        w = [f"w{r.randrange(300)}" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[r.randrange(60)] = r.choice(["grubbel", "Snarkix!", "grubbelant"])
        table.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    table += [(5000, None), (5001, ""), (None, "grubbel")]
    labels += [(None, 1, 1), (7777, 1, None)]
    df, marks = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in toxicity.toxicity(df, marks).collect()}
    held = [i for i in range(900) if found[i].held_out]
    assert held and all(found[i].predicted == (i % 6 == 0) for i in held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in found.values())
    assert found[5000].score == found[5001].score < 0.3
    empty = marks.where("false")
    assert {x.score for x in toxicity.toxicity(docs, empty).collect()} == {0.5}
    assert toxicity.toxicity(nothing, marks).count() == 0


def test_ftrl_drops_useless_features():
    r = np.random.default_rng(3)
    model = linear.Ftrl(50, 1, linear.Rates(alpha=1.0, l1=4.0))
    for _ in range(600):
        y = r.integers(0, 2)
        at = np.array([0, 1 if y else 2, *(3 + r.choice(47, 5, replace=False))])
        w = model.weights(at)
        model.step(at, np.ones(len(at)), np.array([1 / (1 + np.exp(-w.sum())) - y]), w)
    w = model.weights(slice(None))[:, 0]
    assert w[1] > 1 > -1 > w[2] and (w[3:] == 0).mean() > 0.8


def test_forget_empties_every_memo_of_an_encoder():
    import gc

    import pyarrow as pa

    from cuelake.llm.common import forget
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["(words), that's all; words <|endoftext|>"]})
    (_, ids, sizes, shown), = tokens._coded(iter([batch]), WORD)
    library = bpe.tokenizer_at(WORD)
    assert shown == [library.decode(ids.tolist(), skip_special_tokens=False).encode()] and sizes.tolist() == [len(ids)]
    forget()
    gc.collect()
    assert not [m for m in gc.get_objects() if isinstance(m, bpe.Memo) and (m.young or m.old)]
