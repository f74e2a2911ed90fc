"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cuelake.llm import common, language, mixing
from test_llm import ascii_lower, near_brute, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, prose(i, 60 + i % 40), "en", f"s{i % 3}", 1) for i in range(60)]
    table += [(100 + i, table[i][1].replace("w", "W"), "en", "s1", 1) for i in range(10)]
    table += [(200 + i, table[20 + i][1] + " one more", "en", None, 1) for i in range(10)]
    table += [(300, None, "en", "s2", 1), (301, "1234 !!!", "en", "s2", 1), (302, "", None, "s0", None)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = common.documents(spark, folder)
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    steps = dict(corpus_pipeline.STAGES)

    after = common.stored(steps["language_id"](spark, docs, folder), "test")
    said = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert after.columns == columns
    assert {r.doc_id for r in after.collect()} == {d for d, r in said.items() if r.lang_pred != "und" and r.score >= 0.3} == set(before) - {300, 301, 302}

    unique = common.stored(steps["exact_dedup"](spark, after, folder), "test")
    last = {}
    for r in after.collect():
        last[ascii_lower(r.text)] = max(last.get(ascii_lower(r.text), -1), r.doc_id)
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted(last.values())

    apart = common.stored(steps["near_dedup"](spark, unique, folder), "test")
    want = {r[0] for r in near_brute([(r.doc_id, r.text) for r in unique.collect()]) if r[3]}
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == want and len(want) < unique.count()

    mixed = common.stored(steps["mix_sources"](spark, apart, folder), "test")
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect() if r.copies}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == copies

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in steps["bpe_encode"](spark, mixed, folder).collect():
        ids = tokenizer.encode(before[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    whole = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in whole.collect()) == copies
