"""Partners of scans against counting all pairs."""

import random
from collections import Counter

import pytest

from cuelake.operators import chunking


def brute(scans, keys, fan=3):
    seq = {name: s for s, name, generated in scans if not generated}
    held = {}
    for name, key in set(keys):
        if name in seq:
            held.setdefault(seq[name], set()).add(key)
    out = []
    for later, mine in held.items():
        found = sorted(((-len(mine & theirs), -e) for e, theirs in held.items() if e < later and mine & theirs))[:fan]
        out += [(later, -e, -n, i) for i, (n, e) in enumerate(found, 1)]
    return sorted(out)


def case(seed, n=160, n_keys=90):
    """A key that all have, keys that many have, keys that few have, scans without keys, generated ones."""
    r = random.Random(seed)
    weights = [1 / (1 + k) for k in range(n_keys)]
    scans = [(i, f"s{i}", r.random() < 0.2) for i in range(n)]
    keys = [(name, f"k{k}") for _, name, _ in scans for k in r.choices(range(n_keys), weights, k=r.randrange(0, 12))]
    keys += [(name, "all") for _, name, _ in scans if r.random() < 0.9] + [("s1", "k3"), ("unknown", "k1")]
    return scans, keys


@pytest.mark.parametrize(("seed", "rare", "groups"), [(1, 64, 1 << 10), (2, 8, 1 << 10), (3, 2, 40), (4, 1, 25)])
def test_partners(spark, monkeypatch, seed, rare, groups):
    monkeypatch.setattr(chunking, "GROUP_LATER", groups)
    monkeypatch.setattr(chunking, "GROUP_EARLIER", groups)
    monkeypatch.setattr(chunking, "KEYS_AT_ONCE", 7)
    scans, keys = case(seed)
    got = chunking.pair_overlap(spark.createDataFrame(scans, "seq BIGINT, name STRING, generated BOOLEAN"),
                                spark.createDataFrame(keys, "name STRING, key STRING").repartition(3), rare=rare)
    assert sorted(tuple(r) for r in got.select("later", "earlier", "overlap", "nth").collect()) == brute(scans, keys)


def test_one_key_of_many(spark):
    """3,000 scans under one key: three partners each, found in cells."""
    scans = [(i, f"s{i}", False) for i in range(3000)]
    got = chunking.pair_overlap(spark.createDataFrame(scans, "seq BIGINT, name STRING, generated BOOLEAN"),
                                spark.createDataFrame([(f"s{i}", "k") for i in range(3000)], "name STRING, key STRING")).collect()
    assert Counter(r.nth for r in got) == {1: 2999, 2: 2998, 3: 2997}
    assert all(r.earlier == r.later - r.nth and r.overlap == 1 for r in got)


def test_words_are_shuffled_as_one_row_a_video(spark, monkeypatch):
    """The keys of the scans are made once, and scans of ordinary number go to them instead of meeting them by name."""
    from cuelake.operators import chunking
    from cuelake.plans import worklist
    seen = []
    monkeypatch.setattr(chunking, "pair_overlap", lambda scans, keys: seen.append(keys) or keys)
    worklist.pair_overlap_words(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and plan.count("regexp_extract_all") == 1
    assert "Exchange hashpartitioning(name" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_lists_of_keys_are_packed(spark):
    """Ten thousand frequent keys in order take little more than a byte each on their way to a cell, and come back whole."""
    from cuelake.operators.chunking import _by_key, _packed
    lists = [list(range(3 * i, 30000, 3)) for i in range(2)]
    rows = spark.createDataFrame([(x,) for x in lists], "often ARRAY<BIGINT>").select(_packed("often").alias("often")).toPandas()
    assert rows["often"].map(len).max() < 2 * 10000
    flat, owner = _by_key(rows["often"])
    assert sorted(zip(flat.tolist(), owner.tolist())) == sorted((k, i) for i, x in enumerate(lists) for k in x)
