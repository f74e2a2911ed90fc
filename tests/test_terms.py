"""Consolidation of terms against a walk that lets the entries join the catalogue one by one."""

import random

import pytest

from cuelake.functions import patterns
from cuelake.operators import replies

TOPICS = [
    (0, "hand", ["(?i:a|b)"]), (1, "term1", ["(?i:c|d)"]), (2, "term2", ["(?i:d|e|f)"]), (3, "term4", ["(?i:g", "|h)"]), (4, "term9", ["i|j"]),
    (5, "part", ["(?i:k)"]), (6, "term10", [r"(?i:l|\{part:})"]), (7, "termite", ["(?i:m)"]), (8, "term11", ["(?i:n|d)"])]
EXPANDED = {name: "".join(fragments).replace(r"\{part:}", "(?:(?i:k))") for _, name, fragments in TOPICS}


def stem(name):
    return name.startswith("term") and name[4:].isdigit()


def walk(entries, topics=TOPICS):
    """``entries``: (term, kind, gloss, spellings) in order."""
    keys = {n: {b.key for b in patterns.branches(EXPANDED[n])[1]} for _, n, _ in topics}
    texts = {n: "".join(f) for _, n, f in topics}
    grows = {n: len(f) == 1 and "\\{" not in f[0] and patterns.branches(EXPANDED[n])[0] for _, n, f in topics}
    index, info = {}, {}
    for term, kind, gloss, spellings in entries:
        mine = {}
        for s in spellings:
            mine.setdefault(patterns.FOLD_TAG + s.lower(), s)
        covered = set().union(*keys.values())
        novel = {k: s for k, s in mine.items() if k not in covered}
        f = term.lower()
        if f in index:
            name = index[f]
            info[name] = (info[name][0], info[name][1] or kind, info[name][2] or gloss)
            if novel and grows[name]:
                keys[name] |= set(novel)
                texts[name] = f"(?i:{patterns.unwrap(texts[name])[0]}|{'|'.join(novel.values())})"
            continue
        if novel:
            n = 1
            while f"term{n}" in keys:
                n += 1
            name = f"term{n}"
            keys[name], texts[name], grows[name] = set(novel), "(?i:" + "|".join(novel.values()) + ")", True
        else:
            counts = [(-len(keys[n] & set(mine)), i, n) for i, n in enumerate(keys) if stem(n) and keys[n] & set(mine)]
            name = min(counts)[2] if counts else None
            if name is None or name in info:
                continue
        info[name], index[f] = (term, kind, gloss), name
    old = {n for _, n, _ in topics}
    return sorted((n, *info[n], texts[n], n in old) for n in info)


def consolidated(spark, entries, parts=3):
    rows = [(i, i % 3, term, kind, "", gloss, list(s)) for i, (term, kind, gloss, s) in enumerate(entries)]
    df = spark.createDataFrame(rows, "seq long, block_no int, term string, kind string, means string, gloss string, kept array<string>").repartition(parts)
    topics = spark.createDataFrame(TOPICS, "seq int, name string, fragments array<string>")
    return sorted(tuple(r) for r in replies.consolidate_terms(df, topics, ["seq", "block_no"]).collect())


@pytest.mark.parametrize("seed", range(4))
def test_random_entries(spark, seed):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwx" if seed % 2 else "abcdefghklmn"
    entries = [(r.choice("TtUuVWXYZQRS") + r.choice("01"), r.choice(["", "kind", "Other"]), f"gloss {i}",
                [r.choice([str.upper, str])(r.choice(letters)) for _ in range(r.randrange(1, 4))]) for i in range(60)]
    assert consolidated(spark, entries) == walk(entries)


def test_attachment_and_growth(spark):
    """A covered term attaches to the widest topic, grows it, and what it grew counts for the next one."""
    entries = [("A", "", "one", ["d"]), ("a", "k", "two", ["new", "d"]), ("B", "k", "three", ["new", "e", "f"]), ("C", "", "four", ["new"]),
               ("D", "", "five", ["g", "h"]), ("D", "x", "six", ["staysfree"]), ("E", "", "seven", ["staysfree"]), ("F", "", "eight", ["a"])]
    got = consolidated(spark, entries)
    assert got == walk(entries)
    assert [(r[0], r[1], r[4]) for r in got if r[5]] == [("term1", "A", "(?i:c|d|new)"), ("term2", "B", "(?i:d|e|f)"), ("term4", "D", "(?i:g|h)")]


def test_chain_of_dependence(spark):
    """Each attachment decides the next one."""
    entries = [("A", "", "g", ["d", "n"]), ("B", "", "g", ["d"]), ("C", "", "g", ["d", "e"]), ("D", "", "g", ["d"]), ("E", "", "g", ["c", "d", "e"])]
    assert consolidated(spark, entries) == walk(entries)


def test_no_entries(spark):
    assert consolidated(spark, []) == []
