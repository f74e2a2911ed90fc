"""Pattern structure and catalogue growth: small cases of our own."""

import pytest
from hypothesis import given, settings, strategies as st

from cuelake.functions import patterns as P
from cuelake.operators import catalog

SAME = [
    ("a|b", "b|a"), ("a|a|b", "a|b"), ("(?:a|b)", "a|b"), ("(a|(b|c))", "c|b|a"), ("[Cc]at", "(?i:cat)"), ("(?i)Cat", "(?i:cAT)"),
    ("[abc]x", "[ca-b]x"), ("[a-cb]", "[abc]"), ("[\\d_a]", "[a_\\d]"), ("[^ba]", "[^ab]"), ("[\\-a]", "[a-]"),
]
DIFFERENT = [
    ("cat", "(?i:cat)"), ("[Cc]at", "cat"), ("a|b", "a|b|c"), ("(a)\\1|b", "b|(a)\\1"), ("a||b", "b||a"), ("[é]a", "[ée]a"),
    ("[z-a]", "[a-z]"), ("[[:alpha:]]", "[[:alph:a]]"), ("[ab]", "[^ab]"), ("\\(a|b", "(a|b"),
]


def key(pattern):
    _, found = P.branches(pattern)
    return pattern if found is None else "|".join(sorted({b.key for b in found}))


@pytest.mark.parametrize("a, b", SAME)
def test_same_meaning(a, b):
    assert key(a) == key(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_meaning(a, b):
    assert key(a) != key(b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abX[]()|\\-^?:i", min_size=1, max_size=12), min_size=1, max_size=3))
def test_structure_never_fails_and_loses_nothing(parts):
    pattern = "|".join(parts)
    assert "".join(P.units(pattern)) == pattern
    assert "|".join(P.top_branches(pattern)) == pattern
    P.branches(pattern)
    P.export_branches(pattern)


def test_unwrap_and_groups():
    assert P.unwrap("(?i:(a|b))") == ("a|b", True)
    assert P.unwrap("(a)(b)") == ("(a)(b)", False)
    assert P.capture_count("(a)(?:b)(?<n>c)(?i:d)\\([(]") == 2
    assert P.export_branches(r"(\{a:})|(x\{a:}\{b:})|\{a:}|(?:\{a:})|[|]") == [
        (r"(\{a:})", "a"), (r"(x\{a:}\{b:})", None), (r"\{a:}", None), (r"(?:\{a:})", None), ("[|]", None)]


def catalogue(spark, rows):
    return spark.createDataFrame([(i, n, f) for i, (n, f) in enumerate(rows)], "seq INT, name STRING, fragments ARRAY<STRING>")


def test_expansion_depth_and_taint(spark):
    t = catalogue(spark, [("a", ["x"]), ("b", [r"\{a:}", "y"]), ("c", [r"\{b:}|\{a:}"]), ("d", [r"\{c:}\{z:}"]), ("e", [r"\{f:}"]),
                          ("f", [r"\{e:}"]), ("g", [r"\{e:}"]), ("h", [r"\{not a ref}"])])
    got = {r.name: r.pattern for r in catalog.expand_topics(t).collect()}
    assert got == {"a": "x", "b": "(?:x)y", "c": "(?:(?:x)y)|(?:x)", "d": None, "e": None, "f": None, "g": None, "h": r"\{not a ref}"}


def test_adoption_order_and_numbers(spark):
    known = catalog.expand_topics(catalogue(spark, [("search1", ["old"]), ("search3", ["older"])]))
    incoming = spark.createDataFrame([(0, "a|b"), (1, "b|a"), (2, "old"), (3, " edge"), (4, "c"), (5, r"\{x:}"), (6, "d"), (7, "e")],
                                     "seq INT, pattern STRING")
    got = {r.seq: r.name for r in catalog.adopt(incoming, known).collect()}
    assert got == {0: "search2", 4: "search4", 6: "search5", 7: "search6"}


def test_novel_branches_replay_sequentially(spark):
    incoming = [(0, "a|b"), (1, "b|c|old"), (2, "c| d"), (3, "(?i:A|B)"), (4, "a"), (5, "(q)\\1"), (6, "x|x|y"), (7, " d|e")]
    covered = {"old"}
    want = {}
    for seq, pattern in incoming:  # one after the other, the plain way
        folds, found = P.branches(pattern)
        found = [P.Branch(pattern, pattern)] if found is None else found
        fresh = []
        for b in found:
            if b.key not in covered and b.key not in [f.key for f in fresh]:
                fresh.append(b)
        body = "|".join(b.text for b in fresh)
        rebuilt = f"(?i:{body})" if folds else body
        if body and rebuilt == rebuilt.strip(" \t"):
            covered |= {b.key for b in fresh}
            want[seq] = rebuilt
    df = spark.createDataFrame(incoming, "seq INT, pattern STRING")
    keys = spark.createDataFrame([("old",)], "key STRING")
    assert {r.seq: r.rebuilt for r in catalog.adopt_novel(df, keys).collect()} == want


def test_extend_and_cover(spark):
    t = catalogue(spark, [("term1", ["(?i:a|b)"]), ("term2", ["c"]), ("term3", ["p", "q"]), ("term4", ["(?i:b|z)"])])
    covered = catalog.corpus_keys(catalog.expand_topics(t))
    requests = spark.createDataFrame([(0, "term1", "(?i:B|n)"), (1, "term2", "(?i:m)"), (2, "term3", "r"), (3, "term2", "c")],
                                     "seq INT, name STRING, pattern STRING")
    assert {r.name: r.grown for r in catalog.extend(requests, t, covered).collect()} == {"term1": "(?i:a|b|n)"}
    incoming = spark.createDataFrame([(0, "(?i:b|x)"), (1, "(?i:b|z)"), (2, "none")], "seq INT, pattern STRING")
    got = {r.seq: r.owner for r in catalog.cover_of(incoming, catalog.expand_topics(t), "term").collect()}
    assert got == {0: "term1", 1: "term4"}


@pytest.mark.parametrize(("text", "shown"), [
    ("[abc]x", "[a-c]x"), ("[cab]", "[a-c]"), ("[ab]", "[ab]"), ("[a-cx]", "[a-cx]"), ("[-a]", "[\\-a]"), ("[+--]", "[+-\\-]"), ("[\\da]", "[a\\d]"), ("[^b-a]", "[^b-a]"),
    ("[^ba]", "[^ab]"), ("[a\\]]", "[\\]a]"), ("[0-46-9]", "[0-46-9]"), ("[z-a]", "[z-a]"), ("[\\x41]", "[\\x41]"), ("x[[:alpha:]]y", "x[[:alpha:]]y")])
def test_classes_are_shown_as_runs(text, shown):
    assert P.branch_key(text, False) == shown
