"""URL filters: the automaton against regular expressions, the verdicts against the rules read one by one."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import urls
from cuelake.llm.urls import GlobRule, SiteRule


def as_regex(glob):
    out = ""
    for part in re.findall(r"\*+|\?|[^*?]+", glob):
        out += ".*" if part.startswith("**") else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part)
    return re.compile(out, re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/.*?é", max_size=12), min_size=1, max_size=40), st.lists(st.text("ab/.é\n😀", max_size=40), max_size=20))
def test_automaton_is_the_regular_expression(globs, texts):
    found = urls.Automaton([urls.tokens(g) for g in globs]).match(texts)
    assert found.tolist() == [[as_regex(g).fullmatch(t) is not None for g in globs] for t in texts]


def test_states_cross_words():
    long = "x" * 200
    found = urls.Automaton([urls.tokens(long), urls.tokens(long + "**"), urls.tokens("**" + long)]).match([long, long + "y", "y" + long, ""])
    assert found.tolist() == [[True, True, True], [False, True, False], [False, False, True], [False] * 3]


def judged(url, sites, globs):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(raw):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
    fit = [r for r in sites if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        rule = min(fit, key=lambda r: (-len(r.name), r.action != "block", r.name))
        return host, path, rule.name, None, rule.action
    for g in globs:
        if as_regex(g.glob).fullmatch(host + path):
            return host, path, None, g.glob, g.action
    return host, path, None, None, "allow"


ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.NET", "http://a.net/", "http://A.B.Example.NET/en/x", "http://example.net/en", "http://xnet/",
       "http://a.org/x.net/y", "http://a.org/fr/", "http://a.org?u=http://b.net/", "http://u@b.net:80/", "http://É.NET/ä", "x://y://z.net/", "http://.net/",
       "http://example.com/de/?q#f", "http://my-casino.example.com/a", "http://my-casino.example.com", "http://a.com/casino", "http://a.com/" + "p" * 50_000,
       "http://b.net/" + "q/" * 20_000, "http://c.com/\nx", "http://d.com#/net/", "http://a.net/"]


def run(spark, texts, **kwargs):
    schema = "page_id long, url string, host string, path string, rule string, verdict string, glob string"
    table = spark.createDataFrame([(i, t, "c", "c", "c", "c", "c") for i, t in enumerate(texts)], schema)
    return {r.page_id: tuple(r)[1:] for r in urls.url_filter(table, **kwargs).collect()}


def test_verdicts(spark):
    r = random.Random(5)
    hosts = ["net", "a.net", "example.net", "b.example.net", "example.com", "x.example.com", "org", "q.org", "spam-farm.com", "Casino.de"]
    texts = ODD + [f"http://{r.choice(hosts)}{r.choice(['/', '/en/', '/de/', '/fr/x', '', '/EN/'])}{r.choice(['', '?a=/b', '#x', 'y'])}" for _ in range(300)]
    assert run(spark, texts) == {i: judged(t, urls.SITE_RULES, urls.GLOB_RULES) for i, t in enumerate(texts)}


def test_many_rules_in_packs_and_ties(spark):
    sites = [SiteRule("allow" if i % 2 else "block", f"h{i}.example.org", f"/{'d' * (i % 7)}") for i in range(300)]
    sites += [SiteRule("allow", "x.net", "/"), SiteRule("block", "net", "/ab")]  # equally long
    globs = [GlobRule("block", f"**/secret{i}?/**") for i in range(200)]
    texts = [f"http://h{i}.example.org/{'d' * (i % 9)}/secret{i}z/q" for i in range(0, 330)] + ["http://x.net/abc", "http://q.com/secret7/", "http://q.com/secret7x/"]
    assert run(spark, texts, sites=sites, globs=globs) == {i: judged(t, sites, globs) for i, t in enumerate(texts)}


def test_empty_and_oversized(spark):
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        urls.url_filter(spark.createDataFrame([], "page_id long, url string"), globs=[GlobRule("block", "x" * (urls.MOST_STATES + 1))])
