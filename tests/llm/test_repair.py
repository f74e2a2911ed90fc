"""Conversation repair against a plain search over (row, state) that compares whole audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache
from itertools import product

import pytest

from cuelake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, block string, dropped string, costs string, final string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            out.append((conv, None))
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, (turn, role, text))] * (2 if draw == 3 else 1)
    return out


def best_edits(rows):
    """(cost, audit, repaired) of one conversation by memoised search."""
    seen, flags = set(), []
    for _, role, text in rows:
        stripped = text.strip(SPACE)
        flags.append("b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def go(i, q, inserted):
        found = []
        if i == len(rows) and q in ("", "a"):
            found.append((0, "", ()))
        nxt = "a" if q == "u" else "u"
        name = {"u": "user", "a": "assistant"}[nxt]
        if inserted < 3:
            c, a, r = go(i, nxt, inserted + 1)
            found.append((c + 3, "I" + a, (f"{name}:",) + r))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = go(i + 1, q, 0)
            found.append((c + 4, "D" + a, r))
            if flags[i] not in ("b", "d"):
                extra = 3 * (flags[i] == "t")
                if role[:1] in step[q]:
                    c, a, r = go(i + 1, step[q][role[:1]], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}",) + r))
                c, a, r = go(i + 1, nxt, 0)
                found.append((c + 3 + extra, "R" + a, (f"{name}:{text}",) + r))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for q in ("", "s", "u", "a"):
            go(i, q, 0)
    cost, audit, lines = go(0, "", 0)
    return flags, cost, audit, "\n".join(lines)


def brute(table):
    convs = defaultdict(list)
    for conv, row in damaged(table):
        convs[conv] += [row] if row else []
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        flags, cost, audit, text = best_edits(rows)
        turns = {r[0] for r in rows} - {None}
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, flags.count("b"), flags.count("d"), flags.count("t"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)
    return out


def talk(seed, conv, n, roles=("user", "assistant", "system", "usr", "tool", "", None, "Assistant")):
    r = random.Random(seed)
    out = []
    for t in range(n):
        usual = ["user", "assistant"][t % 2]
        turn = r.choice([t, t, t, t, t + 1, None]) if r.random() < 0.3 else t
        out.append((conv, turn, usual if r.random() < 0.7 else r.choice(roles),
                    r.choice(["Yes.", f"No {t}", f"what {t}?", f"fine {t}.", f"done {t}!  \n", "", " \t", None, "ends\x0b", f"é {t}。"]) if r.random() < 0.6 else f"Well {t}."))
    return out


def run(spark, table, parts=3, **kwargs):
    rows = [(*row, "c", "c", "c", "c") for row in table]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = repair.repair(repair.damaged(df), texts_too=True, **kwargs).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def order_is_plain(table):
    """Rows of one turn whose texts differ before the 64th character go by role and text, as in the brute force."""
    return all(len(t or "") < 64 for *_, t in table)


@pytest.fixture(scope="module")
def table():
    out = [row for c in range(400) for row in talk(c, c, random.Random(c).randrange(1, 9))]
    out += [(900 + i, t, "user", "x.") for i, t in enumerate(range(40))]  # some have all rows dropped
    out += talk(7, None, 12) + talk(8, -5, 30) + [(3000, None, "user", "a."), (3000, None, None, None), (3001, 5, "assistant", "b."), (3001, 9, "system", "c.")]
    return out


def test_against_search(spark, table):
    assert order_is_plain(table)
    assert run(spark, table) == brute(table)


@pytest.mark.parametrize(("rows", "size"), [(1, 1 << 18), (3, 1 << 18), (7, 40)])
def test_conversations_over_many_blocks(spark, rows, size):
    """A conversation with most of the rows, in blocks of few rows or bytes; repeats lie in other blocks."""
    table = talk(1, 1, 400) + [row for c in range(2, 60) for row in talk(c, c, 5)] + talk(99, None, 60)
    assert run(spark, table, block_rows=rows, block_bytes=size) == brute(table)


def test_long_conversation_one_block(spark):
    table = talk(21, 1, 300)
    assert run(spark, table) == brute(table)


def test_all_short_role_strings(spark):
    """Every sequence of up to four of five kinds of rows."""
    kinds = [("system", "S."), ("user", "U."), ("assistant", "A."), ("other", "O."), ("user", "cut")]
    table, conv = [], 0
    for n in range(1, 5):
        for chosen in product(kinds, repeat=n):
            table += [(conv, t, role, f"{t} {text}") for t, (role, text) in enumerate(chosen)]
            conv += 1
    assert run(spark, table) == brute(table)


def test_repeated_rows_and_very_long_text(spark):
    long = "word " * 200_000
    table = [(1, 1, "user", "same.")] * 50 + [(1, 2, "assistant", long + ".")] + [(2, None, "user", long)] * 3
    got = run(spark, table)
    want = brute(table)
    assert got == want


def test_empty(spark):
    assert run(spark, []) == {}
