"""URL filters: every rule is simulated at once over each canonical URL by a bit-parallel wildcard automaton.

A rule is a chain of states, one bit each, and all rules lie behind one another in a few 64-bit words (Shift-And).
Reading a character moves every active state one bit up where the next token of its rule takes the character, and
keeps a state that stands on a wildcard which takes it.  One step of a batch of URLs is a handful of array operations,
however many rules there are; a URL leaves the batch when no state is left that could still change.

Globs: ``?`` is one character but ``/``, ``*`` any run without ``/``, ``**`` any run.  A site rule (host, path) fits the
host and its subdomains where the path begins with the rule's: two globs, ``host/path**`` and ``*.host/path**``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PACK = 32  # words of an automaton; more rules are simulated pack by pack
MOST_STATES = 1 << 20  # of all rules together; every task holds them
_IDLE = 16  # characters between two looks for URLs that are decided


@dataclass(frozen=True)
class SiteRule:
    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    action: str
    glob: str


SITE_RULES = (SiteRule("block", "net"), SiteRule("allow", "example.net", "/en/"), SiteRule("block", "example.com", "/de/"), SiteRule("allow", "org", "/fr/"))
# Words of host names that no page is taken from, where no site rule says otherwise.
GLOB_RULES = tuple(GlobRule("block", f"*{word}**") for word in ("casino", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track"))

_ANY, _IN_LABEL = "any", "no slash"  # classes beside single characters


def tokens(glob: str) -> list[tuple[str, bool]]:
    """(class or character, does it repeat) of a glob."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out.append((_ANY if run > 1 else _IN_LABEL, True))
            i += run
        else:
            out.append((_IN_LABEL if glob[i] == "?" else glob[i], False))
            i += 1
    return out


def _site_tokens(rule: SiteRule) -> list[list[tuple[str, bool]]]:
    literal = [(c, False) for c in rule.name]
    return [[*literal, (_ANY, True)], [(_IN_LABEL, True), (".", False), *literal, (_ANY, True)]]


class Automaton:
    """Patterns packed into words; ``match`` tells for each text which of them take the whole of it."""

    def __init__(self, patterns: Sequence[list[tuple[str, bool]]]):
        literals = sorted({c for p in patterns for c, _ in p if c not in (_ANY, _IN_LABEL)} | {"/"})
        self.alphabet = np.array([ord(c) for c in literals], dtype=np.uint32)
        symbols = ["", *literals]  # the first stands for every other character
        starts, moves, stays, self.accepts = [], [], [], []
        n = 0
        for pattern in patterns:
            starts.append(n)
            for kind, repeats in pattern:
                if repeats:
                    stays.append((n, kind))
                else:
                    n += 1
                    moves.append((n, kind))
            self.accepts.append(n)
            n += 1
        self.words = -(-n // 64)

        def mask(bits: Sequence[int]) -> np.ndarray:
            on = np.zeros(self.words * 64, dtype=np.uint8)
            on[list(bits)] = 1
            return np.packbits(on, bitorder="little").view("<u8")

        def takes(kind: str, symbol: str) -> bool:
            return kind == _ANY or (symbol != "/" if kind == _IN_LABEL else kind == symbol)

        self.start = mask(starts)
        self.move = np.stack([mask([b for b, kind in moves if takes(kind, s)]) for s in symbols])
        self.stay = np.stack([mask([b for b, kind in stays if takes(kind, s)]) for s in symbols])
        # An accepting state under ``**`` stays whatever comes; it decides nothing any more.
        self.open = ~mask([b for b, kind in stays if kind == _ANY and b in set(self.accepts)])

    def match(self, texts: list[str]) -> np.ndarray:
        """Texts x patterns, boolean."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes
        symbols = np.where(known, at + 1, 0)
        begins = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(texts), 1))
        live = np.arange(len(texts))
        low = np.uint64(63)
        for p in range(int(lengths[0]) if len(lengths) else 0):
            live = live[:np.searchsorted(-lengths[live], -p, side="left")]  # texts that have a character here
            if p % _IDLE == 0:
                live = live[(state[live] & self.open).any(axis=1)]
            if not len(live):
                break
            now, symbol = state[live], symbols[begins[live] + p]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> low
            state[live] = (moved & self.move[symbol]) | (now & self.stay[symbol])
        accepts = np.array(self.accepts)
        found = np.empty((len(texts), len(accepts)), dtype=bool)
        found[order] = (state[:, accepts // 64] >> (accepts % 64).astype(np.uint64)) & np.uint64(1) == 1
        return found


def _packs(patterns: list[list[tuple[str, bool]]]) -> list[list[int]]:
    """The numbers of the patterns of each pack."""
    packs, size = [], 0
    for i, p in enumerate(patterns):
        states = 1 + sum(not repeats for _, repeats in p)
        if not packs or size + states > PACK * 64:
            packs.append([])
            size = 0
        packs[-1].append(i)
        size += states
    return packs


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_filter(pages: DataFrame, sites: Sequence[SiteRule] = SITE_RULES, globs: Sequence[GlobRule] = GLOB_RULES,
               otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, glob, verdict`` of every page.

    ``rule`` is the longest site rule (host and path) that fits, of equally long ones a block before an allow, then the
    least name; it decides.  Where none fits, the first of ``globs`` that takes host and path together decides and is
    named in ``glob``; else the verdict is ``otherwise``.  A null url, or one without ``://``, has an empty host and
    path, which site rules never fit.  Rows are judged each for itself; an empty table gives no rows.
    """
    ranked = sorted(sites, key=lambda r: (-len(r.name), r.action != "block", r.name))
    rules = [*ranked, *globs]
    patterns, owner = [], []
    for i, rule in enumerate(rules):
        for p in _site_tokens(rule) if isinstance(rule, SiteRule) else [tokens(rule.glob)]:
            patterns.append(p)
            owner.append(i)
    if sum(1 + len(p) for p in patterns) > MOST_STATES:
        raise ValueError(f"rules of more than {MOST_STATES} states; deal them out over several calls")
    packs = [([owner[i] for i in pack], [patterns[i] for i in pack]) for pack in _packs(patterns)]
    names = [rule.name if isinstance(rule, SiteRule) else None for rule in rules] + [None]
    texts = [rule.glob if isinstance(rule, GlobRule) else None for rule in rules] + [None]
    actions = [rule.action for rule in rules] + [otherwise]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(np.array(owners), Automaton(held)) for owners, held in packs]
        for batch in slices(batches, text="path"):
            urls = [h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            best = np.full(len(urls), len(rules))
            for owners, automaton in automata:
                found = automaton.match(urls)
                first = found.argmax(axis=1)  # rules lie in the order of their precedence
                best = np.minimum(best, np.where(found.any(axis=1), owners[first], len(rules)))
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("host"), batch.column("path"),
                *[pa.array([held[i] for i in best.tolist()], pa.string()) for held in (names, texts, actions)]],
                names=["page_id", "host", "path", "rule", "glob", "verdict"])

    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    rows = bare(pages, page_id=F.col("page_id").cast("bigint"), host=host, path=path)
    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, glob string, verdict string")
