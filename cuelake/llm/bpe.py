"""Pieces of text that tokenize on their own, and three ways to turn them into ids.

A tokenizer's pre-tokens never reach over certain places in a text, so the ids of a text are the ids of its pieces
in order.  Word frequencies fall off steeply; each Python worker keeps the results of the pieces it has met, and only
new pieces reach an encoder.  Which encoder that is makes the difference between the operators: the library as it
is (`SpacedEncoder`), halves that are encoded apart and joined (`tree_encode`), or whole batches of pre-tokens merged
in step (`merge_ranks`).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

from cuelake.llm.common import worker_cache

MEMO = 200_000  # pieces that a worker remembers; the memo starts anew beyond that
LEAF = 64  # bytes of an unsplit run that are encoded in one go
TREE_MEMO = 120_000  # as many of them, and of their pre-tokens, with ids
RUN = 100  # pieces that the library encodes in one call
WINDOW = 4  # tokens on each side of a join that are encoded again at first

# Characters on whose class (letter, number, white space, none) and lower case every Unicode version agrees, and
# which normalisation leaves alone.  A text with any other character is split by the library itself.
_PLAIN = "\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧€"
_UNSURE = regex.compile(f"[^{_PLAIN}]")
UNSURE = f"[^{_PLAIN}]"
# Where a blank stands beside other white space, the pre-tokens of white space reach over it.
UNSURE_SPACED = f"[^{_PLAIN}]|[\t\n\r ] | [\t\n\r]"


def plain(text: str) -> bool:
    return _UNSURE.search(text) is None


def tokenizer_at(path: str) -> Tokenizer:
    """The library's tokenizer, loaded once per worker, without truncation and padding."""
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cache["tokenizer", path] = tokenizer
    return cache["tokenizer", path]


class Memo:
    """Results by piece; ``fill`` computes those of new pieces in one call.

    Two generations are kept: when the younger one is full it becomes the elder, and an elder piece that is met again
    moves back.  Frequent pieces stay, pieces that came once leave, and memory has a bound.
    """

    def __init__(self, fill: Callable[[list], list], most: int = MEMO):
        self.fill, self.most, self.young, self.old = fill, most, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def get(self, pieces: list) -> list:
        """The result of each of the (distinct) pieces."""
        young, old = self.young, self.old
        found = [young.get(p) for p in pieces]
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i in missing:
                found[i] = old.get(pieces[i])
            new = [i for i in missing if found[i] is None]
            for i, x in zip(new, self.fill([pieces[i] for i in new])):
                found[i] = x
            if len(young) + len(missing) > self.most:
                self.old, self.young = young, {}
            self.young.update((pieces[i], found[i]) for i in missing)
        return found


def memo_for(name: str, path: str, fill: Callable[[], Callable[[list], list]], most: int = MEMO) -> Memo:
    """The worker's memo of that name; like every memo in the cache it is emptied by ``forget``."""
    cache = worker_cache()
    if (name, path) not in cache:
        cache[name, path] = Memo(fill(), most)
    return cache[name, path]


class Pieces:
    """The pieces of some texts as numbers into a list of distinct pieces, and where each text begins.

    Plain texts are cut and numbered by Arrow; ``cut`` gives the pieces of any other text.
    """

    def __init__(self, texts: pa.Array, unsure: str, split: Callable[[pa.Array], pa.ListArray], cut: Callable[[str], list]):
        odd = pc.match_substring_regex(texts, unsure).to_numpy(zero_copy_only=False)
        lists = split(pc.if_else(pa.array(odd), "", texts))
        coded = lists.flatten().dictionary_encode()
        self.distinct: list = coded.dictionary.to_pylist()
        numbers, counts = coded.indices.to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        more: dict = {}

        def number(piece: object) -> int:
            return more.setdefault(piece, len(self.distinct) + len(more))

        if odd.any():
            parts = np.split(numbers, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array([number(p) for p in cut(texts[i].as_py())], dtype=np.int32)
                counts[i] = len(parts[i])
            numbers = np.concatenate(parts)
        self.distinct += more
        self.numbers, self.counts = numbers, counts
        self.ends = np.cumsum(counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a number per distinct piece over each text."""
        upto = np.concatenate([[0], np.cumsum(values[self.numbers])])
        return upto[self.ends] - upto[self.ends - self.counts]

    def joined(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        values = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = sizes[self.numbers]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(starts[self.numbers] - before, lengths) + np.arange(int(lengths.sum()))
        return values[at], self.sums(sizes)


# Byte-level text with white space kept (byte_bpe)

PIECES = 1_500_000  # pieces that a worker remembers, of about 40 bytes each
LONGEST = 64  # bytes of a piece that is remembered


_OF_BYTE, _BASE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)


_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([b < 128 and not chr(b).isalnum() and b != 32 for b in range(256)])


def _ends_letter(data: np.ndarray) -> np.ndarray:
    """Bytes that end a letter of ASCII, or of U+00C0 to U+017F (all letters but the signs of multiplication and division)."""
    out = _ASCII_LETTER[data]
    lead, last = data[:-1], data[1:]
    out[1:] |= (lead >= 0xC3) & (lead <= 0xC5) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    return out


class SpacedEncoder:
    """The tokenizers library over texts, with the ids of pieces met before kept in arrays.

    A text is cut in front of each blank, and where a letter is followed by a mark or a line's end; no byte-level pre-token
    reaches over the one edge if the blank stands alone, and over the other at all.
    Pieces are told apart by two 64-bit hashes, made for all of a slice at once; the ids of a remembered piece are a
    stretch of one array, so that a slice's ids are gathered without a loop.  Only new pieces reach the library, a
    hundred as one text: a piece begins with its blank and ends in another character, so no pre-token reaches from one
    into the next, and the ids are dealt back by the bytes that each token stands for.

    Texts with other white space beside a blank, with unsure characters or special strings are encoded whole and not remembered, nor are
    pieces of more than ``LONGEST`` bytes.  Beyond ``most`` pieces the half used longest ago is dropped.
    """

    def __init__(self, tokenizer: Tokenizer, most: int = PIECES):
        self.tokenizer, self.most = tokenizer, most
        vocab = tokenizer.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)  # one character per byte
        self.added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.now = np.zeros(0, "<u4"), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), "<u4", int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        odd = pc.match_substring_regex(texts, UNSURE_SPACED).to_numpy(zero_copy_only=False)
        for special in self.added:
            odd = odd | pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        ids, sizes = self._plain(texts.filter(pa.array(~odd)))
        if not odd.any():
            return ids, sizes
        odd_ids, odd_sizes = self._library(texts.filter(pa.array(odd)).to_pylist())
        all_sizes = np.zeros(len(texts), np.int64)
        all_sizes[~odd], all_sizes[odd] = sizes, odd_sizes
        out, is_odd = np.empty(len(ids) + len(odd_ids), "<u4"), np.repeat(odd, all_sizes)
        out[~is_odd], out[is_odd] = ids, odd_ids
        return out, all_sizes

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two sums over the bytes of each piece, the second over terms whose bits are mixed once more."""
        powers = np.full(int(lengths.max()), _BASE, np.uint64)
        powers[0] = 1
        terms = _OF_BYTE[data]
        terms *= np.cumprod(powers)[np.arange(len(data)) - np.repeat(starts, lengths)]
        first = np.add.reduceat(terms, starts) + lengths.astype(np.uint64)
        terms ^= terms >> np.uint64(29)
        return first, np.add.reduceat(terms, starts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2].to_pybytes()[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else b""
        if not raw:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        edges = offsets.astype(np.int64) - offsets[0]
        at_edge = data == 32
        at_edge[1:] |= _ends_letter(data)[:-1] & _MARK[data[1:]]
        at_edge[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(at_edge)
        lengths = np.diff(np.append(starts, len(data)))
        hashes, checks = self._hashes(data, starts, lengths)
        keys, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks[first][number] != checks).any():  # two pieces of one hash: about never
            return self._library(texts.to_pylist())
        start, size, pool = self._known(raw, keys, checks[first], starts[first], lengths[first])
        counts = size[number]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(start[number] - upto[:-1], counts) + np.arange(int(upto[-1]))]
        per_text = np.searchsorted(starts, edges)  # pieces in front of each text
        return ids, np.diff(upto[per_text])

    def _known(self, raw: bytes, keys: np.ndarray, checks: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct piece stand in the returned pool; new pieces are encoded and remembered."""
        self.now += 1
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        same = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        hit = same & (self.checks[near] == checks) if len(self.keys) else same
        self.used[near[hit]] = self.now
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[hit], size[hit] = self.starts[near[hit]], self.sizes[near[hit]]
        new = np.flatnonzero(~hit)
        ids, sizes = self._pieces([raw[b:b + n].decode() for b, n in zip(begin[new].tolist(), length[new].tolist())])
        start[new], size[new] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([self.ids, ids])
        kept = new[(length[new] <= LONGEST) & ~same[new]]
        self.ids = pool
        for name, values in (("checks", checks), ("starts", start), ("sizes", size), ("used", np.full(len(keys), self.now)), ("keys", keys)):
            setattr(self, name, np.insert(getattr(self, name), at[kept], values[kept]))
        if len(self.keys) > self.most or len(self.ids) > 8 * self.most:
            self._shrink()
        return start, size, pool

    def _shrink(self) -> None:
        n = min(len(self.keys), self.most // 2)
        stay = np.sort(np.argsort(-self.used, kind="stable")[:n])
        self.keys, self.checks, self.starts, self.sizes, self.used = (x[stay] for x in (self.keys, self.checks, self.starts, self.sizes, self.used))
        upto = np.cumsum(self.sizes)
        self.ids = self.ids[np.repeat(self.starts - (upto - self.sizes), self.sizes) + np.arange(int(upto[-1]) if n else 0)]
        self.starts = upto - self.sizes

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([len(p) > 1 and p[0] == " " and not p[-1].isspace() for p in pieces], dtype=bool)
        runs = [p for p, ok in zip(pieces, plain.tolist()) if ok]
        ids, _ = self._library(["".join(runs[i:i + RUN]) for i in range(0, len(runs), RUN)])
        ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(p.encode()) for p in runs])) + 1 if runs else np.zeros(0, np.int64)
        rest_ids, rest_sizes = self._library([p for p, ok in zip(pieces, plain.tolist()) if not ok])
        sizes = np.zeros(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = np.diff(np.append(0, ends)), rest_sizes
        out, is_plain = np.empty(len(ids) + len(rest_ids), "<u4"), np.repeat(plain, sizes)
        out[is_plain], out[~is_plain] = ids, rest_ids
        return out, sizes


def word_pieces(texts: pa.Array, words: WordBpe) -> Pieces:
    """Stretches between white space of plain texts; pre-tokens (bytes) and special ids of any other text."""
    return Pieces(texts, UNSURE, pc.ascii_split_whitespace, words.parts)


# Word-end BPE (word_bpe)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """The parts of a word-end BPE file: pre-tokens, symbols, merges, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.path, self.tokenizer = path, tokenizer_at(path)
        self.vocab, self.end = said["model"]["vocab"], said["model"]["end_of_word_suffix"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.symbols = _byte_symbols()
        self.bytes_of = {s: b for b, s in enumerate(self.symbols)}
        split = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre_tokens = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def parts(self, text: str) -> list:
        """Pre-tokens as bytes and special strings as their ids, in order."""
        if plain(text):
            sections = self.cut.split(text) if "<|" in text else [text]
            found = []
            for section in sections:
                if section in self.special:
                    found.append(self.special[section])
                else:
                    found += [p.encode() for p in self.pre_tokens.findall(section.lower())]
            return found
        found = []
        for section in self.cut.split(text):
            if section in self.special:
                found.append(self.special[section])
            elif section:
                normal = self.tokenizer.normalizer.normalize_str(section)
                found += [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    @cached_property
    def decoded(self) -> list[bytes]:
        """What the library's decode shows of each id; the file names no decoder, so it joins these with blanks."""
        if self.tokenizer.decoder is not None:
            raise ValueError("a decoder may show tokens in another way when they stand together")
        shown = [b""] * (max(i for i in self.tokenizer.get_vocab().values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            shown[i] = token.encode()
        return shown

    def shown(self, run: bytes) -> str:
        return "".join(map(self.symbols.__getitem__, run))

    def filler(self, encode: Callable[[list[bytes]], list[np.ndarray]], result: Callable[[np.ndarray], object],
               combine: Callable[[list], object], name: str | None = None, most: int = MEMO) -> Callable[[list], list]:
        """Fill for a memo over pieces: new pre-tokens are encoded together, and pieces put together from them.

        Pre-tokens are remembered too, under ``name`` in the worker's cache, where ``forget`` finds them.
        """
        def values(parts: list) -> list:
            runs = [x for x in parts if isinstance(x, bytes)]
            ids = iter(encode(runs))
            return [result(next(ids) if isinstance(x, bytes) else np.array([x], "<u4")) for x in parts]

        known = Memo(values) if name is None else memo_for(f"{name}, pre-tokens", self.path, lambda: values, most)

        def fill(pieces: list) -> list:
            parts = [self.parts(p) if isinstance(p, str) else [p] for p in pieces]
            distinct = list({x for found in parts for x in found})
            value = dict(zip(distinct, known.get(distinct)))
            return [value[found[0]] if len(found) == 1 else combine([value[x] for x in found]) for found in parts]
        return fill


def word_bpe(path: str) -> WordBpe:
    cache = worker_cache()
    if ("word_bpe", path) not in cache:
        cache["word_bpe", path] = WordBpe(path)
    return cache["word_bpe", path]


class TreeEncoder:
    """Encodes unsplit runs by halves.

    A long run is halved until its parts are short; all leaves of all runs are encoded together.  On the way up, the
    tokens around each join are encoded again, over a window that doubles until its first token is the one
    the left side has there and its last token the one the right side has there.  Every two neighbours of the joined
    sequence then are neighbours in an encoding, which makes it the encoding of the whole.
    """

    def __init__(self, words: WordBpe, leaf: int = LEAF, window: int = WINDOW):
        self.words, self.leaf, self.window = words, leaf, window
        # Inside a run no symbol carries the word end; at its end the last one does.
        self.inner = Tokenizer(models.BPE(vocab=words.vocab, merges=words.merges))
        self.final = Tokenizer(models.BPE(vocab=words.vocab, merges=words.merges, end_of_word_suffix=words.end))
        self.final.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # no symbol is white space: it parts runs given together
        lengths = {s: 1 for s in words.symbols} | {s + words.end: 1 for s in words.symbols}
        for a, b in words.merges:
            lengths[a + b] = lengths[a] + lengths[b]
        self.length = np.zeros(max(words.vocab.values()) + 1, dtype=np.int64)
        for token, n in lengths.items():
            self.length[words.vocab[token]] = n

    def _batch(self, jobs: list[tuple[bytes, bool]]) -> list[list[int]]:
        """Ids of pieces; the flag says whether a piece ends its run."""
        out: list = [None] * len(jobs)
        inside, ends = [], []
        for i, (_, last) in enumerate(jobs):
            (ends if last else inside).append(i)
        if inside:
            for i, e in zip(inside, self.inner.encode_batch_fast([self.words.shown(jobs[i][0]) for i in inside], add_special_tokens=False)):
                out[i] = e.ids
        if ends:
            shown = [self.words.shown(jobs[i][0]) for i in ends]
            encoded = self.final.encode_batch_fast([" ".join(shown[i:i + RUN]) for i in range(0, len(shown), RUN)], add_special_tokens=False)
            ids = [x for e in encoded for x in e.ids]
            cuts = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(jobs[i][0]) for i in ends])) + 1
            begin = 0
            for i, end in zip(ends, cuts.tolist()):
                out[i], begin = ids[begin:end], end
        return out

    def __call__(self, runs: list[bytes]) -> list[np.ndarray]:
        levels = []  # per run: its parts, halved as often as its length asks for
        for run in runs:
            depth = max(0, (len(run) - 1).bit_length() - (self.leaf - 1).bit_length())
            edges = [len(run) * i >> depth for i in range((1 << depth) + 1)]
            levels.append([(run[a:b], b == len(run)) for a, b in zip(edges, edges[1:])])
        flat = self._batch([part for parts in levels for part in parts])
        ids, at = [], 0
        for parts in levels:
            ids.append([(part, last, flat[at + i]) for i, (part, last) in enumerate(parts)])
            at += len(parts)
        while any(len(parts) > 1 for parts in ids):
            pairs = [(r, i, parts[i], parts[i + 1]) for r, parts in enumerate(ids) for i in range(0, len(parts) - 1, 2)]
            joined = self._join([(left, right) for _, _, left, right in pairs])
            above: list[list] = [[] if len(parts) > 1 else parts for parts in ids]
            for (r, _, left, right), tokens in zip(pairs, joined):
                above[r].append((left[0] + right[0], right[1], tokens))
            ids = above
        return [np.array(parts[0][2], dtype="<u4") for parts in ids]

    def _join(self, pairs: list) -> list[list[int]]:
        out: list = [None] * len(pairs)
        open_, k = list(range(len(pairs))), self.window
        while open_:
            jobs = []
            for i in open_:
                (left, _, a), (right, last, b) = pairs[i]
                before, after = int(self.length[a[-k:]].sum()), int(self.length[b[:k]].sum())
                jobs.append((left[len(left) - before:] + right[:after], last and k >= len(b)))
            still = []
            for i, tokens in zip(open_, self._batch(jobs)):
                a, b = pairs[i][0][2], pairs[i][1][2]
                if (k >= len(a) or tokens[0] == a[-k]) and (k >= len(b) or tokens[-1] == b[k - 1]):
                    out[i] = a[:-k] + tokens + b[k:]
                else:
                    still.append(i)
            open_, k = still, 2 * k
        return out


_NEVER = np.iinfo(np.int64).max


class RankMerger:
    """Applies merges to many runs at once.

    All runs lie in one ragged array of symbols.  In each step every run takes its own lowest-ranking pair and joins
    all its occurrences, from the left where they overlap; ranks are looked up anew next to a join only.  Runs
    without a pair to join leave the array.  A join never makes a pair of lower rank than its own (checked when
    the merges are loaded), so that joining all occurrences in one step is what joining them one by one gives.
    """

    def __init__(self, words: WordBpe):
        vocab = words.vocab
        self.first = np.array([vocab[s] for s in words.symbols], dtype=np.int64)
        self.last = np.array([vocab[s + words.end] for s in words.symbols], dtype=np.int64)
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(words.merges):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("a merge precedes one that it builds on")
            made.setdefault(a + b, rank)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in words.merges], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.into = np.array([vocab[a + b] for a, b in words.merges], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NEVER)

    def __call__(self, runs: list[bytes]) -> list[np.ndarray]:
        out: list = [np.zeros(0, dtype="<u4")] * len(runs)
        owner = np.array([i for i, run in enumerate(runs) if run], dtype=np.int64)
        if not len(owner):
            return out
        sizes = np.array([len(runs[i]) for i in owner], dtype=np.int64)
        raw = np.frombuffer(b"".join(runs[i] for i in owner), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.first[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        ranks = np.full(len(symbols), _NEVER, dtype=np.int64)  # of the pair that begins at each symbol
        ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
        ranks[ends - 1] = _NEVER
        while len(owner):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            least = np.minimum.reduceat(ranks, starts)
            done = least == _NEVER
            if done.any():
                for i, a, n in zip(owner[done], starts[done], sizes[done]):
                    out[i] = symbols[a:a + n].astype("<u4")
                stay = np.repeat(~done, sizes)
                symbols, ranks = symbols[stay], ranks[stay]
                owner, sizes, least = owner[~done], sizes[~done], least[~done]
                continue
            chosen = ranks == np.repeat(least, sizes)
            # Neighbouring choices overlap (a pair of equal symbols): every second one of such a row counts.
            at = np.flatnonzero(chosen)
            begins = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self.into[ranks[at]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            ends_run = np.zeros(len(symbols), dtype=bool)
            ends_run[np.cumsum(sizes) - 1] = True
            ends_run[at] |= ends_run[at + 1]
            gone = np.add.reduceat((~stay).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            new_at = at - np.searchsorted(at, at)  # each earlier join has moved the symbol one to the left
            symbols, ranks, ends_run, sizes = symbols[stay], ranks[stay], ends_run[stay], sizes - gone
            touched = np.unique(np.concatenate([new_at, new_at[new_at > 0] - 1]))
            inner = touched[~ends_run[touched]]
            ranks[touched] = _NEVER
            ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        return out
