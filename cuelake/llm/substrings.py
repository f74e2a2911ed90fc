"""Substring deduplication: passages that occur in an earlier document, found by anchors at difference-cover positions.

A difference cover of a period v is a set of residues such that any two positions i and j have an offset k < v for
which both i + k and j + k fall on the cover.  Two equal runs of 50 words therefore share an anchor that lies on the
cover in both documents, wherever they begin: it is enough to hash short windows at cover positions (6 of 31) and to
compare those.  Only around anchors that occur in several documents are whole 50-word windows compared.

1. anchors are hashed and counted by hash, combined before the shuffle; those of two or more documents remain;
2. they are written, joined back to the anchors (both sides are shuffled for the join, so Spark may split a hot key)
   and gathered per document;
3. texts of documents with such anchors extend them to every 50-word window around, a hash of 96 bits each; the
   smallest document of each window is found the same way, and joined back;
4. each text drops the words of its windows that have a smaller document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, slices, stored

WINDOW = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is one of two members
ANCHOR = WINDOW - PERIOD + 1

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)  # odd, so that they have inverses modulo 2^64
_LAST = (1 << 63) - 1  # the place of a document without id: after all others


def covers(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Words:
    """The words of some texts in one array of hashes, with windows that never leave their text."""

    def __init__(self, texts: list[str]):
        self.words = [t.encode().split() for t in texts]  # splits at U+0009 to U+000D and the blank only
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for text in self.words for w in text), np.uint64, total)

    def rows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and position in it of every window of ``width`` words."""
        counts = np.maximum(self.sizes - width + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)

    def window_hash(self, at: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
        """Polynomial hash modulo 2^64 of the windows that begin at the array positions ``at``."""
        values = self.hashes if lane == 0 else (self.hashes ^ (self.hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        base = _BASES[lane]
        power = np.full(len(values) + 1, base, dtype=np.uint64)
        power[:1] = 1
        inverse = np.full(len(values) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(power)[:-1], dtype=np.uint64)])
        return (sums[at + width] - sums[at]) * np.cumprod(inverse)[at]


def _by_place(docs: DataFrame) -> DataFrame:
    """Documents with their place in the order; ``own`` tells those without id, which share a place, apart by their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return bare(docs, doc_id=F.col("doc_id").cast("bigint"), place=F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)),
                own=F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.lit(0)), text=text)


def anchors(texts: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``place, own, pos, h``: hashes of the windows at cover positions."""
    width, residues = window - period + 1, np.array(sorted(cover))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = _Words(batch.column("text").to_pylist())
            text, pos = words.rows(width)
            on = np.isin(pos % period, residues)
            text, pos = text[on], pos[on]
            h = words.window_hash(words.begins[text] + pos, width).view(np.int64)
            place, own = (pa.array(batch.column(c).to_numpy()[text]) for c in ("place", "own"))
            yield pa.RecordBatch.from_arrays([place, own, pa.array(pos.astype(np.int32)), pa.array(h)], names=["place", "own", "pos", "h"])

    return texts.where(F.length("text") >= 2 * window - 1).select("place", "own", "text").mapInArrow(run, "place bigint, own bigint, pos int, h bigint")


def shared_anchors(found: DataFrame) -> DataFrame:
    """``place, own, marks``: of each document, the anchors that other documents have too.

    A mark is four times the position, plus 1 if an earlier document has the anchor, plus 2 if a later one has.
    """
    repeated = stored(found.groupBy("h").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi"), "repeated-anchors")
    mark = F.col("pos").cast("bigint") * 4 + (F.col("lo") < F.col("place")).cast("int") + 2 * (F.col("hi") > F.col("place")).cast("int")
    return (found.join(repeated, "h").select("place", "own", mark.alias("mark"))
            .groupBy("place", "own").agg(F.collect_set("mark").alias("marks")))  # a set: copies of a text have the same marks


def _near(marks: np.ndarray, n: int, period: int) -> np.ndarray:
    """Which of ``n`` window positions have one of the anchors inside."""
    edge = np.zeros(n + period + 1, dtype=np.int64)
    np.add.at(edge, np.clip(marks - period + 1, 0, n), 1)
    np.add.at(edge, np.minimum(marks + 1, n), -1)
    return np.cumsum(edge)[:n] > 0


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def candidates(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Every document: the result where no earlier document shares an anchor, the text and marks where any other does."""
    schema = "doc_id bigint, place bigint, own bigint, n_words bigint, kept_sha256 string, text string, marks array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, marks = batch.column("text").to_pylist(), batch.column("marks").to_pylist()
            words = [t.encode().split() for t in texts]
            later = [bool(m) and any(x & 1 for x in m) for m in marks]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("place"), batch.column("own"), pa.array([len(w) for w in words], pa.int64()),
                pa.array([None if open_ else _sha(w) for w, open_ in zip(words, later)], pa.string()),
                pa.array([t if m else None for t, m in zip(texts, marks)], pa.string()),
                pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "place", "own", "n_words", "kept_sha256", "text", "marks"])

    return texts.join(marks, ["place", "own"], "left").select("doc_id", "place", "own", "text", "marks").mapInArrow(run, schema)


def windows(held: DataFrame, window: int, period: int) -> DataFrame:
    """``w1, w2, place, own, pos, later``: the windows around shared anchors; ``later`` if an earlier document has the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            words = _Words(batch.column("text").to_pylist())
            texts, poss, laters = [], [], []
            for i, marks in enumerate(batch.column("marks")):
                n = int(words.sizes[i]) - window + 1
                if n <= 0:
                    continue
                marks = marks.values.to_numpy()
                wanted = _near(marks >> 2, n, period)
                later = _near(marks[marks & 1 == 1] >> 2, n, period)
                pos = np.flatnonzero(wanted)
                texts.append(np.full(len(pos), i))
                poss.append(pos)
                laters.append(later[pos])
            if not texts:
                continue
            text, pos = np.concatenate(texts), np.concatenate(poss)
            at = words.begins[text] + pos
            yield pa.RecordBatch.from_arrays([
                pa.array(words.window_hash(at, window).view(np.int64)), pa.array(_short(words, at, window)),
                *[pa.array(batch.column(c).to_numpy()[text]) for c in ("place", "own")], pa.array(pos.astype(np.int32)), pa.array(np.concatenate(laters))],
                names=["w1", "w2", "place", "own", "pos", "later"])

    return held.where("text is not null").select("place", "own", "text", "marks").mapInArrow(
        run, "w1 bigint, w2 int, place bigint, own bigint, pos int, later boolean")


def _short(words: _Words, at: np.ndarray, window: int) -> np.ndarray:
    return (words.window_hash(at, window, lane=1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def removed_windows(found: DataFrame) -> DataFrame:
    """``place, own, removed``: of each document, the windows that an earlier document has (position and half of the hash)."""
    least = stored(found.groupBy("w1", "w2").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").drop("hi"), "repeated-windows")
    packed = F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.col("w2").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    return (found.where("later").join(least, ["w1", "w2"]).where("lo < place").select("place", "own", packed.alias("window"))
            .groupBy("place", "own").agg(F.collect_set("window").alias("removed")))


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def _cut(held: DataFrame, removed: DataFrame, window: int, texts_too: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = _Words(batch.column("text").to_pylist())
            held = batch.column("removed")
            counts = pc.fill_null(pc.list_value_length(held), 0).to_numpy().astype(np.int64)
            packed = pc.list_flatten(held).to_numpy()
            text = np.repeat(np.arange(len(counts)), counts)
            pos, half = packed >> 32, packed.astype(np.uint32).view(np.int32)
            inside = pos <= words.sizes[text] - window  # a row of the same id may have another text
            text, pos, half = text[inside], pos[inside], half[inside]
            same = _short(words, words.begins[text] + pos, window) == half
            begins = words.begins[text[same]] + pos[same]
            edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            np.add.at(edge, begins, 1)
            np.add.at(edge, begins + window, -1)  # windows end within their text
            stays = np.cumsum(edge)[:-1] == 0
            gone_counts, shas, kept_texts = [], [], []
            for own, stay in zip(words.words, np.split(stays, words.begins[1:])):
                kept = own if stay.all() else [own[j] for j in np.flatnonzero(stay)]
                gone_counts.append(len(own) - len(kept))
                shas.append(_sha(kept))
                kept_texts.append(b" ".join(kept).decode() if texts_too else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(words.sizes), pa.array(gone_counts, pa.int64()), pa.array(shas, pa.string()),
                pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return held.join(removed, ["place", "own"], "left").select("doc_id", "text", "removed").mapInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                    texts_too: bool = False) -> DataFrame:
    """Remove each word covered by a window whose words also occur in a document with a smaller ``doc_id``.

    Words are what lies between ASCII white space, unchanged; windows are judged on the input.  Returns a row per
    input row: ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one blank) and ``kept_text``
    (null unless ``texts_too``, and null for documents that nothing was taken from).

    A null text has no words.  A document without id counts as later than all others.  Rows with the same id are not
    earlier than one another, so that repeated rows keep their words unless a smaller id has them.  Texts shorter than
    a window are kept whole; an empty table gives no rows.
    """
    if not covers(cover, period) or period > window:
        raise ValueError("not a difference cover of a period within the window")
    texts = _by_place(docs)
    marks = stored(shared_anchors(anchors(texts, window, period, cover)), "shared-anchors")
    held = stored(candidates(texts, marks), "anchored")
    removed = stored(removed_windows(windows(held, window, period)), "removed-windows")
    whole = held.where("kept_sha256 is not null").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return whole.unionByName(_cut(held.where("kept_sha256 is null").select("doc_id", "place", "own", "text"), removed, window, texts_too))
