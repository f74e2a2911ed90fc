"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, connected components.

Documents with the same shingle set form a class, which has a number and the smallest id of its documents.  Classes,
not ids, are what is linked, since one id (or none) may stand at several texts.  They meet in the buckets of their bands.  Within a bucket no pairs are formed: its first member is compared with the others, and
verified links are joined into components.  Only buckets whose members are then in different components are looked at
again.  Their members are dealt into blocks, and each two blocks meet in one place, where all full sets are compared
at once and only a spanning forest of the links comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, forget, slices, stored

SHINGLE, SIMILARITY = 5, 75  # words; per cent
BANDS, ROWS = 32, 4  # a pair at 75 % misses all bands once in 200,000

BLOCK = 256  # members of a bucket, on average, that are compared with those of another block in one place
COLUMNS = 1 << 14  # shingles of a comparison that are laid out at once

_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1  # the place of a document without id: after all others
_SLICE = 1 << 20  # bytes of text at once: the permutations of their shingles take some sixty times that
_LAZY = 4  # steps of the permutations that are replayed before they are written out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, A-Z lower-cased.

    A text with fewer words than a shingle has one, the whole sequence; one without words has none.
    """
    words = [t.encode().lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for text in words for w in text), np.uint64, int(sizes.sum()))
    rolled = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(_BASE) + hashes[k:k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for begin, n in zip(begins.tolist(), sizes.tolist()):
        if n >= size:
            out.append(np.unique(rolled[begin:begin + n - size + 1]))
        elif n:
            whole = hashes[begin:begin + n]
            out.append(_mix(np.array([xxhash.xxh3_64_intdigest(whole.tobytes(), seed=n)], dtype=np.uint64)))
        else:
            out.append(rolled[:0])
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` values per set (all ones for an empty set).

    Each element gets a random permutation of the ``m`` places, drawn step by step, and offers in step j the value
    ``j + r`` to the place the permutation has there; a place keeps its least offer.  Since offers of later steps are
    larger than those of earlier ones, a set is finished after the step in which its last place has got a value.
    The integers here hold j in the top 8 bits and r below, so they order as ``j + r`` does.
    """
    if m > 256:
        raise ValueError("at most 256 places")
    signature = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = signature.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = np.concatenate([np.zeros(0, np.uint64), *sets])
    chosen: list[np.ndarray] = []  # k of each step so far: place j was swapped with place k
    permutation: np.ndarray | None = None
    for j in range(m):
        draw = _mix(seed + np.uint64((2 * j + 1) * _BASE % (1 << 64)))
        k = (j + _mix(seed + np.uint64((2 * j + 2) * _BASE % (1 << 64))) % np.uint64(m - j)).astype(np.int64)
        if permutation is None:
            place = k.copy()
            for t in range(j - 1, -1, -1):
                place = np.where(place == chosen[t], t, place)
            chosen.append(k)
        else:
            rows = np.arange(len(seed))
            place = permutation[rows, k].astype(np.int64)
            permutation[rows, k] = permutation[:, j]
            permutation[:, j] = place
        np.minimum.at(flat, owner * m + place, (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8)))
        open_ = (signature == np.iinfo(np.uint64).max).any(axis=1)
        stay = open_[owner]
        if not stay.any():
            break
        if not stay.all():
            owner, seed, chosen = owner[stay], seed[stay], [c[stay] for c in chosen]
            permutation = permutation[stay] if permutation is not None else None
        if permutation is None and len(chosen) >= _LAZY:
            permutation = np.tile(np.arange(m, dtype=np.uint8), (len(seed), 1))
            rows = np.arange(len(seed))
            for t, swapped in enumerate(chosen):
                held = permutation[rows, swapped].copy()
                permutation[rows, swapped] = permutation[:, t]
                permutation[:, t] = held
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band; the band's number goes into it."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_BASE), (len(signature), 1))
    for r in range(rows):
        key = _mix(key ^ parts[:, :, r]) + np.uint64(r)
    return key.view(np.int64)


def _placed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return bare(docs, doc_id=doc_id, place=F.coalesce(doc_id, F.lit(_LAST)), text=F.coalesce(F.col("text"), F.lit("")), text_key=_text_key())


def _text_key():
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _signed(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most_bytes=_SLICE):
        sets = shingle_sets(batch.column("text").to_pylist(), shingle)
        keys = band_keys(superminhash(sets, bands * rows), bands, rows)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("place"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))],
            names=["doc_id", "place", "text_key", "n_shingles", "set_key", "buckets"])


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, place, text_key, n_shingles, set_key, buckets``; ``set_key`` is 128 bits of the whole set, null if it is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        return _signed(batches, shingle, bands, rows)

    return _placed(docs).mapInArrow(run, "doc_id bigint, place bigint, text_key bigint, n_shingles bigint, set_key binary, buckets array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the classes ``node, place, text_key, set_key`` that are wanted, from the text each of them names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, most_bytes=_SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            ok = [xxhash.xxh3_128_digest(s.tobytes()) == key for s, key in zip(sets, batch.column("set_key").to_pylist())]
            node = batch.column("node").filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([node, pa.array([s.view(np.int64) for s, good in zip(sets, ok) if good], pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    texts = _placed(docs).select("place", "text_key", "text").join(wanted, ["place", "text_key"]).select("node", "set_key", "text")
    return texts.mapInArrow(run, "node bigint, shingles array<bigint>").groupBy("node").agg(F.max("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets overlap by ``similarity`` per cent of their union or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every end of an edge ``a, b``: the smallest node that can be reached.

    Large-star and small-star steps in turn (each node hands its neighbours to the smallest one) until every node hangs
    on the smallest of its component.  Only sums and joins over edges; the number of rounds grows with the logarithm.
    """
    def star(rows: DataFrame) -> DataFrame:
        """Rows ``u, v``; all v of a u and u itself are tied to the least of them."""
        least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return rows.join(least, "u")

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = star(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        said = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = said


def _forest(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """For each of some sets, the first one that it can reach over links of ``similarity`` per cent or more."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[number] > 1
    columns = np.cumsum(count > 1) - 1
    owner, number = owner[shared], columns[number[shared]]
    common = np.zeros((n, n))
    for begin in range(0, int(number.max(initial=-1)) + 1, COLUMNS):
        inside = (number >= begin) & (number < begin + COLUMNS)
        has = np.zeros((n, COLUMNS), dtype=np.float32)
        has[owner[inside], number[inside] - begin] = 1
        common += has @ has.T
    linked = 100 * common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        if (least == label).all():
            return label
        label = least


def block_links(rows: DataFrame, similarity: int) -> DataFrame:
    """Links ``a, b`` among the sets of each ``bucket, low, high`` of the rows ``..., node, shingles``.

    Rows are dealt out by that key and sorted, and pass by as a stream; a task holds the sets of two blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, nodes, sets = None, [], []

        def found() -> pa.RecordBatch:
            label = _forest(sets, similarity)
            at = np.flatnonzero(label != np.arange(len(label)))
            node = np.array(nodes, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[label[at]]), pa.array(node[at])], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "low", "high")]))
            lists, ids = batch.column("shingles"), batch.column("node").to_pylist()
            for i, k in enumerate(keys):
                if k != key:
                    if len(nodes) > 1:
                        yield found()
                    key, nodes, sets = k, [], []
                nodes.append(ids[i])
                sets.append(lists[i].values.to_numpy())
        if len(nodes) > 1:
            yield found()

    dealt = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, classes: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """``node, component`` of the classes ``node, place, text_key, n_shingles, set_key, buckets`` that are linked to others."""
    filed = classes.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    # Bands often gather the same classes: of buckets with equal members one is enough.
    mark = F.xxhash64(F.col("node"), F.lit(7))
    shared = (filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                          F.bit_xor(mark).alias("y"), F.sum(mark.cast("decimal(38,0)")).alias("z")).where("n > 1")
              .groupBy("n", "first", "x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "first"))
    members = stored(filed.join(shared, "bucket"), "buckets")
    wanted = classes.select("node", "place", "text_key", "set_key").join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(full_sets(docs, wanted, shingle), "shingle-sets")

    first = members.where("node = first").select("bucket", F.col("n_shingles").alias("n_first"))
    near = (100 * F.least("n_shingles", "n_first") >= similarity * F.greatest("n_shingles", "n_first"))
    pairs = members.where("node <> first").join(first, "bucket").where(near).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    edges = stored(verified(pairs, sets, similarity), "links")
    labelled = members.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("size")).where("lo < hi and size > 2")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    open_ = members.join(split.select("bucket"), "bucket", "left_semi").select(
        "bucket", "node", block.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = open_.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node").join(sets, "node")
    more = stored(block_links(met, similarity), "links")
    return components(edges.unionByName(more))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key``: groups of documents linked by shingle sets that overlap by 75 % or more.

    ``component_id`` is the smallest id that can be reached over links, and the document with that id is kept.

    A null text, or one without words, has no shingles, is linked with nothing and kept.  A null id counts as larger
    than all others; a group of null ids only has a null ``component_id`` and keeps all its rows.  Rows that
    repeat an id and a text share their fate.  Texts of one id, or of none, are linked each for itself: what one of
    them is linked with does not touch the others.  ``text_key`` (a hash of the text) tells them apart.  An empty
    table gives no rows.
    """
    found = stored(signatures(docs, shingle, bands, rows), "signatures")
    classes = found.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("place").alias("place"), F.first("n_shingles").alias("n_shingles"))
    # The text and buckets of a class are those of any of its members; taken from one that has its smallest place.
    standing = found.where("n_shingles > 0").select("place", "text_key", "set_key", "buckets").join(
        classes, ["place", "set_key"]).dropDuplicates(["set_key"])
    standing = stored(standing.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = stored(links(docs, standing, shingle, similarity), "labels")
    roots = labels.join(standing.select("node", "place"), "node").groupBy("component").agg(F.min("place").alias("least"))
    named = standing.select("set_key", "node", "place").join(labels.join(roots, "component").select("node", "least"), "node", "left").select(
        "set_key", F.coalesce("least", "place").alias("component"))
    return found.join(named, "set_key", "left").withColumn("component", F.coalesce("component", "place")).select(
        "doc_id", "n_shingles", F.nullif("component", F.lit(_LAST)).alias("component_id"), (F.col("place") == F.col("component")).alias("kept"), "text_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns: of each group the one with the smallest id."""
    gone = near_dedup(docs).where(~F.col("kept")).select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("__gone"), F.col("text_key").alias("__gone_key")).distinct()
    same = (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)) == F.col("__gone")) & (_text_key() == F.col("__gone_key"))
    return docs.join(gone, same, "left_anti")
