"""Exact deduplication of arriving documents against history, by minimal perfect hashing.

History is kept as an index over its distinct digests.  A bucket of some thousand digests is one row: the bit
maps of a levelled minimal perfect hash, and for every slot the full digest, the document that won and how many
documents share the text.  An arriving digest is hashed to its one slot and compared with the digest that lies
there, byte for byte: equal bytes mean a repeat of a historical text, anything else a text that history lacks.
Nonmembers form groups of their own.

Buckets are cut by a hash of the digest, so their size does not depend on the data; repeats are counted into one
row per digest before anything is shuffled, so a text that makes up a third of all documents is one probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bare, stored

PER_BUCKET = 8192  # distinct digests in one bucket of the index, on average
ROOM = 1.5  # bits per digest still to be placed, in each level

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)  # stands for a missing document id inside the index: every id wins over it

INDEX = "bucket bigint, level_bits array<int>, bits binary, digests binary, winners binary, counts binary"
GROUPS = "digest binary, keep_id bigint, group_size bigint, repeat boolean"


def folded(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text."""
    return bare(docs, doc_id=F.col("doc_id").cast("bigint"), digest=F.unhex(F.sha2(F.encode(folded(F.col("text")), "utf-8"), 256)))


def distinct_digests(rows: DataFrame, n_buckets: int) -> DataFrame:
    """One row per digest with the largest id and the number of documents."""
    return (rows.groupBy("digest").agg(
        F.coalesce(F.max("doc_id"), F.lit(_NO_ID)).alias("winner"), F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets))))


def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest (four 64-bit words) in a level of ``size`` bits."""
    x = keys[:, level % 4] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= keys[:, (level + 1) % 4] >> np.uint64(7)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(raw: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct digests (an n by 32 array of bytes).

    In each level every digest still without a place is hashed; those that meet no other keep the bit, the rest
    go to the next level.  A digest's slot is the number of set bits before its own.
    """
    keys = np.ascontiguousarray(raw).view("<u8").reshape(-1, 4)
    sizes, bits = [], []
    while len(keys):
        size = int(len(keys) * ROOM) + 8
        spots = _spots(keys, len(sizes), size)
        alone = np.bincount(spots, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[spots]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def slots_of(raw: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has its bit.  A digest outside the index may get any slot."""
    keys = np.ascontiguousarray(raw).view("<u8").reshape(-1, 4)
    ranks = np.cumsum(bits) - 1
    slots, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _spots(keys[left], level, size)
        hit = bits[at]
        slots[left[hit]] = ranks[at[hit]]
        left, base = left[~hit], base + size
    return slots


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    raw = _raw(table["digest"])
    sizes, bits = build_hash(raw)
    order = np.empty(len(raw), dtype=np.int64)
    order[slots_of(raw, sizes, bits)] = np.arange(len(raw))
    return pa.table({
        "bucket": pa.array([key[0].as_py()], pa.int64()), "level_bits": pa.array([sizes], pa.list_(pa.int32())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "digests": pa.array([raw[order].tobytes()], pa.binary()),
        "winners": pa.array([table["winner"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
        "counts": pa.array([table["n"].to_numpy()[order].astype("<i8").tobytes()], pa.binary())})


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The index of historical documents ``(doc_id, digest)``, a row per bucket."""
    return distinct_digests(history, n_buckets).groupBy("bucket").applyInArrow(_build, INDEX)


def _merge(_: tuple, index: pa.Table, probes: pa.Table) -> pa.Table:
    """Look the probes of one bucket up; every distinct text of history and arrivals is returned once."""
    raw = _raw(probes["digest"]) if probes.num_rows else np.zeros((0, 32), dtype=np.uint8)
    last, copies = probes["winner"].to_numpy(), probes["n"].to_numpy()
    if index.num_rows:
        row = index.to_pylist()[0]
        sizes = row["level_bits"]
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], "<i8").copy(), np.frombuffer(row["counts"], "<i8").copy()
        slots = slots_of(raw, sizes, bits)
        member = slots >= 0
        member[member] = (held[slots[member]] == raw[member]).all(axis=1)
        at = slots[member]
        winners[at] = np.maximum(winners[at], last[member])
        counts[at] += copies[member]
    else:
        held, member = raw[:0], np.zeros(len(raw), dtype=bool)
        winners = counts = np.zeros(0, dtype=np.int64)
    digest = np.concatenate([held, raw[~member]])
    return pa.table({
        "digest": pa.array([d.tobytes() for d in digest], pa.binary()),
        "keep_id": pa.array(np.concatenate([winners, last[~member]]), pa.int64()),
        "group_size": pa.array(np.concatenate([counts, copies[~member]]), pa.int64()),
        "repeat": pa.array(np.concatenate([np.ones(len(held), bool), np.zeros(int((~member).sum()), bool)]))})


def lookup(index: DataFrame, arrivals: DataFrame, n_buckets: int) -> DataFrame:
    """Groups of equal texts: ``digest, keep_id, group_size, repeat``; ``repeat`` is true for texts of history."""
    probes = distinct_digests(arrivals, n_buckets)
    return index.groupBy("bucket").cogroup(probes.groupBy("bucket")).applyInArrow(_merge, GROUPS).withColumn(
        "keep_id", F.nullif("keep_id", F.lit(_NO_ID)))


def grouped(rows: DataFrame, arriving: Column | None = None) -> DataFrame:
    """Groups of equal texts among stored rows ``doc_id, digest``: those that arrive are looked up in the index of the others."""
    span = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    n_buckets = span[2] // PER_BUCKET + 1
    if arriving is None:
        arriving = F.col("doc_id") > F.lit(((span[0] or 0) + (span[1] or 0)) // 2)
    arriving = F.coalesce(arriving, F.lit(False))
    index = stored(build_index(rows.where(~arriving), n_buckets), "digest-index")
    return lookup(index, rows.where(arriving), n_buckets)


def exact_dedup(docs: DataFrame, arriving: Column | None = None) -> DataFrame:
    """Of documents equal after lower-casing A-Z, the one with the largest ``doc_id`` stays.

    ``arriving`` marks the rows that are looked up in the index of the others; by default those in the upper
    half of the id range.  Which rows are history does not change the result.

    Returns a row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.  A null text equals the empty
    text.  A null id loses against every other id; a group of null ids only has a null ``keep_id`` and keeps all its
    rows.  Rows that repeat id and text count in ``group_size`` and share their fate.  An empty table gives no rows.
    """
    rows = stored(digests(docs), "digests")
    return rows.join(grouped(rows, arriving), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns; rows that repeat id and text become one."""
    groups = grouped(stored(digests(docs), "digests")).select(F.col("digest").alias("__kept_digest"), F.col("keep_id").alias("__keep_id"))
    marked = docs.withColumn("__digest", F.unhex(F.sha2(F.encode(folded(F.col("text")), "utf-8"), 256)))
    stay = (F.col("__digest") == F.col("__kept_digest")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__keep_id"))
    return marked.join(groups, stay, "left_semi").dropDuplicates(["__digest", "doc_id"]).drop("__digest")
