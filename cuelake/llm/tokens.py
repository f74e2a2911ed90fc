"""Token operators: counts, encoding with decoding, and token files."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import bpe
from cuelake.llm.common import bare, forget, fresh_path, release, slices, worker_cache

LIMIT = 2048  # tokens of a context
END_ID = 0  # closes each document in a token file


def _texts(docs: DataFrame) -> DataFrame:
    return bare(docs, doc_id=F.col("doc_id").cast("bigint"), text=F.coalesce(F.col("text"), F.lit("")))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each whole text, by merging ranks in step over arrays.

    A null text counts as empty: 0 bytes, 0 tokens.  Special strings inside a text are one token each, as in the
    library.  Repeated rows are counted each; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.word_bpe(path)
        memo = bpe.memo_for("rank counts", path, lambda: words.filler(bpe.RankMerger(words), len, sum, "rank counts"))
        for batch in slices(batches):
            pieces = bpe.word_pieces(batch.column("text"), words)
            counts = pieces.sums(np.array(memo.get(pieces.distinct), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def encode_decode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """The ids of each whole text by tree concatenation, and what they decode to.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``ids`` and ``decoded`` themselves where asked
    for.  The digests are over the ids as little-endian unsigned 32-bit integers and over the decoded text in UTF-8.

    A null text counts as empty and has no ids; it decodes to the empty string.  The ids of a text are as the
    library gives them, special strings included.  Repeated rows are treated alike; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, all_ids, sizes, shown in _coded(batches, path):
            ends = np.cumsum(sizes)
            columns = {
                "doc_id": doc_id, "n_tokens": pa.array(sizes),
                "ids_sha256": pa.array([hashlib.sha256(all_ids[b - n:b]).hexdigest() for b, n in zip(ends, sizes)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in shown], pa.string())}
            if ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(all_ids.astype(np.int32)))
            if decoded:
                columns["decoded"] = pa.array([x.decode() for x in shown], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _texts(docs).mapInArrow(run, schema + ", ids array<int>" * ids + ", decoded string" * decoded)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """Ids of all texts in one array, how many each has, and the text they decode to.

    The memos hold ids alone: an id decodes to the same bytes wherever it stands, so decoded texts are put together per document.
    """
    words = bpe.word_bpe(path)
    most = bpe.TREE_MEMO
    memo = bpe.memo_for("tree ids", path, lambda: words.filler(bpe.TreeEncoder(words), np.ndarray.tobytes, b"".join, "tree ids", most), most)
    table = words.decoded
    release()
    for batch in slices(batches, most_bytes=1 << 20):
        pieces = bpe.word_pieces(batch.column("text"), words)
        ids, sizes = pieces.joined(memo.get(pieces.distinct))
        decoded = [b" ".join([table[i] for i in run.tolist()]) for run in np.split(ids, np.cumsum(sizes)[:-1])]
        yield batch.column("doc_id"), ids, sizes, decoded


# Token files

# Parquet settings of a token file.  Token lists are dictionary-encoded (a vocabulary of 16 bits fits one dictionary
# page), ids and offsets delta-encoded; small row groups and pages with page indexes let a reader of a few
# documents, or of the metadata columns, skip the rest.
FILE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false", "parquet.dictionary.page.size": str(1 << 20),
}
FILE_SCHEMA = "shard int, doc_id bigint, offset bigint, n_tokens int, tokens array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order: ``path/tokens`` and the index ``path/shards``.

    Each of the ``shards`` files holds a range of ids, ordered inside.  A row is a document: its tokens with
    ``end_id`` behind, their number and its offset in the shard.  The index has a row per shard with the number of
    tokens in the shards before it, so that a document's place in the whole is the sum of two numbers.

    A null text counts as empty (the end id alone).  Null ids come first; rows with equal ids stand side by side, in
    the order of their texts.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, offset = TaskContext.get().partitionId(), 0
        encoder = worker_cache().setdefault(("spaced", tokenizer), None) or bpe.SpacedEncoder(bpe.tokenizer_at(tokenizer))
        worker_cache()["spaced", tokenizer] = encoder
        for batch in slices(batches, most_bytes=6 << 20):
            ids, sizes = encoder.encode(batch.column("text"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            ends = np.cumsum(sizes)
            values = pa.array(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(sizes), shard, dtype=np.int32)), batch.column("doc_id"), pa.array(offset + ends - sizes),
                pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)],
                names=["shard", "doc_id", "offset", "n_tokens", "tokens"])
            offset += int(ends[-1])

    rows = _texts(docs)
    shards = shards or max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    by_id = F.col("doc_id").asc_nulls_first()
    ranges = rows.repartitionByRange(shards, by_id, F.substring("text", 1, 32))  # rows of one id, or without, fill several ranges
    ordered = ranges.sortWithinPartitions(by_id, "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**FILE_OPTIONS).parquet(f"{path}/tokens")
    per = read_token_files(spark, path, indexed=False).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    before = F.sum("n_tokens").over(_by_shard())
    per.select("shard", "n_docs", "n_tokens", F.coalesce(before, F.lit(0)).cast("bigint").alias("shard_start")).write.parquet(f"{path}/shards")


def _by_shard():
    """Over one row per file, whatever the number of documents."""
    from pyspark.sql import Window
    return Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)


def read_token_files(spark, path: str, indexed: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` from token files; unused columns and skipped row groups are not read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/tokens")
    if not indexed:
        return rows
    index = spark.read.schema("shard int, n_docs bigint, n_tokens bigint, shard_start bigint").parquet(f"{path}/shards")
    return rows.join(index.select("shard", "shard_start"), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "tokens")


def token_file_report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write token files and report from them ``doc_id, start, n_tokens, ids_crc32``, the checksum over all of a document's ids."""
    path = path or fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            tokens = batch.column("tokens")
            ends = tokens.offsets.to_numpy()
            values = tokens.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    read = read_token_files(docs.sparkSession, path)
    return read.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
