"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.session import checkpoint_root

# White space that separates words: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder in the storage that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends at the files, so an executor lost later costs the rereading of its splits only.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bare(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, so that further columns of the input cannot clash with working columns."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hashed_part(key: Column, of: int = 4) -> Column:
    """crc32 of the key as decimal text, modulo ``of``: the split into folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)).cast("int")


def worker_cache() -> dict:
    """One dictionary per Python worker process, kept over its tasks.

    Functions of this package may travel by value and then get new module globals with every task; tokenizers
    and memos of pieces already encoded are worth keeping longer than that.
    """
    return sys.__dict__.setdefault("_cuelake_llm_cache", {})


def forget() -> None:
    """Give the memory of all memos back; for tasks of other operators that run in the same workers."""
    for held in worker_cache().values():
        if hasattr(held, "clear") and not isinstance(held, dict):
            held.clear()
    release()


def release() -> None:
    """Give memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # what was freed in small pieces goes back too
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts add up to ``most_bytes`` at most (or one longer text)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = [n or 0 for n in pa.compute.binary_length(batch.column(text)).to_pylist()]
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
