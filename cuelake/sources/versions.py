"""Files that come again: new and changed ones are read, broken ones set aside and tried again.

A version of a file is its (path, length, time).  What was read is on record; a run reads the versions that are not, writes
their cues and the broken ones to two places under names of their own, and puts the good ones on record last.  A run that
dies before that leaves folders that nobody refers to, and the next one reads the same files again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelake import schemas
from cuelake.session import cut
from cuelake.sources.srt import decode_text, quarantine_split, srt_scan

MOST_FILES = 10_000  # of one slice; their paths are all that the driver sees

_FILE = "file STRUCT<name: STRING, path: STRING, length: BIGINT, modified: TIMESTAMP>"
_SINKS = {"versions": f"{_FILE}, batch STRING", "quarantine": f"{_FILE}, reason STRING, batch STRING",
          "cues": f"{_FILE}, cue_no INT, start_ms BIGINT, end_ms BIGINT, text STRING, line STRING, batch STRING"}


def _read(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """What lies in a sink; nothing before the first run.  Readers write nothing: a writer beside them would lose its files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{sink}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _SINKS[sink])
    return spark.read.schema(_SINKS[sink]).parquet(f"{root}/{sink}")


def _version(name: Column | None) -> Column:
    return F.struct((F.col("path") if name is None else name).alias("name"), "path", "length", F.col("modificationTime").alias("modified")).alias("file")


@contextmanager
def _many_small_files(spark: SparkSession) -> Iterator[None]:
    """Files are listed by a few tasks per core, and packed by what they hold.

    Else Spark lists in up to 10,000 tasks each time, and counts every file as 4 MiB, so that a task reads a handful.
    """
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
              "spark.sql.files.openCostInBytes": str(64 << 10)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def ingest_changes(spark: SparkSession, folder: str, root: str, glob: str = "*.srt", name: Column | None = None, most_files: int = MOST_FILES) -> int:
    """Read what is new or changed under ``folder`` into ``root``; returns how many versions were looked at.

    ``name`` tells what a file is called (its path, if not given); a newer version of a name replaces the older one.
    """
    with _many_small_files(spark):
        return _ingest_changes(spark, folder, root, glob, name, most_files)


def _ingest_changes(spark: SparkSession, folder: str, root: str, glob: str, name: Column | None, most_files: int) -> int:
    source = spark.read.format("binaryFile").schema(schemas.BINARY_FILE).option("pathGlobFilter", glob)
    listed = source.option("recursiveFileLookup", "true").load(folder).select(_version(name))
    todo = cut(listed.join(_read(spark, root, "versions").select("file"), "file", "left_anti"))
    n = todo.count()
    slices = -(-n // most_files)
    for i in range(slices):
        part = todo.where(F.pmod(F.xxhash64("file.path"), F.lit(slices)) == i)
        paths = [r.path for r in part.select("file.path").collect()]
        if not paths:
            continue
        batch = uuid4().hex
        held = lambda paths: decode_text(source.load(paths).select(_version(name), "content"))
        srt_scan(held(paths), "file").write.parquet(f"{root}/cues/batch={batch}")
        good = cut(spark.read.schema(_FILE).parquet(f"{root}/cues/batch={batch}").distinct())
        # Only files that gave no cue are read once more, to say why.
        rest = [r.path for r in part.join(good, "file", "left_anti").select("file.path").collect()]
        if rest:
            quarantine_split(held(rest), "file").write.parquet(f"{root}/quarantine/batch={batch}")
        good.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/versions")
    return n


def _newest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("file.name").agg(F.max_by(F.struct("file", "batch"), F.struct("file.modified", "file.path", "batch")).alias("v")).select("v.*")


def ingested(spark: SparkSession, root: str) -> DataFrame:
    """Cues of the newest good version of each file: (file, cue_no, start_ms, end_ms, text, line)."""
    return _read(spark, root, "cues").join(_newest(_read(spark, root, "versions")), ["file", "batch"]).drop("batch")


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """Broken versions that no good version has followed: (file, reason)."""
    newest = _newest(_read(spark, root, "versions")).select(F.col("file.name").alias("name"), F.col("file.modified").alias("since"))
    broken = _read(spark, root, "quarantine").select("file", "reason").distinct().withColumn("name", F.col("file.name"))
    return broken.join(newest, "name", "left").where("since is null or since < file.modified").select("file", "reason")


def watch(spark: SparkSession, folder: str, root: str, every: str = "1 minute", **options) -> StreamingQuery:
    """Run ``ingest_changes`` again and again, as a stream whose rows are the ticks of a clock."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.trigger(processingTime=every).option("checkpointLocation", f"{root}/clock")
            .foreachBatch(lambda batch, epoch: ingest_changes(batch.sparkSession, folder, root, **options)).start())
