"""SHA-256 of files of any size, read in chunks.

A hash goes through its file from front to end, so a file is one task row; files are dealt to tasks by size.  The few
that are large against a task's share are placed one by one, each on the task that has least so far; all others go by a
hash of their paths.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once, and bytes that a task should have.
CHUNK, TASK_BYTES = 1 << 20, 1 << 30
#: Stores that Arrow reads; files of others are read by Spark as whole values, of 2 GB at most.
ARROW_STORES = {"file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss"}


def sha256_of(uri: str, chunk: int = CHUNK) -> str:
    """The hash of one file, named as Spark names it; no more than a chunk of it is held."""
    from pyarrow import fs

    if uri.startswith(("/", "file:")):
        store, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    digest = hashlib.sha256()
    with store.open_input_stream(path, buffer_size=0) as stream:
        while data := stream.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def dealt(files: DataFrame, task_bytes: int = TASK_BYTES, most_tasks: int = 10_000) -> DataFrame:
    """``files`` (path, length) over tasks of about equal bytes: a column ``task`` as well."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = int(max(1, min(n, -(-total // task_bytes), most_tasks)))
    large = files.where(F.col("length") * tasks * 4 > total).select("path", "length").collect()  # less than 4 a task
    heap = [(0, t) for t in range(tasks)]
    place = []
    for r in sorted(large, key=lambda r: (-r.length, r.path)):
        load, t = heapq.heappop(heap)
        place.append((r.path, t))
        heapq.heappush(heap, (load + r.length, t))
    placed = files.sparkSession.createDataFrame(place, "path string, own int")
    by_hash = F.pmod(F.xxhash64("path"), F.lit(tasks)).cast("int")
    out = files.join(F.broadcast(placed), "path", "left").withColumn("task", F.coalesce("own", by_hash)).drop("own")
    return out.repartitionById(tasks, F.col("task"))


def file_hashes(spark: SparkSession, path: str, chunk: int = CHUNK, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, length, sha256) of each file below a path; empty files are left out, as Spark's scans do."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() not in ARROW_STORES:
        return found.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("path"), row.column("length"), pa.array([sha256_of(row.column("path")[0].as_py(), chunk)])], names=["path", "length", "sha256"])

    # the content's column is not read
    return dealt(found.select("path", "length"), task_bytes).select("path", "length").mapInArrow(run, "path string, length long, sha256 string")
