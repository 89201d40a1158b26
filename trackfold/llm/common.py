"""Session, storage and Arrow helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 3 << 19


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most some megabytes, so that texts of any length need little memory on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so that any store Spark knows will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a local one is made, but only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trackfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/trackfold-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (a string) has about ``limit`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each of the given stretches, one stretch after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def to_arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given columns in the order and types of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key that at least one in HOT rows hold is dealt over as many copies of its table row.
HOT = 256


def spread_join(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` left join ``table``, which has each key once; no task gets all rows of a common key.

    Both have the column ``key`` without nulls; ``counted`` (key, n) are the rows of each key, if they are known.  At most HOT keys are common, so these alone are broadcast; their rows
    go by salts, of which there are HOT, and their table rows once to each salt.
    """
    n = unused(rows, "__n")
    counts = rows.groupBy(key).agg(F.count("*").alias(n)) if counted is None else counted.select(key, F.col("n").alias(n))
    total = rows.count() if counted is None else counts.agg(F.sum(n)).first()[0] or 0
    often = F.broadcast(saved(counts.where(F.col(n) * HOT > total).select(key), "hot").withColumn(n, F.lit(True)))  # less than HOT keys
    salt = unused(rows, "__salt")
    dealt = rows.join(often, key, "left").withColumn(salt, F.when(F.col(n), F.pmod(F.monotonically_increasing_id(), F.lit(HOT))).otherwise(F.lit(0))).drop(n)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(n), F.lit(HOT - 1)).otherwise(F.lit(0)).cast("long")))
    return dealt.join(table.join(often, key, "left").withColumn(salt, copies).drop(n), [key, salt], "left").drop(salt)
