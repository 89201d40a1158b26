"""JSON lines read strictly: a line that is no object, or a blank one where blanks are refused, stops the query with its place.

A place is a file and the byte where the line begins.  Spark reads files in splits; lines of a split come in order, so a
line's place is that of its split's first line and the bytes of the lines between.  Where a split's first line begins
follows from the bytes of the splits before it, which one cheap pass adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import saved

_PLACED = "file string, split long, behind long, value string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path (or a pattern), in any store that Spark's file systems reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _behind_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes between the first line of a split and each line of it."""
    before, at = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        # a split is named by its file's number in this batch and its own begin
        file, split = batch.column("file").dictionary_encode(), batch.column("split").to_numpy()
        number = file.indices.to_numpy()
        size = pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        new = np.ones(len(size), bool)
        new[1:] = (number[1:] != number[:-1]) | (split[1:] != split[:-1])
        run = np.cumsum(size) - size
        first = np.flatnonzero(new)
        here = (file.dictionary[number[0]].as_py(), int(split[0]))
        base = np.repeat(run[first], np.diff(np.append(first, len(size))))
        behind = run - base
        if here == before:
            behind[: first[1] if len(first) > 1 else len(size)] += at
        before, at = (file.dictionary[number[-1]].as_py(), int(split[-1])), int(behind[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(behind), batch.column("value")], names=["file", "split", "behind", "value"])


def _placed(text: DataFrame) -> DataFrame:
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value").mapInArrow(_behind_split, _PLACED)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, value): every line, blank ones too, with the byte of its file where it begins."""
    # other line ends than a newline stay in the value, so that bytes add up
    text = spark.read.option("lineSep", "\n").text(path)
    splits = text.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")).agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    begins = saved(splits.withColumn("begin", F.sum("bytes").over(Window.partitionBy("file").orderBy("split")) - F.col("bytes")).drop("bytes"))
    return _placed(text).join(begins, ["file", "split"]).select("file", (F.col("begin") + F.col("behind")).alias("offset"), "value")


def _checked(rows: DataFrame, schema: str, blanks: bool, place: Column) -> DataFrame:
    parsed = F.from_json("value", f"{schema}, `__bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    blank = F.trim(F.translate("value", "\t\r\n\f\v", "     ")) == ""
    kept = rows if blanks else rows.where(~blank)
    kept = kept.withColumn("__row", parsed)
    wrong = F.when(blank, "blank line").when(F.col("__row").isNull() | F.col("__row")["__bad"].isNotNull() | ~F.ltrim("value").startswith("{"), "no JSON object")
    # the check is a filter, so that no choice of columns can leave it out
    stop = F.raise_error(F.concat(wrong, F.lit(" at "), place))
    return kept.where(F.when(wrong.isNull(), True).otherwise(stop.cast("boolean"))).select("__row.*").drop("__bad")


def strict_rows(spark: SparkSession, path: str, schema: str, blanks: bool = False, must_exist: bool = False) -> DataFrame:
    """Rows of JSON lines; the first line that is no object stops the query with its file and byte.

    Blank lines are left out, or stop the query too (``blanks``: they are judged as all others).  An absent path is an
    empty table, or raises FileNotFoundError (``must_exist``).
    """
    if not exists(spark, path):
        if must_exist:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    place = F.concat("file", F.lit(", byte "), F.col("offset").cast("string"))
    return _checked(lines(spark, path), schema, blanks, place)


def strict_stream(spark: SparkSession, path: str, schema: str, blanks: bool = False, **options) -> DataFrame | None:
    """The same as a stream of the files of a folder, or None where the folder is absent.

    A bad line stops the stream; its place is given from the begin of its split (0: the file's).
    """
    if not exists(spark, path):
        return None
    text = spark.readStream.option("lineSep", "\n").options(**options).text(path)
    place = F.concat("file", F.lit(", split "), F.col("split").cast("string"), F.lit(", byte "), F.col("behind").cast("string"))
    return _checked(_placed(text), schema, blanks, place)


def drained(stream: DataFrame | None, path: str, checkpoint: str) -> int:
    """Run a stream over what is there into Parquet files; the number of batches run, 0 and no files without a stream."""
    if stream is None:
        return 0
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p.numInputRows)
