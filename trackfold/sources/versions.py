"""Tables that are changed in whole steps: readers see one version or the next, never half of one.

A writer puts new files into a folder of its own, then names all folders of the new version in a small document and
renames that document to the next number.  The rename fails if the number is taken, so of two writers that began from
the same version one has to begin again, and a writer that dies leaves only a folder that no version names.  Appends
carry the id of their batch; a batch that a version holds is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a keyed table: an upsert rewrites those that its keys fall into.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


@dataclass(frozen=True)
class Version:
    """The folders of one version by bucket (-1: appended), and the batches that it holds."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    batches: tuple[str, ...] = ()


class VersionedTable:
    """Rows of one schema below ``path``, in any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, *names: str):
        return self._fs.Path("/".join([self.path, *names]))

    def current(self) -> Version:
        """The newest version; number 0 without folders where there is none."""
        log = self._path("log")
        fs = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(log):
            return Version()
        names = sorted(n for s in fs.listStatus(log) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())
        if not names:
            return Version()
        stream = fs.open(self._path("log", names[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Version(int(names[-1][:-5]), found["folders"], tuple(found["batches"]))

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version (the newest)."""
        folders = [f for fs in (version or self.current()).folders.values() for f in fs]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _commit(self, version: Version) -> Version:
        name = f"{version.number:020d}.json"
        staged, final = self._path("staged", uuid.uuid4().hex), self._path("log", name)
        conf = self.spark._jsc.hadoopConfiguration()
        fs = final.getFileSystem(conf)
        fs.mkdirs(final.getParent())
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps({"folders": version.folders, "batches": version.batches}).encode()))
        finally:
            out.close()
        context = self._fs.FileContext.getFileContext(final.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(staged), context.makeQualified(final), options)
        except Exception as e:
            if fs.exists(final):
                raise Conflict(f"version {version.number} of {self.path} was made by another writer") from e
            raise
        return version

    def append(self, rows: DataFrame, batch: str, expected: int | None = None) -> Version:
        """Add rows as the batch ``batch``; a batch that is there already changes nothing.

        With ``expected`` the table must still be at that version.
        """
        base = self._expected(expected)
        if batch in base.batches:
            return base
        folder = f"data/{uuid.uuid4().hex}"
        self._typed(rows).write.parquet(f"{self.path}/{folder}")
        return self._commit(Version(base.number + 1, base.folders | {"-1": [*base.folders.get("-1", []), folder]}, (*base.batches, batch)))

    def upsert(self, rows: DataFrame, key: str, expected: int | None = None) -> Version:
        """Replace the rows of the keys that ``rows`` has, and add those of new keys; of repeated keys all rows stay.
        Null keys replace nothing.

        Only the buckets that these keys fall into are rewritten.  Appended rows count as old ones, and are put into
        buckets the first time.
        """
        base = self._expected(expected)
        loose = "-1" in base.folders  # appended rows may have any key: all is put into buckets once
        bucketed = self._typed(rows).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
        changed = sorted(r[0] for r in bucketed.select("__bucket").distinct().collect())  # BUCKETS numbers at most
        touched = list(base.folders) if loose else [str(b) for b in changed if str(b) in base.folders]
        old = self.read(Version(base.number, {b: base.folders[b] for b in touched}))
        kept = old.join(bucketed.select(key).distinct(), key, "left_anti").select(*old.columns)
        folder = f"data/{uuid.uuid4().hex}"
        whole = kept.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).unionByName(bucketed)
        whole.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        written = [r[0] for r in whole.select("__bucket").distinct().collect()] if loose else changed
        folders = {b: f for b, f in base.folders.items() if b not in touched} | {str(b): [f"{folder}/__bucket={b}"] for b in written}
        return self._commit(Version(base.number + 1, folders, base.batches))

    def _expected(self, expected: int | None) -> Version:
        base = self.current()
        if expected is not None and base.number != expected:
            raise Conflict(f"{self.path} is at version {base.number}, not {expected}")
        return base

    def _typed(self, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields])


def retried(step: Callable[[], Version], times: int = 5) -> Version:
    """A write that begins again when another writer was faster."""
    for n in range(times):
        try:
            return step()
        except Conflict:
            if n == times - 1:
                raise
    raise AssertionError
