"""Vector code compression: integer parts, deduplicated, and weighted k-means over the distinct ones.

A vector's components become integers and are cut into parts.  Parts that are equal at a position are one distinct row
with a weight, so Lloyd's rounds run over distinct rows: each task assigns its rows to the entries of their position's
codebook and adds up weights and weighted components for each entry; Spark adds these sums, and only they reach the
driver, which holds the codebooks.  In the end codes and errors of the distinct parts are joined back to the vectors.
All arithmetic is on integers, so results depend on no order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, spread_join

#: Codebooks by (length of the vectors, part): entries x components.
Codebooks = dict[tuple[int, int], np.ndarray]


def integers(x: Column, scale: int) -> Column:
    """floor(scale * component); a component beyond what 64 bits hold raises an error."""
    small = lambda v: F.abs(v) * scale < float(1 << 63)
    return F.transform(x.cast("array<double>"), lambda v: F.when(small(v), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large for a 64-bit integer"))))


def _parts(x: Column, parts: int) -> Column:
    """(position, values) of consecutive parts; lengths that ``parts`` does not divide give parts that differ by one."""
    cut = lambda k: F.floor(F.size(x) * k / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(F.size(x).alias("size"), k.alias("part"), F.slice(x, cut(k) + 1, cut(k + 1) - cut(k)).alias("values")))


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the smallest) and its squared distance, exactly, for each row of integers."""
    largest = max((int(np.abs(a.astype(object)).max()) for a in (rows, entries) if a.size), default=0)
    kind = np.int64 if (2 * largest) ** 2 * max(1, rows.shape[1]) < 1 << 63 else object
    rows, entries = rows.astype(kind), entries.astype(kind)
    best = code = None
    for k, e in enumerate(entries):
        d = ((rows - e) ** 2).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), kind)
        if best is None:
            best, code = d, np.zeros(len(rows), np.int64)
        else:
            nearer = (d < best).astype(bool)
            code[nearer], best[nearer] = k, d[nearer]
    return code, best


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """(length, part), places in the batch, and values as a matrix, for the keys in a batch."""
    key = batch.column("key")
    size, part = key.field("size").to_numpy(), key.field("part").to_numpy()
    values = key.field("values")
    flat, at = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
    for s, p in sorted(set(zip(size.tolist(), part.tolist(), strict=True))):
        here = np.flatnonzero((size == s) & (part == p))
        width = int(at[here[0] + 1] - at[here[0]])
        yield (s, p), here, flat[at[here][:, None] + np.arange(width)]


def _sums(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(size, part, entry, place, n, total): weights and weighted components of the parts nearest to each entry.

    Place -1 carries the weight of an entry whose parts have no component.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = batch.column("n").to_numpy().astype(object)
            out: list[tuple] = []
            for (s, p), here, rows in _groups(batch):
                code, _ = nearest(rows, shared.value[s, p])
                for k in np.unique(code):
                    w = weight[here[code == k]]
                    total = (rows[code == k].astype(object) * w[:, None]).sum(axis=0)
                    out += [(s, p, int(k), j, Decimal(int(w.sum())), Decimal(int(t))) for j, t in enumerate(total)]
            if out:
                kinds = [pa.int32()] * 4 + [pa.decimal128(38, 0)] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["size", "part", "entry", "place", "n", "total"])

    sums = distinct.select("key", "n").mapInArrow(run, "size int, part int, entry int, place int, n decimal(38,0), total decimal(38,0)")
    return sums.groupBy("size", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def first_entries(rows: DataFrame, entries: int, parts: int) -> Codebooks:
    """Codebooks of the vectors with the smallest keys (nulls last, then by values), for each length of vectors."""
    order = Window.partitionBy(F.size("x")).orderBy(F.asc_nulls_last("key"), "x")
    few = rows.select("key", "x").withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries)
    books: dict[tuple[int, int], list] = {}
    for r in few.orderBy("n").select(F.explode(_parts(F.col("x"), parts)).alias("p"), "n").orderBy("n").collect():  # ``entries`` vectors of each length
        books.setdefault((r.p.size, r.p.part), []).append(r.p["values"])
    return {k: np.array(v, np.int64).reshape(len(v), -1) for k, v in books.items()}


def lloyd(distinct: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    """The codebooks after some rounds over weighted distinct parts; entries that no part is nearest to stay."""
    for _ in range(rounds):
        moved = {k: v.copy() for k, v in books.items()}
        for r in _sums(distinct, books).toLocalIterator():  # one number for each component of each entry
            moved[r["size"], r.part][r.entry, r.place] = int(r.total) // int(r.n)
        books = moved
    return books


def codebook_digest(books: Codebooks, size: int, parts: int) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for p in range(parts) for v in books[size, p].ravel().tolist()).encode()).hexdigest()


def _coded(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(key, code, error) of the distinct parts; an error that 64 bits do not hold is a decimal still."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([distinct.schema["key"], T.StructField("code", T.IntegerType()), T.StructField("error", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for k, here, rows in _groups(batch):
                codes[here], errors[here] = nearest(rows, shared.value[k])
            held = [Decimal(int(e)) if e < 10**38 else None for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(codes), pa.array(held, pa.decimal128(38, 0))], names=["key", "code", "error"])

    return distinct.select("key").mapInArrow(run, schema)


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: key, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped.  Every other row gives one row, also
    those that repeat a key or have none (null keys come last where codebooks begin).  Vectors of each length have their
    own codebooks, held by the driver, ``entries`` for each length.  Where fewer vectors than ``entries`` are left, that
    is the number of entries.  Empty vectors have error 0.  Errors that 64 bits do not hold are null; a component beyond
    2^63 / scale raises an error.  Null labels are one label.  Other columns are ignored; an empty table gives an empty
    result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark, x = vectors.sparkSession, F.col(f"`{column}`")
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = saved(vectors.where(x.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), integers(x, scale).alias("x")), "integers")
    split = F.explode(_parts(F.col("x"), parts)).alias("key")
    distinct = saved(rows.select(split).groupBy("key").agg(F.count("*").alias("n")), "distinct")
    books = lloyd(distinct, first_entries(rows, entries, parts), rounds)
    coded = saved(_coded(distinct, books), "coded")
    dealt = spread_join(rows.select("row", F.col("key").alias("id"), "label", split), coded, "key", distinct)
    digits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key.part", "code"))), lambda c: F.lower(F.lpad(F.hex(c["code"]), 2, "0"))), "")
    whole = F.when(F.count("error") == parts, F.sum("error")).cast("decimal(38,0)")
    summed = dealt.groupBy("row", "id", "label", F.col("key.size").alias("size")).agg(digits.alias("code"), whole.alias("error"))
    named = F.concat(F.when(F.col("label").isNull(), "-").otherwise("+"), F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("name")
    done = saved(summed.select("id", named, "size", "code", "error"), "codes")
    labels = saved(done.groupBy("name").agg(F.when(F.count("error") == F.count("*"), F.sum("error")).alias("label_error"), F.count("*").alias("n")), "labels")
    digests = spark.createDataFrame([(s, codebook_digest(books, s, parts)) for s in sorted({s for s, _ in books})], "size int, digest string")
    out = spread_join(done, labels.drop("n"), "name", labels).join(F.broadcast(digests), "size")  # one row for each length
    return out.select(F.col("id").alias(key), "code", F.expr("try_cast(error AS bigint)").alias("error"), F.expr("try_cast(label_error AS bigint)").alias("label_error"), F.col("digest").alias("codebooks_sha256"))
