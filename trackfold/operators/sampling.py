"""Random choice of clips with replacement: a seeded multinomial sample that is the same at any number of partitions.

Every draw is a uniform number below the sum of all weights, made from the seed and the draw's number alone.  Clips lie
side by side on that range, in the order of a hash of their keys; where they begin is a prefix sum in two steps (within
buckets of the hash, then over the buckets).  The range is cut into about as many slots as there are clips, so draws and
clips meet by an equality of slots; a heavy clip lies in many slots and its draws in as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a clip's bucket; draws for each clip beyond which sampling ends.
BUCKET_DIGITS, MOST_PER_CLIP = 3, 2


def uniform(seed: int, stream: str, draw: Column, below: Column) -> Column:
    """A number from 0 below ``below`` for each draw: the first 60 bits of a hash, reduced."""
    text = F.concat(F.lit(f"{seed}:{stream}:"), draw.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("bigint"), below)


def laid_out(clips: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``clips`` (with an integer ``weight``) and where each begins (``lo``) and ends (``hi``) on the range of all weights."""
    hashed = clips.withColumn("hash", F.md5(F.encode(F.col(key).cast("string"), "UTF-8"))).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    within = Window.partitionBy("bucket").orderBy("hash", key, *columns).rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("end", F.sum("weight").over(within))
    totals = hashed.groupBy("bucket").agg(F.sum("weight").alias("total"))
    begins = totals.withColumn("before", F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).drop("total")  # 16^3 rows
    out = placed.join(F.broadcast(begins), "bucket")
    return out.select(key, *columns, "weight", (F.col("before") + F.col("end") - F.col("weight")).alias("lo"), (F.col("before") + F.col("end")).alias("hi"))


def sampled(clips: DataFrame, cap: int, seed: int, seconds: float = 5.0, fps: float = 30.0, by_length: bool = False, most: int | None = MOST_PER_CLIP, key: str = "clip_id", frames: str = "frames") -> DataFrame:
    """Clips drawn with replacement up to ``cap``: draw, clip, frames, start_frame, start_s.

    Only clips with more frames than the piece to take can be drawn, and the piece begins at any frame from which it
    fits.  Every such clip is as likely as any other, or as its length (``by_length``).  Sampling ends after ``most``
    draws for each clip and one more, if ``most`` is given.  Rows that are repeated are one clip with their weight;
    null keys and null lengths take no part.  Without clips that can be drawn the result is empty.
    """
    piece = int(seconds * fps)
    usable = clips.where(F.col(key).isNotNull() & (F.col(frames) > piece))
    weight = F.count("*") * (F.col(frames) if by_length else F.lit(1))
    distinct = usable.groupBy(key, frames).agg(F.count("*").alias("rows"), weight.cast("bigint").alias("weight"))
    n, rows, total = distinct.agg(F.count("*"), F.sum("rows"), F.sum("weight")).first()
    spark = clips.sparkSession
    draws = min(cap, most * (rows or 0) + 1) if most is not None else cap
    drawn = spark.range(draws if n else 0).select(F.col("id").alias("draw"), uniform(seed, "clip", F.col("id"), F.lit(total or 1).cast("bigint")).alias("u"))
    width = -(-(total or 1) // max(1, n))
    slot = lambda c: F.call_function("div", c, F.lit(width))
    lying = laid_out(distinct, key, [frames]).withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi") - 1))))
    met = drawn.withColumn("slot", slot(F.col("u"))).join(lying, "slot").where("lo <= u AND u < hi")
    start = uniform(seed, "start", F.col("draw"), F.col(frames) - piece + 1)
    return met.select("draw", key, frames, start.alias("start_frame")).withColumn("start_s", F.col("start_frame") / F.lit(fps))
