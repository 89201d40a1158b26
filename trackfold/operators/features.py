"""Feature rows of pose windows, and dataset manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let

STEPS, WIDTH = 30, 72


def feature_row(pose: Column, before: Column, wrists: Column, ball: Column, court: Column) -> Column:
    """72 numbers: 34 of the pose, 34 of its change times 0.1, two wrist-ball distances times 0.01, court position times 0.001."""
    flat = F.flatten(pose)
    change = F.zip_with(flat, F.flatten(before), lambda a, b: (a - b) * 0.1)
    d = lambda w: F.sqrt((w[0] - ball[0]) ** 2 + (w[1] - ball[1]) ** 2 + (w[2] - ball[2]) ** 2) * 0.01
    return F.concat(flat, change, F.array(d(wrists[0]), d(wrists[1]), court[0] * 0.001, court[1] * 0.001))


def feature_windows(rows: DataFrame) -> DataFrame:
    """Rows (clip_id, track_id, frame_idx, pose, wrists, court) with their last 30 feature rows, where there are 30.

    The ball of all steps is that of the window's last row (column ``ball``; z is 100 where it has none).
    """
    w = Window.partitionBy("clip_id", "track_id").orderBy("frame_idx")
    steps = rows.withColumn("before", F.lag("pose").over(w))
    last30 = w.rowsBetween(-(STEPS - 1), 0)
    d = steps.withColumn("steps", F.collect_list(F.struct("pose", F.coalesce("before", "pose").alias("before"), "wrists", "court")).over(last30)).where(F.size("steps") == STEPS)
    ball = F.array(F.col("ball")[0], F.col("ball")[1], F.coalesce(F.get("ball", F.lit(2)), F.lit(100.0)))
    # the first step of a window has no change, whatever lies before the window
    made = let(ball, lambda b: F.transform(F.col("steps"), lambda s, i: feature_row(s["pose"], F.when(i == 0, s["pose"]).otherwise(s["before"]), s["wrists"], b, s["court"])))
    return d.select("clip_id", "track_id", "frame_idx", made.alias("features"))


def shape_ok(features: Column) -> Column:
    """Whether features are 30 rows of 72."""
    return F.coalesce((F.size(features) == STEPS) & F.forall(features, lambda r: F.size(r) == WIDTH), F.lit(False))


def manifest(samples: DataFrame, dataset_id: str, schema_version: str = "2.0.0") -> DataFrame:
    """One row: id, version, hash of the content, sample count, label distribution, status and errors of the shapes.

    The hash does not depend on the order of samples: their hashes are added up, so no task gathers them.
    """
    text = F.to_json(F.struct("label", "features"))
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    by_label = samples.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~shape_ok(F.col("features"))).alias("bad"), F.concat_ws(":", total(F.xxhash64(text)), total(F.xxhash64(F.sha2(text, 256)))).alias("h"))
    bad = F.coalesce(F.sum("bad"), F.lit(0))
    return by_label.agg(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(schema_version).alias("schema_version"),
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))), 256).alias("sha256_hash"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_distribution"),
        F.when(bad == 0, "pass").otherwise("fail").alias("validation_status"),
        bad.alias("n_errors"),
    )


def label_index(labels: DataFrame) -> DataFrame:
    """Distinct labels, sorted and numbered from 0 (a label set is small)."""
    return labels.select("label").distinct().withColumn("index", F.row_number().over(Window.orderBy("label")) - 1)
