"""Stored feedback and calibrations: validated appends and upserts by clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import validated_feedback
from .storage import saved
from .versions import Version, VersionedTable, retried

FEEDBACK = "clip_id string, frame_idx long, t_ms long, issue_type string, timestamp string, track_id string, note string"
CALIBRATION = "clip_id string, type string, solver string, h_sequence map<string,array<array<double>>>, h_matrix array<array<double>>, primitive_count long, point_sample_count long, primitive_ids array<string>, primitive_families array<string>"


def feedback_store(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, FEEDBACK)


def append_feedback(store: VersionedTable, feedback: DataFrame, frames: DataFrame, tracks: DataFrame, batch: str) -> tuple[Version, DataFrame]:
    """Append the rows that pass all checks as one batch; also give the refused rows with their ``problem``."""
    checked = saved(validated_feedback(feedback, frames, tracks))  # judged once: what is written and what is refused agree
    version = retried(lambda: store.append(checked.where(F.col("problem").isNull()), batch))
    return version, checked.where(F.col("problem").isNotNull())


def calibration_store(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, CALIBRATION)


def upsert_calibrations(store: VersionedTable, new: DataFrame) -> Version:
    """Put calibrations of clips in place of those that the store has; columns that ``new`` lacks are null."""
    named = {c.split()[0]: c.split(maxsplit=1)[1] for c in CALIBRATION.split(", ")}
    whole = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in named.items()])
    return retried(lambda: store.upsert(whole, "clip_id"))


def homographies(store: VersionedTable) -> DataFrame:
    """(clip_id, frame_idx, h) of the stored calibrations: by frame, or by clip (frame_idx null)."""
    rows = store.read()
    by_frame = rows.select("clip_id", F.explode("h_sequence").alias("k", "m")).select("clip_id", F.col("k").cast("bigint").alias("frame_idx"), F.flatten("m").alias("h"))
    whole = rows.where("h_matrix IS NOT NULL").select("clip_id", F.lit(None).cast("bigint").alias("frame_idx"), F.flatten("h_matrix").alias("h"))
    return by_frame.union(whole)
