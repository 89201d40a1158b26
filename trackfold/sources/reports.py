"""Writers of reports: a small header document beside the tables that it speaks of, in sorted order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import floor_point
from .jsonl import write_lines

REPORT_VERSION = "1.0.0"
LIMITATIONS = ["signals of reviewed cases, without a verdict on quality", "the ball is that of a single frame, not of a track"]


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document with sorted keys, as the only line of a text folder."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    """The document of a folder that ``write_document`` made."""
    return json.loads(spark.read.text(path).first()[0])


def write_fixture(cases: DataFrame, source: str, path: str) -> None:
    """Regression cases below ``path``/cases, by clip and frame, and their header in ``path``/report.

    The cases are sorted by ranges over all tasks; no document holds them all.
    """
    write_lines(cases.orderBy("clip_id", "frame_idx"), f"{path}/cases")
    n = cases.sparkSession.read.text(f"{path}/cases").count()
    write_document(cases.sparkSession, f"{path}/report", {"schema_version": REPORT_VERSION, "source": source, "case_count": n})


def write_audit(report: DataFrame, rollup: DataFrame, fixture: str, artifacts: str, path: str) -> None:
    """The audit of cases: ``path``/cases and ``path``/categories in sorted order, and the header with their numbers."""
    spark = report.sparkSession
    write_lines(report.orderBy("clip_id", "frame_idx"), f"{path}/cases")
    write_lines(rollup.orderBy("category"), f"{path}/categories")
    counts = {f"{k}_count": spark.read.text(f"{path}/{d}").count() for k, d in (("case", "cases"), ("category", "categories"))}
    write_document(spark, f"{path}/report", {"schema_version": REPORT_VERSION, "fixture": fixture, "artifact_dir": artifacts, "limitations": LIMITATIONS} | counts)


def write_manifest(manifest: DataFrame, dataset: str) -> str:
    """The one row of a manifest as a document beside its dataset; its path."""
    path = f"{dataset.rstrip('/')}.manifest"
    write_document(manifest.sparkSession, path, json.loads(manifest.select(F.to_json(F.struct("*"))).first()[0]))
    return path


def write_enriched(rows: DataFrame, h: Column, path: str) -> None:
    """Rows as JSON lines with court_x, court_y and court_z where x and y are there; all else passes through."""
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    point = F.when(there, floor_point(F.col("x"), F.col("y"), h))
    write_lines(rows.withColumns({f"court_{c}": point[c] for c in "xyz"}), path)


def score_lines(summary: DataFrame) -> DataFrame:
    """A line of text for each game of a summary (game_id, points_1, points_2), to be shown or written."""
    return summary.select("game_id", F.format_string("Final Score: [%d, %d]", "points_1", "points_2").alias("line"))
