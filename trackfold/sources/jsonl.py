"""JSON lines and artifact documents: schemas, readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import exists

#: Rows of the event stream; ``kind`` tells which fields are set.
STREAM = (
    "kind string, t_ms bigint, track_id int, player_id int, `from` int, `to` int, x double, y double, confidence_bps int, action string, court_x double, court_y double, event_type string, actor_id int, secondary_actor_id int, "
    "team_id int, points int, is_official boolean, _bad string"
)
_DETECTION = "struct<track_id:int,class_id:int,class_name:string,confidence:double,bbox_xyxy:array<double>,bbox_xywh:array<double>,keypoints_xy:array<array<double>>,keypoints_conf:array<double>,court_xy:array<double>,uniform_bucket:string,appearance_histogram_rgbq:array<double>>"
#: A perception document: one for each clip.
ARTIFACT = (f"clip_id string, schema_version string, frames array<struct<frame_idx:int,t_ms:bigint,calibrated:boolean,detections:array<{_DETECTION}>,signature:array<array<double>>>>")
CALIBRATION = "map<string,struct<h_sequence:map<string,array<array<double>>>,h_matrix:array<array<double>>>>"


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_lines(spark: SparkSession, path: str, schema: str = STREAM, strict: bool = False, must_exist: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped and a missing path is an empty table unless it must exist.

    A bad line aborts if ``strict``, else it stays as a row with ``_bad`` set (if the schema has that column).
    """
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    df = _read(spark, path, schema, **options)
    if df is None:
        if must_exist:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return df


def first_that_exists(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the first of several JSON-lines files that exists, so that a newer dataset replaces an older one; none of them raises."""
    for path in paths:
        if (df := _read(spark, path, schema)) is not None:
            return df
    raise FileNotFoundError(", ".join(paths))


def of_kind(stream: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind."""
    return stream.where(F.col("kind") == kind)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Perception documents (one JSON document in each file); a missing path is an empty table."""
    df = _read(spark, path, ARTIFACT, multiLine="true")
    return spark.createDataFrame([], ARTIFACT) if df is None else df


def frames(artifacts: DataFrame) -> DataFrame:
    """Frames of perception documents."""
    return artifacts.select("clip_id", F.explode("frames").alias("f")).select("clip_id", "f.frame_idx", "f.t_ms", "f.calibrated", "f.signature", "f.detections")


def detections(frames_: DataFrame) -> DataFrame:
    """Detections of frames in their order (``det_ord``), with track ids where any detection of the frame has one."""
    tracked = F.exists("detections", lambda d: d["track_id"].isNotNull())
    return frames_.where(tracked).select("clip_id", "frame_idx", "t_ms", F.posexplode("detections").alias("det_ord", "d")).select("clip_id", "frame_idx", "t_ms", "det_ord", "d.*")


def read_calibration(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """(clip_id, frame_idx, h): homographies by frame, or by clip (frame_idx null).  The legacy path counts only if the other is missing; a broken file is an empty table."""
    empty = spark.createDataFrame([], "clip_id string, frame_idx bigint, h array<double>")
    for p in (path, legacy):
        if p is None:
            continue
        try:
            text = spark.read.text(p, wholetext=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        clips = text.select(F.explode(F.from_json("value", CALIBRATION)).alias("clip_id", "c"))
        by_frame = clips.select("clip_id", F.explode("c.h_sequence").alias("k", "m")).select("clip_id", F.col("k").cast("bigint").alias("frame_idx"), F.flatten("m").alias("h"))
        whole = clips.where("c.h_matrix IS NOT NULL").select("clip_id", F.lit(None).cast("bigint").alias("frame_idx"), F.flatten("c.h_matrix").alias("h"))
        return by_frame.union(whole)
    return empty


def listed_clips(clips: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The clips that have a document."""
    return clips.join(artifacts.select("clip_id").distinct(), "clip_id", "left_semi")


#: The folders of clips.
DOMAINS = ["nba", "ncaa", "youth", "playground"]


def clips_of_domains(spark: SparkSession, folder: str, artifacts: DataFrame) -> DataFrame:
    """(clip_id, domain, path): the clips (mp4 files) of the four domains below ``folder`` that have a document.

    A domain without a folder has none; names are told apart by case.  Only names are read, not the files.
    """
    there = [d for d in DOMAINS if exists(spark, f"{folder}/{d}")]
    if not there:
        return spark.createDataFrame([], "clip_id string, domain string, path string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load([f"{folder}/{d}" for d in there])
    named = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.mp4$", 1).alias("domain"), F.regexp_extract("path", r"([^/]+)/([^/]+)\.mp4$", 2).alias("clip_id"))
    return listed_clips(named.select("clip_id", "domain", F.concat("domain", F.lit("/"), "clip_id", F.lit(".mp4")).alias("path")), artifacts)


def pose_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Pose sequences of a JSON file that is a list, or an object with ``sequences``: sequence, poses."""
    poses = "array<array<array<array<double>>>>"
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", poses), F.from_json("value", f"sequences {poses}")["sequences"])
    return text.select(F.posexplode(listed).alias("sequence", "poses"))


def contract_errors(rows: DataFrame, required: dict[str, str]) -> DataFrame:
    """Rows of text JSON (column ``value``) with the first required key that is missing or of another type; ints count as floats."""
    parsed = F.try_parse_json("value")
    out = F.lit(None).cast("string")
    for name, kind in reversed(required.items()):
        found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        kinds = {"int": ["BIGINT"], "float": ["BIGINT", "DOUBLE"], "string": ["STRING"], "bool": ["BOOLEAN"]}[kind]
        ok = found.isin(kinds) | (found.startswith("DECIMAL") if kind == "float" else F.lit(False))
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return rows.withColumn("problem", F.when(parsed.isNull(), "not_json").otherwise(out))


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_artifacts(df: DataFrame, path: str) -> None:
    """Documents as JSON, in a folder for each clip."""
    df.write.mode("overwrite").partitionBy("clip_id").json(path)


def clip_slices(clips: DataFrame, seconds: float) -> DataFrame:
    """Ranges of ``seconds`` of each clip (clip_id, duration), up to the first that is shorter than 80 percent of that."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    s = clips.where("duration > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    s = s.withColumn("start", F.col("slice") * seconds).withColumn("end", F.least(F.col("start") + seconds, F.col("duration")))
    return s.where(F.col("end") - F.col("start") >= 0.8 * seconds)
