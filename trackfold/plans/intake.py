"""Queries of sampling, strict readers, versioned files, hashes, benchmark totals and streams with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review, sampling
from ..sources import jsonl, lines, stores
from ..sources.storage import saved, shared_folder
from ..sources.versions import VersionedTable
from ..streaming import state
from . import adapter, reviews
from .people import _FOLD, _LEDGER, HISTORY_SQL, ledger_events
from .registry import query

_CLIPS = "cl AS (SELECT clip_id, 100 + sum(v) % 1900 AS frames FROM ev GROUP BY clip_id), us AS (SELECT *, {weight} AS w FROM cl WHERE frames > 150), po AS (SELECT clip_id, frames, sum(w) OVER (ORDER BY md5(clip_id::VARCHAR), clip_id ROWS UNBOUNDED PRECEDING) - w AS lo FROM us), tt AS (SELECT sum(w)::BIGINT AS total, count(*) AS n FROM us)"
_DRAWS = """SELECT d AS draw, clip_id, frames, ('0x' || md5('7:start:' || d)[1:15])::BIGINT % (frames - 150 + 1) AS start_frame
    FROM (SELECT d, ('0x' || md5('7:clip:' || d)[1:15])::BIGINT % total AS u FROM tt, range(1000) r(d) WHERE d < 2 * n + 1) ASOF JOIN po ON u >= lo"""


def clip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with a number of frames made from their events."""
    return adapter.events(spark, sf_dir).groupBy("clip_id").agg((100 + F.sum("v") % 1900).alias("frames"))


@query(_DRAWS, _CLIPS.format(weight=1))
def srt_07_sampled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of five seconds drawn with replacement, at most 1,000."""
    return sampling.sampled(clip_lengths(spark, sf_dir), 1000, 7).drop("start_s")


@query(_DRAWS, _CLIPS.format(weight="frames"))
def srt_07_sampled_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chances by length."""
    return sampling.sampled(clip_lengths(spark, sf_dir), 1000, 7, by_length=True).drop("start_s")


#: Stretches that a stream is cut into, and those that arrive together.
STRETCHES, TOGETHER = 5, 2


def _streamed(rows: DataFrame, stretch: str, order: str, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``result`` makes of a stream of ``rows`` that arrive by ascending stretches, each in as many files as tasks write.

    Every run takes what has arrived since the last one and goes on from its checkpoint.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    kept = saved(rows)  # each arrival reads its own part
    for k in range(0, STRETCHES, TOGETHER):
        arrived = kept.where((F.col(stretch) >= k) & (F.col(stretch) < k + TOGETHER))
        arrived.drop(stretch).sortWithinPartitions(order).write.mode("append").parquet(f"{folder}/stream")
        stream = spark.readStream.schema(rows.drop(stretch).schema).parquet(f"{folder}/stream")
        out = state.run_available(result(stream), f"{folder}/out", f"{folder}/checkpoint", last=k + TOGETHER >= STRETCHES)
    return out


@query(HISTORY_SQL, _LEDGER + "," + _FOLD, recursive=True)
def sts_06_streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's history worked out by a stream with state; every arrival holds a stretch of each game."""
    events = ledger_events(spark, sf_dir).withColumn("part", F.col("seq") * STRETCHES / 500).withColumn("part", F.floor("part"))
    return _streamed(events, "part", "seq", state.ledger)


_TRACKS = """z AS (SELECT clip_id, track_id, frame_idx, x, y, v % 3 = 0 AS has_pose, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx) AS n FROM ply),
    k AS (SELECT clip_id, track_id, frame_idx, n, x AS sx, y AS sy, 1.0::DOUBLE AS p FROM z WHERE n = 1
          UNION ALL SELECT z.clip_id, z.track_id, z.frame_idx, z.n, sx + (p + 1e-4) / (p + 1e-4 + 1e-2) * (z.x - sx), sy + (p + 1e-4) / (p + 1e-4 + 1e-2) * (z.y - sy), (1 - (p + 1e-4) / (p + 1e-4 + 1e-2)) * (p + 1e-4)
          FROM k JOIN z ON z.clip_id = k.clip_id AND z.track_id = k.track_id AND z.n = k.n + 1),
    hs AS (SELECT *, count(*) FILTER (has_pose) OVER (PARTITION BY clip_id, track_id ORDER BY frame_idx) AS poses FROM z)"""


@query("SELECT clip_id, track_id, frame_idx, round(sx, 4) AS court_x, round(sy, 4) AS court_y, 1 AS team, k.n AS seen, least(poses, 30) AS poses FROM k JOIN hs USING (clip_id, track_id, frame_idx)", _TRACKS, recursive=True)
def sts_08_streamed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of tracks kept by a stream: each detection with its track's state after it."""
    rows = adapter.players(spark, sf_dir).select("clip_id", "track_id", "frame_idx", "x", "y", (F.col("v") % 3 == 0).alias("has_pose"), F.floor(F.col("frame_idx") * STRETCHES / 50).alias("part"))
    out = _streamed(rows, "part", "frame_idx", state.tracks)
    return out.withColumns({c: F.round(c, 4) for c in ("court_x", "court_y")})


@query(f"SELECT issue_type, count(*) AS n, count(track_id) AS tracks, sum(t_ms) AS t_total, count(note) AS notes FROM (SELECT *, {reviews._PROBLEM} AS problem FROM fb) WHERE problem IS NULL GROUP BY issue_type", reviews._FEEDBACK)
def snk_03_validated_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback appended in two batches, one of which comes twice, and read back."""
    store = stores.feedback_store(spark, f"{shared_folder(spark)}/feedback")
    feedback, d = reviews.feedback(spark, sf_dir), adapter.detections(spark, sf_dir)
    for batch in (0, 1, 0):
        stores.append_feedback(store, feedback.where(F.col("seq") % 2 == batch), reviews.reviewed_frames(d), d, f"batch {batch}")
    return store.read().groupBy("issue_type").agg(F.count("*").alias("n"), F.count("track_id").alias("tracks"), F.sum("t_ms").alias("t_total"), F.count("note").alias("notes"))


@query("SELECT clip_id, max(version) AS version, count(*) AS n FROM (SELECT clip_id, 1 AS version FROM ev WHERE event_id % 500 = 0 AND clip_id % 3 <> 0 UNION ALL SELECT clip_id, 2 FROM ev WHERE event_id % 500 = 0 AND clip_id % 3 = 0) GROUP BY ALL")
def snk_05_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of clips, of which an upsert replaces every third."""
    store = VersionedTable(spark, f"{shared_folder(spark)}/clips", "clip_id long, version int")
    clips = adapter.events(spark, sf_dir).select("clip_id").distinct()
    store.append(clips.withColumn("version", F.lit(1)), "first")
    store.upsert(clips.where("clip_id % 3 = 0").withColumn("version", F.lit(2)), "clip_id")
    return store.read().groupBy("clip_id").agg(F.max("version").alias("version"), F.count("*").alias("n"))


@query(
    """SELECT clip_id::VARCHAR AS clip_id, CASE WHEN clip_id % 3 = 0 THEN 'second' ELSE 'first' END AS solver, CASE WHEN clip_id % 3 = 0 THEN points * 2 ELSE points END AS point_sample_count,
       CASE WHEN clip_id % 3 = 0 THEN frames ELSE 1 END AS homographies, CASE WHEN clip_id % 3 = 0 THEN frames * (clip_id + 0.5::DOUBLE) ELSE clip_id::DOUBLE END AS h0_total
       FROM (SELECT clip_id, count(*) AS points, count(DISTINCT frame_idx) AS frames FROM det GROUP BY clip_id)"""
)
def snk_05_calibration_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations by clip are stored, every third is replaced by one with a homography for each frame, all are read back."""
    store = stores.calibration_store(spark, f"{shared_folder(spark)}/calibrations")
    clips = adapter.detections(spark, sf_dir).groupBy(F.col("clip_id").alias("n")).agg(F.count("*").alias("point_sample_count"), F.collect_set("frame_idx").alias("frames"))  # a clip's 50 frames
    matrix = lambda a: F.array(F.array(a.cast("double"), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    key = F.col("n").cast("string").alias("clip_id")
    stores.upsert_calibrations(store, clips.select(key, F.lit("first").alias("solver"), "point_sample_count", matrix(F.col("n")).alias("h_matrix")))
    by_frame = F.map_from_arrays(F.transform("frames", lambda f: f.cast("string")), F.transform("frames", lambda f: matrix(F.col("n") + 0.5)))
    stores.upsert_calibrations(store, clips.where("n % 3 = 0").select(key, F.lit("second").alias("solver"), (F.col("point_sample_count") * 2).alias("point_sample_count"), by_frame.alias("h_sequence")))
    found = stores.homographies(store).groupBy("clip_id").agg(F.count("*").alias("homographies"), F.sum(F.col("h")[0]).alias("h0_total"))
    return store.read().select("clip_id", "solver", "point_sample_count").join(found, "clip_id")


_LINE = "kind string, t_ms long, track_id long"


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_folder(spark)}/lines"
    jsonl.write_lines(adapter.events(spark, sf_dir).select(F.col("event_type").alias("kind"), "t_ms", F.when(F.col("v") % 3 != 0, F.col("user_id")).alias("track_id")), path)
    return path


_LINE_TOTALS = "SELECT event_type AS kind, count(*) AS n, sum(t_ms) AS t_total, count(user_id) FILTER (v % 3 <> 0) AS tracked FROM ev GROUP BY event_type"


def _line_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("t_ms").alias("t_total"), F.count("track_id").alias("tracked"))


@query(_LINE_TOTALS)
def src_02_strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read by the reader that refuses blank and broken ones."""
    return _line_totals(lines.strict_rows(spark, _written_lines(spark, sf_dir), _LINE, blanks=True))


@query(_LINE_TOTALS)
def src_04_strict_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that a broken line would stop."""
    stream, folder = lines.strict_stream(spark, _written_lines(spark, sf_dir), _LINE, maxFilesPerTrigger=4), shared_folder(spark)
    lines.drained(stream, f"{folder}/out", f"{folder}/checkpoint")
    return _line_totals(spark.read.schema(_LINE).parquet(f"{folder}/out"))


_MOVED = "list_transform(range(17), lambda j: [((v * j) % 13) / 100.0::DOUBLE, 0.0::DOUBLE])"


@query(
    """SELECT clip_id, count(*) AS samples, count(f.v) AS matches, coalesce(count(*) FILTER (f.v IS NOT NULL AND type = 'id_verification' AND label = 'correct') / nullif(count(f.v), 0), 0.0) AS id_accuracy, round(coalesce(avg(pck), 0.0), 6) AS avg_pck
       FROM (SELECT *, CASE WHEN has_pose AND f.v % 5 <> 0 THEN list_avg(list_transform(range(17), lambda j: CASE WHEN abs(((f.v * j) % 13) / 100.0::DOUBLE) < 0.05 THEN 1.0 ELSE 0.0 END)) END AS pck FROM (
         SELECT t.*, (SELECT arg_min({'v': d.v}, d.frame_idx * 10 + d.slot) FROM det d WHERE d.track_id = t.track_id AND d.clip_id = t.clip_id AND abs(t.t_ms - (d.t_ms + d.v % 40)) < 33) AS f
         FROM (SELECT clip_id, track_id, t_ms, v, CASE WHEN v % 2 = 0 THEN 'id_verification' ELSE 'pose' END AS type, CASE WHEN v % 3 = 0 THEN 'correct' ELSE 'wrong' END AS label, v % 4 <> 0 AS has_pose FROM ply) t)) GROUP BY clip_id"""
)
def agg_16_benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of the tracks against their detections, some milliseconds late: matches, identities, joints."""
    d, j = adapter.detections(spark, sf_dir), F.sequence(F.lit(0), F.lit(16))
    still = F.transform(j, lambda k: F.array(F.lit(0.0), F.lit(0.0)))
    moved = F.transform(j, lambda k: F.array((F.col("v") * k % 13) / 100.0, F.lit(0.0)))
    track = (F.col("clip_id") * 100 + F.col("track_id")).alias("track_id")
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    players = adapter.lowest_slot(d.select("clip_id", "frame_idx", "track_id", "slot", "t_ms", "v"), "clip_id", "frame_idx", "track_id")
    truth = players.select(
        "clip_id", track, "t_ms", pick(F.col("v") % 2 == 0, "id_verification", "pose").alias("type"), pick(F.col("v") % 3 == 0, "correct", "wrong").alias("label"), F.when(F.col("v") % 4 != 0, still).alias("pose")
    )
    found = d.select(track, (F.col("t_ms") + F.col("v") % 40).alias("t_ms"), (F.col("frame_idx") * 10 + F.col("slot")).alias("ord"), F.when(F.col("v") % 5 != 0, moved).alias("pose"))
    return review.benchmark_totals(truth, found, ["clip_id"]).withColumn("avg_pck", F.round("avg_pck", 6))
