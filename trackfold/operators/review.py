"""Review and audit: frame summaries, overlaps, feedback cases, categories, benchmark matching, nearest frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERLAP, SLOW, STILL, MATCH_MS, PCK = 0.2, 6.0, 0.5, 33, 0.05

# What a note's words say, in the order of the tests: (category, issue types that imply it, patterns).
NOTE_WORDS = {
    "spectator": r"\bspectator\b|\bseated\b|\bbench\b",
    "bystander": r"\bbystander",
    "referee": r"\bref\b|\breferee\b|\bsideline\b",
    "cluster": r"\bcluster",
    "merged": r"\bmerged\b",
    "missed_players": r"\bmissed \d+ players?\b",
    "missed": r"\bmissed\b",
    "merge": r"\bmerged\b|\bmerge\b",
    "identity": r"\bsame\b|\bbecomes\b|\bkeep changing\b|\bid switch\b|\bnumbers keep changing\b",
    "uniform": r"\bdark\b|\blight\b|\buniform\b",
    "live": r"\bdribbling\b|\bdribbler\b|\bbringing the ball forward\b|\blive play\b",
    "dead": r"\bsubbed out\b|\bsubstitution\b|\bout of bounds\b|\bstopped the play\b|\bdead ball\b|\binbound\b|\bno actual play\b",
}
ISSUE_TYPES = ["false_positive", "false_negative", "merge_error", "track_error", "live_play", "dead_ball", "uncertain_play_state", "general_note", "pose_error"]

# The signals that each category asks for, in order.
SIGNALS = {
    "spectator_false_positive": ["detection_count", "active_candidate_count", "low_motion_detection_count", "zero_motion_detection_count", "track_ids"],
    "bystander_false_positive": ["detection_count", "active_candidate_count", "low_motion_detection_count", "zero_motion_detection_count", "track_ids"],
    "false_positive_generic": ["detection_count", "active_candidate_count", "track_ids"],
    "cluster_miss": ["detection_count", "overlap_pair_count", "synthesized_detection_count", "track_ids"],
    "cluster_merge": ["detection_count", "overlap_pair_count", "synthesized_detection_count", "track_ids"],
    "false_negative_generic": ["detection_count", "synthesized_detection_count", "track_ids"],
    "id_switch": ["track_ids", "canonical_track_ids", "canonical_track_count", "motion_speed_max", "motion_speed_median", "synthesized_detection_count"],
    "uniform_confusion": ["uniform_bucket_counts", "active_uniform_bucket_counts", "track_ids"],
    "live_play_context": ["live_play_label", "live_play_score", "live_play_segment_label", "live_play_segment_duration_ms", "ball_signal_present", "ball_confidence", "active_candidate_count", "motion_speed_max", "motion_speed_median", "track_ids"],
    "dead_ball_context": ["live_play_label", "live_play_score", "live_play_segment_label", "live_play_segment_duration_ms", "ball_signal_present", "ball_confidence", "active_candidate_count", "low_motion_detection_count", "zero_motion_detection_count", "track_ids"],
    "scene_context": ["detection_count", "active_candidate_count", "track_ids"],
}


def iou(a: str, b: str) -> Column:
    """Shared part of two boxes (prefixes of x1, y1, x2, y2); 0 where their union is empty."""
    c = F.col
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(c(f"{a}.x2"), c(f"{b}.x2")) - F.greatest(c(f"{a}.x1"), c(f"{b}.x1")))
    h = F.greatest(zero, F.least(c(f"{a}.y2"), c(f"{b}.y2")) - F.greatest(c(f"{a}.y1"), c(f"{b}.y1")))
    area = lambda p: F.greatest(zero, c(f"{p}.x2") - c(f"{p}.x1")) * F.greatest(zero, c(f"{p}.y2") - c(f"{p}.y1"))
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / union)


def overlapping_pairs(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Pairs of detections of a frame (lower slot first) with at least this IoU; a frame has few detections."""
    side = lambda p: boxes.select("clip_id", "frame_idx", F.struct("slot", "x1", "y1", "x2", "y2").alias(p))
    pairs = side("a").join(side("b"), ["clip_id", "frame_idx"]).where("a.slot < b.slot")
    return pairs.withColumn("iou", iou("a", "b")).where(F.col("iou") >= threshold).select("clip_id", "frame_idx", F.col("a.slot").alias("slot_a"), F.col("b.slot").alias("slot_b"), "iou")


def frame_summary(d: DataFrame) -> DataFrame:
    """Per frame: counts, sorted tracks, uniforms, motion, overlaps.  Input: track_id, identity_id, active, speed, uniform, synthesized, box."""
    speed = F.coalesce("speed", F.lit(0.0))
    uniform = lambda name, cond: F.count_if((F.coalesce("uniform", F.lit("unknown")) == name) & cond)
    yes = F.lit(True)
    tracks = F.array_sort(F.collect_list(F.col("track_id").cast("string")))
    s = d.groupBy("clip_id", "frame_idx").agg(
        F.count("*").alias("detections"),
        F.array_join(tracks, ",").alias("track_ids"),
        F.countDistinct(F.coalesce("identity_id", "track_id")).alias("canonical_tracks"),
        F.count_if("active").alias("active"),
        F.count_if("synthesized").alias("synthesized"),
        F.count_if(speed < SLOW).alias("low_motion"),
        F.count_if(speed <= STILL).alias("zero_motion"),
        F.round(F.min(speed), 3).alias("speed_min"),
        F.round(F.median(speed), 3).alias("speed_median"),
        F.round(F.max(speed), 3).alias("speed_max"),
        *[uniform(u, yes).alias(u) for u in ("dark", "light", "unknown")],
        *[uniform(u, F.col("active")).alias(f"active_{u}") for u in ("dark", "light", "unknown")],
    )
    overlaps = overlapping_pairs(d).groupBy("clip_id", "frame_idx").agg(F.count("*").alias("overlaps"))
    return s.join(overlaps, ["clip_id", "frame_idx"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def categories(issue: Column, note: Column) -> Column:
    """Sorted categories that an issue type and the words of its note imply."""
    text = F.lower(F.trim(F.coalesce(note, F.lit(""))))
    says = {k: text.rlike(p) for k, p in NOTE_WORDS.items()}
    is_ = lambda *names: F.coalesce(issue.isin(*names), F.lit(False))
    fp, fn = is_("false_positive"), is_("false_negative")
    away = says["bystander"] | says["referee"]
    miss = says["cluster"] | says["merged"] | says["missed_players"]
    tests = {
        "spectator_false_positive": says["spectator"],
        "bystander_false_positive": away,
        "false_positive_generic": fp & ~says["spectator"] & ~away,
        "cluster_miss": (fn & miss) | (says["missed"] & says["cluster"]),
        "false_negative_generic": fn & ~miss,
        "cluster_merge": is_("merge_error") | says["merge"],
        "id_switch": is_("track_error") | says["identity"],
        "uniform_confusion": says["uniform"],
        "live_play_context": is_("live_play") | says["live"],
        "dead_ball_context": is_("dead_ball") | says["dead"],
        "scene_context": is_("uncertain_play_state"),
    }
    found = F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    return F.when(is_("general_note") & (F.size(found) == 0), F.array(F.lit("scene_context"))).otherwise(F.array_sort(found))


def cases(feedback: DataFrame) -> DataFrame:
    """Feedback grouped by clip and frame: times, distinct sorted tracks, issues and categories, notes in order, scene context."""
    f = feedback.withColumn("c", categories(F.col("issue_type"), F.col("note")))
    g = f.groupBy("clip_id", "frame_idx").agg(
        F.min("t_ms").alias("t_ms_min"),
        F.max("t_ms").alias("t_ms_max"),
        F.array_sort(F.collect_set("issue_type")).alias("issue_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("categories"),
        F.array_sort(F.collect_set(F.col("track_id").cast("string"))).alias("track_ids"),
        F.transform(F.array_sort(F.collect_list(F.when(F.length(F.trim("note")) > 0, F.struct("seq", F.trim("note").alias("note"))))), lambda s: s["note"]).alias("notes"),
        F.count("*").alias("source_count"),
    )
    context = F.when(F.array_contains("categories", "dead_ball_context"), "dead_ball").when(F.array_contains("categories", "live_play_context"), "live_play")
    return g.withColumn("scene_context", context).withColumn("case_id", F.concat_ws(":", "clip_id", "frame_idx"))


def case_report(cases_: DataFrame, clips: DataFrame, frames: DataFrame) -> DataFrame:
    """Cases with whether their clip and frame are there, and the frame's summary."""
    there = clips.select("clip_id", F.lit(True).alias("artifact_found"))
    own = frames.withColumn("frame_found", F.lit(True))
    out = cases_.join(there, "clip_id", "left").join(own, ["clip_id", "frame_idx"], "left")
    return out.withColumns({"artifact_found": F.coalesce("artifact_found", F.lit(False)), "frame_found": F.coalesce("frame_found", F.lit(False))})


def category_rollup(report: DataFrame) -> DataFrame:
    """Per category (a case counts in each of its own, or as uncategorized): counts, totals, averages over all its cases."""
    own = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("uncategorized")))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return report.withColumn("category", F.explode(own)).groupBy("category").agg(
        F.count("*").alias("case_count"),
        F.count_if("artifact_found").alias("artifact_found_count"),
        F.count_if("frame_found").alias("frame_found_count"),
        total("detections").alias("detection_total"),
        total("active").alias("active_total"),
        total("synthesized").alias("synthesized_total"),
        F.coalesce(F.max("speed_max"), F.lit(0.0)).alias("speed_max_seen"),
        F.round(total("detections") / F.count("*"), 3).alias("avg_detections"),
        F.round(total("active") / F.count("*"), 3).alias("avg_active"),
    )


def category_signals(categories_: Column) -> Column:
    """The signals that categories ask for, each once, in order; three by default."""
    table = F.create_map(*[x for k, v in SIGNALS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.array_distinct(F.flatten(F.transform(F.filter(categories_, lambda c: F.map_contains_key(table, c)), lambda c: table[c])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, ["detection_count", "active_candidate_count", "track_ids"])))


def first_match(truth: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("track_id",), within_ms: int = MATCH_MS) -> DataFrame:
    """Each ground-truth row with ``f``, the first found row (by ``ord``) of the same keys less than ``within_ms`` away, or null.

    Times are put into buckets of that width, and only the own and the two next buckets are compared.  Only keys, times
    and ``ord`` are compared; the other columns of the found rows are fetched for the matches.  Of found rows with equal
    ``ord`` the earliest is taken, then the one that sorts first by its other columns.
    """
    at = [*keys, "t_ms"]
    buckets = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("t_ms") / within_ms) + k)
    moments = truth.select(*at).distinct().withColumn("bucket", F.explode(buckets))
    near = F.abs(F.col("t_ms") - F.col("f_ms")) < within_ms
    slim = found.select(*keys, "ord", F.col("t_ms").alias("f_ms"), F.floor(F.col("t_ms") / within_ms).alias("bucket"))
    first = moments.join(slim, [*keys, "bucket"]).where(near).groupBy(*at).agg(F.min("ord").alias("ord"))
    rest = [c for c in found.columns if c not in (*at, "ord")]
    fetched = first.join(found.withColumnRenamed("t_ms", "f_ms"), [*keys, "ord"]).where(near).repartition(*at)  # so that a group is one from the start
    matched = fetched.groupBy(*at).agg(F.min(F.struct("ord", "f_ms", *rest)).alias("f"))
    return truth.join(matched, at, "left").select(*truth.columns, "f")


def _flat(pose: Column) -> Column:
    """A pose as one array of x and y in turn, which needs less than half the memory of an array of pairs."""
    return F.flatten(F.transform(pose, lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def _pairs(flat: Column) -> Column:
    """The pose of such an array."""
    return F.transform(F.filter(F.transform(flat, lambda x, i: i), lambda i: i % 2 == 0), lambda i: F.array(F.get(flat, i), F.get(flat, i + 1)))


def correct_joints(a: Column, b: Column, threshold: float = PCK) -> Column:
    """Share of joints that are closer than the threshold; null without joints."""
    near = F.aggregate(F.zip_with(a, b, lambda p, q: F.when(F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) < threshold, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, near / F.size(a))


def benchmark_totals(truth: DataFrame, found: DataFrame, by: list[str], within_ms: int = MATCH_MS) -> DataFrame:
    """Per group: samples, matches, id_accuracy and avg_pck of ground truth against found players.

    ``truth``: ``by``, track_id, t_ms, type, label, pose; ``found``: track_id, t_ms, ord, pose, and ``by`` if tracks of
    several groups share their ids.  A sample matches the first found row (as ``first_match``).  id_accuracy is the
    share of all matches that are an ``id_verification`` labelled ``correct``; avg_pck is the mean share of correct
    joints over matches where both have a pose.  Both are 0 without such matches.  Repeated samples count each.
    """
    keys = ("track_id", *(c for c in by if c in found.columns and c != "track_id"))
    flat = [df.withColumn("pose", _flat(F.col("pose"))) for df in (truth, found.select(*keys, "t_ms", "ord", "pose"))]
    matched = first_match(*flat, keys, within_ms).withColumn("pck", correct_joints(_pairs(F.col("pose")), _pairs(F.col("f.pose"))))
    right = F.col("f").isNotNull() & (F.col("type") == "id_verification") & (F.col("label") == "correct")
    sums = matched.groupBy(*by).agg(F.count("*").alias("samples"), F.count("f").alias("matches"), F.count_if(right).alias("__right"), F.sum("pck").alias("__pck"), F.count("pck").alias("__posed"))
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return sums.select(*by, "samples", "matches", share("__right", "matches").alias("id_accuracy"), share("__pck", "__posed").alias("avg_pck"))


def nearest_frames(moments: DataFrame, frames: DataFrame, reach_ms: int = 1000) -> DataFrame:
    """For each moment (clip_id, t_ms) the frame nearest in time, of equally near ones the first.

    The frames are a sorted union with the moments: the last frame before and the first after are found by windows, so
    there is no comparison of pairs and no limit of distance.
    """
    m = moments.select("clip_id", F.col("t_ms"), F.lit(1).alias("is_moment"), F.lit(None).cast("struct<t:long,f:long>").alias("s"), "moment_id")
    f = frames.select("clip_id", "t_ms", F.lit(0).alias("is_moment"), F.struct(F.col("t_ms").alias("t"), F.col("frame_idx").alias("f")).alias("s"), F.lit(None).cast("long").alias("moment_id"))
    w = Window.partitionBy("clip_id").orderBy("t_ms", "is_moment", "s.f")
    back = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    u = f.union(m).withColumns({"before": back, "after": ahead}).where("is_moment = 1")
    nearer = F.col("after").isNotNull() & (F.col("before").isNull() | (F.col("after.t") - F.col("t_ms") < F.col("t_ms") - F.col("before.t")))
    return u.withColumn("n", F.when(nearer, F.col("after")).otherwise(F.col("before"))).select("clip_id", "moment_id", "t_ms", F.col("n.f").alias("frame_idx"))


def feedback_problem(row_checks: dict[str, Column]) -> Column:
    """The first failed check of feedback rows, in order; null if all hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(row_checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def validated_feedback(feedback: DataFrame, frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """Feedback with the first reason to refuse it: missing_field, issue_type, clip, frame, track (null: accepted).

    clip_id, frame_idx, t_ms, issue_type and timestamp must be there (null counts as missing); a note need not.  A track
    that is null or empty stands for none; others must be in the frame, compared as text.
    """
    clips = frames.select("clip_id").distinct().withColumn("__clip", F.lit(True))
    f = feedback.join(clips, "clip_id", "left").join(frames.select("clip_id", "frame_idx").distinct().withColumn("__frame", F.lit(True)), ["clip_id", "frame_idx"], "left")
    named = tracks.select("clip_id", "frame_idx", F.col("track_id").cast("string").alias("__track_id")).distinct().withColumn("__track", F.lit(True))
    f = f.withColumn("__track_id", F.col("track_id").cast("string")).join(named, ["clip_id", "frame_idx", "__track_id"], "left")
    fields = F.lit(True)
    for c in ("clip_id", "frame_idx", "t_ms", "issue_type", "timestamp"):
        fields = fields & F.col(c).isNotNull()
    none = F.coalesce(F.col("__track_id"), F.lit("")) == ""
    checks = {"missing_field": fields, "issue_type": F.col("issue_type").isin(ISSUE_TYPES), "clip": F.col("__clip"), "frame": F.col("__frame"), "track": none | F.col("__track")}
    return f.withColumn("problem", feedback_problem(checks)).select(*feedback.columns, "problem")


def signal_table(spark: SparkSession) -> DataFrame:
    """Categories and their signals as rows: category, place, signal."""
    return spark.createDataFrame([(c, i, s) for c, v in SIGNALS.items() for i, s in enumerate(v)], "category string, place int, signal string")
