"""Active players, uniforms, colour histograms and jersey numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clip01

ACTIVE, LOW_MOTION = 0.55, 3.0
BINS = 8


def uniform_bucket(luma: Column) -> Column:
    """light from 150, dark up to 95, else unknown (null counts as unknown)."""
    return F.when(luma >= 150, "light").when(luma <= 95, "dark").otherwise("unknown")


def colour_histogram(r: Column, g: Column, b: Column, *keys: str):
    """Aggregates of pixel rows: the eight shares of colours that are split at 128 in each channel, six places."""
    code = F.when(r >= 128, 4).otherwise(0) + F.when(g >= 128, 2).otherwise(0) + F.when(b >= 128, 1).otherwise(0)
    return F.array(*[F.round(F.count_if(code == k) / F.greatest(F.count("*"), F.lit(1)), 6) for k in range(BINS)])


def histogram_distance(a: Column, b: Column) -> Column:
    """1 minus the shared part of two histograms, six places; null where lengths differ or one is missing."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.round(1.0 - shared, 6))


def edge_penalty(width: int, height: int) -> Column:
    """0.15 near a side border, 0.05 near the top or bottom one (both may apply)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.when((x1 < 0.06 * width) | (x2 > width - 0.06 * width), 0.15).otherwise(0.0) + F.when((y1 < 0.06 * height) | (y2 > height - 0.06 * height), 0.05).otherwise(0.0)


def in_bounds(x: Column, y: Column) -> Column:
    """Whether a court point is within the generous bounds; null if unknown."""
    return x.between(-50, 2890) & y.between(-50, 1575)


def active_player(width: int, height: int) -> Column:
    """Struct score (four places), candidate, in_bounds, edge, appearance of a detection.

    Input columns: x1, y1, x2, y2, conf, court_x, court_y, n_frames, speed, appearance_distance.
    """
    edge = edge_penalty(width, height)
    inside = in_bounds(F.col("court_x"), F.col("court_y"))
    court = F.when(inside.isNull(), 0.0).when(inside, 0.20).otherwise(-0.20)
    speed = F.coalesce(F.col("speed"), F.lit(0.0))
    far = F.col("appearance_distance")
    appearance = F.when((far > 0.42) & (speed <= LOW_MOTION) & (edge >= 0.15), 0.14 * clip01((far - 0.42) / 0.58)).otherwise(0.0)
    tall = clip01(((F.col("y2") - F.col("y1")) / height - 0.08) / 0.18)
    score = clip01(0.35 * clip01(F.col("conf")) + 0.20 * tall - edge + court + 0.10 * F.least(F.col("n_frames"), F.lit(5)) / 5.0 + 0.15 * clip01(speed / 6.0) - appearance)
    return F.struct(F.round(score, 4).alias("score"), (F.round(score, 4) >= ACTIVE).alias("candidate"), inside.alias("in_bounds"), edge.alias("edge"), appearance.alias("appearance"))


def with_active(detections: DataFrame, counts: DataFrame, width: int, height: int) -> DataFrame:
    """Detections with their active-player struct; tracks without a count have one frame."""
    d = detections.join(counts, ["clip_id", "track_id"], "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(1)))
    return d.withColumn("active", active_player(width, height))


def prototypes(detections: DataFrame) -> DataFrame:
    """The mean histogram of each uniform over clear, moving, active detections: clip_id, bucket, prototype."""
    clear = detections.where(F.col("hist").isNotNull() & F.col("active.candidate") & (F.coalesce("speed", F.lit(0.0)) >= LOW_MOTION) & F.coalesce("active.in_bounds", F.lit(True)) & (F.col("active.edge") < 0.15))
    return clear.groupBy("clip_id", F.when(F.col("uniform").isin("dark", "light"), F.col("uniform")).otherwise("unknown").alias("bucket")).agg(F.array(*[F.avg(F.col("hist")[k]) for k in range(BINS)]).alias("prototype"))


def with_team(detections: DataFrame, protos: DataFrame, order: tuple[str, ...] = ("dark", "light", "unknown")) -> DataFrame:
    """Detections with the nearest prototype's bucket and distance; their own uniform wins ties, then ``order``.

    A clip has at most three prototypes: they are joined as one row for each clip, so no pairs of rows arise.
    """
    per_clip = protos.groupBy("clip_id").agg(F.collect_list(F.struct("bucket", "prototype")).alias("__p"))
    d = detections.join(per_clip, "clip_id", "left")
    rank = lambda b: F.when(b == F.col("uniform"), 0).otherwise(F.array_position(F.array(*map(F.lit, order)), b))
    near = F.array_min(F.filter(F.transform("__p", lambda p: F.struct(histogram_distance(F.col("hist"), p["prototype"]).alias("d"), rank(p["bucket"]).cast("int").alias("r"), p["bucket"].alias("bucket"))), lambda s: s["d"].isNotNull()))
    return d.withColumn("__n", near).withColumn("team_bucket", F.col("__n.bucket")).withColumn("team_distance", F.col("__n.d")).drop("__p", "__n")


def jersey_text(text: Column) -> Column:
    """A jersey number 1 to 99 read from text, else null: look-alike letters count as digits, the last two digits stay.

    Text of more than two characters without any digit is no number.
    """
    t = F.upper(F.trim(text))
    digits = F.regexp_replace(F.translate(t, "OILSBZ", "011582"), "[^0-9]", "")
    number = F.right(digits, F.lit(2)).try_cast("int")
    ok = ~((F.length(t) > 2) & ~t.rlike("[0-9]")) & (F.length(digits) > 0)
    return F.when(ok & number.between(1, 99), number.cast("string"))


def best_reads(reads: DataFrame, *crop: str) -> DataFrame:
    """The most confident legible read of each crop (ties: smaller number), of crops with a sharpness of at least 25."""
    r = reads.withColumn("number", jersey_text(F.col("read"))).where(F.col("number").isNotNull() & (F.col("sharpness") >= 25))
    return r.groupBy(*crop).agg(F.max_by(F.struct("number", "conf", "sharpness"), F.struct("conf", (-F.col("number").cast("int")).alias("k"))).alias("b")).select(*crop, "b.*")


def top_evidence(evidence: DataFrame, keys: tuple[str, ...], n: int = 5) -> DataFrame:
    """The sharpest, then most confident rows of each identity (then frame and slot)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("sharpness"), F.desc("conf"), "frame_idx", "slot")
    return evidence.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def jersey_consensus(evidence: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The number with the largest weight of each identity, if it has two votes and 62 percent of the weight; its share is not rounded."""
    weight = F.greatest(F.lit(0.05), F.col("conf") * F.greatest(F.lit(0.2), clip01(F.col("sharpness") / 120.0)))
    # sums of doubles depend on their order: sharpest reads first, then largest weights first
    total = lambda rows: F.aggregate(F.sort_array(rows, asc=False), F.lit(0.0), lambda s, r: s + r["weight"])
    votes = evidence.groupBy(*keys, "number").agg(total(F.collect_list(F.struct("sharpness", "conf", weight.alias("weight")))).alias("weight"), F.count("*").alias("votes"))
    out = votes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("weight", "votes", "number")), asc=False).alias("all"), F.sum("votes").alias("evidence"))
    out = out.select("*", F.get("all", F.lit(0)).alias("b"), total(F.col("all")).alias("total"))
    share = F.col("b.weight") / F.col("total")
    return out.where((F.col("b.votes") >= 2) & (share >= 0.62)).select(*keys, F.col("b.number").alias("number"), F.col("b.votes").alias("votes"), share.alias("share"), "evidence")


def displayed(consensus: DataFrame) -> DataFrame:
    """Numbers that are sure enough to show: a share of 0.9 and three pieces of evidence."""
    return consensus.where((F.col("share") >= 0.9) & (F.col("evidence") >= 3))


def with_identity_fields(detections: DataFrame) -> DataFrame:
    """Detections with the identity columns before any repair: the tracker's own id, not synthesized."""
    return detections.withColumns({"identity_track_id": F.col("track_id"), "identity_track_source": F.lit("tracker"), "identity_repair": F.lit(None).cast("string"), "synthesized": F.lit(False)})
