"""All review passes over a clip's detections, in the order that their results depend on.

smooth, active, continuity, appearance, active, repair, smooth, active, jersey, live play: the second smoothing sees the
rows that repair made, and the second and third scores of active players see the appearance distances.  What several
later passes read is written to the shared folder, so that no pass is computed again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import saved
from . import appearance, continuity, identity, liveplay, tracks
from .policy import IdentityPolicy

KEYS = ["clip_id", "track_id", "frame_idx"]


@dataclass
class Annotated:
    """Detections and frames after all passes, and the identity links that repair used."""

    detections: DataFrame
    frames: DataFrame
    links: DataFrame


def _smoothed(d: DataFrame, fps: float) -> DataFrame:
    s = tracks.smooth_motion(d.select(*KEYS, "x", "y", "w", "h"), fps).select(*KEYS, "svx", "svy", F.col("motion_speed").alias("speed"))
    return d.drop("svx", "svy", "speed").join(s, KEYS)


def _active(d: DataFrame, width: int, height: int) -> DataFrame:
    boxed = d.drop("active", "n_frames", "x1", "y1", "x2", "y2").withColumns({"x1": F.col("x") - F.col("w") / 2, "y1": F.col("y") - F.col("h") / 2, "x2": F.col("x") + F.col("w") / 2, "y2": F.col("y") + F.col("h") / 2})
    return appearance.with_active(boxed, tracks.frame_counts(boxed), width, height)


def annotate(detections: DataFrame, signatures: DataFrame, balls: DataFrame, reads: DataFrame, width: int, height: int, fps: float, policy: IdentityPolicy = IdentityPolicy()) -> Annotated:
    """``detections``: one row for each track of a frame: clip_id, track_id, frame_idx, slot, x, y, w, h, conf, court_x, court_y, uniform, hist.

    ``signatures``: clip_id, frame_idx, signature; ``balls``: clip_id, frame_idx, conf; ``reads``: clip_id, track_id,
    frame_idx, slot, read, conf, sharpness.
    """
    d = saved(_active(_smoothed(detections.withColumn("appearance_distance", F.lit(None).cast("double")), fps), width, height))
    frames = saved(continuity.with_segments(continuity.frame_tracks(d).join(signatures, ["clip_id", "frame_idx"], "left"), policy=policy))
    d = d.join(frames.select("clip_id", "frame_idx", F.col("continuity_segment").alias("segment")), ["clip_id", "frame_idx"])
    d = appearance.with_team(d, appearance.prototypes(d)).withColumn("appearance_distance", F.col("team_distance"))
    d = saved(_active(d, width, height))

    ends = d.select(*KEYS, "x", "y", "w", "h", F.col("svx").alias("vx"), F.col("svy").alias("vy"), "court_x", "court_y", "uniform", "conf", F.col("active.candidate").alias("active"), "segment")
    links = saved(identity.selected(identity.candidates(ends, policy.link, fps=fps, policy=policy)))
    names = identity.canonical_ids(links)
    filled = tracks.fill_gaps(ends, policy.max_gap, segment="segment" if policy.reset else None).where(F.lit(policy.fill))
    bridges = identity.bridged(ends, links, names).withColumnRenamed("identity", "track_id")
    made = filled.unionByName(bridges).withColumn("synthesized", F.lit(True))
    named = d.join(names, ["clip_id", "track_id"], "left").withColumn("track_id", F.coalesce("canonical", "track_id")).withColumn("synthesized", F.lit(False)).drop("canonical")
    # two tracks of one identity in a frame: the row of the lower slot stays
    first = named.groupBy(*KEYS).agg(F.min("slot").alias("slot"))
    d = named.join(first, [*KEYS, "slot"]).unionByName(made, allowMissingColumns=True)
    d = saved(d.withColumn("conf", F.coalesce("conf", F.lit(0.5))))
    d = saved(_active(_smoothed(d, fps), width, height))

    evidence = reads.withColumn("number", appearance.jersey_text(F.col("read"))).where(F.col("number").isNotNull() & (F.col("sharpness") >= 25))
    evidence = evidence.join(names, ["clip_id", "track_id"], "left").withColumn("track_id", F.coalesce("canonical", "track_id")).drop("canonical")
    jerseys = appearance.jersey_consensus(appearance.top_evidence(evidence, ("clip_id", "track_id")), ("clip_id", "track_id"))
    d = d.join(jerseys.select("clip_id", "track_id", F.col("number").alias("jersey")), ["clip_id", "track_id"], "left")

    rows = d.select(
        "clip_id",
        "frame_idx",
        F.col("active.candidate").alias("active"),
        "speed",
        F.col("svx").alias("vx"),
        F.col("svy").alias("vy"),
        F.col("active.in_bounds").alias("in_bounds"),
        (F.col("active.edge") >= 0.15).alias("edge"),
        (F.col("active.appearance") > 0).alias("mismatch"),
        F.col("synthesized").alias("changed"),
    )
    m = liveplay.frame_metrics(rows).join(balls.select("clip_id", "frame_idx", F.col("conf").alias("ball_conf")), ["clip_id", "frame_idx"], "left")
    m = m.withColumn("t_ms", F.floor(F.col("frame_idx") * 1000 / fps).cast("long"))
    played = liveplay.with_state(liveplay.with_score(m))
    played = played.join(frames.select("clip_id", "frame_idx", "continuity_segment"), ["clip_id", "frame_idx"], "left")
    return Annotated(d, played, links)
