"""Kinematic rules over windows of poses: each rule is a Column, the label is the first rule that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, WINDOW = 15, 30
# Joints that a name means (COCO order), and the rules in order: (label, kind, needs the ball, predicates);
# a fifth value asks for a controlled ball.
JOINTS = {"hips": [11, 12], "wrists": [9, 10], "head": [0], "shoulders": [5, 6], "ankles": [15, 16]}
OVERHEAD = ("wrists", "pos_y", "<", "head")
RULES = [
    ("idle_bystander", "kinematic", False, [("hips", "velocity_z", "<", 0.001)]),
    ("crossover", "kinematic", False, [("wrists", "velocity_x", ">", 0.05)]),
    ("jump_shot", "kinematic", True, [("hips", "velocity_z", ">", 0.02), OVERHEAD]),
    ("dunk", "kinematic", False, [OVERHEAD, ("hips", "velocity_y", "<", -0.05)]),
    ("layup", "kinematic", False, [OVERHEAD]),
    ("euro_step_left", "kinematic", False, [("hips", "velocity_x", "<", -0.02)]),
    ("euro_step_right", "kinematic", False, [("hips", "velocity_x", ">", 0.02)]),
    ("pass_chest", "kinematic", False, [("wrists", "velocity_z", ">", 0.05)]),
    ("block", "kinematic", False, [OVERHEAD]),
    ("steal", "kinematic", False, [("wrists", "velocity_x", ">", 0.02)]),
    ("rebound", "kinematic", False, [OVERHEAD, ("hips", "velocity_y", "<", -0.05)]),
    ("travel", "violation", False, [("ankles", "steps_since_dribble", ">", 2)]),
    ("step_back", "kinematic", False, [("hips", "velocity_y", "<", -0.05)]),
]


def ordered(rules: list = RULES) -> list:
    """Rules in the order of evaluation: kinematic rules, signals and all others are three groups, the first-seen group is first."""
    group = lambda r: r[1] if r[1] in ("kinematic", "signal") else "other"
    groups = list(dict.fromkeys(map(group, rules)))
    return sorted(rules, key=lambda r: groups.index(group(r)))


def joint_mean(pose: Column, joint: str, axis: int) -> Column:
    """Mean coordinate of a named joint in a pose."""
    at = JOINTS[joint]
    total = F.get(pose, F.lit(at[0]))[axis]
    for k in at[1:]:
        total = total + F.get(pose, F.lit(k))[axis]
    return total / len(at)


class PoseList:
    """What the predicates ask of a window, from the list of its poses."""

    def __init__(self, poses: Column):
        self.poses, self.count = poses, F.size(poses)

    def first(self, joint: str, axis: int) -> Column:
        return joint_mean(F.get(self.poses, F.lit(0)), joint, axis)

    def last(self, joint: str, axis: int) -> Column:
        return joint_mean(F.try_element_at(self.poses, F.lit(-1)), joint, axis)

    def share_above(self, joint: str, other: str) -> Column:
        """Share of poses in which a joint is higher in the image (its y is smaller) than another."""
        return F.size(F.filter(self.poses, lambda p: joint_mean(p, joint, 1) < joint_mean(p, other, 1))) / self.count


class PoseFrame:
    """The same from window columns: each row has the means of the joints of its own pose, and no pose is gathered."""

    def __init__(self, rules: list):
        asked = [(p[0], p[1], p[3]) for r in rules for p in r[3] if p[0] in JOINTS]
        speeds = {"velocity_x": 0, "velocity_y": 1, "velocity_z": 1}
        self.above = sorted({(joint, other) for joint, metric, other in asked if metric == "pos_y" and other in JOINTS})
        self.means = sorted({(joint, speeds[metric]) for joint, metric, _ in asked if metric in speeds} | {(j, 1) for pair in self.above for j in pair})
        self.count = F.col("__n")

    def columns(self, rows: DataFrame, w) -> DataFrame:
        posed = F.col("pose").isNotNull()
        means = [joint_mean(F.col("pose"), j, a).alias(f"{j}_{a}") for j, a in self.means]
        d = rows.withColumn("__means", F.when(posed, F.struct(F.lit(True).alias("posed"), *means)))
        counts = {f"__above_{j}_{o}": F.count_if(F.col(f"__means.{j}_1") < F.col(f"__means.{o}_1")).over(w) for j, o in self.above}
        return d.withColumns({"__first": F.first("__means", ignorenulls=True).over(w), "__last": F.last("__means", ignorenulls=True).over(w), "__n": F.count("pose").over(w), **counts})

    def dropped(self, rows: DataFrame) -> DataFrame:
        return rows.drop("__means", "__first", "__last", "__n", *(f"__above_{j}_{o}" for j, o in self.above))

    def first(self, joint: str, axis: int) -> Column:
        return F.col(f"__first.{joint}_{axis}")

    def last(self, joint: str, axis: int) -> Column:
        return F.col(f"__last.{joint}_{axis}")

    def share_above(self, joint: str, other: str) -> Column:
        return F.col(f"__above_{joint}_{other}") / self.count


def predicate(window: PoseList | PoseFrame, joint: str, metric: str, operator: str, value) -> Column:
    """Whether a predicate holds over a window of poses; one with an unknown joint or metric is skipped (true).

    Vertical speeds are differences of image y, so up is negative: ``>`` asks for less than minus the threshold, ``<``
    for more than the threshold; a horizontal ``<`` asks for less than minus the threshold.
    """
    if joint not in JOINTS:
        return F.lit(True)
    if metric in ("velocity_z", "velocity_y"):
        v = window.last(joint, 1) - window.first(joint, 1)
        return v < -value if operator == ">" else v > value
    if metric == "velocity_x":
        v = window.last(joint, 0) - window.first(joint, 0)
        return v > value if operator == ">" else v < -value
    if metric == "pos_y" and operator == "<" and value in JOINTS:
        return window.share_above(joint, value) > 0.6
    return F.lit(True)


def holds(rule: tuple, window: PoseList | PoseFrame, possession: Column, controlled: Column | None = None) -> Column:
    """Whether a rule holds: at least LEAST poses, its preconditions (an unknown possession or control fails), and all predicates."""
    out = window.count >= LEAST
    if rule[2]:
        out = out & F.coalesce(possession, F.lit(False))
    if len(rule) > 4 and rule[4]:
        out = out & (F.lit(False) if controlled is None else F.coalesce(controlled, F.lit(False)))
    for p in rule[3]:
        out = out & F.coalesce(predicate(window, *p), F.lit(True))
    return out


def label(poses: Column | PoseFrame, possession: Column, learned: Column | None = None, rules: list = RULES, controlled: Column | None = None) -> Column:
    """A learned label that is not idle wins; else the first rule that holds; else idle.  ``poses``: a list of poses, or a frame."""
    window = poses if isinstance(poses, PoseFrame) else PoseList(poses)
    out = F.lit("idle_bystander")
    for r in reversed(ordered(rules)):
        out = F.when(holds(r, window, possession, controlled), r[0]).otherwise(out)
    return out if learned is None else F.when(learned.isNotNull() & (learned != "idle_bystander"), learned).otherwise(out)


def with_labels(rows: DataFrame, learned: str | None = None, rules: list = RULES, controlled: str | None = None) -> DataFrame:
    """Rows of poses (clip_id, track_id, frame_idx, pose, possession) with the label of their last WINDOW rows' poses.

    Every predicate is a window column (first, last, or a count) over the means of a row's joints.  Null poses count for
    nothing.
    """
    w = Window.partitionBy("clip_id", "track_id").orderBy("frame_idx").rowsBetween(-(WINDOW - 1), 0)
    frame = PoseFrame(rules)
    found = label(frame, F.col("possession"), F.col(learned) if learned else None, rules, F.col(controlled) if controlled else None)
    return frame.dropped(frame.columns(rows, w).withColumn("label", found))
