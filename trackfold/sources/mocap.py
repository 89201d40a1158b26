"""Motion capture: skeleton and motion text files, forward kinematics level by level."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import EPSILON, let, norm2, resampled
from ..operators.features import STEPS
from ..operators.synthetic import capture_samples

CM_PER_INCH = 2.54
# Bones of the 17 joints behind the five of the head, in order.
COCO_BONES = ["lhumerus", "rhumerus", "lradius", "rradius", "lwrist", "rwrist", "lfemur", "rfemur", "ltibia", "rtibia", "lfoot", "rfoot"]
_WANTED = ["head", *COCO_BONES]
# Nose, eyes and ears as (steps forward from the head, offset).
HEAD = [(5.0, (0, 0, 0)), (4.0, (-2, 0, 2)), (4.0, (2, 0, 2)), (2.0, (-5, 0, 1)), (2.0, (5, 0, 1))]

# The takes of a dataset: skeleton file, motion file, label.
TAKES = [
    ("06.asf", "06_15.amc", "jump_shot"),
    ("06.asf", "06_11.amc", "crossover"),
    ("124.asf", "124_01.amc", "idle_bystander"),
    ("124.asf", "124_02.amc", "idle_bystander"),
    ("102.asf", "102_01.amc", "idle_bystander"),
]


@dataclass
class Bone:
    """A bone: unit direction, length, own axes as a rotation, degrees of freedom, parent."""

    name: str
    direction: np.ndarray
    length: float
    basis: np.ndarray
    dof: list[str]
    parent: str = ""


@dataclass
class Skeleton:
    """Root channels, its axes and pose, and the bones from the root outwards."""

    order: list[str]
    axes: list[str]
    position: np.ndarray
    orientation: np.ndarray
    bones: list[Bone] = field(default_factory=list)


def turns(order: list[str], degrees: np.ndarray) -> np.ndarray:
    """Rotations about the axes of ``order`` (rx, ry, rz), one after the other: a stack for the rows of angles."""
    out = np.broadcast_to(np.eye(3), (len(degrees), 3, 3))
    for axis, column in zip(order, np.radians(degrees).T, strict=True):
        k = "xyz".index(axis[1])
        i, j = (k + 1) % 3, (k + 2) % 3
        turn = np.zeros((len(degrees), 3, 3))
        turn[:, k, k] = 1.0
        turn[:, i, i] = turn[:, j, j] = np.cos(column)
        turn[:, j, i] = np.sin(column)
        turn[:, i, j] = -turn[:, j, i]
        out = out @ turn
    return out


def _fields(block: str) -> dict[str, list[str]]:
    return {w[0]: w[1:] for line in block.splitlines() if (w := line.split())}


def parse_skeleton(text: str) -> Skeleton:
    """A skeleton file's root, bones and hierarchy; bones are put parents first.  A missing section raises."""
    sections = {m[1]: m[2] for m in re.finditer(r"^:(\w+)[ \t]*(.*?)(?=^:|\Z)", text, re.S | re.M)}
    for name in ("root", "bonedata", "hierarchy"):
        if name not in sections:
            raise ValueError(f"the skeleton has no section {name}")
    r = _fields(sections["root"])
    skeleton = Skeleton([w.lower() for w in r["order"]], [f"r{c.lower()}" for c in r["axis"][0]], np.array(r["position"], float), np.array(r["orientation"], float))
    bones: dict[str, Bone] = {}
    for block in re.findall(r"begin\s(.*?)\bend", sections["bonedata"], re.S):
        b = _fields(block)
        d = np.array(b["direction"], float)
        angle = dict(zip("xyz", map(float, b["axis"][:3]), strict=True))
        axes = b["axis"][3].lower()
        basis = turns([f"r{c}" for c in axes], np.array([[angle[c] for c in axes]]))[0]
        name = b["name"][0]
        bones[name] = Bone(name, d / n if (n := np.linalg.norm(d)) > 0 else d, float(b["length"][0]), basis, b.get("dof", []))
    for line in re.search(r"begin\s(.*?)\bend", sections["hierarchy"], re.S)[1].splitlines():
        parent, *children = line.split() or [""]
        for child in children:
            if child in bones:
                bones[child].parent = parent
    level = ["root"]
    while level:
        found = [b for b in bones.values() if b.parent in level]
        skeleton.bones += found
        level = [b.name for b in found]
    return skeleton


def read_motion(spark: SparkSession, path: str, steps: int | None = None) -> DataFrame:
    """(file, frame, bones): a row for each frame of motion files, with bone and channels of its lines in order.

    A line of digits begins a frame; lines before the first, comments and directives are left out.  Each file is one
    text value that is split in order, so frames need no global line numbers.  ``steps``: of a file with more frames only
    that many, at evenly spaced places in the order of their numbers; the others' lines are not parsed.
    """
    cut = F.filter(F.split(F.regexp_replace("value", r"\r", ""), r"(?m)^\s*(?=\d+\s*$)"), lambda b: b.rlike(r"^\d+\s*(\n|$)"))
    if steps is not None:
        numbered = F.transform(cut, lambda b, i: F.struct(F.regexp_extract(b, r"^\d+", 0).cast("long").alias("frame"), i.alias("i"), b.alias("block")))
        cut = let(F.array_sort(numbered), lambda n: F.transform(resampled(n, steps), lambda x: x["block"]))
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(cut).alias("block"))
    blocks = text.withColumn("lines", F.split("block", "\n"))
    worded = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda line: F.trim(line).rlike(r"^[^#:\s]"))
    words = F.transform(worded, lambda line: F.split(F.trim(line), r"\s+"))
    bones = F.transform(words, lambda w: F.struct(w[0].alias("bone"), F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x: x.cast("double")).alias("channels")))
    return blocks.select("file", F.trim(F.get("lines", F.lit(0))).cast("long").alias("frame"), bones.alias("bones"))


def channel_matrix(bones: pa.ListArray, name: str, default: np.ndarray) -> np.ndarray:
    """A bone's channels in each frame (rows), defaults where a frame does not give them; of repeated lines the last counts."""
    lines, n = bones.flatten(), len(bones)
    frame = np.repeat(np.arange(n), bones.value_lengths().to_numpy(zero_copy_only=False))
    at = np.flatnonzero(pc.fill_null(pc.equal(lines.field("bone"), name), False).to_numpy(zero_copy_only=False))
    last = np.full(n, -1)
    last[frame[at]] = at
    here = np.flatnonzero(last >= 0)
    out = np.tile(default, (n, 1)).astype(float)
    channels = lines.field("channels")
    size = channels.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    values = channels.flatten().to_numpy(zero_copy_only=False)
    for c in range(len(default)):
        given = here[size[last[here]] > c]
        out[given, c] = values[begin[last[given]] + c]
    return out


def pose_stacks(skeleton: Skeleton, channels: dict[str, np.ndarray], n: int) -> np.ndarray:
    """World positions (frames x nodes x 3) of the root and all bones in centimetres, for stacks of channels by bone.

    Bones of one level hang on bones that are done, so a level is one product of stacks for all frames.  y and z change
    places in the root's translation.
    """
    root = dict(zip(skeleton.order, channels["root"].T, strict=True))
    still = dict(zip(("tx", "ty", "tz", "rx", "ry", "rz"), [*skeleton.position, *skeleton.orientation], strict=True))
    of = lambda c: root[c] if c in root else np.full(n, still[c])
    number = {"root": 0} | {b.name: i for i, b in enumerate(skeleton.bones, 1)}
    at, turned = np.zeros((n, len(number), 3)), np.zeros((n, len(number), 3, 3))
    at[:, 0] = np.stack([of("tx"), of("tz"), of("ty")], 1) * CM_PER_INCH
    turned[:, 0] = turns(skeleton.axes, np.stack([of(a) for a in skeleton.axes], 1))
    level = ["root"]
    while bones := [b for b in skeleton.bones if b.parent in level]:
        own, above = [number[b.name] for b in bones], [number[b.parent] for b in bones]
        offset = np.stack([b.direction * b.length * CM_PER_INCH for b in bones])
        local = np.stack([b.basis @ turns(b.dof, channels[b.name]) @ b.basis.T for b in bones], 1)
        parents = turned[:, above]
        at[:, own] = at[:, above] + np.einsum("nbij,bj->nbi", parents, offset)
        turned[:, own] = parents @ local
        level = [b.name for b in bones]
    return at


def _positions(skeleton: Skeleton) -> Callable[[pa.ListArray], np.ndarray]:
    """The positions (as ``pose_stacks``) of the frames of a batch, from their lines of bones."""
    still = dict(zip(("tx", "ty", "tz", "rx", "ry", "rz"), [*skeleton.position, *skeleton.orientation], strict=True))
    default = {b.name: np.zeros(len(b.dof)) for b in skeleton.bones} | {"root": np.array([still.get(c, 0.0) for c in skeleton.order])}
    return lambda bones: pose_stacks(skeleton, {b: channel_matrix(bones, b, d) for b, d in default.items()}, len(bones))


def solved(motion: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(file, frame, bone, x, y, z): forward kinematics of the frames of ``read_motion``, all frames of a batch at once."""
    names, positions = ["root", *(b.name for b in skeleton.bones)], _positions(skeleton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            xyz = positions(batch.column("bones")).reshape(-1, 3)
            each = pa.array(np.repeat(np.arange(n), len(names)))
            columns = [batch.column("file").take(each), batch.column("frame").take(each), pa.array(names * n), *(pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "frame", "bone", "x", "y", "z"])

    return motion.select("file", "frame", "bones").mapInArrow(run, "file string, frame long, bone string, x double, y double, z double")


def coco_poses(bones: DataFrame) -> DataFrame:
    """(file, frame, joints): the bones of each frame as 17 joints; null where one of the bones is missing."""
    at = F.map_from_entries(F.collect_list(F.when(F.col("bone").isin(_WANTED), F.struct("bone", F.array("x", "y", "z")))))
    d = bones.groupBy("file", "frame").agg(at.alias("at"))
    return _with_joints(d, lambda b: F.try_element_at("at", F.lit(b)), F.size(F.map_keys("at")) == len(_WANTED))


def solved_poses(motion: DataFrame, skeleton: Skeleton) -> DataFrame:
    """``coco_poses`` of ``solved`` motion without an exchange: a frame stays one row, its positions one array."""
    names, positions = ["root", *(b.name for b in skeleton.bones)], _positions(skeleton)
    place = {b: i for i, b in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                flat = np.ascontiguousarray(positions(batch.column("bones"))).reshape(-1)
                at = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 3 * len(names), dtype=np.int32), pa.array(flat))
                assert len(at) == n
                yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("frame"), at], names=["file", "frame", "at"])

    d = motion.select("file", "frame", "bones").mapInArrow(run, "file string, frame long, at array<double>")
    nowhere = F.array(*[F.lit(None).cast("double")] * 3)
    return _with_joints(d, lambda b: F.array(*[F.col("at")[3 * place[b] + i] for i in range(3)]) if b in place else nowhere, F.lit(place.keys() >= set(_WANTED)))


def _with_joints(d: DataFrame, at: Callable[[str], Column], whole: Column) -> DataFrame:
    """(file, frame, joints) of rows whose bones are ``at`` places; null unless they are ``whole``.

    The joints of the head are set off forward, at right angles to the shoulders.
    """
    left, right, head = (at(b) for b in ("lhumerus", "rhumerus", "head"))
    across = [right[i] - left[i] for i in range(3)]
    width = F.sqrt(across[0] * across[0] + across[1] * across[1] + across[2] * across[2]) + EPSILON
    d = d.withColumns({"fx": -across[1] / width, "fy": across[0] / width})
    length = norm2(F.col("fx"), F.col("fy")) + EPSILON
    d = d.withColumns({"fx": F.col("fx") / length, "fy": F.col("fy") / length})
    face = [F.array(head[0] + F.col("fx") * step + off[0], head[1] + F.col("fy") * step + off[1], head[2] + off[2]) for step, off in HEAD]
    joints = F.array(*face, *[at(b) for b in COCO_BONES])
    return d.select("file", "frame", F.when(whole, joints).alias("joints"))


def capture_dataset(spark: SparkSession, folder: str, takes: list[tuple[str, str, str]] = TAKES) -> DataFrame:
    """Training samples of the takes (skeleton file, motion file, label) whose files are both there; the others are warned of."""
    out = None
    for skeleton_file, motion_file, label in takes:
        try:
            text = spark.read.text(f"{folder}/{skeleton_file}", wholetext=True).first()[0]
            motion = read_motion(spark, f"{folder}/{motion_file}", STEPS)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            warnings.warn(f"take without files: {skeleton_file}/{motion_file}", stacklevel=2)
            continue
        made = capture_samples(solved_poses(motion, parse_skeleton(text)), label).drop("file")
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], "label string, schema_version string, features_v2 array<array<double>>") if out is None else out
