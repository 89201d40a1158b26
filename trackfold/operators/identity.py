"""Identity repair: links between the end of one track and the start of another, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from ..functions.geometry import clip01
from ..sources.storage import saved
from .components import components, smallest_nodes
from .policy import IdentityPolicy

MARGIN = 0.05
#: Rows of candidates that are put into components together, about; a clip is not cut if it has fewer.
BATCH = 1 << 18
_PART = ["clip_id", "__label", "__batch"]
_ENDS = ["frame_idx", "x", "y", "w", "h", "vx", "vy", "court_x", "court_y", "uniform", "conf", "active", "segment"]


def link_measures(gap: str = "gap", fps: float = 30.0, policy: IdentityPolicy = IdentityPolicy()) -> Column:
    """What a track end (columns ``a_``) and a track start (``b_``) are judged by, as a struct; ``link_score`` wants its fields as columns."""
    A, B = (lambda f: F.col(f"a_{f}")), (lambda f: F.col(f"b_{f}"))  # noqa: N806
    elapsed = (F.col(gap) + 1) * max(1.0 / fps, 0.001)
    distance = F.sqrt((A("x") + A("vx") * elapsed - B("x")) ** 2 + (A("y") + A("vy") * elapsed - B("y")) ** 2)
    limit = F.greatest(F.lit(40.0), policy.max_ratio * (A("h") + B("h")) / 2)
    ratio = lambda f: F.least(A(f), B(f)) / F.greatest(A(f), B(f))
    size = (ratio("w") + ratio("h")) / 2
    sa, sb = F.sqrt(A("vx") ** 2 + A("vy") ** 2), F.sqrt(B("vx") ** 2 + B("vy") ** 2)
    known = A("uniform").isin("dark", "light") & B("uniform").isin("dark", "light")
    on_court = F.sqrt((A("court_x") - B("court_x")) ** 2 + (A("court_y") - B("court_y")) ** 2)
    values = {"distance": distance, "limit": limit, "size": size, "sa": sa, "sb": sb, "dot": A("vx") * B("vx") + A("vy") * B("vy"), "known": known, "on_court": on_court}
    return F.struct(*[v.alias(f"m_{k}") for k, v in values.items()])


def link_score(gap: str = "gap", policy: IdentityPolicy = IdentityPolicy()) -> Column:
    """Score of a track end (columns ``a_``) and a track start (``b_``) with their measures (``m_``); null where a gate rules the link out."""
    A, B, M = (lambda f: F.col(f"a_{f}")), (lambda f: F.col(f"b_{f}")), (lambda f: F.col(f"m_{f}"))  # noqa: N806
    cosine = M("dot") / (M("sa") * M("sb"))
    velocity = F.when((M("sa") > 1) & (M("sb") > 1), clip01((cosine + 1) / 2)).otherwise(F.lit(0.5))
    conflict = F.coalesce(M("known") & (A("uniform") != B("uniform")), F.lit(False))
    uniform = F.when(A("uniform").isNull() | B("uniform").isNull(), 0.0).when(M("known") & (A("uniform") == B("uniform")), 1.0).when((A("uniform") == "unknown") | (B("uniform") == "unknown"), 0.55).otherwise(0.0)
    court = F.when(M("on_court").isNull(), 0.5).otherwise(clip01(1 - M("on_court") / policy.max_court))
    score = (
        0.34 * clip01(1 - M("distance") / M("limit")) + 0.18 * velocity + 0.14 * M("size") + 0.14 * uniform + 0.10 * court + 0.06 * clip01(1 - (F.col(gap) - 1) / float(max(policy.max_gap, 1))) + 0.04 * F.least(A("conf"), B("conf"))
    )
    allowed = A("active") & B("active") & ~conflict & (M("distance") <= M("limit")) & (M("size") >= 0.55) & F.coalesce(M("on_court") <= policy.max_court, F.lit(True))
    return F.when(allowed, F.round(score, 4))


def track_ends(rows: DataFrame) -> DataFrame:
    """First and last row of each track as structs ``head`` and ``tail``."""
    s = F.struct(*_ENDS)
    return rows.groupBy("clip_id", "track_id").agg(F.min(s).alias("head"), F.max(s).alias("tail"))


def candidates(rows: DataFrame, least: float, same_segment: bool | None = None, fps: float = 30.0, policy: IdentityPolicy = IdentityPolicy()) -> DataFrame:
    """Pairs (pred, succ) of tracks of a clip whose gap is 1 to ``policy.max_gap`` frames, scored at least ``least``.

    Both ends lie in one segment if ``same_segment`` says so, or where it is None the policy; if they need not, a column
    ``same_segment`` says whether they do.  A limit of no frames gives no pairs.

    A clip's ends are dealt to one task, once: the starts and ends of a frame become one row, and a window over the frames
    of the clip brings each frame the starts of the frames behind it.
    """
    reach = max(policy.max_gap, 1)
    ends = track_ends(rows).repartition("clip_id").where("clip_id IS NOT NULL")
    side = lambda c: F.struct(F.lit(c).alias("side"), F.col(f"{c}.frame_idx").alias("frame_idx"), F.struct("track_id", f"{c}.*").alias("of"))
    each = ends.select("clip_id", F.inline(F.array(side("tail"), side("head")))).where("frame_idx IS NOT NULL")
    gathered = lambda c: F.collect_list(F.when(F.col("side") == c, F.col("of"))).alias(f"{c}s")
    behind = Window.partitionBy("clip_id").orderBy("frame_idx").rangeBetween(2, reach + 1)
    frames = each.groupBy("clip_id", "frame_idx").agg(gathered("tail"), gathered("head")).withColumn("heads", F.flatten(F.collect_list("heads").over(behind)))
    # flat columns: Spark 4.1 loses columns of chained generators where it prunes structs
    last = frames.select("clip_id", "heads", F.inline("tails").alias("pred", *[f"a_{c}" for c in _ENDS]))
    pairs = last.select("clip_id", *last.columns[2:], F.inline("heads").alias("succ", *[f"b_{c}" for c in _ENDS])).where("pred <> succ")
    pairs = pairs.withColumn("gap", (F.col("b_frame_idx") - F.col("a_frame_idx") - 1).cast("int")).where(F.col("gap") <= policy.max_gap)
    within = F.col("a_segment") == F.col("b_segment")
    must = policy.reset if same_segment is None else same_segment
    if must:
        pairs = pairs.where(within)
    # exploded, so that the optimiser copies neither the measures into the score nor the whole score into the filter: the
    # code of all in one is a method too long to be compiled
    measured = pairs.select("*", F.inline(F.array(link_measures(fps=fps, policy=policy))))
    scored = measured.select("*", F.explode(F.array(link_score(policy=policy))).alias("score")).where(F.col("score") >= least)
    more = [] if must else [F.coalesce(within, F.lit(False)).alias("same_segment")]
    return scored.select("clip_id", "pred", "succ", "gap", F.col("a_frame_idx").alias("end_frame"), F.col("b_frame_idx").alias("start_frame"), "score", *more)


def marked(links: DataFrame) -> DataFrame:
    """Candidates with ``is_selected``: it beats every rival for the same predecessor or successor by more than the margin.

    A greedy choice in score order gives the same: a rival that was chosen before would have vetoed the candidate.
    """
    out = links
    for side in ("pred", "succ"):
        w = Window.partitionBy("clip_id", side).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        best, second = F.first("score").over(w), F.nth_value("score", 2).over(w)
        out = out.withColumns({"__best": best, "__second": second})
        out = out.withColumn(f"__{side}", F.coalesce(F.when(F.col("score") < F.col("__best"), F.col("__best")).otherwise(F.col("__second")), F.lit(0.0))).drop("__best", "__second")
    return out.withColumn("is_selected", (F.col("score") - MARGIN) > F.greatest("__pred", "__succ")).drop("__pred", "__succ")


def selected(links: DataFrame) -> DataFrame:
    """The candidates that ``marked`` selects."""
    return marked(links).where("is_selected").drop("is_selected")


def _node(c: str, side: int) -> Column:
    """The number of a predecessor (side 0) or a successor (1) as a node."""
    return F.col(c).cast("long") * 2 + side


def _unrivalled(ends: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """What ``marked`` says of candidates between numbered ends, among these alone."""
    rival = np.zeros(len(score))
    for end in ends:
        best, second = np.zeros((2, end.max(initial=-1) + 1))
        np.maximum.at(best, end, score)
        leads = score == best[end]
        np.maximum.at(second, end[~leads], score[~leads])
        second = np.where(np.bincount(end[leads], minlength=len(best)) > 1, best, second)
        rival = np.maximum(rival, np.where(leads, second[end], best[end]))
    return (score - MARGIN) > rival


def _clip_numbers(t: pa.Table) -> np.ndarray:
    return pc.dictionary_encode(t.column("clip_id"), null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)


def _by_clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``BATCH`` rows that end where a clip does; a clip of more rows is cut."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            table = pa.Table.from_batches(held).combine_chunks()
            clips = _clip_numbers(table)
            others = np.flatnonzero(clips != clips[-1])
            cut = int(others[-1]) + 1 if len(others) else n
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def with_labels(links: DataFrame, top: int) -> DataFrame:
    """Candidates with the component that they are in among those of their batch.

    ``__label``: its smallest node; predecessors are even numbers, successors odd ones.  ``__batch``: the batch.
    ``__first``: whether it is that component's smallest (pred, succ).  ``__top``: whether its score is not below the
    ``top`` best ones of that component.  If the candidates have ``linked`` (which of them may be links), ``is_selected``
    is added too, as ``marked`` gives it for those of the batch.
    """
    choose = "linked" in links.columns
    rows = links.where("clip_id IS NOT NULL AND pred IS NOT NULL AND succ IS NOT NULL").withColumns({"__a": _node("pred", 0), "__b": _node("succ", 1)})

    def label(batches):
        first = TaskContext.get().partitionId() << 32
        for i, t in enumerate(_by_clips(batches)):
            a, b, score = (pc.fill_null(t.column(c), least).to_numpy() for c, least in (("__a", 0), ("__b", 0), ("score", -np.inf)))
            label, group, ends = smallest_nodes(_clip_numbers(t), a, b)
            worth = np.where(np.isnan(score), np.inf, score)
            smallest, best = np.zeros((2, len(group)), bool)
            order = np.lexsort((b, a, group))
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))  # of each component
            sizes = np.diff(starts, append=len(order))
            smallest[order[starts]] = True
            order = np.lexsort((-worth, group))
            last = worth[order[starts + np.minimum(sizes, max(top, 1)) - 1]]
            best[order] = (worth[order] >= np.repeat(last, sizes)) & (top > 0)
            t = t.drop_columns(["__a", "__b"])
            more = {"__label": label, "__batch": np.full(len(order), first + i), "__first": smallest, "__top": best}
            if choose:
                linked = t.column("linked").to_numpy()
                more["is_selected"] = np.zeros(len(order), bool)
                more["is_selected"][linked] = _unrivalled((ends[0][linked], ends[1][linked]), worth[linked])
            for name, values in more.items():
                t = t.append_column(name, pa.array(values))
            yield from t.to_batches(max_chunksize=10_000)

    out = StructType([*links.schema.fields])
    out.add("__label", LongType()).add("__batch", LongType()).add("__first", BooleanType()).add("__top", BooleanType())
    if choose:
        out.add("is_selected", BooleanType())
    return rows.mapInArrow(label, out)


def _torn(links: DataFrame) -> DataFrame:
    """The clips that lie in several batches."""
    return saved(links.groupBy("clip_id").agg(F.min("__batch").alias("l"), F.max("__batch").alias("h")).where("l < h").select("clip_id"))


def _chosen(links: DataFrame, torn: DataFrame) -> DataFrame:
    """Candidates whose ``is_selected`` holds for the whole clip, not for the batch alone."""
    split = links.join(torn, "clip_id", "left_semi")
    again = saved(marked(split.where("linked").drop("is_selected")))
    return links.join(torn, "clip_id", "left_anti").unionByName(split.where("NOT linked")).unionByName(again)


def _torn_labels(links: DataFrame, torn: DataFrame) -> DataFrame:
    """(clip_id, __label, __root): the smallest node of a label's group, for the clips that lie in several batches."""
    ends = links.join(torn, "clip_id", "left_semi").select(F.col("clip_id").alias("part"), F.explode(F.array(_node("pred", 0), _node("succ", 1))).alias("a"), F.col("__label").alias("b"))
    ends = saved(ends.distinct())
    labels = ends.select("part", F.col("b").alias("node")).distinct()
    return saved(components(ends).join(labels, ["part", "node"]).toDF("clip_id", "__label", "__root"))


def _groups(links: DataFrame, torn: DataFrame, **more: tuple[Column, Callable]) -> DataFrame:
    """For each component of a batch its group's ``group_key`` and ``more``: an aggregate of it, put together over the group by the function.

    No aggregate is a struct, so that Spark aggregates by hash and does not sort all candidates.
    """
    first = {c: F.min(F.when(F.col("__first"), F.col(c))).alias(c) for c in ("pred", "succ")}
    parts = links.groupBy(*_PART).agg(*first.values(), *[of_part.alias(c) for c, (of_part, _) in more.items()])
    named = parts.join(_torn_labels(links, torn), ["clip_id", "__label"], "left").withColumn("__root", F.coalesce("__root", "__label"))
    g = Window.partitionBy("clip_id", "__root")
    key = F.min(F.struct("pred", "succ")).over(g)
    return named.select(*_PART, key.alias("group_key"), *[of_group(c).over(g).alias(c) for c, (_, of_group) in more.items()])


def hypothesis_groups(links: DataFrame) -> DataFrame:
    """Candidates with the group of those that share a predecessor or successor with each other, over any number of steps.

    Ends are nodes (a predecessor an even number, a successor an odd one), candidates are edges, and groups are their
    components: those of batches first, and only what lies in several batches is contracted further.  The label is the
    smallest (pred, succ) of the group.
    """
    found = saved(with_labels(links, 0))
    return found.join(_groups(found, _torn(found)), _PART).drop("__label", "__batch", "__first", "__top")


def hypotheses(links: DataFrame, chosen: DataFrame | None = None, policy: IdentityPolicy = IdentityPolicy()) -> DataFrame:
    """The best ``policy.top`` candidates of each group: rank, status of candidate and group, margin to the best; none if the policy wants none.

    Without ``chosen`` the candidates have ``linked`` (a boolean, not null), and those that may be links are chosen from as
    ``selected`` does.  They may have gone through ``with_labels``.  All but the best candidates are counted where they
    lie and not shuffled.
    """
    if not policy.with_hypotheses:
        links = links.where(F.lit(False))
    if chosen is not None:
        links = links.join(chosen.select("clip_id", "pred", "succ", F.lit(True).alias("is_selected")), ["clip_id", "pred", "succ"], "left").withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))
    if "__label" not in links.columns:
        links = saved(with_labels(links, policy.top))
    torn = _torn(links)
    if chosen is None:
        links = _chosen(links, torn)
    groups = _groups(
        links,
        torn,
        best=(F.max("score"), F.max),
        any_selected=(F.max("is_selected"), F.max),
        best_other=(F.max(F.when(~F.col("is_selected"), F.col("score"))), F.max),
        n=(F.count("*"), F.sum),
    )
    c = links.where("__top").join(groups, _PART)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id", "group_key").orderBy(F.desc("score"), "gap", "succ", "pred")))
    group_status = F.when(~F.col("any_selected"), "deferred").when(F.col("best_other") >= F.col("best") - policy.ambiguity, "ambiguous_selected").otherwise("selected")
    status = F.when(F.col("is_selected"), "selected").when(F.col("any_selected"), "alternate").otherwise("deferred")
    out = c.where(F.col("rank") <= policy.top)
    return out.select("clip_id", F.col("group_key.pred").alias("group_pred"), F.col("group_key.succ").alias("group_succ"), "rank", "pred", "succ", "gap", "score", F.round(F.col("best") - F.col("score"), 4).alias("margin"), status.alias("status"), group_status.alias("group_status"), F.col("n").alias("candidates"))


def canonical_ids(links: DataFrame) -> DataFrame:
    """(clip_id, track_id, canonical): each successor's first track.

    Links are applied by descending score, then gap and successor; a chain goes through a link only if that was applied
    before.  So a link points at its predecessor's link if that has a smaller rank.  Pointers are then doubled: each
    round every link takes its pointer's pointer, so a chain of n links takes log2(n) + 1 rounds at most.
    """
    order = Window.partitionBy("clip_id").orderBy(F.desc("score"), "gap", "succ")
    ranked = links.withColumn("rank", F.row_number().over(order)).select("clip_id", F.col("succ").alias("track_id"), F.col("pred").alias("canonical"), "rank")
    above = ranked.select("clip_id", F.col("track_id").alias("canonical"), F.col("rank").alias("__rank"))
    # ``next`` is the link to go on with, named by its successor
    now = saved(ranked.join(above, ["clip_id", "canonical"], "left").select("clip_id", "track_id", "canonical", F.when(F.col("__rank") < F.col("rank"), F.col("canonical")).alias("next")))
    while now.where("next IS NOT NULL").limit(1).count():
        ahead = now.select("clip_id", F.col("track_id").alias("next"), F.col("canonical").alias("__canonical"), F.col("next").alias("__next"))
        met = now.join(ahead, ["clip_id", "next"], "left")
        now = saved(met.select("clip_id", "track_id", F.coalesce("__canonical", "canonical").alias("canonical"), F.col("__next").alias("next")))
    return now.select("clip_id", "track_id", "canonical")


def bridged(rows: DataFrame, links: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """Interpolated rows for the gap of each link, under the canonical id; frames that have that identity get none.

    ``canon`` are the canonical ids, if they are at hand.
    """
    ends = track_ends(rows)
    canon = canonical_ids(links) if canon is None else canon
    named = lambda t: F.coalesce("canonical", t)
    p = ends.select("clip_id", F.col("track_id").alias("pred"), F.col("tail").alias("a"))
    s = ends.select("clip_id", F.col("track_id").alias("succ"), F.col("head").alias("b"))
    l = links.join(p, ["clip_id", "pred"]).join(s, ["clip_id", "succ"]).join(canon.withColumnRenamed("track_id", "succ"), ["clip_id", "succ"], "left")
    l = l.withColumn("frame_idx", F.explode(F.sequence(F.col("a.frame_idx") + 1, F.col("b.frame_idx") - 1)))
    alpha = (F.col("frame_idx") - F.col("a.frame_idx")) / (F.col("b.frame_idx") - F.col("a.frame_idx"))
    made = l.select("clip_id", F.col("canonical").alias("identity"), "frame_idx", *[(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * alpha).alias(c) for c in "xywh"])
    seen = rows.join(canon, ["clip_id", "track_id"], "left").select("clip_id", named("track_id").alias("identity"), "frame_idx").distinct()
    return made.join(seen, ["clip_id", "identity", "frame_idx"], "left_anti")
