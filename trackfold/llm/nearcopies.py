"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding, exact verification.

1. Each text's five-word shingles are counted; the weight of a shingle is 1 + ln(count).  Texts with the same weighted
   set form a class, whose member with the smallest key stands for it.
2. ProbMinHash: every element of a class's set starts a Poisson process with its weight as rate; an arrival falls into
   a random register and stays there if it is the register's earliest.  Elements whose next arrival is later than the
   latest register's are given up (early termination).  Two sets agree in a register with their probability Jaccard.
3. Banding: classes that agree in all registers of a band share a bucket.  Buckets with the same members are taken once.
4. Verification: a link is a pair in a bucket whose probability Jaccard, worked out exactly, is at least 0.8.  The
   members of a bucket are dealt to blocks of at most BLOCK_MEMBERS, each of which is one group and also gets HUBS
   members of the whole bucket, so that a bucket of near copies needs as many groups as it has blocks.  Only members
   that are then not connected with most of their bucket are compared with the rest: with the component that most of
   the bucket is in (once, not once for each bucket), and with each other.
5. Connected components of the links by star contraction, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, slices, text_bytes, unused
from .words import mix, shingle_table, word_table

WIDTH, SIMILARITY = 5, 0.8
#: A pair of probability Jaccard 0.8 is missed by all bands with a chance of 5e-8.
BANDS, ROWS = 32, 4
BLOCK_MEMBERS, BLOCK_SHINGLES, HUBS = 512, 1_000_000, 16


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the bits of hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def weighted_sets(hashes: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row (sorted by row and hash), their counts, and each row's first."""
    shingles, at = shingle_table(hashes, first, width)
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    # 48 bits of a hash identify a shingle: with a row's number they fit one number, which is sorted at once
    out: list[tuple] = []
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        both = np.sort((row[at[a] : at[b]] - np.uint64(a)) << np.uint64(48) | shingles[at[a] : at[b]] >> np.uint64(16))
        head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(both)))
        both = both[head]
        out.append((both & np.uint64((1 << 48) - 1), count, np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=b - a)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    elements, count, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
    return elements, count, np.concatenate([[0], np.cumsum(sizes)])


def prob_min_hash(elements: np.ndarray, weight: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """Signatures: for each row and register the element of the earliest arrival (0 for a row without elements)."""
    n_rows = len(first) - 1
    best = np.full(n_rows * registers, np.inf)
    owner = np.zeros(n_rows * registers, np.uint64)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    live = np.arange(len(elements))
    time = np.zeros(len(elements))
    step = 0
    while len(live):
        # each element has its own stream of waiting times and registers, the same in every set
        stream = mix(elements[live] + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(_uniform(stream)) / weight[live]
        worst = best.reshape(n_rows, registers).max(1) if n_rows else np.zeros(0)
        near = time < worst[row[live]]
        live, time, stream = live[near], time[near], stream[near]
        slot = row[live] * registers + (mix(stream ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        # the earliest arrival at each register; of equal times the largest element, as elements are in order
        np.minimum.at(best, slot, time)
        won = time <= best[slot]
        owner[slot[won]] = elements[live[won]]
        step += 1
    return owner.reshape(n_rows, registers)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sign_batches(key: str, text: str):
    """Per document: two hashes of its shingle set and of its text, and the hashes of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, rows = text_bytes(batch.column(text))
            hashes, _, _, first = word_table(data, rows)
            elements, count, at = weighted_sets(hashes, first)
            empty = np.diff(at) == 0
            a, b = (np.concatenate([[0], np.cumsum(x, dtype=np.uint64)]) for x in (mix(elements + mix(count.astype(np.uint64))), mix(elements ^ mix(count.astype(np.uint64) + np.uint64(1 << 32)))))
            set_a, set_b = a[at[1:]] - a[at[:-1]], b[at[1:]] - b[at[:-1]]
            owner = prob_min_hash(elements, weights(count), at, BANDS * ROWS)
            band = mix(owner)
            band = band.reshape(len(owner), BANDS, ROWS)
            mixed = np.zeros((len(owner), BANDS), np.uint64)
            for k in range(ROWS):
                mixed = mix(mixed * np.uint64(3) + band[:, :, k])
            mixed[empty] = 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(owner) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(_signed(mixed.reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("text_hash"), pa.array(_signed(set_a)), pa.array(_signed(set_b)), pa.array(np.diff(at), pa.int64()), lists], names=["key", "text_hash", "set_a", "set_b", "n_shingles", "bands"])

    return run


def weights(count: np.ndarray) -> np.ndarray:
    """Weights of shingles by how often they occur in a text."""
    return 1 + np.log(count)


def probability_jaccard(e1: np.ndarray, w1: np.ndarray, e2: np.ndarray, w2: np.ndarray) -> float:
    """The exact probability Jaccard similarity of two weighted sets (distinct elements, positive weights)."""
    _, i, j = np.intersect1d(e1, e2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = w1[i], w2[j]
    by = np.argsort(-x / y, kind="stable")
    x, y = x[by], y[by]
    # for a common element, all others count with max(x_j / x_i, y_j / y_i): the first of the two up to its place
    x_sum, y_sum = w1.sum() - x.sum() + np.cumsum(x), w2.sum() - np.cumsum(y)
    return float((1 / (x_sum / x + y_sum / y)).sum())


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component under the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def linked(texts: pa.Array, side: np.ndarray, threshold: float = SIMILARITY) -> np.ndarray:
    """Components of all pairs of texts with at least this probability Jaccard: the smallest row of each row's component.

    Pairs of rows on different sides 0 and 1, and pairs within side 2, are compared.  The Bhattacharyya coefficient of
    the normalised weights is never below the probability Jaccard: it comes from dense products in slabs of bounded size
    and leaves few pairs.  Where all weights of a pair are equal it gives the Jaccard similarity at once; the other pairs
    are worked out one by one, unless they are connected already.
    """
    sets, weight = [], []
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
        data, rows = text_bytes(part.column("text"))
        hashes, _, _, first = word_table(data, rows)
        elements, count, at = weighted_sets(hashes, first)
        sets += np.split(elements, at[1:-1])
        weight += np.split(weights(count), at[1:-1])
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return np.arange(n)
    flat = np.array([len(w) > 0 and w.max() == w.min() for w in weight])
    root = np.concatenate([np.sqrt(w / w.sum()) if len(w) else w for w in weight]).astype(np.float32)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    kept = count[place] > 1
    row, place, root = row[kept], np.unique(place[kept], return_inverse=True)[1], root[kept]
    order = np.argsort(place, kind="stable")
    row, place, root = row[order], place[order], root[order]
    n_places = int(place[-1]) + 1 if len(place) else 0
    alike = np.zeros((len(left), len(right)), np.float32)
    slab = max(256, (8 << 20) // n)
    for a in range(0, n_places, slab):
        lo, hi = np.searchsorted(place, (a, a + slab))
        m = np.zeros((n, min(slab, n_places - a)), np.float32)
        m[row[lo:hi], place[lo:hi] - a] = root[lo:hi]
        alike += m[left] @ m[right].T
    i, j = np.nonzero(alike >= threshold - 1e-3)
    bound = alike[i, j].astype(np.float64)
    i, j = left[i], right[j]
    wanted = (side[i] != 2) | (i < j)
    i, j, bound = i[wanted], j[wanted], bound[wanted]
    shared = bound * np.sqrt(size[i] * size[j])
    jaccard = shared / (size[i] + size[j] - shared)
    even = flat[i] & flat[j]
    sure = even & (jaccard >= threshold + 1e-3)
    label = _labels(n, i[sure], j[sure])
    open_ = np.flatnonzero((~even | (np.abs(jaccard - threshold) < 1e-3)) & (label[i] != label[j]))
    for k in open_[np.argsort(-bound[open_], kind="stable")].tolist():
        a, b = sorted((int(label[i[k]]), int(label[j[k]])))
        if a != b and probability_jaccard(sets[i[k]], weight[i[k]], sets[j[k]], weight[j[k]]) >= threshold - 1e-9:
            label[label == b] = a
    return label


def _verify(group: pa.Table) -> pa.Table:
    """Links (a, b) that connect what is connected in a group: from each node to the smallest of its component."""
    label = linked(group.column("text").combine_chunks() if group.num_rows else pa.array([], pa.string()), group.column("side").to_numpy())
    names = group.column("node").to_numpy()
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, label, names)
    least = least[label]
    moved = least != names
    return pa.table({"a": names[moved], "b": least[moved]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root) for every node of an edge, root the smallest node of its component.

    Alternates the large-star and small-star contractions until all edges are stars; each round is written to the shared
    folder and read back.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf > 1 OR (leaf > 0 AND hub > 0)").isEmpty():
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.b").alias("b"))
        now = saved(small.where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, text hash, its shingle set's hashes, number of distinct shingles, band hashes."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(_sign_batches("key", "text"), f"key {kind}, text_hash long, set_a long, set_b long, n_shingles long, bands array<long>")


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(node, bucket, blocks, own): the members of each distinct set of classes that share a band, its number of blocks, and the member's own."""
    banded = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "h"))
    banded = banded.select("node", "n_shingles", F.xxhash64("band", "h").alias("bucket"))
    sets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.min("node").alias("least")).where("size > 1")
    once = sets.withColumn("blocks", _blocks("size", "shingles")).groupBy("size", "members", "least", "blocks").agg(F.min("bucket").alias("bucket")).select("bucket", "blocks")
    return banded.drop("n_shingles").join(once, "bucket").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))


def _blocks(members: str, shingles: str):
    return F.greatest(F.ceil(F.col(members) / BLOCK_MEMBERS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _to(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _first_round(members: DataFrame) -> DataFrame:
    """(node, bucket, low, high, side): the groups of blocks, each with HUBS members of its bucket."""
    several = members.where("blocks > 1")
    order = F.xxhash64(F.col("node") + 1, F.col("bucket"))
    hubs = several.groupBy("bucket", F.pmod(order, F.lit(HUBS))).agg(F.min(F.struct(order.alias("h"), "node")).alias("hub"), F.first("blocks").alias("blocks"))
    own = members.select("node", "bucket", "own")
    spread = hubs.select(F.col("hub.node").alias("node"), "bucket", _to("blocks").alias("own"))
    # a hub is in its own block already
    both = own.union(spread.join(several.select("node", "bucket", "own"), ["node", "bucket", "own"], "left_anti"))
    return both.select("node", "bucket", F.col("own").alias("low"), F.lit(-1).alias("high"), F.lit(2).alias("side"))


def _second_round(members: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Groups that compare members not connected with most of their bucket with the rest; None if there are no such members."""
    placed = members.where("blocks > 1").select("node", "bucket").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("bucket", "most")
    few = placed.join(most, "bucket").where("root <> most").join(classes.select("node", "n_shingles"), "node")
    few = saved(few.select("node", "bucket", "most", "n_shingles"), "others")
    if few.isEmpty():
        return None

    def dealt(rows: DataFrame, by: str, count: str, own: str) -> DataFrame:
        """Rows with the number of blocks of their group, and their own block."""
        n = rows.groupBy(by).agg(F.count("*").alias("__n"), F.sum("n_shingles").alias("__s")).select(by, _blocks("__n", "__s").alias(count))
        return rows.join(n, by).withColumn(own, F.pmod(F.xxhash64("node", F.col(by) + 1), F.col(count)).cast("int"))

    left = dealt(few.select("node", "most", "n_shingles").distinct(), "most", "chunks", "chunk")
    wanted = left.select("most", "chunks").distinct()
    whole = roots.union(wanted.select(F.col("most").alias("node"), F.col("most").alias("root"))).distinct().join(wanted.select("most"), F.col("root") == F.col("most"))
    right = dealt(whole.select("node", "most").join(classes.select("node", "n_shingles"), "node"), "most", "blocks", "own")
    sizes = right.select("most", "blocks").distinct()
    across = left.join(sizes, "most").select("node", F.col("most").alias("bucket"), F.col("chunk").alias("low"), _to("blocks").alias("high"), F.lit(0).alias("side"))
    rest = right.join(wanted, "most").select("node", F.col("most").alias("bucket"), _to("chunks").alias("low"), F.col("own").alias("high"), F.lit(1).alias("side"))
    pairs = dealt(few.select("node", "bucket", "n_shingles"), "bucket", "chunks", "chunk").withColumn("other", _to("chunks"))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    # high is below zero here, so these groups are others than those above
    among = pairs.select("node", "bucket", F.least("chunk", "other").alias("low"), (-1 - F.greatest("chunk", "other")).alias("high"), side.alias("side"))
    return across.union(rest).union(among)


def near_links(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root): the components of all links between classes, for the nodes that have any."""
    members = saved(_bucket_members(classes), "buckets")
    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def places(dealt: DataFrame) -> DataFrame:
        """Where the texts of the nodes in ``dealt`` are."""
        return classes.join(dealt.select("node").distinct(), "node").select("node", F.col("key").alias("__k"), F.col("text_hash").alias("__h"))

    def verified(dealt: DataFrame, wanted: DataFrame) -> DataFrame:
        texts = source.join(wanted, (F.col("text_hash") == F.col("__h")) & F.col("key").eqNullSafe(F.col("__k")))
        texts = texts.select("node", "text").dropDuplicates(["node"])
        return saved(dealt.join(texts, "node").groupBy("bucket", "low", "high").applyInArrow(_verify, "a long, b long"), "links")

    edges = verified(_first_round(members), places(members))
    roots = saved(components(edges), "roots")
    more = _second_round(members, roots, classes)
    if more is None:
        return roots
    # written down, so that Spark sees the size of these (mostly small) tables before it plans the joins with all texts
    more = saved(more, "second")
    return saved(components(edges.union(verified(more, saved(places(more), "places")))), "roots")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, class_id (smallest key of all near copies), n_copies, n_class.

    ``n_copies``: documents with the same weighted set of shingles; ``n_class``: documents of the class; ``text_hash``
    with ``keep_hash``: the document to keep has the class_id as key and both hashes equal.  Texts without words (null
    and empty ones too) are near copies of nothing: each is a class of its own.  Texts of any length are taken whole.
    Rows that repeat a key with the same text are copies; a null key is a key like others and the smallest; an empty
    table gives an empty one.  Other columns are ignored.
    """
    signs = saved(signed(docs, key, text), "signs")
    worded = signs.where("n_shingles > 0")
    sets = worded.groupBy("set_a", "set_b").agg(F.min(F.struct("key", "text_hash")).alias("first"), F.count("*").alias("n_copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = saved(sets.select(F.xxhash64("set_a", "set_b").alias("node"), "set_a", "set_b", "first.key", "first.text_hash", "n_copies", "n_shingles", "bands"), "classes")
    roots = near_links(docs, classes, key, text)
    member = classes.drop("bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = member.groupBy("root").agg(F.min(F.struct("key", "text_hash")).alias("keep"), F.sum("n_copies").alias("n_class"))
    member = member.join(whole, "root").select("set_a", "set_b", F.col("keep.key").alias("class_id"), "n_copies", "n_class", F.col("keep.text_hash").alias("keep_hash"))
    out = worded.select("key", "text_hash", "set_a", "set_b").join(saved(member, "members"), ["set_a", "set_b"]).drop("set_a", "set_b")
    one = F.lit(1).cast("long")
    alone = signs.where("n_shingles = 0").select("key", "text_hash", F.col("key").alias("class_id"), one.alias("n_copies"), one.alias("n_class"), F.col("text_hash").alias("keep_hash"))
    return out.unionByName(alone).withColumnRenamed("key", key)


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with the columns of ``docs``: that with the smallest key, then text hash; of equal rows, one.

    Texts without words all stay.
    """
    found = near_copies(docs.select(key, text), key, text)
    gone, gone_hash, same, same_hash, h = (unused(docs, n) for n in ("__gone", "__gone_hash", "__same", "__same_hash", "__h"))
    away = found.where(~(F.col(key).eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("keep_hash")))).select(F.col(key).alias(gone), F.col("text_hash").alias(gone_hash)).distinct()
    several = found.where("n_copies > 1").groupBy(F.col(key).alias(same), F.col("text_hash").alias(same_hash)).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hashed = docs.withColumn(h, F.xxhash64(text))
    kept = hashed.join(away, F.col(key).eqNullSafe(F.col(gone)) & (F.col(h) == F.col(gone_hash)), "left_anti")
    # rows that repeat key and text are few or none: only they are reduced to one
    is_several = F.col(key).eqNullSafe(F.col(same)) & (F.col(h) == F.col(same_hash))
    repeated = kept.join(several, is_several, "left_semi").dropDuplicates([key, h])
    single = kept.join(several, is_several, "left_anti")
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
