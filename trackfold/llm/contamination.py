"""Benchmark decontamination with suffix arrays over the training documents.

Each slice of documents is a shard.  Its words are mapped to the benchmark's vocabulary; a word outside of it ends
every match, so only the stretches of vocabulary words that are at least as long as the shortest window are kept,
and the shard's suffix array is built over those by prefix doubling.  No match is lost by that.  Every suffix of
every benchmark item is then binary-searched in the array at once, and the range that begins with its window gives all
places where the window occurs.  At such a place, the neighbours among the sorted test suffixes give the length of the
longest verbatim match, and the range of test suffixes that begin with it all its locations in the benchmark.

A benchmark is worked on in blocks of at most ``BLOCK_BYTES`` of text, one at a time; each block is one broadcast of
proven size and one pass of a shuffle-free map over the documents.  Passes after the first return only the texts that
are hit; these are joined to the documents by two hashes of the text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, saved, slices, text_bytes, unused
from .words import word_table

#: Text of one benchmark block that is broadcast.
BLOCK_BYTES = 8 << 20
#: Query rows that are compared at once.
_ROWS = 1 << 15


@dataclass
class TestSuffixes:
    """All suffixes of a benchmark block over its vocabulary (ids from 1; a 0 ends an item).

    Only what the words are is stored and broadcast; the rest is worked out where it is needed, once in each worker.
    """

    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray  # ids of all items' words, a 0 behind each item
    first: np.ndarray  # where each item begins in words
    names: list[str]
    before: np.ndarray  # words of the item before this part of it
    width: int

    @functools.cached_property
    def start(self) -> np.ndarray:
        """Where each suffix begins in words."""
        return np.flatnonzero(self.words)

    @functools.cached_property
    def item(self) -> np.ndarray:
        """The item of each suffix."""
        return np.searchsorted(self.first, self.start, side="right") - 1

    @functools.cached_property
    def length(self) -> np.ndarray:
        """Words from each suffix to its item's end."""
        ends = np.append(self.first[1:], len(self.words)) - 1
        return ends[self.item] - self.start

    @functools.cached_property
    def offset(self) -> np.ndarray:
        """The word position of each suffix in its item."""
        return self.start - self.first[self.item] + self.before[self.item]

    @functools.cached_property
    def window(self) -> np.ndarray:
        """Words of the window that begins with each suffix, 0 if none does."""
        return np.where(self.length >= self.width, self.width, np.where(self.start == self.first[self.item], self.length, 0))

    @functools.cached_property
    def order(self) -> np.ndarray:
        """The sorted suffixes: where each begins in words."""
        order = suffix_array(self.words, int(self.length.max()))
        return order[self.words[order] != 0]

    @functools.cached_property
    def number(self) -> np.ndarray:
        """The suffix that begins at each place of words."""
        return np.cumsum(self.words != 0) - 1


def test_suffixes(items: list[tuple], width: int) -> TestSuffixes | None:
    """Suffixes of (item_id, text, words before) rows; None if no item has a word."""
    data, rows = text_bytes(pa.array([r[1] for r in items], pa.string()))
    hashes, _, _, at = word_table(data, rows)
    if not len(hashes):
        return None
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    counts = np.diff(at)
    worded = np.flatnonzero(counts)
    counts = counts[worded]
    first = np.cumsum(counts + 1) - counts - 1
    words = np.zeros(int((counts + 1).sum()), np.int32)
    words[ragged(first, counts)] = ids + 1
    return TestSuffixes(vocabulary, words, first, [str(items[i][0]) for i in worded], np.array([items[i][2] for i in worded], np.int64), width)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the words that follow them, up to ``depth`` words and the next 0."""
    rank, step = words.astype(np.int64), 1
    while step < depth:
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:] if step < len(rank) else 0
        behind[rank == 0] = 0
        # a 0 on the way ends the comparison: a suffix that has met it must not look further
        met = np.zeros(len(rank), bool)
        if step < len(rank):
            zeros = np.concatenate([[0], np.cumsum(words == 0)])
            met[: len(rank) - step] = zeros[step : len(rank)] > zeros[: len(rank) - step]
        behind[met] = 0
        key = rank * (int(rank.max()) + 1) + behind
        distinct, rank = np.unique(key, return_inverse=True)
        rank = rank.reshape(-1)
        if len(distinct) == len(key):
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def _compare(words: np.ndarray, at: np.ndarray, query: np.ndarray, q_at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: common words (at most length) and whether the shard's suffix is smaller."""
    common = np.zeros(len(at), np.int64)
    smaller = np.zeros(len(at), bool)
    live = np.arange(len(at))
    k = 0
    while len(live):
        live = live[length[live] > k]
        a, b = words[np.minimum(at[live] + k, len(words) - 1)], query[q_at[live] + k]
        same = (a == b) & (a != 0)
        smaller[live[~same]] = a[~same] < b[~same]
        live = live[same]
        common[live] += 1
        k += 1
    return common, smaller


def search(words: np.ndarray, order: np.ndarray, query: np.ndarray, q_at: np.ndarray, length: np.ndarray, above: bool) -> np.ndarray:
    """Binary search, among sorted suffixes, of the ``length`` words at each place ``q_at`` of ``query``.

    ``above``: behind the suffixes that begin with all of the words, else before them.
    """
    lo, hi = np.zeros(len(q_at), np.int64), np.full(len(q_at), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        common, smaller = _compare(words, order[mid], query, q_at[open_], length[open_])
        whole = common == length[open_]
        right = smaller & ~whole | (whole & above)
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


@dataclass
class ShardMatches:
    """Hit words of a shard, pairs of (row, item), and maximal matches: row, word in the text, words, suffix."""

    hit: np.ndarray
    pairs: np.ndarray
    matches: np.ndarray


def shard_matches(hashes: np.ndarray, first: np.ndarray, t: TestSuffixes) -> ShardMatches:
    """What the rows of one shard have in common with the benchmark block."""
    n, n_rows = len(hashes), len(first) - 1
    hit = np.zeros(n, bool)
    none = ShardMatches(hit, np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64))
    if not n:
        return none
    place = np.minimum(np.searchsorted(t.vocabulary, hashes), len(t.vocabulary) - 1)
    ids = np.where(t.vocabulary[place] == hashes, place + 1, 0)
    # stretches of vocabulary words within a row
    row = np.repeat(np.arange(n_rows), np.diff(first))
    cut = np.ones(n + 1, bool)
    cut[1:-1] = ((ids[1:] != 0) != (ids[:-1] != 0)) | (row[1:] != row[:-1])
    edges = np.flatnonzero(cut)
    size = np.diff(edges)
    windowed = np.flatnonzero(t.window)
    keep = (ids[edges[:-1]] != 0) & (size >= t.window[windowed].min())
    if not keep.any():
        return none
    begin, size = edges[:-1][keep], size[keep]
    source = ragged(begin, size + 1)  # each stretch with one place behind it for the 0
    ends = np.cumsum(size + 1) - 1
    words = np.zeros(len(source), np.int64)
    inner = np.ones(len(source), bool)
    inner[ends] = False
    words[inner] = ids[source[inner]]
    order = suffix_array(words, int(t.length.max()))
    order = order[words[order] != 0]
    mark = np.zeros(n + 1, np.int64)
    pairs: list[np.ndarray] = []
    starts = np.zeros(len(words), bool)
    for a in range(0, len(windowed), _ROWS):
        which = windowed[a : a + _ROWS]
        lo = search(words, order, t.words, t.start[which], t.window[which], above=False)
        hi = search(words, order, t.words, t.start[which], t.window[which], above=True)
        found = hi > lo
        if not found.any():
            continue
        which, lo, count = which[found], lo[found], (hi - lo)[found]
        inside = order[ragged(lo, count)]
        at = source[inside]
        starts[inside] = True
        np.add.at(mark, at, 1)
        np.add.at(mark, at + np.repeat(t.window[which], count), -1)
        pairs.append(np.unique(np.stack([row[at], np.repeat(t.item[which], count)], 1), axis=0))
    if not pairs:
        return none
    return ShardMatches(np.cumsum(mark)[:-1] > 0, np.unique(np.concatenate(pairs), axis=0), _longest(words, source, np.flatnonzero(starts), row, first, t))


def _longest(words: np.ndarray, source: np.ndarray, places: np.ndarray, row: np.ndarray, first: np.ndarray, t: TestSuffixes) -> np.ndarray:
    """Maximal verbatim matches at places where a window begins: (row, word in the text, words, suffix), all locations of each."""
    whole = np.full(len(places), len(t.words))
    # of all test suffixes, the neighbours in the sorted order have most words in common with the text at a place
    near = search(t.words, t.order, words, places, whole, above=False)
    length = np.zeros(len(places), np.int64)
    for step in (-1, 0):
        other = t.order[np.clip(near + step, 0, len(t.order) - 1)]
        length = np.maximum(length, _compare(t.words, other, words, places, whole)[0])
    by_place = np.zeros(len(words) + 1, np.int64)
    by_place[places] = length
    inner = by_place[places - 1] == length + 1  # the match began a word earlier (the place before the first is never set)
    places, length = places[~inner], length[~inner]
    lo = search(t.words, t.order, words, places, length, above=False)
    count = search(t.words, t.order, words, places, length, above=True) - lo
    at = np.repeat(source[places], count)
    suffix = t.number[t.order[ragged(lo, count)]]
    return np.stack([row[at], at - first[row[at]], np.repeat(length, count), suffix], 1)


_STATE = "__tf_hits"
_SPAN = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_MATCH = T.StructType([T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_word", T.LongType())])
_FOUND = [T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(_MATCH))]
_STATE_TYPE = T.StructType([T.StructField("n_words", T.LongType()), *_FOUND])


def _match_batches(block, text_column: str, hits_only: bool):
    """Batches with a state column; or only the columns of the state, and the batch's others, of texts that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = block.value
        for batch in slices(batches, text_column):
            data, rows = text_bytes(batch.column(text_column))
            hashes, _, _, first = word_table(data, rows)
            found = shard_matches(hashes, first, t)
            items: dict[int, list[str]] = {}
            for r, i in found.pairs.tolist():
                items.setdefault(r, []).append(t.names[i])
            matches: dict[int, list[tuple]] = {}
            for r, at, n, s in found.matches.tolist():
                matches.setdefault(r, []).append({"doc_word": at, "n_words": n, "item": t.names[t.item[s]], "item_word": int(t.offset[s])})
            state = []
            for r in range(batch.num_rows):
                spans = []
                if r in items:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.hit[first[r] : first[r + 1]].view(np.int8), [0]])))
                    spans = [{"a": a, "b": b} for a, b in edge.reshape(-1, 2).tolist()]
                state.append({"n_words": int(first[r + 1] - first[r]), "spans": spans, "items": sorted(set(items.get(r, []))), "matches": matches.get(r, [])})
            names = [n for n in batch.schema.names if n != _STATE]
            out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(state, _ARROW_STATE)], names=[*names, _STATE])
            if hits_only:
                out = out.take(pa.array(sorted(items), pa.int64())).select([n for n in (*names, _STATE) if n != text_column])
            yield out

    return run


_ARROW_STATE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("doc_word", pa.int64()), ("n_words", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())]))),
    ]
)


def _parts(item, text: str, width: int) -> Iterator[tuple]:
    """(item, text, words before): an item above BLOCK_BYTES in parts of at most so many bytes that share width - 1 words, so no window is lost."""
    if len(text.encode()) <= BLOCK_BYTES:
        yield item, text, 0
        return
    spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    a = 0
    while a < len(spans):
        b, size = a, 0
        while b < len(spans) and (b < a + width or size <= BLOCK_BYTES):
            size += 4 * (spans[b][1] - spans[b][0] + 1)
            b += 1
        yield item, text[spans[a][0] : spans[b - 1][1]], a
        if b == len(spans):
            return
        a = b - (width - 1)


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, width: int) -> Iterator[list[tuple]]:
    """The benchmark's rows on the driver, block by block; one block is there at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_column), F.col(text_column)).where(F.col(text_column).isNotNull()).toLocalIterator():
        for part in _parts(item, text, width):
            own = len(part[1].encode())
            if block and size + own > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append(part)
            size += own
    if block:
        yield block


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """``docs`` with a struct column ``__tf_hits`` of what the benchmark has in common with each text.

    Fields: n_words; spans (hit word ranges [a, b), which may overlap); items (ids as sorted strings); matches: every
    maximal verbatim match that holds a window, as doc_word, n_words, item, item_word, with all its locations.  Null and
    empty texts have no words; repeated rows are judged one by one; an empty benchmark hits nothing; texts of any length
    are taken whole; all other columns stay.  Of an item above BLOCK_BYTES, matches are found in each of its parts.
    """
    context = docs.sparkSession.sparkContext
    out = docs.drop(_STATE)
    schema = T.StructType([*out.schema.fields, T.StructField(_STATE, _STATE_TYPE)])
    shared, more = None, []
    for block in _blocks(benchmark, item, item_text, width):
        suffixes = test_suffixes(block, width)
        if suffixes is None:
            continue
        passed = context.broadcast(suffixes)
        if shared is None:
            shared = passed
            continue
        texts = out.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.col(text).alias("text")).where("text IS NOT NULL")
        hits = texts.mapInArrow(_match_batches(passed, "text", True), T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField(_STATE, _STATE_TYPE)]))
        more.append(saved(hits.dropDuplicates(["h1", "h2"]), "hits"))
        passed.destroy()
    if shared is None:
        shared = context.broadcast(test_suffixes([("", "\x80", 0)], width))
    out = out.mapInArrow(_match_batches(shared, text, False), schema)
    if not more:
        return out
    every = functools.reduce(DataFrame.union, more).groupBy("h1", "h2").agg(*(F.flatten(F.collect_list(f"{_STATE}.{f.name}")).alias(f.name) for f in _FOUND))  # one row of each block at most
    both = out.join(every.select(*(F.col(c).alias(f"__tf_{c}") for c in every.columns)), (F.xxhash64(text) == F.col("__tf_h1")) & (F.xxhash64(F.lit(1), text) == F.col("__tf_h2")), "left")
    own = {f.name: F.col(f"{_STATE}.{f.name}") for f in _STATE_TYPE.fields}
    join = lambda name: F.concat(own[name], F.coalesce(F.col(f"__tf_{name}"), F.array().cast(_STATE_TYPE[name].dataType)))
    state = F.struct(own["n_words"].alias("n_words"), join("spans").alias("spans"), F.array_sort(F.array_distinct(join("items"))).alias("items"), join("matches").alias("matches"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns if c != _STATE], state.alias(_STATE))


def contaminated(n_hit, n_words):
    """The rule: some word is hit, and at least one in twenty words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(state: str = _STATE):
    """Number of hit words of a state column."""
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    spans = F.array_sort(F.col(f"{state}.spans"))
    return F.aggregate(spans, begin, lambda s, x: F.struct(F.greatest(s.end, x.b).alias("end"), (s.n + F.greatest(x.b - F.greatest(x.a, s.end), F.lit(0).cast("long"))).alias("n")), lambda s: s.n)


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 13, key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words of the longest verbatim
    match that holds a window, else 0), and matches (all maximal ones with their places in text and items)."""
    found = with_matches(docs.select(key, "text"), benchmark, width=width)
    s = _STATE
    return found.select(
        key,
        F.col(f"{s}.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(f"{s}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col(f"{s}.items")), 256).alias("items_sha256"),
        contaminated(n_hit(), F.col(f"{s}.n_words")).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(f"{s}.matches", lambda m: m.n_words)), F.lit(0)).cast("long").alias("longest_match"),
        F.array_sort(f"{s}.matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their own columns; nothing is shuffled."""
    taken = {c: unused(docs, "__own") for c in docs.columns if c.lower() == _STATE}
    found = with_matches(docs.withColumnsRenamed(taken), benchmark, width=width)
    return found.where(~contaminated(n_hit(), F.col(f"{_STATE}.n_words"))).select(*[F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns])
