"""Byte-level BPE in Spark's own higher-order functions.

A text is cut by the tokenizer's pattern.  The ranked merges of a word are a fold over its array of single bytes: each
step finds the smallest rank among the pairs of neighbours and merges its leftmost occurrences at once, until no pair
has a rank.  Ranks stand in the plan as a literal: an array of small maps, one for each value of a hash, so a lookup
searches a few entries only.  Decoding concatenates the binary pieces of the ids.

Texts are worked on in groups of neighbouring rows, of about ``GROUP_BYTES``: a small helper lists the distinct words of
a group and where each text has them.  A word is folded once for its group, or its ids stand in
the plan if it is common, and the ids are fetched by place.  So
neither texts nor words are shuffled or written, no word is common enough to burden a task, and what a task holds does
not grow with the table.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: A word that is at least this share of the words of a sample, one in ``SAMPLED`` of the texts, has its ids in the plan
#: (so these are ``COMMON`` at most); longer words (in bytes) never have.  It saves time only: the ids are the same.
COMMON, COMMON_BYTES, SAMPLED = 1 << 20, 32, 16
#: Bytes of words in a group of texts; a longer text stands alone.
GROUP_BYTES = 32 << 20
#: Bytes up to which a word is merged one pair a step, which costs fewer lookups; the ids are the same.
SHORT = 32
#: The inside of a class of Unicode's white space.
_SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_BUCKETS = 1 << 14
#: Bits of a place in a word, and the rank of pairs without one.
_PLACE, _NO_RANK = (1 << 40) - 1, 1 << 22
#: Bits of a place in a short word.
_SHORT_BITS = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _ranges(points: Iterable[int]) -> str:
    """A character class's inside for code points: stretches of neighbours."""
    found: list[list[int]] = []
    for p in sorted(points):
        if found and found[-1][1] == p - 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in found)


@cache
def _class_of_library(kind: str) -> frozenset[int]:
    """The code points beyond ASCII that the library counts as letters (L) or numbers (N), asked from the library.

    Its tables are of another Unicode version than Java's, and neither states its version.  A probe whose pieces are
    ``a`` (or ``1``) and one more character is a single id only where the pattern keeps the two together.
    """
    import regex
    import tiktoken

    front = {"L": b"a", "N": b"1"}[kind]
    pattern = regex.compile(rf"[\p{{{kind}}}\p{{Cn}}]")  # unassigned ones too: the library may know more of them
    points = [c for c in range(0x80, 0x32400) if not 0xD800 <= c < 0xE000 and pattern.match(chr(c))]
    ranks = {bytes([b]): b for b in range(256)} | {front + chr(c).encode(): 256 + i for i, c in enumerate(points)}
    probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{kind}}}+|.", mergeable_ranks=ranks, special_tokens={})
    return frozenset(c for c in points if len(probe.encode_ordinary(front.decode() + chr(c))) == 1)


def _java_class(spark: SparkSession, kind: str) -> str:
    r"""The inside of a Java class that equals the library's \p{L} or \p{N}."""
    points = _class_of_library(kind)
    java = spark.sparkContext._jvm.java.util.regex.Pattern.compile(rf"\p{{{kind}}}+")
    lacking = {ord(c) for c in java.matcher("".join(map(chr, sorted(points)))).replaceAll("")}
    # the class of added characters begins with a test that most characters fail at once
    return rf"\p{{{kind}}}" + (rf"[[^\x00-\x{{{min(lacking) - 1:X}}}]&&[{_ranges(lacking)}]]" if lacking else "")


def java_pattern(spark: SparkSession, pattern: str) -> str:
    r"""``pattern`` with the library's letters, numbers and white space spelled out for Java."""
    letters, numbers = _java_class(spark, "L"), _java_class(spark, "N")
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = next((t for t in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(t, i)), pattern[i : i + 1])
        if token == r"\S" and inside:
            raise ValueError(r"\S within a class is not supported")
        spelled = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": _SPACES}.get(token)
        if token == r"\S":
            out.append(f"[^{_SPACES}]")
        elif spelled is None:
            inside = {"[": True, "]": False}.get(token, inside)
            out.append(token)
        else:
            out.append(spelled if inside else f"[{spelled}]")
        i += len(token)
    return "".join(out)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(value: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """``_let`` for a body of a known type, much faster in nested bodies.

    Spark asks an element's type of the whole body at every evaluation of ``_let``; an ``aggregate`` has that of its variable.
    """
    return F.aggregate(F.array_repeat(value, F.lit(1)), F.lit(None).cast(kind), lambda _, x: body(x))


def _literal_map(entries: dict[bytes, tuple[str, object]], value_type: str) -> Column:
    """A literal of (text key, value) by bytes: an array of maps, each with the keys of one hash."""
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for raw, (key, value) in entries.items():
        buckets[zlib.crc32(raw) % _BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{value_type}>>")


def _found(table: Column, raw: Column, key: Column) -> Column:
    """The value of a key in such a literal, or null."""
    return F.try_element_at(F.get(table, F.pmod(F.crc32(raw), F.lit(_BUCKETS)).cast("int")), key)


def _rank(table: Column, piece: Column) -> Column:
    return _found(table, piece, F.hex(piece))


class _Fold:
    """The merges of one word (binary, of at least one byte).

    The state is an array with a number for each pair of neighbouring pieces: its rank, and below it the place where its
    right piece begins.  So the least number is the leftmost pair of the smallest rank, pieces are stretches of the word
    between such places, and a merge takes one number out and renews the two beside it.
    """

    def __init__(self, table: Column, word: Column):
        self.table, self.word = table, word

    def place(self, state: Column, i: Column) -> Column:
        """Where the right piece of pair ``i`` (from 0) begins; the word's begin or end beyond the first or last pair."""
        return F.coalesce(F.get(state, i).bitwiseAND(F.lit(_PLACE)), F.when(i < 0, F.lit(1)).otherwise(F.length(self.word) + 1).cast("long"))

    def piece(self, begin: Column, end: Column) -> Column:
        return F.substring(self.word, begin.cast("int"), (end - begin).cast("int"))

    def number(self, begin: Column, place: Column, end: Column) -> Column:
        return F.coalesce(_rank(self.table, self.piece(begin, end)).cast("long"), F.lit(_NO_RANK)) * (_PLACE + 1) + place

    def numbered(self, state: Column) -> Column:
        """All numbers anew for the places of ``state``."""
        return F.transform(state, lambda x, i: self.number(self.place(state, i - 1), x.bitwiseAND(F.lit(_PLACE)), self.place(state, i + 1)))

    def merge_first(self, state: Column, least: Column) -> Column:
        """Merge the leftmost pair of the smallest rank."""

        def at(p: Column) -> Column:
            def renewed(x: Column, i: Column) -> Column:  # i counts without the pair p
                left = self.number(self.place(state, p - 2), x.bitwiseAND(F.lit(_PLACE)), self.place(state, p + 1))
                right = self.number(self.place(state, p - 1), x.bitwiseAND(F.lit(_PLACE)), self.place(state, p + 2))
                return F.when(i == p - 1, left).when(i == p, right).otherwise(x)

            return F.transform(F.array_remove(state, least), renewed)

        return _let(F.array_position(state, least).cast("int") - 1, at)

    def merge_all(self, state: Column, least: Column) -> Column:
        """Merge all pairs of the smallest rank, of overlapping ones every other from the left; null where that may go wrong.

        It differs from merging one after the other only if the new piece makes a pair of a smaller rank with a
        neighbour, before or after that is merged too.
        """
        limit = least - least.bitwiseAND(F.lit(_PLACE))  # the rank, at place 0
        marks = F.array_join(F.transform(state, lambda x: F.when(x < limit + _PLACE, F.lit("1")).otherwise(F.lit("0"))), "")

        def merged(flags: Column) -> Column:
            beside = F.transform(state, lambda x, i: F.when(F.get(flags, i) == "1", self.number(self.place(state, i - 1), F.lit(0), self.place(state, i + 2))))
            new = _let(F.filter(state, lambda x, i: F.get(flags, i) == "0"), self.numbered)
            early = F.array_min(beside) < limit
            return _let(new, lambda s: F.when(~early & F.coalesce(F.array_min(s) > limit, F.lit(True)), s))

        return _let(F.split(F.replace(marks, F.lit("11"), F.lit("10")), ""), merged)

    def step(self, state: Column) -> Column:
        """Merge the leftmost pair of the smallest rank, in a long word all pairs of that rank where that is the same."""

        def merge(least: Column) -> Column:
            first = self.merge_first(state, least)
            return F.when(F.size(state) > SHORT, F.coalesce(self.merge_all(state, least), first)).otherwise(first)

        return _let(F.array_min(state), lambda least: F.when(least < _NO_RANK * (_PLACE + 1), merge(least)).otherwise(state))

    def ids(self) -> Column:
        bytes_ = F.when(F.length(self.word) > 1, F.sequence(F.lit(2).cast("long"), F.length(self.word).cast("long"))).otherwise(F.array().cast("array<long>"))
        last = F.aggregate(bytes_, _let(bytes_, self.numbered), lambda s, _: self.step(s))
        begins = lambda s: F.concat(F.array(F.lit(1).cast("long")), F.transform(s, lambda x: x.bitwiseAND(F.lit(_PLACE))))
        return _let(last, lambda s: F.transform(begins(s), lambda x, i: _rank(self.table, self.piece(x, self.place(s, i)))))


class _ShortFold:
    """The same merges of a short word, one pair a step, with few expressions in each: they are what takes the time.

    The state has integers, with places in ``_SHORT_BITS`` bits, and an entry without a rank at either end: the word's
    begin and end.  So the four places around a pair are read without asking where it lies; beyond the ends they are null.
    """

    def __init__(self, table: Column, word: Column):
        self.table, self.word = table, word

    def number(self, begin: Column, place: Column, end: Column) -> Column:
        rank = _with(F.substring(self.word, begin, end - begin), lambda piece: _rank(self.table, piece), "int")
        return F.coalesce(rank, F.lit(_NO_RANK)) * F.lit(1 << _SHORT_BITS) + place

    def merge(self, state: Column, at: Column) -> Column:
        """Merge the pair at ``at`` (from 1)."""

        def place(i: Column) -> Column:
            return F.get(state, i).bitwiseAND(F.lit((1 << _SHORT_BITS) - 1))

        def renewed(left: Column, right: Column) -> Column:
            return F.array(self.number(place(at - 3), left, right), self.number(left, right, place(at + 1)))

        between = _with(place(at - 2), lambda left: _with(place(at), lambda right: renewed(left, right), "array<int>"), "array<int>")
        return F.flatten(F.array(F.slice(state, F.lit(1), at - 2), between, F.slice(state, at + 2, F.size(state))))

    def step(self, state: Column) -> Column:
        def merge(least: Column) -> Column:
            return _with(F.array_position(state, least).cast("int"), lambda at: self.merge(state, at), "array<int>")

        return _with(F.array_min(state), lambda least: F.when(least < F.lit(_NO_RANK << _SHORT_BITS), merge(least)).otherwise(state), "array<int>")

    def ids(self) -> Column:
        no_pair, n = F.lit(_NO_RANK << _SHORT_BITS), F.length(self.word)
        places = F.sequence(F.lit(2), n)
        pairs = F.transform(places, lambda i: self.number(i - 1, i, i + 1))
        first = F.concat(F.array(no_pair + 1), pairs, F.array(no_pair + n + 1))
        last = F.aggregate(places, first, lambda s, _: self.step(s))

        def piece(state: Column) -> Column:
            begins = F.transform(state, lambda x: x.bitwiseAND(F.lit((1 << _SHORT_BITS) - 1)))
            spans = lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b)), lambda x, y: _with(F.substring(self.word, x, y - x), lambda k: _rank(self.table, k), "int"))
            return _with(begins, spans, "array<int>")

        return _with(last, piece, "array<int>")


def fold_ids(table: Column, raw: Column) -> Column:
    """Ids of one word of at least one byte (binary): its own if it is a piece, else those of its ranked merges."""

    def folded(word: Column) -> Column:
        short = F.length(word) <= min(SHORT, (1 << _SHORT_BITS) - 2)
        return F.when(short, _ShortFold(table, word).ids()).otherwise(_Fold(table, word).ids())

    def ids(word: Column) -> Column:
        return _with(_rank(table, word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded(word)), "array<int>")

    return _with(raw, ids, "array<int>")


def _group(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of the rows of ``batches``, their distinct words, and the place of each word of each row among these."""
    lists = pa.concat_arrays([b.column("words") for b in batches])
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
    rows = pa.concat_arrays([b.column("row") for b in batches])

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    places = pa.ListArray.from_arrays(pa.array(ends), coded.indices.cast(pa.int32()))
    return pa.RecordBatch.from_arrays([one(rows), one(coded.dictionary.cast(pa.string())), one(places)], names=["rows", "words", "places"])


def grouped(rows: DataFrame) -> DataFrame:
    """(row, words) to groups of neighbours, none of which has many more than ``GROUP_BYTES`` of words unless in one batch."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType())))])
    limit = GROUP_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.nbytes
            if held and size + more > limit:
                yield _group(held)
                held, size = [], 0
            held.append(batch)
            size += more
        if held:
            yield _group(held)

    return rows.mapInArrow(run, schema)


class Vocabulary:
    """The ranks of a file and its pattern, as expressions."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.ranks = read_ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)) or sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must be 0, 1, 2 ... and hold every single byte")
        self.pattern = java_pattern(spark, pattern)
        self.table = _literal_map({p: (p.hex().upper(), r) for p, r in self.ranks.items()}, "int")
        pieces = [p.hex() for p, _ in sorted(self.ranks.items(), key=lambda e: e[1])]
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        self.numbers = F.from_json(F.lit(json.dumps([r.to_bytes(4, "little").hex() for r in range(len(pieces))])), "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def common(self, docs: DataFrame, text: str) -> Column:
        """A literal of the ids of common words that are no pieces."""
        sample = docs.where(F.pmod(F.xxhash64(f"`{text}`"), F.lit(SAMPLED)) == 0)
        counts = sample.select(F.explode(self.words(F.col(f"`{text}`"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        counts = saved(counts, "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        often = counts.where((F.col("n") > 1) & (F.col("n") * COMMON >= total) & (F.octet_length("word") <= COMMON_BYTES))
        ids = often.select("word", _with(self.table, lambda t: fold_ids(t, F.encode("word", "UTF-8")), "array<int>").alias("ids")).where(F.size("ids") > 1)
        return _literal_map({r.word.encode(): (r.word, r.ids) for r in ids.toLocalIterator()}, "array<int>")

    def with_ids(self, docs: DataFrame, text: str, ids: str, keep: list[str] | None = None) -> DataFrame:
        """``docs`` (or its columns ``keep``) with the ids of its whole texts; null texts have none."""
        keep = [c for c in docs.columns if c != ids] if keep is None else keep
        known_words = self.common(docs, text)
        groups = grouped(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), self.words(F.col(f"`{text}`")).alias("words")))

        def of_texts(known: Column) -> Column:
            return F.transform("places", lambda p: F.flatten(F.transform(p, lambda i: F.get(known, i))))

        def ids_of(table: Column, common: Column) -> Column:
            def one(word: Column) -> Column:
                return _with(F.encode(word, "UTF-8"), lambda raw: F.coalesce(_found(common, raw, word), fold_ids(table, raw)), "array<int>")

            return F.transform("words", one)

        kind = "array<array<int>>"
        folded = _with(known_words, lambda c: _with(self.table, lambda t: ids_of(t, c), kind), kind)
        made = groups.select("rows", _with(folded, of_texts, "array<array<int>>").alias("ids"))
        each = made.select(F.explode(F.arrays_zip("rows", "ids")).alias("one"))
        return each.select(*[F.col("one.rows").getField(c).alias(c) for c in keep], F.col("one.ids").alias(ids))

    def ids_binary(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return _let(self.numbers, lambda numbers: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(numbers, i)), "")))

    def decoded(self, ids: Column) -> Column:
        """The binary pieces of ids, joined."""
        return _let(self.pieces, lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "bpe_ids", decoded: str = "bpe_bytes") -> DataFrame:
    """``docs`` with the ids of every whole text (array<int>) and the bytes decoded from them (binary).

    Null and empty texts have no ids and decode to no bytes.  Every row stays, repeated ones too, with its other
    columns; columns called ``ids`` or ``decoded`` are replaced.  An empty table gives an empty result.
    """
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    made = vocabulary.with_ids(docs.drop(decoded), text, ids)
    return made.withColumn(decoded, vocabulary.decoded(F.col(f"`{ids}`")))


def token_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of the decoded bytes).

    Nulls, repeated rows and empty tables as in ``encode_decode``; other columns are ignored whatever their names.
    """
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    ids = vocabulary.with_ids(rows, "text", "ids", ["key"])
    digest = [F.sha2(c, 256) for c in (vocabulary.ids_binary(F.col("ids")), vocabulary.decoded(F.col("ids")))]
    return ids.select(F.col("key").alias(key), F.size("ids").cast("long").alias("n_tokens"), digest[0].alias("ids_sha256"), digest[1].alias("decoded_sha256"))
