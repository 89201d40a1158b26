"""Token ids in binary shard files: one zstandard frame for each document, all with one shared dictionary.

The dictionary is trained on the serialized id arrays of a bounded sample of documents.  A shard file is

    magic (8 bytes) | sha256 of the dictionary (32) | bytes of an id (u8) | frames | index | index offset (u64) | documents (u64) | magic

with an index row (doc_id i64, offset u64, bytes u32, ids u32, ids before it in the shard u64) for each document, so
that one short document is read with two small reads.  Shards hold ascending ranges of doc_id; ``manifest`` rows give
each shard's path, documents, ids and ids before it.  A file has the name of its task attempt, and only the files of
attempts that ended well are in the manifest, so an attempt that is lost or repeated leaves no broken or double shard.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, shared_folder, slices
from .unitcache import CACHE_UNITS, UnitCache

MAGIC = b"TFTOKEN1"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("before", "<u8")])
END_ID = 2
#: Rows and text characters at most that the dictionary is trained on, and its size.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4_000_000, 64 << 10
LEVEL = 3
#: Characters of text that a shard holds on average at most, which bounds a task's work and the index that it keeps.
SHARD_CHARS = 1 << 30
_NULL_ID = -(1 << 63)
_EXACT = "\ue000"
_JOINED = 300
_PUNCTUATION = frozenset(string.punctuation)
#: Between a letter or digit and ASCII punctuation, and on both sides of a single newline, a token ends.
_CUT = re.compile(r"(?<=[^\W_])(?=[!-/:-@\[-`{-~])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: White space in front of a space, and white space beyond ASCII.
_SPACED = [w + " " for w in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]
_WIDE = list("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class TextTokenizer:
    """The tokenizers library behind a cache of units.

    A byte-level pre-tokenizer never lets a token reach from a non-space over a following space, so texts are cut
    before each space that has a non-space in front.  A text with a string of a special token is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # every unit comes once: the library's own cache would only be filled
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.id_bytes = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.token_bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.token_bytes[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        self.cache = UnitCache(self._encode, CACHE_UNITS)
        if "ByteLevel(add_prefix_space=False" not in str(self.library.pre_tokenizer) or self.library.normalizer is not None:
            raise ValueError("only byte-level tokenizers without normaliser and prefix space are supported")

    def _encode(self, keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Ids of units and of their parts: a unit is cut at certain token borders, before punctuation and around a newline."""
        known, cut, need = self.cache.place, {}, {}
        for k in keys:
            if k.isalpha() or k[0:1] == _EXACT:
                need[k] = None
                continue
            if k[-1:] in _PUNCTUATION and k[:-1].isalpha():  # the commonest cut
                cut[k] = parts = [k[:-1], _EXACT + k[-1]]
            else:
                first, *more = _CUT.split(k)
                if not more:
                    need[k] = None
                    continue
                cut[k] = parts = [first, *[_EXACT + p for p in more]]
            for p in parts:
                if p not in known:
                    need[p] = None
        new = list(need)
        flat, sizes = self._encode_words(new) if new else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if not cut:
            return new, flat, sizes
        # parts lie in the cache, or behind it among the new ones
        n, offset = len(known), self.cache.n_flat
        place = {k: n + i for i, k in enumerate(new)}
        begin = np.concatenate([self.cache.begin[:n], offset + np.cumsum(sizes) - sizes])
        size = np.concatenate([self.cache.size[:n], sizes])
        at = np.fromiter((place[p] if p in place else known[p] for parts in cut.values() for p in parts), np.int64)
        joined = np.concatenate([self.cache.flat[:offset], flat])[ragged(begin[at], size[at])]
        heads = np.cumsum([0, *map(len, cut.values())])[:-1]
        return [*new, *cut], np.concatenate([flat, joined]), np.concatenate([sizes, np.add.reduceat(size[at], heads)])

    def _encode_words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: those with a space in front are joined and encoded in stretches, as their borders are token borders."""
        exact = [i for i, k in enumerate(keys) if k[0:1] == _EXACT]
        spaced = [" " + k for k in keys if k[0:1] != _EXACT]
        stretches = ["".join(spaced[a : a + _JOINED]) for a in range(0, len(spaced), _JOINED)]
        encoded = self.library.encode_batch_fast([*stretches, *(keys[i][1:] for i in exact)], add_special_tokens=False)
        joined = np.fromiter(chain.from_iterable(e.ids for e in encoded[: len(stretches)]), np.int32)
        ends = np.searchsorted(np.cumsum(self.token_bytes[joined]), np.cumsum([len(u.encode()) for u in spaced]), side="left") + 1 if spaced else np.zeros(0, np.int64)
        if not exact:
            return joined, np.diff(ends, prepend=0)
        alone = [e.ids for e in encoded[len(stretches) :]]
        sizes = np.zeros(len(keys), np.int64)
        other = np.ones(len(keys), bool)
        other[exact] = False
        sizes[other], sizes[exact] = np.diff(ends, prepend=0), [len(i) for i in alone]
        flat = np.zeros(int(sizes.sum()), np.int32)
        from_joined = np.repeat(other, sizes)
        flat[from_joined], flat[~from_joined] = joined, np.fromiter(chain.from_iterable(alone), np.int32)
        return flat, sizes

    def keys(self, t: str) -> list[str]:
        """The units of a text: a key stands for itself with a space in front, or begins with _EXACT and stands for the rest."""
        if any(s in t for s in self.special):
            return [_EXACT + t]
        parts = t.split(" ")
        if _EXACT not in t and not any(s in t for s in _SPACED) and (t.isascii() or not any(s in t for s in _WIDE)):
            if parts[0]:
                parts[0] = _EXACT + parts[0]
            elif len(parts) > 1:
                del parts[0]  # the text begins with a space
            return parts
        units, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if open_:
                units[-1] += " " + p
            else:
                units.append(" " + p)
            open_ = not p or p[-1].isspace()
        return [_EXACT + u for u in units]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each begins (with the total at the end)."""
        keys: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                keys += self.keys(t)
            ends.append(len(keys))
        ids, at = self.cache.ids(keys)
        return ids, at[np.array(ends)]


_tokenizers: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """The tokenizer of a file, read once by each worker."""
    if path not in _tokenizers:
        _tokenizers[path] = TextTokenizer(path)
    return _tokenizers[path]


@dataclass
class TokenFiles:
    """What was written: shards as (path, documents, ids, ids before) in ascending order of doc_id, and the dictionary."""

    folder: str
    dictionary: bytes
    shards: list[tuple[str, int, int, int]]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def train_dictionary(docs: DataFrame, path: str, key: str, text: str) -> bytes:
    """A dictionary from the id arrays of at most SAMPLE_ROWS documents, chosen by a hash of the key.

    Of a text above SAMPLE_CHARS / SAMPLE_ROWS characters a stretch at a hashed place is taken.  From too few samples to
    train on, the dictionary is their ids as they are; it is empty only if no text has an id.
    """
    import zstandard

    longest = SAMPLE_CHARS // SAMPLE_ROWS
    hashed = docs.select(F.col(text).alias("__t"), F.xxhash64(key).alias("__h")).where(F.length("__t") > 0)
    least = hashed.select("__h").orderBy("__h").limit(SAMPLE_ROWS).agg(F.max("__h")).first()[0]
    if least is None:
        return b""
    at = F.pmod(F.col("__h"), F.greatest(F.length("__t") - longest, F.lit(0)) + 1).cast("int") + 1
    rows = hashed.where(F.col("__h") <= least).select(F.substring("__t", at, F.lit(longest)).alias("t"), "__h").orderBy("__h", "t").limit(SAMPLE_ROWS).collect()
    ids, at = tokenizer(path).encode([r[0] for r in rows])
    data = ids.astype(f"<u{tokenizer(path).id_bytes}")
    samples = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every whole text (null counts as empty), append END_ID, and write the shard files.

    Rows of equal key stay neighbours; a null key comes first.  An empty table gives one empty shard.  Shards hold ranges
    of keys of about equal numbers of rows, as many as there are shuffle partitions, and more where these would hold more
    than SHARD_CHARS; a key with more rows than a shard has several shards of its own.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, key, text)
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    ranges = [i / n for i in range(1, n)]
    bounds, times = np.unique(np.array(docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", ranges, 0.25 / n) if n > 1 else [], np.float64), return_counts=True)
    # range r begins at bounds[r - 1]; a bound that is met several times is a key with its own shards, in front of the range
    own = np.concatenate([[0], np.where(np.abs(bounds) < 2.0**53, times - 1, 0)])
    front = np.cumsum(own + 1) - own - 1
    n_shards = int((own + 1).sum())
    shared = spark.sparkContext.broadcast((dictionary, bounds, own, front))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, compressor = tokenizer(path), _compressor(shared.value[0])
        _, bounds, own, front = shared.value
        n_rows = TaskContext.get().partitionId()
        for batch in slices(batches, text):
            ids, at = t.encode([x or "" for x in batch.column(text).to_pylist()])
            whole = np.full(len(ids) + batch.num_rows, END_ID, f"<u{t.id_bytes}")
            begin = at + np.arange(batch.num_rows + 1)
            text_id = np.ones(len(whole), bool)
            text_id[begin[1:] - 1] = False
            whole[text_id] = ids
            raw = memoryview(whole.tobytes())
            frames = [compressor.compress(raw[a * t.id_bytes : b * t.id_bytes]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            keys = batch.column(key).cast(pa.int64()).fill_null(_NULL_ID)
            k = keys.to_numpy().astype(np.float64)
            part = np.searchsorted(bounds, k, side="right")
            common = (own[part] > 0) & (k == np.append(bounds, np.nan)[part - 1])
            turn = (n_rows + np.arange(len(k))) % np.maximum(own[part], 1)
            n_rows += len(k)
            shard = front[part] + np.where(common, turn, own[part])
            yield pa.RecordBatch.from_arrays([keys, pa.array(shard, pa.int32()), pa.array(np.diff(begin), pa.int64()), pa.array(frames, pa.binary())], names=["key", "shard", "ids", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId()
        filesystem, base = _filesystem(folder)
        name = f"shard-{number:06d}-{task.taskAttemptId()}.tok"
        rows, offset, before = [], len(MAGIC) + 33, 0
        with filesystem.open_output_stream(f"{base}/{name}") as f:
            f.write(MAGIC + hashlib.sha256(shared.value[0]).digest() + bytes([tokenizer(path).id_bytes]))
            for batch in batches:
                n_ids, keys = batch.column("ids").to_numpy(), batch.column("key").to_numpy()
                frames = batch.column("frame").to_pylist()
                sizes = np.array([len(x) for x in frames], np.int64)
                index = np.zeros(batch.num_rows, INDEX)
                index["doc_id"], index["bytes"], index["ids"] = keys, sizes, n_ids
                index["offset"] = offset + np.cumsum(sizes) - sizes
                index["before"] = before + np.cumsum(n_ids) - n_ids
                offset, before = offset + int(sizes.sum()), before + int(n_ids.sum())
                rows.append(index)
                f.write(b"".join(frames))
            index = np.concatenate(rows) if rows else np.zeros(0, INDEX)
            f.write(index.tobytes() + np.array([offset, len(index)], "<u8").tobytes() + MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([len(index)], pa.int64()), pa.array([before], pa.int64())], names=["shard", "documents", "ids"])

    filesystem, base = _filesystem(folder)
    filesystem.create_dir(base, recursive=True)
    with filesystem.open_output_stream(f"{base}/dictionary.zdict") as f:
        f.write(dictionary)
    encoded = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(encode, "key long, shard int, ids long, frame binary")
    dealt = encoded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("key", "frame")
    written = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard string, documents long, ids long").collect())  # one row a shard
    shards, before = [], 0
    for name, documents, ids in written:
        shards.append((f"{folder}/{name}", documents, ids, before))
        before += ids
    with filesystem.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "shards": shards}).encode())
    return TokenFiles(folder, dictionary, shards)


def open_files(folder: str) -> TokenFiles:
    """The token files that a finished ``write_tokens`` left in a folder."""
    filesystem, base = _filesystem(folder)
    with filesystem.open_input_file(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    with filesystem.open_input_file(f"{base}/dictionary.zdict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != manifest["dictionary"]:
        raise ValueError(f"{folder} has another dictionary than its manifest names")
    return TokenFiles(folder, dictionary, [tuple(s) for s in manifest["shards"]])


def read_shard(path: str, dictionary: bytes, at: int | None = None) -> Iterator[tuple[np.void, np.ndarray]]:
    """The index rows and id arrays of a shard file, or only those of index row ``at``; the dictionary must be the one it names."""
    filesystem, base = _filesystem(path)
    with filesystem.open_input_file(base) as f:
        size = f.size()
        head = f.read_at(len(MAGIC) + 33, 0)
        tail = f.read_at(len(MAGIC) + 16, size - len(MAGIC) - 16)
        if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC or head[len(MAGIC) : -1] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} is no token file of this dictionary")
        kind = f"<u{head[-1]}"
        begin, n = np.frombuffer(tail[:16], "<u8").tolist()
        decompressor = _decompressor(dictionary)
        if at is not None:
            row = np.frombuffer(f.read_at(INDEX.itemsize, begin + at * INDEX.itemsize), INDEX)[0]
            yield row, np.frombuffer(decompressor.decompress(f.read_at(int(row["bytes"]), int(row["offset"]))), kind)
            return
        index = np.frombuffer(f.read_at(n * INDEX.itemsize, begin), INDEX)
        for a in range(0, n, 256):
            rows = index[a : a + 256]
            block, first = f.read_at(int(rows["bytes"].sum()), int(rows["offset"][0])), int(rows["offset"][0])
            for row in rows:
                o = int(row["offset"]) - first
                yield row, np.frombuffer(decompressor.decompress(block[o : o + int(row["bytes"])]), kind)


def read_tokens(spark: SparkSession, files: TokenFiles, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Documents read back from the files: key, start, n_tokens, ids_crc32 (of little-endian 32-bit ids), and ids if asked for."""
    shared = spark.sparkContext.broadcast((files.dictionary, files.shards))
    fields = [T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                path, _, _, before = shared.value[1][number]
                rows: list[tuple] = []
                pending = 0
                for row, tokens in read_shard(path, shared.value[0]):
                    k = int(row["doc_id"])
                    rows.append((None if k == _NULL_ID else k, before + int(row["before"]), len(tokens), zlib.crc32(tokens.astype("<u4")), *([tokens.astype(np.int32)] if ids else [])))
                    pending += len(tokens)
                    if len(rows) >= 5000 or pending > 2_000_000:
                        yield _rows(rows, ids, key)
                        rows, pending = [], 0
                if rows:
                    yield _rows(rows, ids, key)

    n = len(files.shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, T.StructType(fields))


def _rows(rows: list[tuple], ids: bool, key: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    if ids:
        arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])


def token_report(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` into a (new) folder and read them back.

    Null and empty texts are one end id; repeated rows are written one by one; null keys come first; long texts are
    encoded whole; an empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, path, folder or shared_folder(spark)))
