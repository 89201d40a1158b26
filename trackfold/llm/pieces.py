"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut before every stretch of spaces: the model's pieces hold the space mark only at their front, or consist
of nothing else, so no merge crosses such a cut.  (``PieceModel`` checks that; a model with other pieces is encoded in
whole texts.)  Distinct units are merged together: their symbols lie in one flat array, each round finds the smallest
pair rank of every unit (segmented minimum), merges its leftmost non-overlapping occurrences at once, and compacts the
array, until no unit has a pair left.  The library merges one pair at a time, the leftmost of the smallest rank.  It may
go another way where a round makes a pair of no greater rank than its own, or where pairs of different pieces share the
smallest rank (all pieces of spaces do): such a unit is encoded again merge by merge, with a heap of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ragged, slices
from .unitcache import UnitCache

SPACE = "▁"
_NONE = np.int64(1 << 40)
_SLOT_BITS = 22


class PieceModel:
    """The vocabulary of a BPE model file with byte fallback and an identity normaliser.

    Symbols are numbered from 0: all pieces by id, then single characters that are no piece.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        scores = [p.score for p in proto.pieces]
        if any(k not in (1, 2, 3, 6) for k in kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        self.byte = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.splits = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        # rank: the order of scores, equal scores share one
        order = sorted({scores[i] for i in self.id.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        left, right, made, rank = [], [], [], []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                # a character that is no piece can be part of a longer piece
                a = self._symbol(p[:k]) if a is None and k == 1 else a
                b = self._symbol(p[k:]) if b is None and len(p) - k == 1 else b
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), rank.append(rank_of[scores[i]])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        by = np.argsort(key)
        self.pair_key, self.pair_made, self.pair_rank = key[by], np.array(made, np.int64)[by], np.array(rank, np.int64)[by]
        # slots of a hash of the key: the pair's place, -1 for none, -2 where pairs share a slot
        slot = self._slot(self.pair_key)
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        taken, count = np.unique(slot, return_counts=True)
        self.slots[taken[count > 1]] = -2
        surface = [b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.surface = np.frombuffer(b"".join(surface) + b"\0", np.uint8)
        self.surface_len = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.leads_space = np.array([p.startswith(SPACE) and k == 1 for p, k in zip(self.pieces, kinds, strict=True)])
        self.is_byte = np.array([k == 6 for k in kinds])
        self.cache = UnitCache(lambda units: (units, *self.unit_ids([u.replace(" ", SPACE) for u in units])), 300_000)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _pairs(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among the pairs, -1 for none."""
        at = self.slots[self._slot(key)].astype(np.int64)
        if (shared := np.flatnonzero(at == -2)).size:
            at[shared] = np.minimum(np.searchsorted(self.pair_key, key[shared]), len(self.pair_key) - 1)
        at[self.pair_key[at] != key] = -1
        return at

    def _symbol(self, char: str) -> int:
        """The symbol of a character: its piece, or a number behind all pieces."""
        return self.id.get(char, len(self.pieces) + ord(char))

    def merge(self, units: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units after all merges, flat, and the unit each belongs to."""
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        distinct, inverse = np.unique(chars, return_inverse=True)
        symbols = np.array([self._symbol(chr(c)) for c in distinct], np.int64)[inverse] if len(chars) else chars
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        done_s, done_u = [], []
        again: set[int] = set()
        last = np.full(len(units), -1, np.int64)
        while len(symbols) > 1:
            rank = np.full(len(symbols), _NONE)
            made = np.zeros(len(symbols), np.int64)
            key = symbols[:-1] << 32 | symbols[1:]
            at = self._pairs(key)
            ok = (at >= 0) & (unit[:-1] == unit[1:])
            rank[:-1][ok], made[:-1][ok] = self.pair_rank[at[ok]], self.pair_made[at[ok]]
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            least = np.minimum.reduceat(rank, first)
            if not single:
                own = unit[first]
                back = (least <= last[own]) & (least < _NONE)
                again.update(own[back].tolist())
                last[own] = least
            size = np.diff(np.append(first, len(unit)))
            hit = (rank == np.repeat(least, size)) & (rank < _NONE)
            where = np.flatnonzero(hit)
            if not single and len(where):
                other = np.flatnonzero((unit[where[1:]] == unit[where[:-1]]) & (key[where[1:]] != key[where[:-1]]))
                again.update(unit[where[other]].tolist())
            if single:
                where = where[np.concatenate([[True], unit[where[1:]] != unit[where[:-1]]])] if len(where) else where
            elif len(where):
                # leftmost first: in a stretch of overlapping pairs every other one is merged, if it is the same pair
                fresh = np.concatenate([[True], (np.diff(where) > 1) | (unit[where[1:]] != unit[where[:-1]])])
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - begin) % 2 == 0]
            symbols[where] = made[where]
            stay = np.ones(len(symbols), bool)
            stay[where + 1] = False
            # units without a pair leave
            open_ = np.repeat(least < _NONE, size)
            done_s.append(symbols[~open_]), done_u.append(unit[~open_])
            stay &= open_
            symbols, unit = symbols[stay], unit[stay]
        done_s.append(symbols), done_u.append(unit)
        symbols, unit = np.concatenate(done_s), np.concatenate(done_u)
        by = np.argsort(unit, kind="stable")
        symbols, unit = symbols[by], unit[by]
        if again:
            redo = sorted(again)
            parts = [self.in_order(units[i]) for i in redo]
            keep = ~np.isin(unit, redo)
            symbols, unit = np.concatenate([symbols[keep], *parts]), np.concatenate([unit[keep], np.repeat(redo, [len(p) for p in parts])])
            by = np.argsort(unit, kind="stable")
            symbols, unit = symbols[by], unit[by]
        return symbols, unit

    def in_order(self, text: str) -> np.ndarray:
        """Symbols of one unit after its merges one by one, as the library takes them: by rank, then from the left."""
        symbols = [self._symbol(c) for c in text]
        n = len(symbols)
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[int, tuple[int, int] | None] = {}

        def pair(a: int, b: int) -> tuple[int, int] | None:
            key = a << 32 | b
            if key not in known:
                at = int(self._pairs(np.array([key], np.int64))[0])
                known[key] = (int(self.pair_rank[at]), int(self.pair_made[at])) if at >= 0 else None
            return known[key]

        heap = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pair(symbols[i], symbols[i + 1]))]
        heapify(heap)
        while heap:
            _, i, a, b, made = heappop(heap)
            j = behind[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two was merged since
            symbols[i], symbols[j] = made, -1
            behind[i] = behind[j]
            if behind[i] < n:
                before[behind[i]] = i
                if p := pair(made, symbols[behind[i]]):
                    heappush(heap, (p[0], i, made, symbols[behind[i]], p[1]))
            if before[i] >= 0 and (p := pair(symbols[before[i]], made)):
                heappush(heap, (p[0], before[i], symbols[before[i]], made, p[1]))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, flat, and how many each has; characters that are no piece become their UTF-8 bytes' pieces."""
        symbols, unit = self.merge(units)
        other = symbols >= len(self.pieces)
        if other.any():
            parts = [[self.byte[b] for b in chr(s - len(self.pieces)).encode()] for s in symbols[other]]
            sizes = np.ones(len(symbols), np.int64)
            sizes[other] = [len(p) for p in parts]
            flat = np.repeat(symbols, sizes)
            flat[np.repeat(other, sizes)] = np.concatenate(parts)
            symbols, unit = flat, np.repeat(unit, sizes)
        return symbols.astype(np.int32), np.bincount(unit, minlength=len(units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text begins (with the total at the end)."""
        n_units, keys = [], []
        for t in texts:
            t = t.replace(SPACE, " ")
            if not t:
                n_units.append(0)
                continue
            t = " " + t if self.dummy_prefix else t
            if not self.splits:
                parts = [t]
            else:
                # "a  b" splits into "a", "", "b": empty parts are spaces that belong to the next unit
                parts = t.split(" ")
                if "" in parts[1:]:
                    whole, run = [], 0
                    for k, p in enumerate(parts):
                        run += k > 0
                        if p:
                            whole.append(" " * run + p)
                            run = 0
                    parts = [*whole, " " * run] if run else whole
                elif parts[0]:
                    parts = [parts[0], *[" " + p for p in parts[1:]]]
                else:
                    parts = [" " + p for p in parts[1:]]
            n_units.append(len(parts))
            keys += parts
        ids, at = self.cache.ids(keys)
        return ids, at[np.concatenate([[0], np.cumsum(n_units)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of flat ids: surfaces joined, one leading space of the dummy prefix dropped, bad UTF-8 replaced byte by byte."""
        sizes = self.surface_len[ids]
        data = self.surface[ragged(self.surface_at[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[at]
        lead = np.zeros(len(at) - 1, np.int64)
        full = np.diff(at) > 0
        if self.dummy_prefix:
            lead[full] = self.leads_space[ids[at[:-1][full]]]
        out = []
        for r, (a, b) in enumerate(zip((ends[:-1] + lead).tolist(), ends[1:].tolist(), strict=True)):
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_one(ids[at[r] : at[r + 1]]))
        return out

    def _decode_one(self, ids: np.ndarray) -> str:
        """As decode, for ids whose byte pieces are no valid UTF-8: each stray byte becomes U+FFFD."""
        out, run = [], b""

        def flush() -> str:
            text, rest = "", run
            while rest:
                for n in (1, 2, 3, 4):
                    try:
                        text += rest[:n].decode()
                        rest = rest[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text += "�"
                    rest = rest[1:]
            return text

        for k, i in enumerate(ids.tolist()):
            s = self.surface[self.surface_at[i] : self.surface_at[i] + self.surface_len[i]].tobytes()
            if self.is_byte[i]:
                run += s
                continue
            out.append(flush())
            run = b""
            out.append(s[1 if k == 0 and self.dummy_prefix and self.leads_space[i] else 0 :].decode())
        return "".join([*out, flush()])


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, read once by each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", decoded: str = "piece_text") -> DataFrame:
    """``docs`` with the ids of every whole text and the text decoded from these ids.

    Null and empty texts have no ids and decode to the empty text.  Columns of these names are replaced; others stay.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches, text):
            flat, at = m.encode([t or "" for t in batch.column(text).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(m.decode(flat, at), pa.string())], names=[*keep, ids, decoded])

    return docs.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256 (and piece_ids, if asked for), in one pass."""
    import hashlib

    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("piece_ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        names = np.array([str(i) for i in range(len(m.pieces))], object)
        for batch in slices(batches, text):
            flat, at = m.encode([t or "" for t in batch.column(text).to_pylist()])
            words = names[flat].tolist()
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            sha = [hashlib.sha256(",".join(words[a:b]).encode()).hexdigest() for a, b in spans]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in m.decode(flat, at)]
            columns = [batch.column(key), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(key, text).mapInArrow(run, schema)
