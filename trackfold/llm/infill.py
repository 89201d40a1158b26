"""Fill-in-middle transformation in two passes over lazy matches.

A text is cut into units, each with the white space before it.  The first pass counts them; the second advances a lazy
match iterator to the two ranks where the text is cut.  No unit is ever stored, so beside the text itself a row needs
constant memory.  White space is ASCII, so matching runs on the UTF-8 bytes of the Arrow column, uncopied.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, text_bytes

UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_LATER_BYTES = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Infill:
    """How texts are rearranged: shares are percentages of documents, and of rearranged ones that begin with the suffix."""

    seed: int = 42
    share: int = 50
    spm_share: int = 80
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self) -> None:
        """An end of a sentinel that begins another one could make up a sentinel with the text beside it."""
        marks = (self.prefix, self.suffix, self.middle)
        if any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, min(len(a), len(b)))) or len({*marks, b""}) < 4:
            raise ValueError("sentinels must be distinct, not empty, and must not overlap")

    def draws(self, key: object) -> list[int]:
        """Four numbers of 32 bits that depend on the seed and the key alone; a null key counts as empty."""
        digest = hashlib.sha256(f"{self.seed}:{'' if key is None else key}".encode()).digest()
        return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]

    def form(self, text: bytes | memoryview, draws: list[int]) -> str:
        """plain, psm or spm; empty texts and texts that hold a sentinel stay plain, as they could not be read back."""
        if not len(text) or draws[2] % 100 >= self.share or any(re.search(re.escape(s), text) for s in (self.prefix, self.suffix, self.middle)):
            return "plain"
        return "spm" if draws[3] % 100 < self.spm_share else "psm"

    def join(self, form: str, text: bytes | memoryview, low: int, high: int) -> bytes:
        """The output for a text that is cut at two byte offsets."""
        if form == "plain":
            return bytes(text)
        head, body, tail = text[:low], text[low:high], text[high:]
        parts = (self.prefix, head, self.suffix, tail, self.middle, body) if form == "psm" else (self.suffix, tail, self.prefix, head, self.middle, body)
        return b"".join(parts)

    def restore(self, form: str, output: bytes) -> bytes:
        """The text of an output: its sentinels stand there once each, so three searches find all parts."""
        if form == "plain":
            return output
        one, two = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        a, c = output.index(two, len(one)), output.rindex(self.middle)
        first, second, body = output[len(one) : a], output[a + len(two) : c], output[c + len(self.middle) :]
        return first + body + second if form == "psm" else second + body + first


def count_units(text: bytes | memoryview) -> int:
    """First pass: the number of units."""
    return sum(1 for _ in UNIT.finditer(text))


def cut(text: bytes | memoryview, ranks: tuple[int, int]) -> tuple[int, int]:
    """Second pass: the byte offsets behind the units of two ascending ranks (0: the text's beginning)."""
    matches = UNIT.finditer(text)
    low = _behind(matches, ranks[0], 0)
    return low, _behind(matches, ranks[1] - ranks[0], low)


def _behind(matches: Iterator, steps: int, here: int) -> int:
    """The end of the match that many steps further; ``here`` if there is no step."""
    last = deque(islice(matches, steps), maxlen=1)
    return last[0].end() if last else here


def _characters(part: bytes | memoryview) -> int:
    return len(bytes(part).translate(None, _LATER_BYTES))


def rearranged(docs: DataFrame, how: Infill = Infill(), key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Per row of ``docs``: key, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    With ``texts`` there are also ``output`` and ``restored``, the text rebuilt from output and form alone.  Null texts
    count as empty; they are plain with n = 0.  prefix_chars and middle_chars are null for plain rows.  Null keys count
    as empty strings in the draws.  Rows that repeat a key get the same draws; every row gives one row.  Other columns
    are ignored whatever their names; an empty table gives an empty result.
    """
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
    fields += [T.StructField(c, T.StringType()) for c in ("output_sha256", "restored_sha256", *(("output", "restored") if texts else ()))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw, at = text_bytes(batch.column(text))
            view, ends = memoryview(raw), at.tolist()
            columns: list[list] = [[] for _ in fields[1:]]
            for r, k in enumerate(batch.column(key).to_pylist()):
                body = view[ends[r] : ends[r + 1]]
                n, draws = count_units(body), how.draws(k)
                form = how.form(body, draws)
                low, high = cut(body, tuple(sorted(h % (n + 1) for h in draws[:2]))) if form != "plain" else (0, 0)
                output = how.join(form, body, low, high)
                back = how.restore(form, output)
                sizes = (None, None) if form == "plain" else (_characters(body[:low]), _characters(body[low:high]))
                row = (n, form, *sizes, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest())
                for c, v in zip(columns, (*row, output.decode(), back.decode()) if texts else row, strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for c, f in zip(columns, fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], names=schema.fieldNames())

    return docs.select(key, text).mapInArrow(run, schema)
