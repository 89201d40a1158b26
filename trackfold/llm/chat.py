"""Chat formatting: whole conversations rendered by a template, encoded once, with masks aligned by offsets.

Template: ``<s>``, then each turn as ``[INST]text[/INST]`` (user), ``[SYS]text[/SYS]`` (system), ``text</s>`` (assistant)
or ``[ROLE]role[/ROLE]text[/TURN]`` (any other role).  Within texts a control string gets one more backslash behind its
first character, which is taken away when the output is read: texts without control strings stay as they are.  The
control strings are single tokens of their own, so no token reaches over a turn's border.

The rows of a conversation stream through one task in the order of their turns.  A conversation is encoded once; one of
more than ``PART_CHARS`` is stored in parts that end at a turn and are encoded one after the other, which bounds memory:
as control tokens cut the text there, the parts' tokens are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

PART_CHARS = 1 << 18
#: The control strings.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]"]
_NAMES = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(rf"(?P<open>[<\[])(?P<bars>\\*)(?P<rest>{_NAMES})")
_UNESCAPE = re.compile(rf"(?P<open>[<\[])\\(?P<bars>\\*)(?P<rest>{_NAMES})")
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]|(?P<assistant>.*?)</s>", re.S)


def escape(text: str) -> str:
    """One more backslash behind the first character of each control string."""
    return _ESCAPE.sub(r"\g<open>\\\g<bars>\g<rest>", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _UNESCAPE.sub(r"\g<open>\g<bars>\g<rest>", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted text, and where its text begins and ends in it."""
    own = escape(text)
    if role == "assistant":
        return own + "</s>", 0, len(own)
    if role == "user":
        front, back = "[INST]", "[/INST]"
    elif role == "system":
        front, back = "[SYS]", "[/SYS]"
    else:
        front, back = f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]"
    return front + own + back, len(front), len(front) + len(own)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text (without the leading ``<s>``)."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("no turn")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["system"] is not None:
            out.append(("system", unescape(m["system"])))
        elif m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["other"])))
        else:
            out.append(("assistant", unescape(m["assistant"])))
        at = m.end()
    return out


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The library's tokenizer of a file, with the control strings as tokens of their own."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        # the file's own special strings are ordinary text within a turn
        t.add_tokens([AddedToken(c, normalized=False, special=False) for c in CONTROLS])
        t.encode_special_tokens = True
        _encoders[path] = t
    return _encoders[path]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (sorted character ranges) lie in one of the sorted spans, by binary search of each token's place."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 0] < spans[at, 1]) & (offsets[:, 1] <= spans[at, 1])


_PARTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("token_start", T.ArrayType(T.IntegerType())),
        T.StructField("token_end", T.ArrayType(T.IntegerType())),
        T.StructField("loss", T.ArrayType(T.BooleanType())),
    ]
)


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """One row for each part of a conversation: formatted text, token ids, their character ranges, and the loss mask.

    ``rows``: conv_id, turn, role, text.  Null text and null role count as empty, a null turn comes first, a null
    conv_id is one conversation; rows of equal turn go by role and text, and repeated rows stay.  Other columns are
    ignored.  Parts of a conversation follow each other within a partition.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(path)
        now, part, text, size, spans = None, 0, [], 0, []
        waiting: list[tuple] = []

        def flush(last: bool) -> None:
            whole = "".join(text)
            e = t.encode(whole, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            waiting.append((now[0], part, last, whole, e.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets, np.array(spans, np.int64).reshape(-1, 2))))

        for batch in batches:
            for conv, role, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        flush(True)
                    now, part, text, size, spans = (conv,), 0, ["<s>"], 3, []
                elif size > PART_CHARS:
                    flush(False)
                    part, text, size, spans = part + 1, [], 0, []
                formatted, a, b = render_turn(role, own)
                if role == "assistant" and b > a:
                    spans.append((size + a, size + b))
                text.append(formatted)
                size += len(formatted)
                if len(waiting) >= 256 or (waiting and len(waiting[-1][3]) > PART_CHARS):
                    yield _batch(waiting)
                    waiting.clear()
        if now is not None:
            flush(True)
        if waiting:
            yield _batch(waiting)

    return dealt.mapInArrow(run, _PARTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_PARTS.fieldNames())


def masked_texts(formatted: str, start: np.ndarray, end: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text under the loss mask, unescaped."""
    a, b = start[loss], end[loss]
    if not len(a):
        return []
    fresh = np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]])
    heads = np.flatnonzero(fresh)
    return [unescape(formatted[x:y]) for x, y in zip(a[heads].tolist(), np.maximum.reduceat(b, heads).tolist(), strict=True)]


_REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from the formatted parts alone: turns and their digest, text under the mask and its digest, sizes.

    The parts may lie in any order, as they do in files: those of a conversation are brought together and sorted.
    """
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c) for c in _PARTS.fieldNames()]
            for r in range(batch.num_rows):
                conv, part, last, formatted = (c[r].as_py() for c in columns[:4])
                start, end, loss = (columns[k][r].values.to_numpy(zero_copy_only=False) for k in (5, 6, 7))
                if part == 0:
                    turns_sha, loss_sha, sums = hashlib.sha256(), hashlib.sha256(), np.zeros(5, np.int64)
                turns = read_turns(formatted[3:] if part == 0 else formatted)
                for role, text in turns:
                    turns_sha.update(f"{role}\n{text}\n".encode())
                loss_chars = 0
                for text in masked_texts(formatted, start, end, loss.astype(bool)):
                    loss_sha.update(text.encode())
                    loss_chars += len(text)
                sums += (len(turns), loss_chars, len(formatted), len(loss), int(loss.sum()))
                if last:
                    n, chars, whole, tokens, masked = sums.tolist()
                    out.append((conv, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), whole, tokens, masked))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _REPORT.split(", ")])

    return parts.mapInArrow(run, _REPORT)


#: A conversation that says control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_report(rows: DataFrame, path: str) -> DataFrame:
    """Format all conversations and the probe, write the output to the shared folder, and read it back from there.

    Null texts and roles count as empty; null keys are one conversation; rows that repeat a turn stay; an empty table
    gives the probe alone; turns of any length are taken whole.  Other columns are ignored.
    """
    rows = rows.select(*(F.col(c).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    probe = rows.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(saved(format_conversations(rows.union(probe), path), "formatted"))
