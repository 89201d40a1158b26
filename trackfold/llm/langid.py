"""Language identification with a linear-chain conditional random field over the words of a text.

Every word gets a label; emissions are sums of hashed features (prefixes, suffixes, and all character bigrams and
trigrams of the word, and lexicon features), transitions are learned.  A run of more than ``PIECE`` bytes without a
space, as in scripts that write none, is cut into pieces that are labelled one by one, so every byte of a text counts.
Marginals come from forward-backward.  Both are exact for texts of any length: sequences are cut into blocks, the
blocks' transfer matrices are multiplied in parallel, joined one after the other, and the blocks then run forward and
backward in parallel from their true borders.

Documents carry one language each, so the training sequences are made to switch: stretches of words from different
documents of the sample follow each other.  The model is fitted in a task, on a bounded sample of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, slices, text_bytes
from .words import mix, word_table

#: Training rows of each language at most (the documented bound of the sample).
ROWS_PER_LANGUAGE = 400
#: Hashed feature weights, lexicon words of each language, bytes of a word or piece.
FEATURES, LEXICON, PIECE = 1 << 16, 2000, 32
BLOCK = 64
UNKNOWN = "und"


@dataclass
class Model:
    """Languages, emission weights by feature, transition and start scores, and the languages of each lexicon word."""

    languages: list[str]
    weights: np.ndarray  # FEATURES x L, float32
    transition: np.ndarray  # L x L
    start: np.ndarray  # L
    lexicon: np.ndarray  # sorted word hashes
    lexicon_at: np.ndarray  # where each word's languages begin
    lexicon_language: np.ndarray  # languages that have the word among their commonest


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters of U+00C0-U+00DE in lower case."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, flat, and where each word's begin.  ``data`` is lower-cased already."""
    n = len(starts)
    length = ends - starts
    parts: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    first = 2 + len(model.languages)  # below: the bias, "in no lexicon", and one for each language's lexicon

    def add(words: np.ndarray, at: np.ndarray, size: int, kind: int) -> None:
        value = sum(data[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(size))
        parts.append((mix(value ^ (np.uint64(kind) << np.uint64(56))) % np.uint64(FEATURES - first)).astype(np.int64) + first)
        owner.append(words)

    for size in (1, 2, 3, 4):  # prefixes and suffixes
        words = np.flatnonzero(length >= size)
        add(words, starts[words], size, size)
        add(words, ends[words] - size, size, 8 + size)
    for size in (2, 3):  # character n-grams at every place
        count = np.maximum(length - size + 1, 0)
        add(np.repeat(np.arange(n), count), ragged(starts, count), size, 16 + size)
    every = np.arange(n)
    if len(model.lexicon):
        place = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        known = model.lexicon[place] == hashes
        count = np.where(known, np.diff(model.lexicon_at)[place], 0)
        parts.append(2 + model.lexicon_language[ragged(model.lexicon_at[place], count)].astype(np.int64))
        owner.append(np.repeat(every, count))
        parts.append(np.ones(int((~known).sum()), np.int64))
        owner.append(every[~known])
    parts.append(np.zeros(n, np.int64))  # the bias
    owner.append(every)
    flat, own = np.concatenate(parts), np.concatenate(owner)
    by = np.argsort(own, kind="stable")
    return flat[by], np.searchsorted(own[by], np.arange(n + 1))


def emission_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Emission scores of words given by byte ranges; one row of L scores for each."""
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32)
    out = []
    for a in range(0, len(starts), 1 << 16):  # bounds the features that are held at once
        features, at = word_features(data, starts[a : a + (1 << 16)], ends[a : a + (1 << 16)], hashes[a : a + (1 << 16)], model)
        out.append(np.add.reduceat(model.weights[features], at[:-1], axis=0))
    return np.concatenate(out)


def marginals(scores: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word by forward-backward, for sequences that begin at ``first``; and those from the words before alone."""
    n, size = scores.shape
    if not n:
        return np.zeros((0, size)), np.zeros((0, size))
    move = np.exp(model.transition - model.transition.max()).astype(np.float64)
    begin = np.exp(model.start - model.start.max()).astype(np.float64)
    emit = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64) + 1e-30
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    row = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[:-1][row] + number * BLOCK
    length = np.minimum(counts[row] - number * BLOCK, BLOCK)
    by = np.argsort(-length, kind="stable")
    at, length, row, number = at[by], length[by], row[by], number[by]
    live = [int(np.searchsorted(-length, -k, side="left")) for k in range(BLOCK)]  # blocks longer than k
    several = blocks.max() > 1
    entry = np.tile(begin, (len(at), 1))  # what the first word of a block is multiplied with
    leave = np.ones((len(at), size))
    if several:
        # transfer[b]: product of (move, emit) over the words of block b, rows: the label before
        transfer = np.tile(np.eye(size), (len(at), 1, 1))
        for k in range(BLOCK):
            m = live[k]
            if not m:
                break
            t = (transfer[:m] @ move) * emit[at[:m] + k][:, None, :]
            transfer[:m] = t / t.sum((1, 2), keepdims=True)
        order = np.lexsort((number, row))
        rank = number[order]
        head = np.flatnonzero(rank == 0)
        n_blocks = np.diff(np.append(head, len(order)))
        heads, sizes = head, n_blocks
        # forward over the blocks of each sequence, one step for all sequences at a time
        first_block = order[heads]
        f = np.zeros((len(heads), size))
        a = begin * emit[at[first_block]]
        # the first block has no label before its first word: walk it from the start vector
        state = a / a.sum(1, keepdims=True)
        for k in range(1, BLOCK):
            on = length[first_block] > k
            if not on.any():
                break
            s = (state[on] @ move) * emit[at[first_block[on]] + k]
            state[on] = s / s.sum(1, keepdims=True)
        f = state
        for j in range(1, int(sizes.max())):
            on = np.flatnonzero(sizes > j)
            b = order[heads[on] + j]
            entry[b] = f[on] @ move
            s = np.einsum("bi,bij->bj", f[on], transfer[b])
            f[on] = s / s.sum(1, keepdims=True)
        g = np.ones((len(heads), size))
        for j in range(int(sizes.max()) - 1, 0, -1):
            on = np.flatnonzero(sizes > j)
            b = order[heads[on] + j]
            s = np.einsum("bij,bj->bi", transfer[b], g[on])
            g[on] = s / s.sum(1, keepdims=True)
            leave[order[heads[on] + j - 1]] = g[on]
    forward = np.zeros((n, size))
    state = entry.copy()
    for k in range(BLOCK):
        m = live[k]
        if not m:
            break
        s = state[:m] * emit[at[:m] + k] if k == 0 else (state[:m] @ move) * emit[at[:m] + k]
        state[:m] = s / s.sum(1, keepdims=True)
        forward[at[:m] + k] = state[:m]
    # backward: after the last word of a block comes what leave says
    filtered = forward.copy()
    state = leave.copy()
    for k in range(BLOCK - 1, -1, -1):
        m = live[k]
        if not m:
            continue
        forward[at[:m] + k] *= state[:m]
        s = (state[:m] * emit[at[:m] + k]) @ move.T
        state[:m] = s / s.sum(1, keepdims=True)
    return forward / forward.sum(1, keepdims=True), filtered


def train(rows: list[tuple[str, str]], seed: int = 11, steps: int = 260, batch: int = 192, span: int = 24, rate: float = 0.12) -> Model | None:
    """Fit on (language, text) rows by AdaGrad on the likelihood of sequences that switch between documents."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    parts, offset = [], 0
    for part in slices([pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.string())], names=["text"])], "text"):
        own, at = text_bytes(part.column("text"))
        own = _lowered(own)
        h, a, e, f = word_table(own, at, PIECE)
        parts.append((own, h, a + offset, e + offset, np.diff(f)))
        offset += len(own)
    data, hashes, starts, ends, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    label = np.repeat([languages.index(lang) for lang, _ in rows], counts)
    size = len(languages)
    pairs = []
    for k in range(size):
        word, count = np.unique(hashes[label == k], return_counts=True)
        word = word[np.lexsort((word, -count))[:LEXICON]]
        pairs.append((word, np.full(len(word), k, np.int32)))
    word, of = (np.concatenate(p) for p in zip(*pairs, strict=True))
    by = np.lexsort((of, word))
    lexicon, at = np.unique(word[by], return_index=True)
    model = Model(languages, np.zeros((FEATURES, size), np.float32), np.zeros((size, size)), np.zeros(size), lexicon, np.append(at, len(by)), of[by])
    distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    features, f_at = word_features(data, starts[where], ends[where], distinct, model)
    f_len = np.diff(f_at)
    pools = [p for k in range(size) if len(p := np.flatnonzero(label == k))]
    g_w, g_t, g_s = np.full((FEATURES, size), 1e-6, np.float32), np.full((size, size), 1e-6), np.full(size, 1e-6)
    for _ in range(steps if size > 1 else 0):
        # sequences of stretches of 4 to 24 words, each from a language drawn anew
        seq, lab = [], []
        while len(seq) < batch * span:
            pool = pools[rng.integers(len(pools))]
            n = int(rng.integers(4, 25))
            a = int(rng.integers(max(1, len(pool) - n)))
            part = pool[a : a + n]
            seq += part.tolist()
            lab += label[part].tolist()
        words, y = inverse[np.array(seq[: batch * span])], np.array(lab[: batch * span])
        n_f = f_len[words]
        flat = features[ragged(f_at[:-1][words], n_f)]
        scores = np.add.reduceat(model.weights[flat], np.cumsum(n_f) - n_f, axis=0)
        begin = np.arange(0, batch * span + 1, span)
        p, filtered = marginals(scores, begin, model)
        grad = p.copy()
        grad[np.arange(len(y)), y] -= 1
        grad /= batch
        # pair probabilities: what the words before say of the first label, and all words of the second given the first
        inner = np.ones(len(y), bool)
        inner[begin[:-1]] = False
        b = np.flatnonzero(inner)
        move = np.exp(model.transition)
        expected = (filtered[b - 1][:, :, None] * move[None] * (p[b] / np.maximum(filtered[b - 1] @ move, 1e-300))[:, None, :]).sum(0)
        seen = np.zeros((size, size))
        np.add.at(seen, (y[b - 1], y[b]), 1)
        d_t = (expected - seen) / batch
        d_s = (p[begin[:-1]].sum(0) - np.bincount(y[begin[:-1]], minlength=size)) / batch
        used, place = np.unique(flat, return_inverse=True)
        d_w = np.zeros((len(used), size), np.float32)
        own = np.repeat(np.arange(len(words)), n_f)
        for k in range(size):
            d_w[:, k] = np.bincount(place, weights=grad[own, k], minlength=len(used))
        d_w += 1e-5 * model.weights[used]
        g_w[used] += d_w**2
        model.weights[used] -= rate * d_w / np.sqrt(g_w[used])
        g_t += d_t**2
        g_s += d_s**2
        model.transition -= rate * d_t / np.sqrt(g_t)
        model.start -= rate * d_s / np.sqrt(g_s)
    return model


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text, h): at most ROWS_PER_LANGUAGE rows of each language, those of the smallest hashes of key and text.

    Rows without language or text are left out; equal rows count once.  Hashes are first counted by language and
    number of leading zeros, in every task before the exchange, so no language's rows meet in one task: only the few
    rows with enough leading zeros are exchanged.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), text).bitwiseAND((1 << 63) - 1).alias("h"))
    bits = F.when(F.col("h") == 0, 0).otherwise(F.length(F.bin("h")))
    counts: dict[str, dict[int, int]] = {}
    for language, n_bits, n in labelled.groupBy("lang", bits.alias("bits")).count().collect():  # 64 rows a language at most
        counts.setdefault(language, {})[n_bits] = n
    limits: list = []
    for language, by_bits in sorted(counts.items()):
        total, n_bits = 0, 0
        for n_bits in sorted(by_bits):
            total += by_bits[n_bits]
            if total >= ROWS_PER_LANGUAGE:
                break
        limits += [F.lit(language), F.lit((1 << n_bits) - 1)]
    if not limits:
        return labelled.limit(0)
    chosen = labelled.where(F.col("h") <= F.create_map(*limits)[F.col("lang")]).dropDuplicates(["lang", "h", "text"])
    order = Window.partitionBy("lang").orderBy("h", "text")
    return chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ROWS_PER_LANGUAGE).drop("n")


def label_texts(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word label probabilities of texts: (probabilities, each text's first word, whether a word has letters, starts, ends)."""
    data, at = text_bytes(column)
    data = _lowered(data)
    hashes, starts, ends, first = word_table(data, at, PIECE)
    if not len(hashes):
        return np.zeros((0, len(model.languages))), first, np.zeros(0, bool), starts, ends
    digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    letters = digit[ends] - digit[starts] < ends - starts
    distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    scores = emission_scores(model, data, starts[where], ends[where], distinct)
    return marginals(scores[inverse], first, model)[0], first, letters, starts, ends


def _decide(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text (UNKNOWN without letters) and the share of its words' probability."""
    import pyarrow.compute as pc

    lettered = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
    if model is None:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    p, first, letters, _, _ = label_texts(model, column)
    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * letters[:, None], axis=0)])
    sums = total[first[1:]] - total[first[:-1]]
    best = sums.argmax(1)
    score = sums[np.arange(len(best)), best] / np.maximum(sums.sum(1), 1e-300)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.clip(score, 0, 1), 0.0)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its score (0 to 1).

    Null texts and texts without a letter get ``und`` and 0.  Columns of these names are replaced, all others stay.
    """
    keep = [c for c in docs.columns if c not in (label, score)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            labels, scores = _decide(shared.value, batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*keep, label, score])

    return docs.mapInArrow(run, schema)


def word_languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of words of one most likely language: key, lang, first and end byte of the stretch, words, mean probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, t) for n, t in (("lang", T.StringType()), ("first_byte", T.LongType()), ("end_byte", T.LongType()), ("n_words", T.LongType()), ("score", T.DoubleType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            p, first, _, starts, ends = label_texts(shared.value, batch.column(text))
            if not len(p):
                continue
            base = text_bytes(batch.column(text))[1]
            row, best = np.repeat(np.arange(batch.num_rows), np.diff(first)), p.argmax(1)
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (best[1:] != best[:-1])]))
            end = np.append(head[1:], len(best)) - 1
            mean = np.add.reduceat(p.max(1), head) / (end - head + 1)
            names = np.array(shared.value.languages, object)[best[head]]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row[head])), pa.array(names, pa.string()), pa.array(starts[head] - base[row[head]]), pa.array(ends[end] - base[row[head]]), pa.array(end - head + 1), pa.array(mean)], names=[f.name for f in schema.fields])

    return docs.select(key, text).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves 2 when divided by 4; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the rows that are not held out; None if there are no labelled rows.

    The bounded sample goes to one task, which returns the model's arrays; the driver only passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["lang"], r["h"], r["text"]) for b in batches for r in b.to_pylist()), key=lambda r: (r[1], r[0], r[2]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(r[0], r[2]) for r in rows]))], pa.binary())], names=["model"])

    rows = training_rows(docs.where(~held_out(key)), key, text, lang)
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred and score.

    Null texts and texts without a letter get ``und`` and 0, as all do if no row that is not held out has text and lang.
    Repeated rows are judged one by one; a null key is not held out; an empty table gives an empty one; long texts are
    judged whole; other columns are ignored.
    """
    out = with_language(docs.select("doc_id", "text"), fit(docs), score="score")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
