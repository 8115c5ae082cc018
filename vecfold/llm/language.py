"""Language identification of texts that may mix languages.

Scripts of letters narrow the candidates: a word is compared only with languages that use its script.
Each word has a score per language, the log probability of its three-byte sequences; Viterbi with a
switching penalty then labels all words of a text, so spans of different languages come out as such.
The text's language is the one that labels most of its letters, its score that share.

Counts are learned from at most SAMPLE_ROWS documents per language, chosen by a hash of the id, and
added up in Spark into BUCKETS numbers per language. Where nothing can be learned, texts with letters
are ``und`` as well. A null text, and one without letters, is ``und`` with score 0. Ties go to the
first language by name. Rows that repeat are labelled alike; whole texts are labelled.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm import batches
from vecfold.llm.tables import in_learning_folds, stored, uniform

SAMPLE_ROWS = 4_000
BUCKETS = 1 << 15
SWITCH = 12.0
UNKNOWN = "und"
SLICE_BYTES = 4_000_000

# First code points of scripts' main ranges, with a name each.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LETTER = ASCII_LETTER.copy()
LETTER[0x80:] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages


def _words(data: np.ndarray, offsets: np.ndarray):
    """Words as runs of letters: starts, ends, text, buckets of their bytes, lengths, letters and scripts.

    Bytes beyond ASCII count as letters here; characters that are none of them carry little weight.
    """
    inside = LETTER[data]
    starts, ends, text = batches.runs(inside, offsets)
    place = np.flatnonzero(inside)
    lengths = ends - starts
    low = batches.LOWER[data].astype(np.uint32)
    here = low[place]
    before, after = np.full(len(place), 32, np.uint32), np.full(len(place), 32, np.uint32)
    before[1:], after[:-1] = here[:-1], here[1:]
    first = np.cumsum(lengths) - lengths
    before[first] = 32
    after[first + lengths - 1] = 32
    buckets = ((before * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35)) ^ (before << np.uint32(8))) * np.uint32(0x27D4EB2F)
    buckets = (buckets >> np.uint32(17)).astype(np.int64)
    characters = np.add.reduceat((data[place] & 0xC0) != 0x80, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    # The first character beyond ASCII outside of Latin decides a word's script.
    scripts = np.full(len(starts), SCRIPT_NAMES.index("latin"))
    lead = place[data[place] >= 0xC0]
    if len(lead):
        wide = np.zeros(len(data) + 3, np.uint32)
        wide[: len(data)] = data
        b0, b1, b2, b3 = wide[lead], wide[lead + 1] & 63, wide[lead + 2] & 63, wide[lead + 3] & 63
        code = np.where(b0 < 0xE0, ((b0 & 31) << 6) | b1, np.where(b0 < 0xF0, ((b0 & 15) << 12) | (b1 << 6) | b2, ((b0 & 7) << 18) | (b1 << 12) | (b2 << 6) | b3))
        ids = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, code, "right") - 1]
        other = np.flatnonzero((ids != SCRIPT_NAMES.index("latin")) & (ids != SCRIPT_NAMES.index("other")))[::-1]
        scripts[np.searchsorted(starts, lead[other], "right") - 1] = ids[other]
    return starts, ends, text, buckets, first, characters, scripts


def _counts(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a slice; buckets from BUCKETS on count letters by script."""
    for batch in batch_iter:
        lang = batch.column("lang")
        for begin, end, data, offsets in batches.text_slices(batch.column("text")):
            _, _, text, buckets, first, characters, scripts = _words(data, offsets)
            names, codes = np.unique(np.array(lang.slice(begin, end - begin).to_pylist(), object).astype(str), return_inverse=True)
            lengths = np.diff(np.append(first, len(buckets)))
            of_byte = np.repeat(codes[text], lengths)
            width = BUCKETS + len(SCRIPT_NAMES)
            total = np.bincount(of_byte * width + buckets, minlength=len(names) * width)
            total += np.bincount(codes[text] * width + BUCKETS + scripts, characters, len(names) * width).astype(np.int64)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[found // width].tolist(), pa.string()), pa.array((found % width).astype(np.int32)), pa.array(total[found])], ["lang", "bucket", "n"]
            )


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model from texts and languages of the learning folds."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    known = known.where(in_learning_folds(F.col("doc_id")))
    have = known.groupBy("lang").count().collect()  # one row a language
    if not have:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.lit(0.0)
    for r in sorted(have, key=lambda r: r["lang"]):
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows / r["count"]))).otherwise(share)
    chosen = known.where(uniform(F.lit("lang"), "doc_id") < share)
    counted = chosen.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stored(counted, "language-counts").toPandas()  # bounded: BUCKETS rows a language
    languages = sorted(r["lang"] for r in have)
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    table[counts["bucket"], pd.Categorical(counts["lang"], languages).codes] = counts["n"]
    letters = table[BUCKETS:]
    allowed = letters >= 0.01 * np.maximum(letters.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script that no language uses rules none out
    table = table[:BUCKETS] + 0.5
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH, transitions: np.ndarray | None = None) -> np.ndarray:
    """Best labels of sequences that lie one after the other in ``scores`` (words x labels).

    All sequences of a slice advance together, longest first, word by word. A change of label costs
    ``switch``, or each pair of labels has a score of its own in ``transitions``.
    """
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than t
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    own = np.arange(scores.shape[1])
    state = scores[starts[: active[0]]].astype(np.float64)
    final = np.zeros(len(starts), np.int64)
    for t in range(1, int(lengths[0])):
        k = active[t]
        if k < len(state):
            final[k : len(state)] = state[k:].argmax(axis=1)
            state = state[:k]
        at = starts[:k] + t
        if transitions is None:
            best = state.argmax(axis=1)
            change = state[np.arange(k), best][:, None] - switch
            stay = state >= change
            came[at] = np.where(stay, own, best[:, None])
            state = np.where(stay, state, change) + scores[at]
        else:
            paths = state[:, :, None] + transitions
            came[at] = paths.argmax(axis=1)
            state = paths.max(axis=1) + scores[at]
    final[: len(state)] = state.argmax(axis=1)
    now = np.zeros(len(starts), np.int64)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = active[t]
        last = active[t + 1] if t + 1 < lengths[0] else 0
        now[last:k] = final[last:k]
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = came[at, now[:k]]
    return labels


def _labelled(model: Model, data: np.ndarray, offsets: np.ndarray):
    starts, ends, text, buckets, first, characters, scripts = _words(data, offsets)
    scores = np.add.reduceat(model.table[buckets], first, axis=0) if len(first) else np.zeros((0, len(model.languages)), np.float32)
    scores[~model.allowed[scripts]] -= 1e4
    n = np.bincount(text, minlength=len(offsets) - 1)
    having = np.flatnonzero(n)
    labels = viterbi(scores, (np.cumsum(n) - n)[having], n[having])
    return starts, ends, text, characters, labels


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts = batch.column("text")
            for begin, end, data, offsets in batches.text_slices(texts, SLICE_BYTES):
                rows, width = end - begin, max(1, len(model.languages))
                _, _, text, characters, labels = _labelled(model, data, offsets) if model.languages else [np.zeros(0, np.int64)] * 5
                weight = np.bincount(text * width + labels, characters, rows * width).reshape(rows, width)
                total, best = weight.sum(axis=1), weight.argmax(axis=1)
                ascii_letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum(ASCII_LETTER[data], out=ascii_letters[1:])
                lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(~lettered & (total > 0)):
                    lettered[i] = any(c.isalpha() for c in texts[begin + int(i)].as_py())
                lettered &= total > 0
                names = np.array([*model.languages, UNKNOWN], object)[np.where(lettered, best, len(model.languages))]
                score = np.where(lettered, weight.max(axis=1) / np.maximum(total, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, rows), pa.array(names.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): runs of words with one label, in bytes of the text."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for begin, _, data, offsets in batches.text_slices(batch.column("text"), SLICE_BYTES):
                starts, ends, text, _, labels = _labelled(model, data, offsets)
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
                last = np.append(new[1:], len(text))[: len(new)] - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(begin + text[new])), pa.array(starts[new] - offsets[text[new]]), pa.array(ends[last] - offsets[text[new]]),
                        pa.array([model.languages[i] for i in labels[new]], pa.string()),
                    ],
                    ["doc_id", "start", "end", "lang"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, start long, end long, lang string")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
