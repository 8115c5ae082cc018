"""Toxicity by multiple-instance learning: sentences are judged, but only documents are labelled.

A sentence's score is logistic in the words and beginnings of words it holds; a document's score combines its sentences by
noisy-or, 1 - product(1 - score), and is trained against the document's label. So the model finds the
sentences that make a document toxic without any labelled sentence, and can point at them.

The labelled sample is bounded (SAMPLE_ROWS, by a hash of the id), and so is the vocabulary: words
with at least MIN_DOCUMENTS sampled documents whose share of toxic ones differs clearly, counted in
Spark. Only the places of those words in the sample reach the driver.

A word is a run of ASCII letters (lower-cased), digits and characters beyond ASCII; a sentence ends at
``.``, ``!``, ``?`` or a line's end. A null or empty text has no sentence and scores 0. Without both
labels in the sample every score is 0. Rows that repeat score alike; whole texts are scored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm import batches
from vecfold.llm.tables import in_learning_folds, stored, uniform, within

SAMPLE_ROWS = 20_000
VOCABULARY = 2_000
MIN_DOCUMENTS = 4
MIN_DEVIATION = 4.0
EPOCHS = 400

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True
#: Bytes of the beginnings of words that count as features of their own.
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def sentence_scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sums)))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, sentence (numbered along the slice) and start of each word; hashes and words of the features."""
    low = batches.LOWER[data]
    starts, ends, text = batches.runs(WORD[low], offsets)
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(STOP[data], out=stops[1:])
    sums = batches.prefix_sums(low)
    hashes, of = [batches.part_hashes(sums, starts, ends)], [np.arange(len(starts))]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        hashes.append(batches.part_hashes(sums, starts[longer], starts[longer] + n) + np.uint64(n))
        of.append(longer)
    # A text's end ends its last sentence too.
    return text, stops[starts] + text, starts, np.concatenate(hashes), np.concatenate(of)


def _slices(batch_iter: Iterator[pa.RecordBatch]):
    for batch in batch_iter:
        for first, end, data, offsets in batches.text_slices(batch.column("text")):
            yield batch.slice(first, end - first), data, offsets


def _document_words(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents, toxic): distinct words of documents, added up per slice."""
    for part, data, offsets in _slices(batch_iter):
        text, _, _, hashes, of = _words(data, offsets)
        toxic = np.asarray(part.column("toxic").to_pylist(), np.int64)
        pairs = pd.DataFrame({"word": hashes, "text": text[of]}).drop_duplicates()
        pairs["toxic"] = toxic[pairs["text"]]
        sums = pairs.groupby("word")["toxic"].agg(["size", "sum"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.index.to_numpy(np.uint64).view(np.int64)), pa.array(sums["size"].to_numpy(np.int64)), pa.array(sums["sum"].to_numpy(np.int64))],
            ["word", "documents", "toxic"],
        )


def _lookup(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of known words among ``hashes`` and their numbers in ``words``."""
    if not len(words) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Few hashes pass a table of the words' lowest bits; only they are searched for.
    low = np.zeros(1 << 16, bool)
    low[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    passed = np.flatnonzero(low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, hashes[passed]), len(words) - 1)
    known = words[at] == hashes[passed]
    return passed[known], at[known]


def _vocabulary(sample: DataFrame) -> np.ndarray:
    counts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(_document_words, "word long, documents long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("documents").alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= MIN_DOCUMENTS)
    share = sample.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share or share == 1:
        return np.zeros(0, np.uint64)
    deviation = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = counts.withColumn("deviation", deviation).where(F.abs("deviation") >= MIN_DEVIATION)
    best = chosen.orderBy(F.desc(F.abs("deviation")), "word").limit(VOCABULARY).select("word").collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))


def sampled(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``rows`` labelled ids of the learning folds, one row an id.

    Of several rows of an id the text with the least md5 counts; conflicting labels count as toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(in_learning_folds(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = stored(known.orderBy(uniform(F.lit("toxic"), "doc_id"), "doc_id").limit(rows), "toxicity-labels")
    texts = within(docs.select("doc_id", "text"), chosen.select("doc_id"))
    text = F.coalesce("text", F.lit(""))
    one = texts.groupBy("doc_id").agg(F.min_by(text, F.md5(text)).alias("text"))
    return stored(one.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 3) -> Model:
    """The model from a sample of labelled documents."""
    sample = sampled(docs, labels, rows, seed)
    words = _vocabulary(sample)
    if not len(words):
        return Model(words, np.zeros(0), -50.0)

    def places(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batch_iter):
            text, sentence, _, hashes, of_word = _words(data, offsets)
            at, word = _lookup(words, hashes)
            at = of_word[at]
            sentences = pd.DataFrame({"text": text, "sentence": sentence}).drop_duplicates()
            n = np.bincount(sentences["text"], minlength=len(part))
            order = np.argsort(text[at], kind="stable")
            of = np.bincount(text[at], minlength=len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.string()), part.column("toxic"), pa.array(n.astype(np.int64)),
                    batches.lists(pa.array(sentence[at][order].astype(np.int64)), of), batches.lists(pa.array(word[order].astype(np.int32)), of),
                ],
                ["doc_id", "toxic", "n", "sentence", "word"],
            )

    kind = "doc_id string, toxic boolean, n long, sentence array<long>, word array<int>"
    found = sample.select("doc_id", "text", "toxic").mapInArrow(places, kind).toPandas().sort_values("doc_id", kind="stable")
    return fit(words, found["toxic"].to_numpy(bool), found["n"].to_numpy(), found["sentence"].tolist(), found["word"].tolist())


def fit(words: np.ndarray, toxic: np.ndarray, n_sentences: np.ndarray, sentences: list, found: list) -> Model:
    """Maximum likelihood of the noisy-or by Adam, all documents a step."""
    doc = np.repeat(np.arange(len(toxic)), [len(s) for s in sentences])
    sentence = np.concatenate([np.asarray(s, np.int64) for s in sentences]) if len(sentences) else np.zeros(0, np.int64)
    word = np.concatenate([np.asarray(w, np.int64) for w in found]) if len(found) else np.zeros(0, np.int64)
    keys = pd.DataFrame({"doc": doc, "sentence": sentence, "word": word}).drop_duplicates()
    numbered, _ = pd.factorize(pd.MultiIndex.from_frame(keys[["doc", "sentence"]]))
    word = keys["word"].to_numpy()
    of_sentence = np.zeros(numbered.max() + 1 if len(numbered) else 0, np.int64)
    of_sentence[numbered] = keys["doc"].to_numpy()
    plain = n_sentences - np.bincount(of_sentence, minlength=len(toxic))
    theta = np.zeros(len(words) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        z = theta[-1] + np.bincount(numbered, theta[word], len(of_sentence))
        # log(1 - sigmoid(z)) = -softplus(z)
        none = -(np.bincount(of_sentence, np.logaddexp(0, z), len(toxic)) + plain * np.logaddexp(0, theta[-1]))
        # d(log likelihood)/d(none): -1 for clean documents' loss, p-weighted for toxic ones.
        pull = np.where(toxic, -np.exp(none) / np.maximum(1 - np.exp(none), 1e-9), 1.0)
        up = -pull[of_sentence] / (1 + np.exp(-z))
        gradient = np.zeros_like(theta)
        gradient[:-1] = np.bincount(word, up[numbered], len(words))
        gradient[-1] = up.sum() + (-pull * plain / (1 + np.exp(-theta[-1]))).sum()
        gradient = gradient / len(toxic) - 2e-4 * np.append(theta[:-1], 0.0) / max(1, len(words)) ** 0.5
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(words, theta[:-1], float(theta[-1]))


def _score(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Text and score of each sentence with a word, in order, its number, and the words' sentences and starts."""
    text, sentence, starts, hashes, of = _words(data, offsets)
    at, word = _lookup(model.words, hashes)
    at = of[at]
    new = np.flatnonzero(np.diff(sentence, prepend=-1))
    number = np.cumsum(np.diff(sentence, prepend=-1) > 0) - 1
    pairs = np.unique(number[at] * (len(model.words) + 1) + word)
    sums = np.bincount(pairs // (len(model.words) + 1), model.weights[pairs % (len(model.words) + 1)], len(new))
    return text[new], model.sentence_scores(sums), starts[new]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batch_iter):
            text, scores, _ = _score(model, data, offsets)
            none = np.bincount(text, np.log1p(-np.minimum(scores, 1 - 1e-15)), len(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(-np.expm1(none))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, score double")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, score) of sentences that score ``least`` or more."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batch_iter):
            text, scores, starts = _score(model, data, offsets)
            raw, rows = data.tobytes(), []
            for i in np.flatnonzero(scores >= least):
                stop = offsets[text[i] + 1]
                tail = np.flatnonzero(STOP[data[starts[i] : stop]])
                end = starts[i] + tail[0] + 1 if len(tail) else stop
                rows.append((part.column("doc_id")[int(text[i])].as_py(), raw[starts[i] : end].decode("utf-8", "replace"), float(scores[i])))
            ids, sentences, values = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, part.schema.field("doc_id").type), pa.array(sentences, pa.string()), pa.array(values, pa.float64())], ["doc_id", "sentence", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, sentence string, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
