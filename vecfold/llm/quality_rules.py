"""Quality rules: statistics of texts and a decision list learned from labelled documents.

Statistics come from one pass of numpy over the bytes. The list is learned by sequential covering:
conjunctions of thresholds grow on two thirds of a bounded labelled sample by information gain, are
pruned on the rest, and each covers what the earlier ones left. The result is an ordered list that
becomes one Spark conditional expression, so applying it needs no Python.

A null text is an empty one: no words, so it fails the base rule. Without labelled rows of both
kinds the list is empty and only the base rule decides. Rows that repeat are judged alike.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.llm import batches
from vecfold.llm.tables import small, stored, uniform

# Labelled rows that the list is learned from, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
MIN_PRECISION = 0.9
MIN_COVERED = 5
MAX_CONDITIONS = 4
MAX_RULES = 12
CUTS = 48

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
WINDOW = 5


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again, and whether it occurred before (in order of place)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[:-1][same]] = True
    before[order[1:][same]] = True
    return again | before, before


def counts_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each text."""
    n = len(offsets) - 1
    starts, ends, text, n_words = batches.words_of(data, offsets)
    of_text = batches.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    # Characters of words: bytes that do not continue a character.
    chars = _per_text(~batches.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    # Lines with a word that equal an earlier one of the text.
    l_starts, l_ends, l_text = batches.runs(data != 10, offsets)
    first_word = np.searchsorted(starts, l_starts)
    with_word = np.zeros(len(l_starts), bool)
    has = first_word < len(starts)
    with_word[has] = starts[first_word[has]] < l_ends[has]
    l_starts, l_ends, l_text = l_starts[with_word], l_ends[with_word], l_text[with_word]
    _, before = _repeats(batches.apart_hashes(data, l_starts, l_ends) ^ of_text[l_text])
    dup_lines = np.bincount(l_text[before], minlength=n)
    # Words inside windows that occur twice or more in the text.
    hashes = batches.apart_hashes(data, starts, ends)
    windows = batches.shingle_hashes(hashes, WINDOW)
    inside = text[: len(windows)] == text[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    place = np.flatnonzero(inside)
    found, _ = _repeats(windows[place] ^ of_text[text[place]])
    edges = np.zeros(len(starts) + 1, np.int32)
    np.add.at(edges, place[found], 1)
    np.add.at(edges, place[found] + WINDOW, -1)
    repeated = np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=n)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    marks = (data == 33) | (data == 63)
    return [
        n_words, chars, _per_text(SYMBOLS[data], offsets), dup_lines, repeated, np.bincount(l_text, minlength=n), _per_text(upper, offsets),
        _per_text(upper | lower, offsets), _per_text((data >= 48) & (data <= 57), offsets), _per_text(marks, offsets),
    ]


def with_counts(docs: DataFrame, name: str = "counts") -> DataFrame:
    """``docs`` with a struct column of COUNTS."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for first, end, data, offsets in batches.text_slices(batch.column("text")):
                arrays = [pa.array(c.astype(np.int64)) for c in counts_of(data, offsets)]
                columns = [c.slice(first, end - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(arrays, list(COUNTS))], [*batch.schema.names, name])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(per_batch, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def features(counts: str = "counts") -> dict[str, Column]:
    """The numbers that rules set thresholds on."""
    c = {name: F.col(counts)[name].cast("double") for name in COUNTS}
    per_word = lambda x: x / F.greatest(c["n_words"], F.lit(1.0))
    return {
        "n_words": c["n_words"],
        "chars_per_word": per_word(c["word_chars"]),
        "symbols_per_word": per_word(c["n_symbols"]),
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "repeat_share": per_word(c["n_repeat_words"]),
        "upper_share": c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0)),
        "digits_per_word": per_word(c["n_digits"]),
        "marks_per_word": per_word(c["n_marks"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        column = values[:, names.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold


def _grow(values: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> list[Condition]:
    """Adds the condition of most information gain while good rows are covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (covered & ~bad).any():
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            for threshold in cuts[j]:
                high = covered & (values[:, j] > threshold)
                for above, part in ((True, high), (False, covered & ~high)):
                    p1, n1 = (part & bad).sum(), (part & ~bad).sum()
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain, best_part = Condition(name, above, float(threshold)), g, part
        if best is None:
            break
        rule.append(best)
        covered = best_part
    return rule


def _covered(rule: list[Condition], values: np.ndarray, names: list[str]) -> np.ndarray:
    covered = np.ones(len(values), bool)
    for condition in rule:
        covered &= condition.holds(values, names)
    return covered


def _prune(rule: list[Condition], values: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Condition]:
    """The beginning of the rule that does best on rows it did not grow on."""

    def worth(part: list[Condition]) -> float:
        covered = _covered(part, values, names)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part)), default=[])


def learn(values: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 7) -> list[list[Condition]]:
    """An ordered list of conjunctions that mark bad rows."""
    rules: list[list[Condition]] = []
    order = np.random.default_rng(seed).permutation(len(bad))
    values, bad = values[order], bad[order]
    while bad.any() and not bad.all() and len(rules) < MAX_RULES:
        grown = np.arange(len(bad)) % 3 > 0
        cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, CUTS + 1)[:-1])) for j in range(len(names))]
        cuts = [np.unique(np.concatenate([c, np.quantile(values[bad, j], np.linspace(0, 1, 17))])) for j, c in enumerate(cuts)]
        rule = _prune(_grow(values[grown], bad[grown], names, cuts), values[~grown], bad[~grown], names)
        covered = _covered(rule, values, names)
        hits = (covered & bad).sum()
        if not rule or hits < MIN_COVERED or hits < MIN_PRECISION * covered.sum():
            break
        rules.append(rule)
        values, bad = values[~covered], bad[~covered]
    return rules


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids (doc_id, bad), by a hash of the id; conflicting labels of one id count as bad."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return stored(known.orderBy(uniform(F.lit("quality"), "doc_id"), "doc_id").limit(rows), "quality-sample")


def learn_rules(counted: DataFrame, sample: DataFrame) -> list[list[Condition]]:
    """From rows with doc_id and ``counts``; collects a few numbers of each sampled row."""
    of = features()
    rows = counted.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("bad"), *[c.alias(n) for n, c in of.items()])
    # An id that repeats gives one row.
    rows = rows.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ["bad", *of]]).toPandas().sort_values("doc_id")
    return learn(rows[list(of)].to_numpy(float), rows["bad"].to_numpy(bool), list(of))


def base_failed(counts: str = "counts") -> Column:
    c = F.col(counts)
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def kept(rules: list[list[Condition]], counts: str = "counts") -> Column:
    """The decision list as an expression: the first rule that holds rejects."""
    of = features(counts)
    decision = F.when(base_failed(counts), False)
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(of)
        decision = decision.when(holds, False)
    return decision.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row of ``docs``."""
    counted = stored(with_counts(docs.select("doc_id", "text")).drop("text"), "counts")
    rules = learn_rules(counted, sample_labels(labels))
    return counted.select("doc_id", *[F.col("counts")[c].alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"), kept(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    sample = sample_labels(labels)
    labelled = docs.select("doc_id", "text").join(small(sample.select("doc_id")), "doc_id", "left_semi")
    rules = learn_rules(stored(with_counts(labelled).drop("text"), "counts"), sample)
    name = "counts"
    while name in docs.columns:
        name += "_"
    return with_counts(docs, name).where(kept(rules, name)).drop(name)
