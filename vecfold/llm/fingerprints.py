"""I-Match fingerprints: hashes of a document's terms within several randomised lexicon subsets.

The lexicon holds the terms (words with A-Z in lower case) whose inverse document frequency ln(N / df)
lies in a band; all documents are counted. A document's distinct lexicon terms are sorted and hashed:
once all of them (64 bits), and once for each of DRAWS * LEVELS random subsets of the lexicon (16 bits),
which keep a half, a quarter and so on of it. Dense subsets agree for copies only, sparse ones, of which
a document has a term or two, also for looser likeness. A text without any lexicon term is fingerprinted
by all its terms.

A lexicon has at most (mean distinct terms of a document) * e ** HIGHEST_IDF terms, however many
documents there are; it is sent to tasks if it has at most LEXICON_TERMS. A larger one is joined to the
terms by shuffle, with the same result.

Likeness of two fingerprints: of the whole lexicon and the subsets in which either has a term, the share
whose hashes agree.

A null text is empty; a text without words has no term, and two of these are alike (1). Rows come in
order of doc_id, null ids first, of equal ids by the md5 of their text; equal rows have equal results
but for what comes after the last of them. The next document of a single row is itself. An empty table
gives no rows. Other columns are not read. Texts are worked on whole, in slices of bounded size; a task
holds one text at least, and its neighbour.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecfold.llm import batches
from vecfold.llm.tables import stored
from vecfold.operators.skew import lookup_join

LOWEST_IDF, HIGHEST_IDF = 1.0, 6.0
DRAWS, LEVELS = 12, 10
# 16-bit parts of a fingerprint: the whole lexicon's hash has four.
WHOLE, PARTS = 4, 4 + DRAWS * LEVELS
LEXICON_TERMS = 2_000_000
NONE = np.zeros(0, np.uint64)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct terms of each text, in that order."""
    low = batches.LOWER[data]
    starts, ends, text, _ = batches.words_of(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), NONE
    hashes = batches.apart_hashes(low, starts, ends)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.r_[True, (np.diff(text) != 0) | (hashes[1:] != hashes[:-1])]
    return text[new], hashes[new]


def in_lexicon(text: np.ndarray, terms: np.ndarray, lexicon: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms that are in the sorted lexicon; all terms of texts that have none in it."""
    at = np.minimum(np.searchsorted(lexicon, terms), max(0, len(lexicon) - 1))
    known = lexicon[at] == terms if len(lexicon) else np.zeros(len(terms), bool)
    known |= (np.bincount(text[known], minlength=texts) == 0)[text]
    return text[known], terms[known]


def fingerprints(text: np.ndarray, terms: np.ndarray, texts: int) -> np.ndarray:
    """PARTS hashes of each text's sorted distinct terms, 0 where a subset has none of them."""
    out = np.zeros((texts, PARTS), np.uint16)

    def hashed(text: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.searchsorted(text, np.arange(texts + 1))
        place = np.arange(len(terms)) - ends[text]
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(batches.mix(terms + batches.mix(place.astype(np.uint64))), out=sums[1:])
        return batches.mix(sums[ends[1:]] - sums[ends[:-1]]), ends[1:] > ends[:-1]

    whole, some = hashed(text, terms)
    out[:, :WHOLE] = np.where(some, whole, np.uint64(0)).view(np.uint16).reshape(texts, WHOLE)
    out[:, 0] |= some  # never 0 in all parts
    for draw in range(DRAWS):
        number = batches.mix(terms + np.uint64((draw + 1) * batches.BASE % (1 << 64)))
        t, h = text, terms
        for level in range(LEVELS):
            kept = number < np.uint64(1 << (63 - level))
            t, h, number = t[kept], h[kept], number[kept]
            value, some = hashed(t, h)
            out[:, WHOLE + draw * LEVELS + level] = np.where(some, np.maximum(value >> np.uint64(48), np.uint64(1)), np.uint64(0))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    whole = (a[:, :WHOLE] == b[:, :WHOLE]).all(axis=1)
    either = (a[:, WHOLE:] != 0) | (b[:, WHOLE:] != 0)
    same = ((a[:, WHOLE:] == b[:, WHOLE:]) & either).sum(axis=1) + whole
    return same / (1 + either.sum(axis=1))


def edit(data: np.ndarray, offsets: np.ndarray, own: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code points of the texts ``own``, and these with their last half replaced from the start of ``following``."""
    first_bytes = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.searchsorted(first_bytes, offsets)
    count = np.diff(before)
    where = np.append(first_bytes, len(data))
    half = count[own] // 2
    kept = where[before[own] + count[own] - half]
    taken = where[before[following] + np.minimum(half, count[following])]
    raw = data.tobytes()
    # A code point's place at the end of a text is the start of the next text's first one.
    return count[own], [raw[a:b] + raw[c:d] for a, b, c, d in zip(offsets[own], np.minimum(kept, offsets[own + 1]), offsets[following], np.minimum(taken, offsets[following + 1]))]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def term_lists(text: np.ndarray, terms: np.ndarray, rows: np.ndarray, texts: int) -> pa.ListArray:
    """The terms of the texts ``rows`` as lists."""
    ends = np.searchsorted(text, np.arange(texts + 1))
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(terms.view(np.int64))).cast(pa.list_(pa.int64()))
    return lists.take(pa.array(rows))


class Pairs:
    """Works on texts with the next ones; with a lexicon to fingerprints, without one to lists of terms."""

    def __init__(self, lexicon: np.ndarray | None):
        self.lexicon = lexicon
        kind = pa.binary() if lexicon is not None else pa.list_(pa.int64())
        names = ["own", "edited", "next"]
        self.fields = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), *[(n, kind) for n in names[: 3 if lexicon is None else 2]]]
        self.fields += [] if lexicon is None else [("near_edited", pa.float64()), ("near_next", pa.float64())]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, own: np.ndarray, following: np.ndarray) -> list[pa.Array]:
        chars, changed = edit(data, offsets, own, following)
        digests = pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string())
        texts = len(offsets) - 1
        a, b = terms_of(data, offsets), terms_of(*joined(changed))
        if self.lexicon is None:
            lists = [term_lists(*a, own, texts), term_lists(*b, np.arange(len(own)), len(own)), term_lists(*a, following, texts)]
            return [pa.array(chars.astype(np.int64)), digests, *lists]
        prints = fingerprints(*in_lexicon(*a, self.lexicon, texts), texts)
        edited = fingerprints(*in_lexicon(*b, self.lexicon, len(own)), len(own))
        return [
            pa.array(chars.astype(np.int64)), digests, packed(prints[own]), packed(edited),
            pa.array(likeness(prints[own], edited)), pa.array(likeness(prints[own], prints[following])),
        ]


def packed(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints], pa.binary())


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df) of all documents; copies of a term merge in tasks before the exchange."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for _, _, data, offsets in batches.text_slices(batch.column("text")):
                term, n = np.unique(terms_of(data, offsets)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return docs.select("text").mapInArrow(per_batch, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon_of(docs: DataFrame, lowest: float, highest: float) -> DataFrame:
    """The stored hashes of the terms within the band."""
    idf = F.log(F.lit(float(max(1, docs.count()))) / F.col("df"))
    return stored(term_counts(docs).where(idf.between(lowest, highest)).select("term"), "lexicon")


EDGES = [("part", pa.int32()), ("edge", pa.string()), ("text", pa.large_string())]


def _in_order(rows: DataFrame, work: Pairs) -> DataFrame:
    """Results of rows with the next one of their partition, and the texts at both ends of each partition."""
    fields = [*work.fields, *EDGES]

    def per_task(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def end(ids: pa.Array, raw: bytes, edge: str) -> pa.RecordBatch:
            blank = [pa.nulls(1, kind) for _, kind in work.fields]
            return pa.RecordBatch.from_arrays([ids, *blank, *[pa.array([v], k) for v, (_, k) in zip((part, edge, raw.decode()), EDGES)]], ["doc_id", *[n for n, _ in fields]])

        for batch in batch_iter:
            for begin, stop, data, offsets in batches.text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(begin, stop - begin)
                if held is None:
                    yield end(ids.slice(0, 1), data[: offsets[1]].tobytes(), "first")
                else:
                    ids = pa.concat_arrays([held[0], ids])
                    data = np.concatenate([np.frombuffer(held[1], np.uint8), data])
                    offsets = np.concatenate([[0], offsets + len(held[1])])
                rows = len(offsets) - 1
                held = ids.slice(rows - 1), data[offsets[-2] :].tobytes()
                if rows > 1:
                    out = work(data, offsets, np.arange(rows - 1), np.arange(1, rows))
                    yield pa.RecordBatch.from_arrays([ids.slice(0, rows - 1), *out, *[pa.nulls(rows - 1, k) for _, k in EDGES]], ["doc_id", *[n for n, _ in fields]])
        if held is not None:
            yield end(*held, "last")

    return rows.mapInArrow(per_task, _kinds(rows, fields))


def _kinds(rows: DataFrame, fields: list) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.large_string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.int64()): "array<bigint>"}
    own = rows.schema["doc_id"].dataType.simpleString()
    return ", ".join([f"doc_id {own}", *[f"{n} {names[k]}" for n, k in fields]])


def _across(edges: DataFrame, work: Pairs) -> DataFrame:
    """Results of the last rows of partitions: the next row is the first of the next partition, at last of all."""
    parts = edges.where("edge = 'first'").select("part")  # a number a partition
    around = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    following = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = edges.where("edge = 'last'").select("doc_id", "part", "text").join(around, "part").join(following, "next_part")

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for i in range(batch.num_rows):
                texts = joined([(batch.column(c)[i].as_py()).encode() for c in ("text", "next_text")])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *work(*texts, np.array([0]), np.array([1]))], ["doc_id", *[n for n, _ in work.fields]])

    return pairs.select("doc_id", "text", "next_text").mapInArrow(per_batch, _kinds(pairs, work.fields))


def _from_lists(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lists of terms to fingerprints, the lexicon joined by shuffle."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "term-lists")
    which = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("terms")) for c in ("own", "edited", "next")])).alias("list")
    terms = rows.select("row", which).select("row", "list.of", F.explode("list.terms").alias("term"))
    known = lookup_join(terms, lexicon, ["term"], "left_semi")
    known = known.groupBy("row").pivot("of", ["own", "edited", "next"]).agg(F.array_sort(F.collect_list("term")))
    full = rows.alias("r").join(known.alias("k"), "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", *[F.when(F.size(F.col(f"k.{c}")) > 0, F.col(f"k.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in ("own", "edited", "next")]
    )
    fields = Pairs(NONE).fields

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            prints = []
            for c in ("own", "edited", "next"):
                terms = batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                text = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(c).offsets.to_numpy()))
                order = np.lexsort((terms, text))  # as unsigned numbers, as in the other way
                prints.append(fingerprints(text[order], terms[order], batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_chars", "edited_sha256")], packed(prints[0]), packed(prints[1]),
                 pa.array(likeness(prints[0], prints[1])), pa.array(likeness(prints[0], prints[2]))],
                ["doc_id", *[n for n, _ in fields]],
            )

    return full.mapInArrow(per_batch, _kinds(full, fields))


def fingerprinted(docs: DataFrame, lowest: float = LOWEST_IDF, highest: float = HIGHEST_IDF, lexicon_terms: int = LEXICON_TERMS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    spark = docs.sparkSession
    lexicon = lexicon_of(docs, lowest, highest)
    sent = lexicon.count() <= lexicon_terms
    work = Pairs(np.sort(lexicon.toArrow().column("term").to_numpy().view(np.uint64)) if sent else None)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "digest", "row"]
    ranged = rows.withColumn("digest", F.unhex(F.md5("text"))).repartitionByRange(*order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast(work)
    results = stored(_in_order(ranged.select("doc_id", "text"), _Shared(shared, work.fields)), "fingerprints")
    names = [n for n, _ in work.fields]
    whole = results.where("edge is null").select("doc_id", *names)
    whole = whole.union(_across(results.where("edge is not null"), _Shared(shared, work.fields)))
    if not sent:
        whole = _from_lists(whole, lexicon)
    hexed = lambda c: F.lower(F.hex(c))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", hexed("own").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), "near_edited", "near_next"
    )


class _Shared:
    """Pairs in a broadcast variable."""

    def __init__(self, shared, fields: list):
        self.shared, self.fields = shared, fields

    def __call__(self, *texts) -> list[pa.Array]:
        return self.shared.value(*texts)
