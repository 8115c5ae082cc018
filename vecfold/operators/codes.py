"""Search through product-quantised codes: a scan of one byte per part of a vector, then few whole vectors.

A vector is cut into ``parts``; each part is replaced by the number of the nearest of up to 256 learned ones.
A query's squared distances to all learned parts make a table, and a row's estimate is the root of the sum of
the entries its code names. Stored with each code is the distance between the vector and what the code stands for:
by the triangle inequality the true Euclidean distance lies within that of the estimate. ``search_codes``
ranks ``rerank`` rows of least estimate exactly; ``search_codes_exact`` ranks all rows that the bounds leave open,
so its result is that of the plain search, ties included.

Codes and vectors lie in one table. The scan reads the columns of codes alone; the rows picked then reach the
Parquet reader as a filter on their place, which skips all other pages of vectors.
"""

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.functions.vectors import as_matrix
from vecfold.operators.access import Allowed, visible
from vecfold.operators.search import check_query, metadata_filter, search_rows
from vecfold.schemas import DEFAULT_TOP_K, Metric

# Codebooks are learned from at most so many rows, those whose ids have the least hashes.
SAMPLE_ROWS = 20_000
CODES = 256
ROUNDS = 10
# Rows of a page of a column: what is read to get one vector.
PAGE_ROWS = 256
# Up to so many picked rows are read through the filter on places; beyond, the scan reads all vectors.
PICKED_ROWS = 512
# Slack of bounds that were computed in floating point.
SLACK = 1e-9


@dataclass(frozen=True)
class Codes:
    """Learned parts as (parts, codes, width), and the table of rows with ``place, code, error``."""

    books: np.ndarray
    path: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _learn(codes: int, rounds: int):
    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order", kind="stable")
        x = np.array(frame["values"].tolist(), np.float64)
        _, first = np.unique(x, axis=0, return_index=True)
        centers = x[np.sort(first)[:codes]].copy()
        for _ in range(rounds):
            nearest = np.argmin(np.sum(centers * centers, axis=1) - 2 * x @ centers.T, axis=1)
            counts = np.bincount(nearest, minlength=len(centers))
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, x)
            centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        return pd.DataFrame({"part": frame["part"].iloc[0], "code": range(len(centers)), "center": centers.tolist()})

    return learn


def train_books(rows: DataFrame, parts: int, codes: int = CODES, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Learned parts, each part in a task of its own, from ``sample`` rows. A table without rows is refused."""
    if not 0 < codes <= CODES:
        raise ValueError(f"a code is a byte: between 1 and {CODES} codes")
    order = F.xxhash64("embedding_id")
    taken = rows.select(order.alias("order"), "embedding_id", "embedding").orderBy("order", "embedding_id").limit(sample)
    width = F.floor(F.size("embedding") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("embedding", p * width + 1, width))
    pieces = taken.where(F.size("embedding") > 0).select("order", F.posexplode(cut).alias("part", "values"))
    learned = pieces.groupBy("part").applyInPandas(_learn(codes, ROUNDS), "part int, code int, center array<double>").collect()
    if not learned:
        raise ValueError("there are no rows to learn codes from")
    found = max(r.code for r in learned) + 1
    # A part with fewer values than the others has its first one several times; the first is the nearest.
    books = np.empty((parts, found, len(learned[0].center)))
    for r in sorted(learned, key=lambda r: r.code):
        if r.code == 0:
            books[r.part, :] = r.center
        books[r.part, r.code] = r.center
    return books


def _encode(books: np.ndarray):
    """An Arrow UDF giving a vector's code and the distance to what it stands for."""
    parts, _, width = books.shape

    @F.arrow_udf("struct<code:binary,error:double>")
    def encode(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.struct([("code", pa.binary()), ("error", pa.float64())]))
        x = as_matrix(vectors)
        if x.shape[1] != parts * width:
            raise ValueError(f"vectors of {x.shape[1]} numbers cannot be cut into {parts} parts of {width}")
        numbers, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x))
        for part, book in enumerate(books):
            piece = x[:, part * width : (part + 1) * width]
            numbers[:, part] = np.argmin(np.sum(book * book, axis=1) - 2 * piece @ book.T, axis=1)
            error += np.sum((piece - book[numbers[:, part]]) ** 2, axis=1)
        offsets = pa.py_buffer(np.arange(0, numbers.size + 1, parts, dtype=np.int32))
        code = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(numbers.tobytes())])
        return pa.StructArray.from_arrays([code, pa.array(np.sqrt(error))], names=["code", "error"])

    return encode


def build_codes(rows: DataFrame, parts: int, path: str, codes: int = CODES, sample: int = SAMPLE_ROWS) -> Codes:
    """Learn parts from a sample, code every row and store rows and codes under ``path``."""
    books = train_books(rows, parts, codes, sample)
    coded = rows.withColumn("at", _encode(books)(F.col("embedding"))).withColumn("place", F.monotonically_increasing_id())
    stored = coded.select(*rows.columns, "at.code", "at.error", "place")
    stored.write.mode("errorifexists").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    return Codes(books, path)


def estimate_to(books: np.ndarray, query: Sequence[float]):
    """An Arrow UDF giving the distance of a query to what a code stands for."""
    parts, _, width = books.shape
    cut = np.asarray(query, np.float64).reshape(parts, 1, width)
    table = np.sum((books - cut) ** 2, axis=2)

    @F.arrow_udf("double")
    def estimate(codes: pa.Array) -> pa.Array:
        if len(codes) == 0:
            return pa.array([], pa.float64())
        codes = codes.cast(pa.binary())
        offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
        numbers = np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(codes), parts)
        total = np.zeros(len(codes))
        for part in range(parts):
            total += table[part][numbers[:, part]]
        return pa.array(np.sqrt(total))

    return estimate


def _at(places: Sequence[int]) -> Column:
    """A filter on places that reaches the Parquet reader whole, as a balanced tree of equalities."""
    terms = [F.col("place") == F.lit(p) for p in sorted(places)] or [F.lit(False)]
    while len(terms) > 1:
        terms = [reduce(operator.or_, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def _check(codes: Codes, query: Sequence[float]) -> list[float]:
    return check_query(query, codes.books.shape[0] * codes.books.shape[2])


def search_codes(
    spark: SparkSession,
    codes: Codes,
    query: Sequence[float],
    *,
    allowed: Allowed,
    rerank: int | None,
    top_k: int = DEFAULT_TOP_K,
    filters: Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """Approximate Euclidean search: the ``rerank`` visible rows of least estimate, ranked exactly.

    With ``rerank`` None all rows are, which is the plain search. ``options`` are those of ``search_rows``.
    """
    query, rows = _check(codes, query), codes.rows(spark)
    options = {"allowed": allowed, "top_k": top_k, "filters": filters, "metric": Metric.l2_distance, **options}
    if rerank is None:
        return search_rows(rows, query, **options)
    seen = visible(rows, allowed).where(metadata_filter(filters))
    estimates = seen.select("place", estimate_to(codes.books, query)(F.col("code")).alias("estimate"))
    least = estimates.orderBy("estimate", "place").limit(rerank)
    if rerank <= PICKED_ROWS:
        return search_rows(rows.where(_at([r.place for r in least.select("place").collect()])), query, **options)
    # At most ``rerank`` narrow rows.
    return search_rows(rows.join(F.broadcast(least.select("place")), "place", "left_semi"), query, **options)


def search_codes_exact(
    spark: SparkSession,
    codes: Codes,
    query: Sequence[float],
    *,
    allowed: Allowed,
    top_k: int = DEFAULT_TOP_K,
    filters: Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """The exact Euclidean ``top_k``: whole vectors are read where the bounds of the code leave a row open."""
    query, rows = _check(codes, query), codes.rows(spark)
    options = {"allowed": allowed, "top_k": top_k, "filters": filters, "metric": Metric.l2_distance, **options}
    if top_k < 1 or "min_value" in options or "max_value" in options:
        return search_rows(rows, query, **options)
    estimate = estimate_to(codes.books, query)(F.col("code"))
    bounds = visible(rows, allowed).where(metadata_filter(filters)).select("place", "error", estimate.alias("estimate"))
    upper = bounds.select((F.col("estimate") + F.col("error")).alias("upper")).orderBy("upper").limit(top_k)
    worst = upper.agg(F.count(F.lit(1)).alias("n"), F.max("upper").alias("upper")).first()
    if worst.n < top_k:
        return search_rows(rows, query, **options)
    reach = worst.upper * (1 + SLACK) + SLACK
    is_open = F.col("estimate") - F.col("error") <= F.lit(reach)
    found = bounds.where(is_open).select("place").limit(PICKED_ROWS + 1).collect()
    if len(found) <= PICKED_ROWS:
        return search_rows(rows.where(_at([r.place for r in found])), query, **options)
    # Too many to name: one scan, whose rows are compared where they are.
    still = rows.withColumn("estimate", estimate).where(is_open).drop("estimate")
    return search_rows(still, query, **options)
