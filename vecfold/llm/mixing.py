"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: its target share of the mixture's bytes over its share of the
input's. A document's number of copies inverts the Poisson distribution with that mean at a number
from a hash of its id (high rates: the sum of several such draws at parts of the rate), so the mixture
has the target weights in expectation, any part of it can be drawn again alone, and no counter runs over
the corpus. Copies are dealt over all partitions and
ordered within them by another hash that includes the copy.

A null source is a source of its own, a null or empty text counts one byte. Rows that repeat an id
and source draw the same number; rows without id draw by their text and their number among equal ones,
each for itself. A source of weight 0 disappears. Other columns pass unchanged.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.llm.tables import numbered, row_key, small, stored, uniform, with_row

#: Without given weights a source weighs its bytes to this power: small sources gain.
SMOOTHING = 0.7
TERMS = 64
# Rate of one draw; higher rates are the sum of independent draws, whose distribution is the same.
DRAW_RATE = 24.0


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """(source, rate): mean copies per document, for a mixture of the input's size in bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("double") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(smoothing)))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "of string, weight double")
        weighed = sizes.join(given, F.col("source").cast("string").eqNullSafe(F.col("of")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = stored(weighed, "weights")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    rate = F.try_divide(F.col("weight") * F.lit(total["size"]), F.lit(total["weight"]) * F.col("size"))
    return weighed.select("source", F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("rate"))


def poisson(rate: Column, at: Column) -> Column:
    """The least count whose cumulative probability exceeds ``at``, as an expression of TERMS terms.

    At rates up to DRAW_RATE the terms reach every number a hash of 52 bits can give but the last few.
    """
    step = lambda a, k: F.struct(
        (a["p"] * rate / k).alias("p"), (a["sum"] + a["p"] * rate / k).alias("sum"), (a["n"] + (a["sum"] + a["p"] * rate / k <= at).cast("int")).alias("n")
    )
    none = F.exp(-rate)
    start = F.struct(none.alias("p"), none.alias("sum"), (none <= at).cast("int").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["n"])


def drawn_copies(rate: Column, what: str, *of: str) -> Column:
    """A Poisson count of any rate: one draw of at most DRAW_RATE, or the sum of several at equal parts of it."""
    draws = F.greatest(F.ceil(rate / DRAW_RATE).cast("int"), F.lit(1))
    draw = lambda k: poisson(rate / draws, uniform(F.lit(f"{what} draw"), k, *of)).cast("long")
    several = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0).cast("long"), lambda total, k: total + draw(k))
    return F.when(rate <= DRAW_RATE, poisson(rate, uniform(F.lit(what), *of)).cast("long")).otherwise(several)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 1, copy: str | None = None) -> DataFrame:
    """``docs`` with each row as often as drawn, shuffled; ``copy`` names a column for the copy's number."""
    by_source = small(stored(rates(docs, weights), "rates").select(F.col("source").alias("of"), "rate"))
    # Whole rows travel as one column, so their names cannot clash with these.
    whole = [F.struct("*").alias("row"), F.col("source").alias("from")]
    rows = docs.where("doc_id is not null").select(*whole, F.col("doc_id").cast("string").alias("id"))
    nameless = with_row(docs.where("doc_id is null").select(*whole, F.hex(row_key(F.col("source"))).alias("text_key")), "nameless")
    own = F.concat_ws("\u0001", F.lit("\u0000"), "text_key", "_copy").alias("id")
    rows = rows.unionByName(numbered(nameless, "text_key").select("row", "from", own))
    joined = rows.join(by_source, F.col("from").eqNullSafe(F.col("of")))
    drawn = joined.select("row", "id", "from", drawn_copies(F.col("rate"), f"copies {seed}", "id", "from").alias("copies"))
    copies = drawn.where("copies > 0").select("row", "id", "from", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    keyed = copies.withColumn("key", uniform(F.lit(f"order {seed}"), "id", "from", "copy"))
    spread = keyed.repartition("key").sortWithinPartitions("key", "copy")
    return spread.select("row.*", F.col("copy").alias(copy)) if copy else spread.select("row.*")
