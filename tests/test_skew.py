"""A key with a third of all rows: hot rows join where they are, and nothing gets lost."""

import pytest
from pyspark.sql import functions as F

from vecfold.operators import ingest, search, skew


@pytest.fixture()
def small_hot(monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)


def skewed(spark, rows=30_000):
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(0)).when(n % 11 == 1, F.lit(None)).otherwise(n)
    return spark.range(0, rows, 1, 4).select(n.alias("pos"), key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_the_plain_join(spark, small_hot, how):
    left = skewed(spark)
    right = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("key"), (F.col("id") * 2).alias("double"))
    got = skew.lookup_join(left, right, ["key"], how)
    want = left.join(right, ["key"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text and "BroadcastHashJoin" in text


def test_more_hot_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    left = spark.range(0, 5000, 1, 4).select(F.col("id").alias("pos"), (F.col("id") % 5).alias("key"))
    right = spark.range(5).select(F.col("id").alias("key"), F.col("id").alias("same"))
    got = skew.lookup_join(left, right, ["key"], hot_rows=100)
    assert got.count() == 5000 and got.where("key <> same").count() == 0


def test_no_hot_key_keeps_the_plain_join(spark):
    left = skewed(spark)
    right = spark.range(100).select(F.col("id").alias("key"))
    assert "Union" not in skew.lookup_join(left, right, ["key"])._jdf.queryExecution().executedPlan().toString()


def test_fan_out_of_a_hot_copy(spark, small_hot):
    n = F.col("pos")
    prepared = skewed(spark).select(
        n, F.lit(1).cast("long").alias("collection_id"), F.md5(F.coalesce("key", n).cast("string")).alias("embedding_hash"),
        F.lit("m").alias("metadata_hash"), F.lit("/a").alias("authz"),
    )
    fanned = ingest.fan_out(prepared, ingest.unique_keys(prepared), ["first_pos", "copies"])
    assert fanned.count() == 30_000
    assert fanned.where("copies > 1").agg(F.min("copies"), F.max("first_pos"), F.count("pos")).first() == (10_000, 0, 10_000)


def test_hot_and_missing_names_resolve(spark, monkeypatch):
    known = spark.createDataFrame([(1, "one"), (2, "two")], "id long, collection_name string")
    lists = ["one"] * 6 + ["one, TWO", "a b, one", "", None, "three,one", "é,é,é"]
    requests = spark.createDataFrame(list(enumerate(lists)), "request_id long, collections string")

    def resolved():
        return sorted((r.request_id, r.pos, r.entry, r.collection_id or 0) for r in search.resolve_names(requests, known).collect())

    plain = resolved()
    assert [r[3] for r in plain if r[0] < 7] == [1] * 7 + [2]
    # Malformed and unknown entries stay, without a collection.
    assert [(r[0], r[3]) for r in plain if r[0] in (7, 10)] == [(7, 0), (7, 1), (10, 0), (10, 1)]
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    assert resolved() == plain
