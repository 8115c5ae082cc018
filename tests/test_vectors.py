import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.functions import vectors as V
from vecfold.schemas import Metric


def reference(metric, x, q):
    x, q = np.asarray(x, float), np.asarray(q, float)
    cosine = float(x @ q / (np.linalg.norm(x) * np.linalg.norm(q)))
    return {
        "l2_distance": float(np.linalg.norm(x - q)),
        "l1_distance": float(np.abs(x - q).sum()),
        "inner_product": -float(x @ q),
        "cosine_distance": 1 - cosine,
        "cosine_similarity": cosine,
    }[metric]


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("kernel", ["expression", "arrow"])
def test_distances(spark, metric, kernel):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=7).astype(np.float32).tolist()) for i in range(20)]
    query = rng.normal(size=7).tolist()
    frame = spark.createDataFrame(rows, "i long, x array<float>")
    got = dict(frame.select("i", V.distance_to(metric, F.col("x"), query, kernel).alias("v")).collect())
    for i, x in rows:
        assert got[i] == pytest.approx(reference(metric, x, query), abs=1e-12)


@pytest.mark.parametrize("kernel", ["expression", "arrow"])
def test_zero_vector_has_no_cosine(spark, kernel):
    frame = spark.createDataFrame([([0.0, 0.0],)], "x array<float>")
    for metric in (Metric.cosine_distance, Metric.cosine_similarity):
        assert math.isnan(frame.select(V.distance_to(metric, F.col("x"), [1.0, 2.0], kernel)).first()[0])


def test_half_rounding_is_numpys(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate(
        [
            rng.normal(size=3000) * np.float64(10.0) ** rng.integers(-9, 5, 3000),
            [0.0, 1.0, -1.0, 65504.0, 65519.9, 2.0**-14, 2.0**-24, 2.0**-25, 3 * 2.0**-26, 2049.0, 2051.0, -4097.0],
            np.float64(2.0) ** np.arange(-24, 16),
        ]
    ).astype(np.float32)
    values = values[np.abs(values) < 65520]
    frame = spark.createDataFrame([(values.tolist(),)], "x array<float>")
    got = np.array(frame.select(V.half_round(F.col("x"))).first()[0], np.float32)
    assert (got == values.astype(np.float16).astype(np.float32)).all()


@pytest.mark.parametrize("value,bad", [(65504.0, False), (65519.0, False), (65520.0, True), (1e9, True), (float("inf"), True)])
def test_half_overflow(spark, value, bad):
    frame = spark.createDataFrame([([0.5, value],)], "x array<double>")
    assert frame.select(V.half_overflows(F.col("x"))).first()[0] is bad


def test_vector_bytes(spark):
    rows = [(0, [1.0, -2.5], False), (1, [0.1, 3.0, 7.0], True)]
    frame = spark.createDataFrame(rows, "i long, x array<float>, half boolean")
    got = dict(frame.select("i", F.base64(V.vector_bytes(F.col("x"), F.col("half")))).collect())
    assert base64.b64decode(got[0]) == np.array([1.0, -2.5], "<f4").tobytes()
    assert base64.b64decode(got[1]) == np.array([0.1, 3.0, 7.0], "<f2").tobytes()


def test_half_query_rounds_like_rows(spark):
    query = [0.1, 1 / 3, 2049.0]
    frame = spark.createDataFrame([(query,)], "x array<double>")
    assert V.half_query(query) == frame.select(V.half_round(F.col("x"))).first()[0]
