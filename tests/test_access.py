import pytest
from pyspark.sql import functions as F

from vecfold.functions import names
from vecfold.operators import access

GRANTS = [
    ("u", "/vectorstore/collections/a", [("vectorstore", "read"), ("vectorstore", "create")]),
    ("u", "/vectorstore/collections/b", [("*", "read")]),
    ("u", "/vectorstore/collections/c", [("vectorstore", "*")]),
    ("u", "/vectorstore/collections/d", [("other", "read")]),
    ("u", "/vectorstore/collections/e/deep", [("*", "*")]),
    ("u", "/vectorstore/collections", [("*", "*")]),
    ("u", "/vectorstore/collections/", [("*", "*")]),
    ("u", "/programs/p", [("*", "*")]),
    ("w", "/vectorstore/collections/a", [("vectorstore", "update")]),
    ("w", "/vectorstore/collections/none", []),
]


@pytest.fixture(scope="module")
def grants(spark):
    schema = "user string, resource string, entries array<struct<service:string,method:string>>"
    rows = spark.createDataFrame(GRANTS, schema)
    mapping = rows.groupBy("user").agg(
        F.map_from_entries(F.collect_list(F.struct("resource", "entries"))).alias("grants")
    )
    return access.explode_grants(mapping, ["user"])


def resources(grants, method):
    return access.allowed_resources(grants, method, "vectorstore", ["user"])


def test_wildcards_match_service_and_method(grants):
    read = {r.authz for r in resources(grants, "read").where("user = 'u'").collect()}
    base = "/vectorstore/collections"
    assert read == {f"{base}/a", f"{base}/b", f"{base}/c", f"{base}/e/deep", base, f"{base}/", "/programs/p"}
    assert {r.authz for r in resources(grants, "update").where("user = 'w'").collect()} == {f"{base}/a"}


def test_only_four_part_paths_name_a_collection(grants):
    named = access.allowed_collections(resources(grants, "read"), ["user"]).collect()
    assert {(r.user, r.collection_name) for r in named} == {("u", "a"), ("u", "b"), ("u", "c")}
    literal = [r.resource for r in grants.select("resource").distinct().collect()]
    assert access.collection_names(literal) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("as_frame", [False, True])
def test_row_policy(spark, as_frame):
    rows = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/a")], "i long, authz string")

    def allowed(*paths):
        return spark.createDataFrame([(p,) for p in paths], "authz string") if as_frame else list(paths)

    assert sorted(r.i for r in access.visible(rows, allowed("/a", "/z")).collect()) == [1, 3]
    assert access.visible(rows, allowed()).count() == 0
    assert [r.i for r in access.write_violations(rows, allowed("/a")).collect()] == [2]
    assert access.write_violations(rows, allowed()).count() == 3
    flags = {r.i: r.visible for r in access.with_visibility(rows, allowed("/b")).collect()}
    assert flags == {1: False, 2: True, 3: False}
    with pytest.raises(access.NotAllowed):
        access.check_writable(rows, allowed("/b"))
    access.check_writable(rows, allowed("/a", "/b"))


def test_names_and_paths(spark):
    rows = spark.createDataFrame(
        [(" My-Col_1\t",), ("bad name",), ("",), ("x/y",), (None,), ("\nok\n",)], "name string"
    )
    assert [r[0] for r in rows.select(names.normalize_name(F.col("name"))).collect()] == [
        "my-col_1", None, None, None, None, "ok",
    ]
    paths = spark.createDataFrame([(" /a ",), ("  ",), (None,), ("a",)], "authz string")
    got = paths.select(names.normalize_authz(F.col("authz")), names.authz_is_valid(F.col("authz"))).collect()
    assert [tuple(r) for r in got] == [("/a", True), (None, True), (None, True), ("a", False)]
    assert rows.select(names.split_names(F.lit(" a, ,B ,,c"))).first()[0] == ["a", "B", "c"]
    assert rows.select(names.url_origin(F.lit("https://h.example:8080/x?y#z"))).first()[0] == "https://h.example:8080"
    assert rows.select(names.url_origin(F.lit("no url at all"))).first()[0] is None
