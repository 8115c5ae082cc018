"""Small literal cases of the response-log jobs."""

import pytest
from pyspark.sql import functions as F

from vecfold.operators import models, requests, responses
from vecfold.sources.fixtures import RAW_ITEM

ROLE = "array<struct<role:string,content:string>>"


def test_chat_requests(spark):
    bodies = spark.createDataFrame(
        [
            (1, "Be kind", [("user", "hi"), ("developer", "x"), ("assistant", "yo")], None, 0.0, None, 5),
            (2, "", None, "just text", None, 0.5, None),
            (3, None, [], "ignored", None, None, None),
            (4, None, None, None, None, None, None),
        ],
        f"id int, instructions string, input_items {ROLE}, input_text string, temperature double, top_p double, max_output_tokens int",
    )
    rows = {r.id: r for r in responses.chat_requests(bodies).collect()}
    assert [tuple(m) for m in rows[1].messages] == [
        ("system", "Be kind"), ("user", "hi"), ("user", "x"), ("assistant", "yo"),
    ]
    assert (rows[1].temperature, rows[1].max_tokens) == (0.0, 5)
    assert [tuple(m) for m in rows[2].messages] == [("user", "just text")]
    assert rows[3].messages == [] and [tuple(m) for m in rows[4].messages] == [("user", "None")]


def test_a_long_conversation_is_one_list(spark):
    turns = spark.range(5000).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("system")).otherwise(F.lit("tool")).alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    (whole,) = responses.assemble_conversations(turns.repartition(4)).collect()
    assert [m.content for m in whole.messages] == [str(n) for n in range(5000)]
    assert [m.role for m in whole.messages[:3]] == ["system", "user", "user"]


def raw_items(spark, *items):
    names = ["type", "id", "call_id", "status", "name", "arguments", "content", "summary", "output", "encrypted_content"]
    output = [tuple(item.get(n) for n in names) for item in items]
    schema = f"id string, created_at long, model string, output array<{RAW_ITEM}>, error struct<message:string>, usage struct<input_tokens:int,output_tokens:int,total_tokens:int>"
    return spark.createDataFrame([("r", 1, "m", output, None, None)], schema)


ITEMS = [
    {"type": "message", "id": "m1", "status": "queued", "content": [("output_text", "a"), ("refusal", "no"), ("output_text", "b")]},
    {"type": "mystery", "id": "?"},
    {"type": "function_call", "call_id": "c1", "name": "f", "arguments": "1", "status": "completed"},
    {"type": "function_call", "call_id": "c2", "name": "g", "arguments": "2", "status": "in_progress"},
    {
        "type": "function_call_output", "call_id": "c2", "status": None,
        "output": [("input_image", None, None, None, "u", "original"), ("video", None, None, None, None, None), (None, "plain", None, None, None, None)],
    },
    {"type": "reasoning", "id": "r1", "content": [("reasoning_text", "z")], "summary": [("s",)], "encrypted_content": "e"},
    {"type": "reasoning", "id": "r2", "content": [], "summary": []},
]


def test_outputs_are_normalised(spark):
    (row,) = responses.normalize_outputs(raw_items(spark, *ITEMS)).collect()
    kinds = [(i.type, i.id, i.call_id, i.status) for i in row.output]
    assert kinds == [
        ("message", "m1", None, "incomplete"),
        ("function_call", "c1", "c1", "completed"),
        ("function_call", "c2", "c2", "in_progress"),
        ("function_call_output", "c2", "c2", "incomplete"),
        ("reasoning", "r1", None, None),
        ("reasoning", "r2", None, None),
    ]
    assert [tuple(p) for p in row.output[0].content] == [("input_text", "a"), ("input_text", "b")]
    assert [(p.type, p.text, p.detail) for p in row.output[3].output] == [("input_image", None, "auto"), (None, "plain", None)]
    assert row.output[4].summary == ["s"] and row.output[4].encrypted_content == "e"
    assert row.output[5].content is None


def test_response_to_chat(spark):
    normal = responses.normalize_outputs(raw_items(spark, *ITEMS))
    (chat,) = responses.responses_to_chat(normal).collect()
    (choice,) = chat.choices
    assert choice.message.content == "abz" and choice.finish_reason == "stop" and chat.usage is None
    assert tuple(choice.message.function_call) == ("g", "2")
    assert [t.id for t in choice.message.tool_calls] == ["c2"]
    (silent,) = responses.responses_to_chat(responses.normalize_outputs(raw_items(spark, ITEMS[2]))).collect()
    assert silent.choices[0].message.content is None
    failed = normal.withColumn("error", F.struct(F.lit("boom").alias("message")))
    (bad,) = responses.responses_to_chat(failed).collect()
    assert bad.choices[0].message.content == "Error: boom" and bad.choices[0].finish_reason == "error"
    assert bad.choices[0].message.function_call is None


def test_completions_keep_zero_apart_from_unknown(spark):
    schema = (
        "id string, created double, model string, choices array<struct<index:int,message:struct<content:string,"
        "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>>,"
        "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,cached_tokens:int,reasoning_tokens:int>,"
        "service_tier string"
    )
    calls = [("t1", "function", ("f", "{}")), ("t2", "custom", ("g", "{}"))]
    data = [
        ("a", 12.9, "m", [(0, (None, calls)), (1, ("hi", None))], (3, 4, 7, 0, None), None),
        ("b", 1.0, "m", [], None, "flex"),
    ]
    rows = {r.id: r for r in responses.normalize_completions(spark.createDataFrame(data, schema)).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.created_at, a.service_tier, a.usage.cached_tokens, a.usage.reasoning_tokens) == (12, "default", 0, -1)
    assert [(i.id, i.content[0].text) for i in a.output] == [("0", ""), ("1", "hi")]
    assert [(t.name, t.parameters) for t in a.tools] == [("f", {responses.CHAT_ARGUMENTS_FIELD: "{}"})]
    assert b.usage is None and b.output == [] and b.service_tier == "flex"
    called = responses.completion_tool_calls(spark.createDataFrame(data, schema)).collect()
    assert [(c.id, c.pos, c.call_id, c.name) for c in called] == [("a", 0, "t1", "f")]


@pytest.mark.parametrize(
    "primary,expected", [([False, False, False], 2), ([False, True, False], 5), ([False, True, True], 4)]
)
def test_model_resolution(spark, primary, expected):
    hosts = [("m", 2, primary[0], 2), ("m", 5, primary[1], 5), ("m", 4, primary[2], 4)]
    availability = spark.createDataFrame(hosts, "model string, host long, is_primary boolean, priority long")
    wanted = spark.createDataFrame([("m",), ("none",)], "model string")
    found = {r.model: r.host for r in models.resolve_models(wanted, availability).collect()}
    assert found == {"m": expected, "none": None}


def test_protocol_preference(spark):
    rows = spark.createDataFrame(
        [(["openai_chat", "openresponses"],), (["openai_chat"],), (["kserve_v2"],), ([],)], "p array<string>"
    )
    assert [r[0] for r in rows.select(models.protocol(F.col("p"))).collect()] == ["openresponses", "openai_chat", None, None]


@pytest.mark.parametrize("as_frame", [False, True])
def test_trusted_models(spark, as_frame):
    rows = spark.createDataFrame(
        [(1, "https://a.org/v1/"), (2, "http://a.org/v1/"), (3, "https://b.org"), (4, None), (5, ""), (6, "https://a.org:81/x")],
        "model int, url string",
    )
    hosts = ["https://a.org/anything", "http://c.org"]
    given = spark.createDataFrame([(h,) for h in hosts], "host string") if as_frame else hosts
    assert sorted(r.model for r in models.trusted_models(rows, given).collect()) == [1, 4, 5]


def test_housekeeping_is_not_counted(spark):
    log = spark.createDataFrame(
        [("GET", p, u, 1.0, 200) for p, u in [("/v1", "a"), ("/v1", None), ("/metrics/", "a"), ("/", "a"), ("/docs", "a")]],
        "method string, path string, user_id string, response_time_ms double, status_code int",
    )
    counted = {r.user_id: r.requests for r in requests.count_requests(log, ["user_id"]).collect()}
    assert counted == {"a": 1, "Unknown": 1}
    assert [tuple(r) for r in requests.requests_by_status(log).collect()] == [(200, 2)]
