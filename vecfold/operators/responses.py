"""Normalisation of logged model requests and replies, one row per logged object.

Nested parts are handled with array expressions inside the row, so these jobs never shuffle;
only the assembly of a conversation from its turns groups rows, in parts and then whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary of the logged protocols.
MESSAGE_ROLES = ["user", "assistant", "system"]
ITEM_STATUSES = ["in_progress", "completed", "incomplete"]
ITEM_TYPES = ["message", "function_call", "function_call_output", "reasoning"]
OUTPUT_PART_TYPES = ["input_file", "input_text", "input_image"]
VERBOSITIES = ["low", "medium", "high"]
REASONING_EFFORTS = ["none", "low", "medium", "high", "xhigh"]
REASONING_SUMMARIES = ["concise", "detailed", "auto"]
UNKNOWN_NUMBER = -1
CHAT_ARGUMENTS_FIELD = "__openai_chat_function_args__"

# Turns sorted at a time, before the parts of a conversation are joined.
MESSAGES_PER_PART = 1024


def chat_role(role: Column) -> Column:
    return F.when(role.isin(MESSAGE_ROLES), role).otherwise(F.lit("user"))


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def chat_requests(bodies: DataFrame) -> DataFrame:
    """Logged request bodies as chat requests.

    A body has ``model, instructions, input_items array<struct<role,content>>, input_text`` and
    ``temperature, top_p, max_output_tokens``; its input is the item list or, without one, the text.
    """
    instructions = F.when(
        F.coalesce("instructions", F.lit("")) != "",
        F.array(_message(F.lit("system"), F.col("instructions"))),
    ).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    items = F.transform("input_items", lambda m: _message(chat_role(m["role"]), m["content"]))
    text = F.array(_message(F.lit("user"), F.coalesce("input_text", F.lit("None"))))
    kept = [c for c in bodies.columns if c not in ("instructions", "input_items", "input_text", "max_output_tokens")]
    return bodies.select(
        *kept,
        F.col("max_output_tokens").alias("max_tokens"),
        F.concat(instructions, F.coalesce(items, text)).alias("messages"),
    )


def assemble_conversations(turns: DataFrame, part_size: int = MESSAGES_PER_PART) -> DataFrame:
    """Turns (``conv_id, turn, role, text``) as one message list per conversation, in turn order.

    Turns count from 0 and a ``system`` turn 0 holds the instructions. Messages are sorted in parts of
    ``part_size`` turns, which spreads a long conversation over tasks, and the parts joined.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / part_size).alias("part"),
        F.struct("turn", chat_role(F.col("role")).alias("role"), F.col("text").alias("content")).alias("message"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("message")).alias("ordered"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "ordered"))).alias("parts"))
    messages = F.transform(F.flatten(F.transform("parts", lambda p: p["ordered"])), lambda m: _message(m["role"], m["content"]))
    return whole.select("conv_id", messages.alias("messages"))


def item_status(status: Column) -> Column:
    return F.when(status.isin(ITEM_STATUSES), status).otherwise(F.lit("incomplete"))


def _text_part(text: Column) -> Column:
    return F.struct(F.lit("input_text").alias("type"), text.alias("text"))


def _tool_calls(choices: str = "choices") -> Column:
    """Function calls of all choices, in order."""
    calls = F.flatten(
        F.transform(choices, lambda c: F.coalesce(c["message"]["tool_calls"], F.array()))
    )
    return F.filter(calls, lambda call: call["type"] == "function")


def normalize_completions(completions: DataFrame) -> DataFrame:
    """Chat completions (``id, created, model, choices, usage, service_tier``) as response records."""

    def item(choice: Column) -> Column:
        return F.struct(
            F.lit("message").alias("type"),
            choice["index"].cast("string").alias("id"),
            F.lit("completed").alias("status"),
            F.lit("assistant").alias("role"),
            F.array(_text_part(F.coalesce(choice["message"]["content"], F.lit("")))).alias("content"),
        )

    def tool(call: Column) -> Column:
        return F.struct(
            F.lit("function").alias("type"),
            call["function"]["name"].alias("name"),
            F.create_map(F.lit(CHAT_ARGUMENTS_FIELD), call["function"]["arguments"]).alias("parameters"),
        )

    unknown = F.lit(UNKNOWN_NUMBER)
    usage = F.col("usage")
    return completions.select(
        "id",
        F.lit("response").alias("object"),
        F.col("created").cast("long").alias("created_at"),
        F.lit("completed").alias("status"),
        "model",
        F.transform("choices", item).alias("output"),
        F.transform(_tool_calls(), tool).alias("tools"),
        F.lit("auto").alias("tool_choice_mode"),
        F.lit("auto").alias("truncation"),
        F.lit(True).alias("parallel_tool_calls"),
        *[
            unknown.alias(c)
            for c in ("top_logprobs", "top_p", "presence_penalty", "frequency_penalty", "temperature")
        ],
        F.when(
            usage.isNotNull(),
            F.struct(
                usage["prompt_tokens"].alias("input_tokens"),
                usage["completion_tokens"].alias("output_tokens"),
                usage["total_tokens"].alias("total_tokens"),
                F.coalesce(usage["cached_tokens"], unknown).alias("cached_tokens"),
                F.coalesce(usage["reasoning_tokens"], unknown).alias("reasoning_tokens"),
            ),
        ).alias("usage"),
        F.coalesce("service_tier", F.lit("default")).alias("service_tier"),
    )


def completion_tool_calls(completions: DataFrame) -> DataFrame:
    """One row per function call of a completion, all choices in order."""
    calls = completions.select("id", F.posexplode(_tool_calls()).alias("pos", "call"))
    return calls.select(
        "id",
        "pos",
        F.col("call")["id"].alias("call_id"),
        F.col("call")["function"]["name"].alias("name"),
        F.col("call")["function"]["arguments"].alias("arguments"),
    )


def function_tools(tools: Column) -> Column:
    """Only the function tools of a request, in chat form."""
    return F.transform(
        F.filter(tools, lambda t: t["type"] == "function"),
        lambda t: F.struct(
            F.lit("function").alias("type"),
            F.struct(t["name"].alias("name"), t["description"], t["parameters"], t["strict"]).alias("function"),
        ),
    )


def chat_tool_choice(choice: Column) -> Column:
    """A request's tool choice ``struct<mode, type, name, tools>`` in chat form.

    A named function stays; an allowed-tools list collapses to its first function; without
    either the mode (``auto`` and the like) counts.
    """
    first = F.get(F.filter(choice["tools"], lambda t: t["type"] == "function"), F.lit(0))
    name = F.when(choice["type"] == "function", choice["name"]).when(
        choice["type"] == "allowed_tools", first["name"]
    )
    mode = F.when(choice["type"].isNull(), choice["mode"])
    return F.when(choice.isNotNull(), F.struct(mode.alias("mode"), name.alias("function_name")))


def allowed_function_tools(choice: Column) -> Column:
    """The names of the function tools an allowed-tools choice lists, ``unknown`` where unnamed."""
    functions = F.filter(choice["tools"], lambda t: t["type"] == "function")
    names = F.transform(functions, lambda t: F.coalesce(t["name"], F.lit("unknown")))
    return F.when(choice["type"] == "allowed_tools", names)


def normalize_output(output: Column) -> Column:
    """Output items with one vocabulary; unknown types drop, order stays."""

    def parts(item: Column) -> Column:
        texts = F.filter(item["content"], lambda p: p["type"] == "output_text")
        reasoning = F.when(F.size(item["content"]) > 0, item["content"])
        chosen = F.when(item["type"] == "message", texts).when(item["type"] == "reasoning", reasoning)
        return F.transform(chosen, lambda p: _text_part(p["text"]))

    def returned(item: Column) -> Column:
        known = F.filter(item["output"], lambda p: p["type"].isNull() | p["type"].isin(OUTPUT_PART_TYPES))
        return F.transform(
            known,
            lambda p: F.struct(
                p["type"].alias("type"),
                p["text"].alias("text"),
                p["filename"].alias("filename"),
                p["file_url"].alias("file_url"),
                p["image_url"].alias("image_url"),
                F.when(p["detail"] == "original", F.lit("auto")).otherwise(p["detail"]).alias("detail"),
            ),
        )

    def normalized(item: Column) -> Column:
        is_call = item["type"].isin("function_call", "function_call_output")
        return F.struct(
            item["type"].alias("type"),
            F.when(is_call, item["call_id"]).otherwise(item["id"]).alias("id"),
            F.when(is_call, item["call_id"]).alias("call_id"),
            F.when(item["type"] != "reasoning", item_status(item["status"])).alias("status"),
            F.when(item["type"] == "message", F.lit("assistant")).alias("role"),
            F.when(item["type"] == "function_call", item["name"]).alias("name"),
            F.when(item["type"] == "function_call", item["arguments"]).alias("arguments"),
            parts(item).alias("content"),
            F.when(item["type"] == "reasoning", F.transform(item["summary"], lambda s: s["text"])).alias("summary"),
            F.when(item["type"] == "function_call_output", returned(item)).alias("output"),
            F.when(item["type"] == "reasoning", item["encrypted_content"]).alias("encrypted_content"),
        )

    return F.transform(F.filter(output, lambda item: item["type"].isin(ITEM_TYPES)), normalized)


def normalize_outputs(responses: DataFrame) -> DataFrame:
    return responses.withColumn("output", normalize_output(F.col("output")))


def responses_to_chat(responses: DataFrame) -> DataFrame:
    """Normalised responses (``id, created_at, model, output, error, usage``) as chat completions."""
    spoken = F.filter("output", lambda item: item["type"].isin("message", "reasoning"))
    texts = F.flatten(
        F.transform(
            spoken,
            lambda item: F.transform(
                F.coalesce(item["content"], F.array()), lambda p: F.coalesce(p["text"], F.lit(""))
            ),
        )
    )
    content = F.when(F.size(spoken) > 0, F.array_join(texts, ""))
    calls = F.filter("output", lambda item: item["type"] == "function_call")
    last_call = F.try_element_at(calls, F.lit(-1))
    outputs = F.transform(
        F.filter("output", lambda item: item["type"] == "function_call_output"),
        lambda item: F.struct(item["call_id"].alias("id"), F.lit("function").alias("type"), item["output"].alias("output")),
    )
    failed = F.col("error").isNotNull()
    message = F.struct(
        F.lit("assistant").alias("role"),
        F.when(failed, F.concat(F.lit("Error: "), F.col("error")["message"])).otherwise(content).alias("content"),
        F.when(~failed & last_call.isNotNull(), F.struct(last_call["name"], last_call["arguments"])).alias(
            "function_call"
        ),
        F.when(~failed & (F.size(outputs) > 0), outputs).alias("tool_calls"),
    )
    return responses.select(
        "id",
        F.lit("chat.completion").alias("object"),
        F.col("created_at").alias("created"),
        "model",
        F.array(
            F.struct(
                F.lit(0).alias("index"),
                message.alias("message"),
                F.when(failed, F.lit("error")).otherwise(F.lit("stop")).alias("finish_reason"),
            )
        ).alias("choices"),
        F.when(
            F.col("usage").isNotNull(),
            F.struct(
                F.col("usage")["input_tokens"].alias("prompt_tokens"),
                F.col("usage")["output_tokens"].alias("completion_tokens"),
                F.col("usage")["total_tokens"].alias("total_tokens"),
            ),
        ).alias("usage"),
    )


def normalize_settings(settings: DataFrame) -> DataFrame:
    """Reply settings with defaults filled in; unset numbers become -1, a real 0 stays."""
    text_format = (
        F.when(F.col("format_type") == "json_schema", F.lit("json_schema"))
        .when(F.col("format_type") == "json", F.lit("json_object"))
        .otherwise(F.lit("text"))
    )
    effort = F.when(F.col("reasoning_effort") == "minimal", F.lit("low")).when(
        F.col("reasoning_effort").isin(REASONING_EFFORTS), F.col("reasoning_effort")
    )
    changed = {
        "format_type": text_format,
        "verbosity": F.when(F.col("verbosity").isin(VERBOSITIES), F.col("verbosity")).otherwise(F.lit("medium")),
        "reasoning_effort": effort,
        "reasoning_summary": F.when(F.col("reasoning_summary").isin(REASONING_SUMMARIES), F.col("reasoning_summary")),
        "truncation": F.when(F.col("truncation") == "auto", F.lit("auto")).otherwise(F.lit("disabled")),
        "service_tier": F.coalesce(F.nullif("service_tier", F.lit("")), F.lit("default")),
        "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")),
        "background": F.coalesce("background", F.lit(False)),
        **{c: F.coalesce(c, F.lit(UNKNOWN_NUMBER)) for c in ("top_p", "temperature", "top_logprobs")},
    }
    return settings.select(*[changed.get(c, F.col(c)).alias(c) for c in settings.columns])


def merged_metadata(own: Column, extra: Column) -> Column:
    """A reply's metadata with the caller's entries on top."""
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k)), extra)
