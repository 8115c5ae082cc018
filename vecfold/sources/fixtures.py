"""The engine's tables derived from the given test tables, whole tables throughout."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.functions.content import hash_uuid, vector_text
from vecfold.functions.names import collection_path, url_origin
from vecfold.functions.vectors import stored_vector
from vecfold.schemas import COLLECTIONS
from vecfold.session import scratch_path
from vecfold.sources.tables import Tables

SERVICE = "vectorstore"
CREATED = "2024-01-01 00:00:00"
CHUNK_CHARACTERS = 16
DIMENSIONS = 64

# What the reading caller of the test queries holds: seven collections and one programme.
CALLER = [f"/vectorstore/collections/c{n}" for n in range(7)] + ["/programs/p0"]

# What the caller of the put queries holds: everything.
OWNER = [f"/vectorstore/collections/c{n}" for n in range(10)] + [f"/programs/p{n}" for n in range(3)]

# Schemas of the given tables, so that no read has to infer one.
SCHEMAS = {
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long",
    "pages": "page_id long, url string, html string",
    "part": "p_partkey long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _vector_type(label: Column) -> Column:
    return F.when(label % 3 == 2, F.lit("halfvec")).otherwise(F.lit("vector"))


def _name(label: Column) -> Column:
    return F.concat(F.lit("c"), label.cast("string"))


def vector_id(vec_id: Column) -> Column:
    return hash_uuid(vec_id.cast("string"))


def _labelled_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection per label of the vectors."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select("label").distinct().select(
        (label + 1).cast("long").alias("id"),
        _name(label).alias("collection_name"),
        F.concat(F.lit("label "), label.cast("string")).alias("description"),
        F.concat(F.lit("model-"), (label % 2).cast("string")).alias("ai_model_name"),
        F.lit(DIMENSIONS).alias("dimensions"),
        _vector_type(label).alias("vector_type"),
        F.lit(CREATED).cast("timestamp").alias("created_at"),
        F.lit(CREATED).cast("timestamp").alias("updated_at"),
    )


_catalogs: dict[tuple[str, str], str] = {}


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as a stored table, written once per application.

    As in a real store its size is then known when a query is planned, so it is broadcast to the
    vectors when it is small, and only then.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        path = scratch_path(spark, "catalog")
        _labelled_collections(spark, sf_dir).coalesce(1).write.parquet(path)
        _catalogs[key] = path
    return spark.read.schema(COLLECTIONS).parquet(_catalogs[key])


def _metadata(vec_id: Column) -> Column:
    return F.to_json(
        F.struct(vec_id.alias("i"), F.concat(F.lit("src"), (vec_id % 7).cast("string")).alias("source"))
    )


def _authz(vec_id: Column, label: Column) -> Column:
    programme = F.concat(F.lit("/programs/p"), (vec_id % 3).cast("string"))
    return F.when(vec_id % 5 == 0, programme).otherwise(collection_path(_name(label)))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored embeddings: every vector, rounded where its collection is half precision."""
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings")
    kind = _vector_type(label)
    return rows.select(
        (label + 1).cast("long").alias("collection_id"),
        kind.alias("vector_type"),
        vector_id(vec_id).alias("embedding_id"),
        stored_vector(F.col("embedding"), kind).alias("embedding"),
        hash_uuid(vector_text(F.col("embedding"))).alias("embedding_hash"),
        _authz(vec_id, label).alias("authz"),
        _metadata(vec_id).alias("metadata"),
        hash_uuid(_metadata(vec_id)).alias("metadata_hash"),
        F.lit(CREATED).cast("timestamp").alias("created_at"),
        F.lit(CREATED).cast("timestamp").alias("updated_at"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the query of a search."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def incoming_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector twice. The first copy is as stored; the second repeats it, or has new
    metadata for even ids, so the batch mixes stored keys, repeats within it and new keys."""
    return batch_of(table(spark, sf_dir, "embeddings"))


def batch_of(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    vec_id = F.col("vec_id")
    revised = F.to_json(F.struct(F.lit(1).alias("rev"), vec_id.alias("i")))
    is_new = (F.col("copy") == 1) & (vec_id % 2 == 0)
    return rows.select(
        (vec_id * 2 + F.col("copy")).alias("pos"),
        (F.col("label") + 1).cast("long").alias("collection_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(vec_id % 5 == 0, _authz(vec_id, F.col("label"))).otherwise(F.lit(" ")).alias("authz"),
        F.when(is_new, revised).otherwise(_metadata(vec_id)).alias("metadata"),
    )


def incoming_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a JSON array document of one row."""
    rows = table(spark, sf_dir, "embeddings")
    row = F.struct(
        (F.col("label") + 1).cast("long").alias("collection_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.lit("  ").alias("authz"),
        F.parse_json(_metadata(F.col("vec_id"))).alias("metadata"),
    )
    return rows.select("vec_id", F.to_json(F.array(row)).alias("document"))


def id_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per event for the vector with the number ``7 * user_id``: ids repeat, and
    numbers past the last vector are unknown."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), vector_id(F.col("user_id") * 7).alias("embedding_id")
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grant per event: collections, programmes, the base path and paths that are too deep."""
    event, user = F.col("event_id"), F.col("user_id")
    number = F.col("event_id") % 12
    resource = (
        F.when(event % 17 == 0, F.lit("/vectorstore/collections"))
        .when(event % 13 == 0, F.concat(F.lit("/vectorstore/collections/c"), number.cast("string"), F.lit("/x")))
        .when(event % 5 == 0, F.concat(F.lit("/programs/p"), (event % 3).cast("string")))
        .otherwise(F.concat(F.lit("/vectorstore/collections/c"), number.cast("string")))
    )
    service = F.when(F.col("event_type") == "view", F.lit("*")).when(
        F.col("event_type") == "error", F.lit("other")
    ).otherwise(F.lit(SERVICE))
    methods = F.array(*[F.lit(m) for m in ("read", "create", "update", "delete", "*")])
    method = F.get(methods, (F.floor(F.col("value")) % 5).cast("int"))
    return table(spark, sf_dir, "events").select(
        user.alias("user_id"), resource.alias("resource"), service.alias("service"), method.alias("method")
    )


def name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma list of collection names per event, with blanks, capitals and unknown names."""
    first = (F.col("event_id") % 11).cast("string")
    second = (F.col("user_id") % 10).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit(" c"), first, F.lit(", ,C"), second, F.lit(" ,")).alias("collections"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log_of(table(spark, sf_dir, "events"))


def request_log_of(events: DataFrame) -> DataFrame:
    """Events as logged requests."""
    kind = F.col("event_type")
    return events.select(
        F.when(kind == "view", F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.when(kind == "signup", F.lit("/docs/")).otherwise(F.concat(F.lit("/"), kind)).alias("path"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("value").alias("response_time_ms"),
        F.when(kind == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _reply_id() -> Column:
    return F.concat_ws("-", F.lit("r"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def chunks_of(turns: DataFrame) -> DataFrame:
    """Turns cut in short pieces, as a reply stream logs them."""
    last = F.greatest(F.ceil(F.length("text") / CHUNK_CHARACTERS).cast("int"), F.lit(1)) - 1
    cut = turns.select(
        _reply_id().alias("response_id"), "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq")
    )
    return cut.select(
        "response_id",
        F.col("seq").cast("long").alias("seq"),
        F.substring("text", F.col("seq") * CHUNK_CHARACTERS + 1, F.lit(CHUNK_CHARACTERS)).alias("delta"),
        (F.col("seq") == F.col("last")).alias("is_last"),
    )


def reply_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(conversations(spark, sf_dir)).drop("is_last")


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request body per turn: item lists with odd roles, plain texts, optional settings."""
    turn, text, role = F.col("turn"), F.col("text"), F.col("role")
    item = F.struct(
        F.when(turn % 4 == 3, F.lit("developer")).otherwise(role).alias("role"), text.alias("content")
    )
    return conversations(spark, sf_dir).select(
        _reply_id().alias("request_id"),
        F.lit("m").alias("model"),
        F.when(turn % 2 == 0, F.concat(F.lit("Answer "), role)).otherwise(F.lit("")).alias("instructions"),
        F.when(turn % 3 != 0, F.array(item, item)).alias("input_items"),
        F.when(turn % 3 == 0, text).alias("input_text"),
        F.when(turn % 2 == 1, turn / 10).alias("temperature"),
        F.lit(None).cast("double").alias("top_p"),
        F.length(text).alias("max_output_tokens"),
    )


def _call(name: str, kind: Column) -> Column:
    arguments = F.concat(F.lit('{"n": '), F.length("text").cast("string"), F.lit("}"))
    return F.struct(
        _reply_id().alias("id"),
        kind.alias("type"),
        F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat completion per turn: a second choice without content, calls, sometimes no usage."""
    turn, n = F.col("turn"), F.length("text")
    kind = F.when(turn % 2 == 0, F.lit("function")).otherwise(F.lit("custom"))
    calls = F.array(_call("lookup", F.lit("function")), _call("count", kind))
    no_calls = F.lit(None).cast(
        "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
    )

    def choice(index: int, content: Column, tool_calls: Column) -> Column:
        message = F.struct(content.alias("content"), tool_calls.alias("tool_calls"))
        return F.struct(F.lit(index).alias("index"), message.alias("message"))

    usage = F.struct(
        (turn * 10).cast("int").alias("prompt_tokens"),
        n.alias("completion_tokens"),
        (turn * 10 + n).cast("int").alias("total_tokens"),
        F.when(turn % 2 == 0, turn.cast("int")).alias("cached_tokens"),
        F.lit(None).cast("int").alias("reasoning_tokens"),
    )
    return conversations(spark, sf_dir).select(
        _reply_id().alias("id"),
        (F.col("conv_id") + 0.5).alias("created"),
        F.lit("m").alias("model"),
        F.array(choice(0, F.col("text"), no_calls), choice(1, F.lit(None).cast("string"), calls)).alias("choices"),
        F.when(turn % 5 != 4, usage).alias("usage"),
        F.when(turn % 2 == 0, F.lit("flex")).alias("service_tier"),
    )


# Type of one raw output item of a logged response.
RAW_ITEM = (
    "struct<type:string,id:string,call_id:string,status:string,name:string,arguments:string,"
    "content:array<struct<type:string,text:string>>,summary:array<struct<text:string>>,"
    "output:array<struct<type:string,text:string,filename:string,file_url:string,image_url:string,detail:string>>,"
    "encrypted_content:string>"
)


def _item(**fields: Column) -> Column:
    names = ["type", "id", "call_id", "status", "name", "arguments", "content", "summary", "output"]
    names.append("encrypted_content")
    struct = F.struct(*[fields.get(name, F.lit(None)).alias(name) for name in names])
    return struct.cast(RAW_ITEM)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logged response per turn with every kind of output item and one unknown kind."""
    turn, text = F.col("turn"), F.col("text")

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    def picture(detail: str) -> Column:
        blank = F.lit(None).cast("string")
        return F.struct(
            F.lit("input_image").alias("type"),
            blank.alias("text"),
            blank.alias("filename"),
            blank.alias("file_url"),
            F.lit("http://example.org/i.png").alias("image_url"),
            F.lit(detail).alias("detail"),
        )

    statuses = F.array(*[F.lit(s) for s in ("completed", "in_progress", "incomplete", "queued")])
    status = F.get(statuses, (turn % 4).cast("int"))
    call_id = F.concat(F.lit("call-"), _reply_id())
    count = F.length(text).cast("string")
    items = F.array(
        _item(
            type=F.lit("reasoning"),
            id=F.lit("think"),
            content=F.array(part("reasoning_text", F.concat(F.lit("["), F.col("role"), F.lit("] ")))),
            summary=F.array(F.struct(F.lit("short").alias("text"))),
        ),
        _item(
            type=F.lit("message"),
            id=F.lit("say"),
            status=status,
            content=F.array(part("output_text", text), part("refusal", F.lit("no")), part("output_text", count)),
        ),
        _item(type=F.lit("web_search_call"), id=F.lit("web"), status=status),
        _item(
            type=F.lit("function_call"),
            id=F.lit("fn"),
            call_id=call_id,
            status=status,
            name=F.when(turn % 2 == 0, F.lit("lookup")).otherwise(F.lit("count")),
            arguments=count,
        ),
        _item(
            type=F.lit("function_call_output"),
            id=F.lit("out"),
            call_id=call_id,
            status=status,
            output=F.array(picture("original"), picture("low")),
        ),
    )
    usage = F.struct(
        turn.cast("int").alias("input_tokens"),
        F.length(text).alias("output_tokens"),
        (turn + F.length(text)).cast("int").alias("total_tokens"),
    )
    return conversations(spark, sf_dir).select(
        _reply_id().alias("id"),
        F.col("conv_id").alias("created_at"),
        F.lit("m").alias("model"),
        items.alias("output"),
        F.when(turn % 6 == 5, F.struct(F.concat(F.lit("stopped at "), count).alias("message"))).alias("error"),
        F.when(turn % 2 == 0, usage).alias("usage"),
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply settings per turn, set, unset and of unknown value."""
    turn = F.col("turn")

    def pick(*values: str | None) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (turn % len(values)).cast("int"))

    return conversations(spark, sf_dir).select(
        _reply_id().alias("id"),
        pick("completed", None, "failed").alias("status"),
        pick("text", "json_schema", "json", "grammar", None).alias("format_type"),
        pick("low", None, "loud", "high").alias("verbosity"),
        pick("minimal", "high", "none", "huge", None, "xhigh").alias("reasoning_effort"),
        pick("auto", "long", "concise").alias("reasoning_summary"),
        pick("auto", None, "disabled").alias("truncation"),
        pick(None, "flex", "").alias("service_tier"),
        F.when(turn % 2 == 0, F.lit(True)).alias("background"),
        F.when(turn % 3 == 0, turn / 4).alias("top_p"),
        F.when(turn % 2 == 0, turn / 2).alias("temperature"),
        F.when(turn % 4 == 0, turn.cast("int")).alias("top_logprobs"),
    )


def model_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part, seen as a model, is available: its suppliers in the line items, as hosts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("model"),
        F.col("l_suppkey").alias("host"),
        (F.col("l_suppkey") % 50 == 7).alias("is_primary"),
        F.col("l_suppkey").alias("priority"),
    )


def requested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a requested model with the protocols it supports."""
    key = F.col("p_partkey")
    supported = (
        F.when(key % 4 == 0, F.array(F.lit("openai_chat"), F.lit("openresponses")))
        .when(key % 4 == 1, F.array(F.lit("openai_chat")))
        .when(key % 4 == 2, F.array(F.lit("kserve_v2"), F.lit("openai_chat")))
        .otherwise(F.array(F.lit("kserve_v2")))
    )
    return table(spark, sf_dir, "part").select(key.alias("model"), supported.alias("protocols"))


def model_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("model"), "url")


def trusted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that serve more than two pages over https."""
    pages = table(spark, sf_dir, "pages").select(url_origin(F.col("url")).alias("host"))
    return pages.where(F.startswith("host", F.lit("https"))).groupBy("host").count().where("count > 2").select("host")


def request_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools of a request per turn, functions and others, and its tool choice in every form."""
    turn, count = F.col("turn"), F.length("text").cast("string")

    def tool(kind: str, name: str) -> Column:
        parameters = F.concat(F.lit('{"size": '), count, F.lit("}"))
        return F.struct(
            F.lit(kind).alias("type"),
            F.concat(F.lit(name), F.lit("_"), F.col("role")).alias("name"),
            F.lit(name).alias("description"),
            parameters.alias("parameters"),
            (turn % 2 == 0).alias("strict"),
        )

    tools = F.array(tool("web_search", "web"), tool("function", "lookup"), tool("function", "count"))
    no_tools = F.lit(None).cast("array<struct<type:string,name:string>>")
    named = F.transform(tools, lambda t: F.struct(t["type"].alias("type"), t["name"].alias("name")))

    def choice(mode: Column, kind: Column, name: Column, allowed: Column) -> Column:
        return F.struct(mode.alias("mode"), kind.alias("type"), name.alias("name"), allowed.alias("tools"))

    unset = F.lit(None).cast("string")
    made = (
        F.when(turn % 4 == 0, choice(F.lit("required"), unset, unset, no_tools))
        .when(turn % 4 == 1, choice(unset, F.lit("function"), F.lit("lookup"), no_tools))
        .when(turn % 4 == 2, choice(F.lit("auto"), F.lit("allowed_tools"), unset, named))
    )
    return conversations(spark, sf_dir).select(_reply_id().alias("id"), tools.alias("tools"), made.alias("tool_choice"))


def response_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's own metadata and what the caller adds, either of them sometimes missing."""
    turn = F.col("turn")
    own = F.create_map(F.lit("role"), F.col("role"), F.lit("from"), F.lit("reply"))
    extra = F.create_map(F.lit("from"), F.lit("caller"), F.lit("turn"), turn.cast("string"))
    return conversations(spark, sf_dir).select(
        _reply_id().alias("id"),
        F.when(turn % 3 != 1, own).alias("own"),
        F.when(turn % 2 == 0, extra).alias("extra"),
    )


def usage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply chunks, some of them with the usage so far."""
    seq = F.col("seq")
    usage = F.struct((seq + 1).alias("completion_tokens"), F.length("delta").alias("last_length"))
    return reply_chunks(spark, sf_dir).withColumn("usage", F.when(seq % 3 == 0, usage))


_stores: dict[tuple[str, str], str] = {}


def stored_root(spark: SparkSession, sf_dir: str) -> str:
    """All collections and embeddings in a partitioned store, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        root = scratch_path(spark, "store")
        catalog = collections(spark, sf_dir)
        ids = [row.id for row in catalog.select("id").collect()]
        Tables(spark, root).commit(catalog, embeddings(spark, sf_dir), ids)
        _stores[key] = root
    return _stores[key]
