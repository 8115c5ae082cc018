"""The queries of the registry as plain SQL over the same tables, for checking results."""

# Views the queries share, as common table expressions.

_UUID = r"regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def _uuid(text: str) -> str:
    return _UUID.format(text)


_HALF = (
    "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x::double * pow(2, 10 - greatest(floor(log2(abs(x::double))), -14)), 0)"
    " * pow(2, greatest(floor(log2(abs(x::double))), -14) - 10) END"
)
_HALF_VECTOR = f"list_transform({{0}}, lambda x: {_HALF})"

_COLS = """
cols AS (
  SELECT (label + 1)::bigint AS id, 'c' || label AS collection_name, 'label ' || label AS description,
         'model-' || (label % 2) AS ai_model_name, max(len(embedding))::int AS dimensions,
         CASE WHEN label % 3 = 2 THEN 'halfvec' ELSE 'vector' END AS vector_type
  FROM embeddings GROUP BY label)"""

_EMB = f"""
emb AS (
  SELECT vec_id, label, (label + 1)::bigint AS collection_id, 'c' || label AS collection_name,
         CASE WHEN label % 3 = 2 THEN 'halfvec' ELSE 'vector' END AS vector_type,
         {_uuid('vec_id::varchar')} AS embedding_id,
         CASE WHEN label % 3 = 2 THEN {_HALF_VECTOR.format('embedding')} ELSE embedding::double[] END AS v,
         embedding AS raw,
         CASE WHEN vec_id % 5 = 0 THEN '/programs/p' || (vec_id % 3)
              ELSE '/vectorstore/collections/c' || label END AS authz,
         '{{"i":' || vec_id || ',"source":"src' || (vec_id % 7) || '"}}' AS metadata
  FROM embeddings)"""

_ALLOWED = """
allowed AS (
  SELECT '/vectorstore/collections/c' || n AS authz FROM range(7) r(n) UNION ALL SELECT '/programs/p0')"""

_SEEN = "seen AS (SELECT * FROM emb WHERE authz IN (SELECT authz FROM allowed))"

_BATCH = f"""
batch AS (
  SELECT vec_id, vec_id * 2 + copy AS pos, collection_id, authz, raw,
         CASE WHEN copy = 1 AND vec_id % 2 = 0 THEN '{{"i":' || vec_id || ',"rev":1}}' ELSE metadata END AS metadata
  FROM emb, (SELECT unnest([0, 1]) AS copy))"""

_UNIQUE = """
uniq AS (
  SELECT collection_id, authz, metadata, raw, min(pos) AS first_pos, count(*) AS copies
  FROM batch GROUP BY collection_id, authz, metadata, raw)"""

_REQUESTS = f"requests AS (SELECT event_id AS pos, {_uuid('(user_id * 7)::varchar')} AS embedding_id FROM events)"

_GRANTS = """
grants AS (
  SELECT user_id,
         CASE WHEN event_id % 17 = 0 THEN '/vectorstore/collections'
              WHEN event_id % 13 = 0 THEN '/vectorstore/collections/c' || (event_id % 12) || '/x'
              WHEN event_id % 5 = 0 THEN '/programs/p' || (event_id % 3)
              ELSE '/vectorstore/collections/c' || (event_id % 12) END AS resource,
         CASE event_type WHEN 'view' THEN '*' WHEN 'error' THEN 'other' ELSE 'vectorstore' END AS service,
         ['read', 'create', 'update', 'delete', '*'][1 + (floor("value")::bigint % 5)] AS method
  FROM events),
readable AS (
  SELECT DISTINCT user_id, resource AS authz FROM grants
  WHERE service IN ('vectorstore', '*') AND method IN ('read', '*')),
readable_names AS (
  SELECT DISTINCT user_id, regexp_extract(authz, '^/vectorstore/collections/([^/]+)$', 1) AS collection_name
  FROM readable WHERE regexp_matches(authz, '^/vectorstore/collections/[^/]+$'))"""

_ENTRIES = """
entries AS (
  SELECT event_id AS request_id, 0 AS pos, 'c' || (event_id % 11) AS entry FROM events
  UNION ALL
  SELECT event_id, 1, 'C' || (user_id % 10) FROM events),
resolved AS (
  SELECT request_id, pos, entry, id AS collection_id, ai_model_name
  FROM entries LEFT JOIN cols ON collection_name = lower(entry))"""

_LOG = """
log AS (
  SELECT CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, '/' || event_type AS path,
         user_id::varchar AS user_id, "value" AS response_time_ms,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, ts
  FROM events WHERE event_type <> 'signup')"""

_CHUNKS = """
chunks AS (
  SELECT 'r-' || conv_id || '-' || turn AS response_id, seq, substring(text, seq * 16 + 1, 16) AS delta, text
  FROM (SELECT *, unnest(range(greatest(ceil(length(text) / 16.0)::bigint, 1))) AS seq FROM conversations))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_ROWS = _with(_COLS, _EMB, _ALLOWED, _SEEN)
_INGEST = _with(_COLS, _EMB, _ALLOWED, _BATCH, _UNIQUE)


def _value(metric: str, x: str, q: str) -> str:
    if metric == "l2":
        return f"list_distance({x}, {q})"
    if metric == "inner":
        return f"-list_inner_product({x}, {q})"
    if metric == "l1":
        return f"list_sum(list_transform(list_zip({x}, {q}), lambda z: abs(z[1] - z[2])))"
    if metric == "cosine_distance":
        return f"1 - list_cosine_similarity({x}, {q})"
    return f"list_cosine_similarity({x}, {q})"


_QUERY = "q AS (SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = 0)"
_HALF_QUERY = f"q AS (SELECT {_HALF_VECTOR.format('embedding')} AS q FROM embeddings WHERE vec_id = 0)"


# Metadata of an event with numbers that a parser would change.
_NUMBERS = """('{"a":[1e-400,-0.0,{"b":null,"y":1E' || event_id || '}],"n":12345678901234567890123456789012345' || event_id
       || ',"z":' || event_id || '.50}')"""


def _all_pairs(metric: str) -> str:
    order = "DESC" if metric == "cosine" else "ASC"
    return f"""{_ROWS}, pairs AS (
  SELECT q.vec_id AS query_id, embedding_id, {_value(metric, "v", "q.embedding::double[]")} AS "value"
  FROM emb, embeddings q WHERE vector_type = 'vector')
SELECT query_id, embedding_id, round("value", 6) AS "value",
       row_number() OVER (PARTITION BY query_id ORDER BY pairs."value" {order}, embedding_id)::int AS rank
FROM pairs QUALIFY rank <= 10"""


def _search(metric, where, k=10, columns="", query=_QUERY, having="true", order=None):
    order = order or ("DESC" if metric == "cosine" else "ASC")
    return f"""{_ROWS}, {query},
scored AS (SELECT seen.*, {_value(metric, 'v', 'q')} AS "value" FROM seen, q WHERE {where})
SELECT collection_id, embedding_id, {columns} round("value", 6) AS "value" FROM scored WHERE {having}
ORDER BY scored."value" {order}, embedding_id LIMIT {k}"""


def _scan(vector_type):
    return f"""{_ROWS} SELECT collection_id, embedding_id, authz, metadata, round(list_sum(v), 6) AS vector_sum
FROM emb WHERE vector_type = '{vector_type}'"""


_ACROSS = "vector_type = 'vector' AND label < 7"
_LINK = "'/vectorstore/collections/' || collection_name || '/embeddings/' || embedding_id"
_INFO = (
    """'{"collection_id":' || collection_id || ',"authz":"' || authz || '","metadata":' || metadata || ',"self":"' || """
    + _LINK
    + """ || '"}'"""
)

# float32 and float16 bit patterns, low byte first, in base64.
_SIGN = "(CASE WHEN x < 0 THEN 1 ELSE 0 END)"
_EXP = "floor(log2(abs(x)))::bigint"
_BITS32 = (
    f"(CASE WHEN x = 0 THEN 0 ELSE {_SIGN}::bigint * 2147483648 + ({_EXP} + 127) * 8388608"
    f" + ((abs(x) / pow(2, {_EXP}) - 1) * 8388608)::bigint END)"
)
_BITS16 = (
    f"(CASE WHEN x = 0 THEN 0 WHEN abs(x) < pow(2, -14) THEN {_SIGN}::bigint * 32768 + (abs(x) * pow(2, 24))::bigint"
    f" ELSE {_SIGN}::bigint * 32768 + ({_EXP} + 15) * 1024 + ((abs(x) / pow(2, {_EXP}) - 1) * 1024)::bigint END)"
)


def _hex(bits: str, width: int) -> str:
    big = f"format('{{:0{width}x}}', {bits})"
    return " || ".join(f"substr({big}, {at}, 2)" for at in range(width - 1, 0, -2))


_NORMALIZED = "CASE WHEN regexp_matches({0}, '^[a-z0-9_-]+$') THEN {0} END"

SQL: dict[str, str] = {
    "collections_scan": f"{_with(_COLS)} SELECT * FROM cols",
    "embeddings_scan": _scan("vector"),
    "embeddings_half_scan": _scan("halfvec"),
    "ingest_json_rows": f"""{_ROWS}
SELECT vec_id AS pos, collection_id, '/vectorstore/collections/c' || label AS authz, metadata,
       {_uuid('metadata')} AS metadata_hash, round(list_sum(raw::double[]), 6) AS vector_sum
FROM emb""",
    "synth_vectors": """
SELECT p_partkey AS i, 200 AS dimensions, (200 * p_partkey + 19900)::double AS vector_sum,
       '{"i":' || p_partkey || ',"name":"d200vector_' || p_partkey || '"}' AS metadata
FROM part""",
    "vectors_binary": f"""{_ROWS}
SELECT embedding_id, CASE WHEN vector_type = 'halfvec' THEN 'float16' ELSE 'float32' END AS "precision",
       to_base64(unhex(list_aggregate(CASE WHEN vector_type = 'halfvec'
         THEN list_transform(v, lambda x: {_hex(_BITS16, 4)})
         ELSE list_transform(v, lambda x: {_hex(_BITS32, 8)}) END, 'string_agg', ''))) AS vector_base64
FROM emb""",
    "embedding_documents": f"{_ROWS} SELECT embedding_id, 64 AS dimensions, {_INFO} AS info FROM emb",
    "content_manifest": """
SELECT url AS path, strlen(html) AS size, sha256(html) AS commit_id, md5(html) AS etag FROM pages""",
    "file_manifest": """
WITH files AS (
  SELECT 'a=' || page_id % 5 || '/b=' || page_id % 20 AS folder,
         string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content
  FROM pages GROUP BY page_id % 5, page_id % 20)
SELECT folder, strlen(content) AS size, sha256(content) AS commit_id, md5(content) AS etag FROM files""",
    "embedding_by_id": f"""{_ROWS}
SELECT collection_id, embedding_id, authz, metadata FROM seen WHERE vec_id = 1""",
    "embeddings_by_ids": f"""{_ROWS}, {_REQUESTS}
SELECT embedding_id, collection_id, vector_type, authz FROM seen
WHERE embedding_id IN (SELECT embedding_id FROM requests)""",
    "visible_embeddings": f"{_ROWS} SELECT embedding_id, authz FROM seen",
    "write_check_violations": f"""{_INGEST}
SELECT pos, authz FROM batch WHERE authz NOT IN (SELECT authz FROM allowed)""",
    "allowed_authz": f"{_with(_GRANTS)} SELECT user_id, authz FROM readable",
    "allowed_collections": f"{_with(_GRANTS)} SELECT user_id, collection_name FROM readable_names",
    "visible_collections": f"""{_with(_COLS, _GRANTS)}
SELECT user_id, id, collection_name FROM readable_names JOIN cols USING (collection_name)""",
    "eligible_collections": f"""{_with(_COLS)}
SELECT id, collection_name FROM cols WHERE vector_type = 'vector' AND dimensions = 64""",
    "eligible_by_model": f"""{_with(_COLS, _ENTRIES)}
SELECT request_id, min(ai_model_name) AS first_model, max(ai_model_name) AS last_model
FROM resolved WHERE collection_id IS NOT NULL GROUP BY request_id HAVING count(DISTINCT ai_model_name) > 1""",
    "dimension_violations": f"""{_INGEST}
SELECT pos, collection_id, len(raw)::int AS given, 128 AS dimensions FROM batch WHERE collection_id % 4 = 0""",
    "trusted_models": """
WITH origins AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages)
SELECT page_id AS model, url FROM origins
WHERE origin IN (SELECT origin FROM origins WHERE origin LIKE 'https%' GROUP BY origin HAVING count(*) > 2)""",
    "search_cosine": _search("cosine", "collection_id = 1"),
    "search_cosine_distance": _search("cosine_distance", "collection_id = 1"),
    "search_l2": _search("l2", "collection_id = 1"),
    "search_l1": _search("l1", "collection_id = 1"),
    "search_inner": _search("inner", "collection_id = 1"),
    "search_half": _search("l2", "collection_id = 3", 20, query=_HALF_QUERY),
    "search_range": _search("inner", "collection_id = 1", 1000, having='scored."value" BETWEEN -0.2 AND 0.1'),
    "search_filtered": _search("cosine", "collection_id = 1 AND metadata ->> '$.source' = 'src3'"),
    "search_across": _search("cosine", _ACROSS, columns="collection_name,"),
    "search_across_filtered": _search(
        "l2",
        "vector_type = 'halfvec' AND label < 7 AND metadata ->> '$.source' = 'src5'",
        columns="collection_name,",
        query=_HALF_QUERY,
    ),
    "stored_search_filtered": _search("cosine", "collection_id = 1 AND metadata ->> '$.source' = 'src3'"),
    "stored_search_all_filtered": _search(
        "l2",
        "vector_type = 'halfvec' AND label < 7 AND metadata ->> '$.source' = 'src5'",
        columns="collection_name,",
        query=_HALF_QUERY,
    ),
    "search_hit_collections": f"""
SELECT DISTINCT collection_id AS id, collection_name, '/vectorstore/collections/' || collection_name AS self
FROM ({_search("cosine", _ACROSS, columns="collection_name,")})""",
    "search_documents": f"""{_ROWS}, {_QUERY},
scored AS (SELECT seen.*, {_value("cosine", 'v', 'q')} AS "value" FROM seen, q WHERE {_ACROSS})
SELECT embedding_id AS id, 'cosine_similarity' AS distance_metric, round("value", 6) AS "value", 64 AS dimensions,
       {_INFO} AS info
FROM scored ORDER BY scored."value" DESC, embedding_id LIMIT 10""",
    "knn_batch_cosine": _all_pairs("cosine"),
    "knn_batch_threshold": f"""{_ROWS}, qs AS (
  SELECT vec_id AS query_id, {_HALF_VECTOR.format('embedding')} AS q FROM embeddings),
pairs AS (SELECT query_id, embedding_id, {_value("cosine", "v", "q")} AS "value" FROM emb, qs
  WHERE vector_type = 'halfvec')
SELECT query_id, embedding_id, round("value", 6) AS "value",
       row_number() OVER (PARTITION BY query_id ORDER BY pairs."value" DESC, embedding_id)::int AS rank
FROM pairs WHERE pairs."value" >= 0.5 QUALIFY rank <= 4""",
    "knn_pruned_cosine": _all_pairs("cosine"),
    "knn_pruned_l2": _all_pairs("l2"),
    "knn_pruned_inner": _all_pairs("inner"),
    "search_index_exact": _search("l2", "collection_id = 1"),
    "search_index_probes": f"""{_ROWS}, {_QUERY},
mids AS (SELECT vec_id AS cell, embedding::double[] AS m FROM embeddings WHERE vec_id < 8),
placed AS (SELECT seen.*, cell FROM seen, mids WHERE collection_id = 1
  QUALIFY row_number() OVER (PARTITION BY embedding_id ORDER BY list_distance(v, m), cell) = 1),
probed AS (SELECT cell FROM mids, q ORDER BY list_distance(m, q), cell LIMIT 2)
SELECT collection_id, embedding_id, round(list_distance(v, q), 6) AS "value" FROM placed JOIN probed USING (cell), q
ORDER BY list_distance(v, q), embedding_id LIMIT 10""",
    "search_codes_all": _search("l2", "vector_type = 'vector'"),
    "search_codes_exact": _search("l2", "vector_type = 'vector'"),
    "search_ivf": _search("l2", "vector_type = 'vector'"),
    "search_ivf_all_probes": _search("l2", "vector_type = 'vector'"),
    "half_round_vectors": f"""
WITH h AS (SELECT vec_id, embedding::double[] AS e, {_HALF_VECTOR.format('embedding')} AS half FROM embeddings),
d AS (SELECT *, list_transform(list_zip(e, half), lambda z: abs(z[1] - z[2])) AS diff FROM h)
SELECT vec_id, round(list_sum(half), 9) AS half_sum, len(list_filter(diff, lambda x: x > 0))::int AS changed,
       round(list_max(diff), 9) AS largest_change
FROM d""",
    "bulk_read_ordered": f"""{_ROWS}, {_REQUESTS}
SELECT pos AS input_index, embedding_id, collection_id, authz FROM requests JOIN seen USING (embedding_id)
WHERE collection_id = 1""",
    "bulk_read_any": f"""{_ROWS}, {_REQUESTS}
SELECT pos AS input_index, embedding_id, collection_name,
       CASE WHEN vector_type = 'halfvec' THEN 'float16' ELSE 'float32' END AS "precision"
FROM requests JOIN seen USING (embedding_id) WHERE label < 7""",
    "resolve_names": f"{_with(_COLS, _ENTRIES)} SELECT request_id, pos, entry, collection_id::varchar AS collection_id FROM resolved",
    "rejected_requests": f"""{_with(_COLS, _ENTRIES)}
SELECT DISTINCT request_id FROM resolved WHERE collection_id IS NULL""",
    "page_collections": f"""{_with(_COLS)}
SELECT id, collection_name, 2 AS page, CASE WHEN count(*) OVER () = 3 THEN 3 END AS next_page, 1 AS prev_page
FROM (SELECT * FROM cols WHERE id <= 7 ORDER BY collection_name LIMIT 3 OFFSET 3)""",
    "page_embeddings": f"""{_ROWS}
SELECT embedding_id, 2 AS page, CASE WHEN count(*) OVER () = 10 THEN 3 END AS next_page, 1 AS prev_page
FROM (SELECT * FROM seen WHERE collection_id = 1 ORDER BY embedding_id LIMIT 10 OFFSET 10)""",
    "page_embeddings_after": f"""{_ROWS}
SELECT embedding_id, authz FROM seen
WHERE collection_id = 1 AND embedding_id > (SELECT embedding_id FROM emb WHERE vec_id = 0)
ORDER BY embedding_id LIMIT 10""",
    "stored_search": _search("cosine", "collection_id = 4", columns="authz, metadata,"),
    "stored_search_all": _search(
        "l1", "collection_id IN (3, 6)", columns="collection_name,", query=_HALF_QUERY
    ),
    "stored_bulk_read": f"""{_ROWS}, {_REQUESTS}
SELECT pos AS input_index, embedding_id, 'float16' AS "precision", 172 AS encoded_length
FROM requests JOIN seen USING (embedding_id) WHERE collection_id = 6""",
    "stored_read_any": f"""{_ROWS}, {_REQUESTS}
SELECT pos AS input_index, embedding_id, CASE WHEN vector_type = 'halfvec' THEN 'float16' ELSE 'float32' END AS "precision",
       (((CASE WHEN vector_type = 'halfvec' THEN 2 ELSE 4 END) * len(v) + 2) // 3 * 4)::int AS encoded_length, authz
FROM requests JOIN seen USING (embedding_id) WHERE label < 7""",
    "stored_read_collections": f"""{_ROWS}, {_REQUESTS}
SELECT DISTINCT collection_id AS id, collection_name FROM requests JOIN seen USING (embedding_id) WHERE label < 7""",
    "stored_page": f"""{_ROWS}
SELECT embedding_id, 2 AS page, CASE WHEN count(*) OVER () = 10 THEN 3 END AS next_page, 1 AS prev_page
FROM (SELECT * FROM seen WHERE collection_id = 1 ORDER BY embedding_id LIMIT 10 OFFSET 10)""",
    "stored_counts": f"""{_ROWS}
SELECT id, cols.collection_name, count(seen.vec_id) AS available_embeddings_count
FROM cols LEFT JOIN seen ON collection_id = id WHERE id <= 7 GROUP BY id, cols.collection_name""",
    "count_visible": f"{_ROWS} SELECT count(*) AS available_embeddings_count FROM seen WHERE collection_id = 1",
    "collections_with_counts": f"""{_ROWS}
SELECT id, cols.collection_name, count(seen.vec_id) AS available_embeddings_count
FROM cols LEFT JOIN seen ON collection_id = id WHERE id <= 7 GROUP BY id, cols.collection_name""",
    "requests_by_status": f"{_with(_LOG)} SELECT status_code, count(*) AS requests FROM log GROUP BY status_code",
    "request_counter": f"""{_with(_LOG)}
SELECT method, path, user_id, response_time_ms, status_code, count(*) AS requests FROM log GROUP BY ALL""",
    "create_collections": f"""{_with(_COLS)}, wanted AS (
  SELECT doc_id AS pos, CASE WHEN lang <> 'de' THEN lower(source) || '_' || lang END AS collection_name
  FROM documents),
permitted AS (SELECT DISTINCT source || '_en' AS name FROM documents),
taken AS (SELECT 'src' || id || '_en' AS name FROM cols),
firsts AS (SELECT collection_name, min(pos) AS first_pos FROM wanted GROUP BY collection_name)
SELECT pos, w.collection_name,
       CASE WHEN w.collection_name IS NULL THEN 'invalid'
            WHEN w.collection_name NOT IN (SELECT name FROM permitted) THEN 'forbidden'
            WHEN w.collection_name IN (SELECT name FROM taken) OR pos <> first_pos THEN 'conflict'
            ELSE 'created' END AS outcome
FROM wanted w LEFT JOIN firsts f ON w.collection_name = f.collection_name""",
    "update_collections": f"""{_with(_COLS)}
SELECT id, collection_name,
       CASE WHEN id % 2 = 0 AND id <= 7 THEN 'new ' || description ELSE description END AS description,
       CASE WHEN id % 2 = 0 AND id <= 7 THEN '2024-02-02' ELSE '2024-01-01' END AS updated
FROM cols""",
    "delete_collection": f"""{_ROWS}
SELECT collection_id, count(*) AS rows_left FROM emb WHERE collection_id <> 3 GROUP BY collection_id""",
    "batch_dedup": f"{_INGEST} SELECT first_pos, copies, collection_id, authz, metadata FROM uniq",
    "batch_fanout": f"""{_INGEST}
SELECT pos, first_pos, copies FROM batch JOIN uniq USING (collection_id, authz, metadata, raw)""",
    "insert_conflicts": f"""{_INGEST}
SELECT first_pos, u.collection_id FROM uniq u
WHERE EXISTS (SELECT 1 FROM emb e WHERE e.collection_id = u.collection_id AND e.raw = u.raw
              AND e.metadata = u.metadata AND e.authz = u.authz)""",
    "insert_result": f"""{_INGEST}
SELECT pos, collection_id, authz, '{{"i":"' || vec_id || '","rev":2}}' AS stored_metadata, 36 AS id_length,
       count(*) OVER (PARTITION BY collection_id, authz, raw, vec_id) AS positions
FROM batch""",
    "upsert_result": f"""{_INGEST}
SELECT pos, first_pos, embedding_id AS stored_id,
       CASE WHEN embedding_id IS NULL THEN 'inserted' ELSE 'touched' END AS action
FROM batch JOIN uniq USING (collection_id, authz, metadata, raw)
LEFT JOIN emb USING (collection_id, authz, metadata, raw)""",
    "upsert_state": f"""{_INGEST}
SELECT collection_id, authz, metadata, round(list_sum(v), 6) AS vector_sum, '2024-01-01' AS created,
       '2024-02-02' AS updated
FROM emb
UNION ALL
SELECT u.collection_id, u.authz, u.metadata, round(list_sum(e.v), 6), '2024-02-02', '2024-02-02'
FROM uniq u JOIN emb e ON e.vec_id = u.first_pos // 2 WHERE u.metadata LIKE '%rev%'""",
    "update_by_id": f"""{_ROWS}
SELECT embedding_id,
       CASE WHEN visible AND vec_id % 7 = 0 THEN '/programs/p0' ELSE authz END AS authz,
       CASE WHEN visible AND vec_id % 4 < 2 THEN '{{"copy":1,"i":' || vec_id || '}}' ELSE metadata END AS metadata,
       visible AND (vec_id % 3 = 0 OR vec_id % 4 < 2 OR vec_id % 7 = 0) AS changed,
       round(list_sum(list_transform(list_zip(
         CASE WHEN visible AND vec_id % 3 = 0 THEN list_reverse(v) ELSE v END, range(1, 65)),
         lambda z: z[1] * z[2])), 6) AS vector_checksum
FROM (SELECT *, authz IN (SELECT authz FROM allowed) AS visible FROM emb)""",
    "metadata_numbers": f"SELECT event_id, {_NUMBERS} AS canonical FROM events",
    "json_batch_numbers": f"""
SELECT event_id, pos, CASE WHEN pos <> 1 THEN 1 END::bigint AS collection_id, CASE WHEN pos <> 1 THEN 'a "metadata": 1.10,' END AS authz,
       CASE WHEN pos <> 1 THEN 1.5 ELSE 0 END::double AS first, CASE WHEN pos <> 1 THEN {_NUMBERS} END AS metadata
FROM events, range(3) t(pos)""",
    "document_numbers": f"""
SELECT event_id::varchar AS embedding_id,
       '{{"vector":[1.5],"embedding_id":"' || event_id || '","info":{{"collection_id":1,"authz":"/p \\"x\\"","metadata":' || {_NUMBERS}
       || ',"self":"/vectorstore/collections/c/embeddings/' || event_id || '"}}}}' AS document
FROM events""",
    "batch_problems": f"""{_INGEST}
SELECT pos, ['embedding has a value that cannot be stored', 'embedding has a value that cannot be stored',
             'metadata is not a JSON object', NULL][1 + pos % 4] AS problem
FROM batch""",
    "put_mixed": f"""{_INGEST}, marked AS (SELECT *, pos % 6 = 1 AS named FROM batch),
state AS (
  SELECT embedding_id, e.collection_id, e.authz, e.raw,
         CASE WHEN n.vec_id IS NULL THEN e.metadata ELSE '{{"i":' || e.vec_id || ',"rev":3}}' END AS metadata
  FROM emb e LEFT JOIN (SELECT DISTINCT vec_id FROM marked WHERE named) n USING (vec_id))
SELECT pos AS input_index, 'updated' AS action, {_uuid('vec_id::varchar')} AS known_id FROM marked WHERE named
UNION ALL
SELECT pos, CASE WHEN s.embedding_id IS NULL THEN 'inserted' ELSE 'touched' END, s.embedding_id
FROM marked LEFT JOIN state s USING (collection_id, authz, metadata, raw) WHERE NOT named""",
    "put_mixed_state": f"""{_INGEST}, marked AS (SELECT *, pos % 6 = 1 AS named FROM batch),
named_ids AS (SELECT DISTINCT vec_id FROM marked WHERE named),
state AS (
  SELECT e.vec_id, e.collection_id, e.authz, e.raw, e.v, n.vec_id IS NOT NULL AS updated,
         CASE WHEN n.vec_id IS NULL THEN e.metadata ELSE '{{"i":' || e.vec_id || ',"rev":3}}' END AS metadata
  FROM emb e LEFT JOIN named_ids n USING (vec_id)),
others AS (SELECT collection_id, authz, metadata, raw, min(vec_id) AS vec_id FROM marked WHERE NOT named GROUP BY ALL)
SELECT s.collection_id, s.authz, s.metadata, round(list_sum(s.v), 6) AS vector_sum, '2024-01-01' AS created,
       CASE WHEN s.updated OR o.vec_id IS NOT NULL THEN '2024-02-02' ELSE '2024-01-01' END AS updated
FROM state s LEFT JOIN others o USING (collection_id, authz, metadata, raw)
UNION ALL
SELECT o.collection_id, o.authz, o.metadata, round(list_sum(e.v), 6), '2024-02-02', '2024-02-02'
FROM others o JOIN emb e ON e.vec_id = o.vec_id
WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.collection_id = o.collection_id AND s.raw = o.raw AND s.metadata = o.metadata AND s.authz = o.authz)""",
    "delete_by_ids": f"""{_ROWS}, {_REQUESTS}
SELECT embedding_id, collection_id FROM emb
WHERE NOT (authz IN (SELECT authz FROM allowed) AND embedding_id IN (SELECT embedding_id FROM requests))""",
    "hash_uuid_texts": f"SELECT doc_id, {_uuid('text')} AS text_hash FROM documents",
    "metadata_values": """
SELECT event_id, props ->> '$.k' AS k, props ->> '$.missing' AS missing, replace(props, ' ', '') AS canonical
FROM events""",
    "normalize_names": f"""
SELECT key, {_NORMALIZED.format('name')} AS collection_name FROM (
  SELECT 'd' || doc_id AS key, lower(source) || '-' || lang AS name FROM documents
  UNION ALL SELECT 'p' || page_id, lower(url) FROM pages)""",
    "normalize_authz_paths": """
SELECT event_id, CASE event_type WHEN 'click' THEN '/programs/' || user_id WHEN 'error' THEN 'programs/' || user_id END
       AS authz, event_type <> 'error' AS valid
FROM events""",
    "self_links": f"""{_ROWS}
SELECT embedding_id, CASE WHEN collection_id % 2 = 1 THEN {_LINK} ELSE '/embeddings/' || embedding_id END AS self
FROM emb""",
    "chat_requests": """
SELECT 'r-' || conv_id || '-' || turn AS request_id, 'm' AS model,
       CASE WHEN turn % 2 = 1 THEN turn / 10 END::double AS temperature, NULL::double AS top_p,
       length(text)::int AS max_tokens,
       CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END AS message_count,
       CASE WHEN turn % 2 = 0 THEN 'system: Answer ' || role || chr(10) ELSE '' END
       || CASE WHEN turn % 3 = 0 THEN 'user: ' || text
               WHEN turn % 4 = 3 THEN 'user: ' || text || chr(10) || 'user: ' || text
               ELSE role || ': ' || text || chr(10) || role || ': ' || text END AS messages
FROM conversations""",
    "assemble_conversations": """
SELECT conv_id, count(*)::int AS message_count,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id""",
    "normalize_completions": """
SELECT 'r-' || conv_id || '-' || turn AS id, conv_id AS created_at, 'completed' AS status,
       CASE WHEN turn % 2 = 0 THEN 'flex' ELSE 'default' END AS service_tier, -1 AS top_p,
       choice::varchar AS item_id, CASE WHEN choice = 0 THEN text ELSE '' END AS text,
       CASE WHEN turn % 2 = 0 THEN 'lookup,count' ELSE 'lookup' END AS tools,
       CASE WHEN turn % 5 <> 4 THEN turn * 10 END::double AS input_tokens,
       CASE WHEN turn % 5 <> 4 THEN length(text) END::double AS output_tokens,
       CASE WHEN turn % 5 <> 4 THEN CASE WHEN turn % 2 = 0 THEN turn ELSE -1 END END::double AS cached_tokens,
       CASE WHEN turn % 5 <> 4 THEN -1 END::double AS reasoning_tokens
FROM conversations, (SELECT unnest([0, 1]) AS choice)""",
    "normalize_outputs": """
WITH t AS (
  SELECT *, 'r-' || conv_id || '-' || turn AS id,
         ['completed', 'in_progress', 'incomplete', 'incomplete'][1 + turn % 4] AS st FROM conversations)
SELECT id, 0 AS pos, 'reasoning' AS type, 'think' AS item_id, NULL AS call_id, NULL AS status, NULL AS name,
       NULL AS arguments, '[' || role || '] ' AS texts, 'short' AS summary, NULL AS details FROM t
UNION ALL SELECT id, 1, 'message', 'say', NULL, st, NULL, NULL, text || '|' || length(text), NULL, NULL FROM t
UNION ALL SELECT id, 2, 'function_call', 'call-' || id, 'call-' || id, st,
       CASE WHEN turn % 2 = 0 THEN 'lookup' ELSE 'count' END, length(text)::varchar, NULL, NULL, NULL FROM t
UNION ALL SELECT id, 3, 'function_call_output', 'call-' || id, 'call-' || id, st, NULL, NULL, NULL, NULL,
       'auto|low' FROM t""",
    "responses_to_chat": """
WITH t AS (
  SELECT *, 'r-' || conv_id || '-' || turn AS id, turn % 6 = 5 AS failed FROM conversations)
SELECT id, conv_id AS created, CASE WHEN failed THEN 'error' ELSE 'stop' END AS finish_reason,
       CASE WHEN failed THEN 'Error: stopped at ' || length(text)
            ELSE '[' || role || '] ' || text || length(text) END AS content,
       CASE WHEN NOT failed THEN CASE WHEN turn % 2 = 0 THEN 'lookup' ELSE 'count' END END AS function_name,
       CASE WHEN NOT failed THEN length(text)::varchar END AS function_arguments,
       CASE WHEN NOT failed THEN 'call-' || id END AS tool_call_id,
       CASE WHEN turn % 2 = 0 THEN turn END::double AS prompt_tokens,
       CASE WHEN turn % 2 = 0 THEN turn + length(text) END::double AS total_tokens
FROM t""",
    "tool_calls": """
SELECT 'r-' || conv_id || '-' || turn AS id, pos, 'r-' || conv_id || '-' || turn AS call_id,
       CASE WHEN pos = 0 THEN 'lookup' ELSE 'count' END AS name, '{"n": ' || length(text) || '}' AS arguments
FROM conversations, (SELECT unnest([0, 1]) AS pos) WHERE pos = 0 OR turn % 2 = 0""",
    "request_tools": """
SELECT 'r-' || conv_id || '-' || turn AS id, 'lookup_' || role || ',count_' || role AS names,
       '{"size": ' || length(text) || '}' AS parameters, turn % 2 = 0 AS strict,
       CASE WHEN turn % 4 = 0 THEN 'required' END AS mode,
       CASE turn % 4 WHEN 1 THEN 'lookup' WHEN 2 THEN 'lookup_' || role END AS chosen,
       CASE WHEN turn % 4 = 2 THEN 'lookup_' || role || ',count_' || role END AS allowed
FROM conversations""",
    "response_metadata": """
SELECT 'r-' || conv_id || '-' || turn AS id,
       CASE WHEN turn % 3 <> 1 THEN 2 ELSE 0 END
       + CASE WHEN turn % 2 = 0 THEN CASE WHEN turn % 3 <> 1 THEN 1 ELSE 2 END ELSE 0 END AS entries,
       CASE WHEN turn % 3 <> 1 THEN role END AS role_entry,
       CASE WHEN turn % 2 = 0 THEN 'caller' WHEN turn % 3 <> 1 THEN 'reply' END AS from_entry,
       CASE WHEN turn % 2 = 0 THEN turn::varchar END AS turn_entry
FROM conversations""",
    "stream_usage": f"""{_with(_CHUNKS)}
SELECT response_id, seq + 1 AS completion_tokens, length(delta)::int AS last_length FROM chunks
WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY seq DESC) = 1""",
    "normalize_settings": """
SELECT 'r-' || conv_id || '-' || turn AS id,
       ['completed', 'unknown', 'failed'][1 + turn % 3] AS status,
       ['text', 'json_schema', 'json_object', 'text', 'text'][1 + turn % 5] AS format_type,
       ['low', 'medium', 'medium', 'high'][1 + turn % 4] AS verbosity,
       ['low', 'high', 'none', NULL, NULL, 'xhigh'][1 + turn % 6] AS reasoning_effort,
       ['auto', NULL, 'concise'][1 + turn % 3] AS reasoning_summary,
       ['auto', 'disabled', 'disabled'][1 + turn % 3] AS truncation,
       ['default', 'flex', 'default'][1 + turn % 3] AS service_tier,
       turn % 2 = 0 AS background,
       CASE WHEN turn % 3 = 0 THEN turn / 4 ELSE -1 END::double AS top_p,
       CASE WHEN turn % 2 = 0 THEN turn / 2 ELSE -1 END::double AS temperature,
       CASE WHEN turn % 4 = 0 THEN turn ELSE -1 END::int AS top_logprobs
FROM conversations""",
    "assemble_deltas": f"""{_with(_CHUNKS)}
SELECT response_id, count(*)::int AS chunks, string_agg(delta, '' ORDER BY seq) AS text
FROM chunks GROUP BY response_id""",
    "stream_events": f"""{_with(_CHUNKS)}, done AS (
  SELECT response_id, count(*) AS n, any_value(text) AS text FROM chunks GROUP BY response_id)
SELECT response_id, 0::bigint AS sequence_number, 'response.output_item.added' AS type, NULL AS text
FROM done
UNION ALL SELECT response_id, 1, 'response.content_part.added', NULL FROM done
UNION ALL SELECT response_id, seq + 2, 'response.output_text.delta', delta FROM chunks
UNION ALL SELECT response_id, n + 2, 'response.output_text.done', text FROM done
UNION ALL SELECT response_id, n + 3, 'response.output_item.done', NULL FROM done""",
    "number_chunks": f"{_with(_CHUNKS)} SELECT response_id, seq, delta FROM chunks",
    "resolve_models": """
WITH best AS (
  SELECT l_partkey AS model,
         coalesce(min(l_suppkey) FILTER (l_suppkey % 50 = 7), min(l_suppkey)) AS host
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey)
SELECT p_partkey AS model, host,
       ['openresponses', 'openai_chat', 'openai_chat', NULL][1 + p_partkey % 4] AS protocol
FROM part LEFT JOIN best ON model = p_partkey""",
    "stream_put": f"""{_INGEST}
SELECT u.collection_id, u.authz, u.metadata, round(list_sum(e.v), 6) AS vector_sum
FROM uniq u JOIN emb e ON e.vec_id = u.first_pos // 2""",
    "stream_deltas": """
SELECT 'r-' || conv_id || '-' || turn AS response_id, text FROM conversations""",
    "stream_replies": """
SELECT 'r-' || conv_id || '-' || turn AS response_id, (1 + turn % 2)::int AS round, coalesce(text, '') AS text
FROM conversations""",
    "stream_requests_by_minute": f"""{_with(_LOG)}, minutes AS (
  SELECT date_trunc('minute', ts) AS minute_start, status_code FROM log)
SELECT minute_start, status_code, count(*) AS requests FROM minutes
GROUP BY minute_start, status_code""",
}
