"""The queries of the operators, each over its whole tables, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.llm import centroids, decontamination, fingerprints, hard_negatives, language, mixing, ngram_join, personal_data, quality_rules, repeats, sharding, token_counts, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.keyed_places(documents(spark, sf_dir), shards=8, seed=1)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), copy="copy").select("doc_id", "source", "lang", "copy", F.octet_length("text").cast("long").alias("n_bytes"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = ngram_join.near_duplicates(documents(spark, sf_dir), width=4, percent=85)
    return classes.select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of over 50 words can be shorter than 400 bytes; the last two columns report all of them.
    removed = repeats.without_repeats(documents(spark, sf_dir), length=400, passage_words=51)
    return removed.withColumns({"has_repeat": F.col("n_removed") > 0, "shares_passage": F.col("n_shared_words") > 0})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary, limit=512)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summarised(*centroids.clustered(embeddings(spark, sf_dir)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir).select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_personal_data": op8_personal_data,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_fingerprints": op11_fingerprints,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op2_mixing": r"""
        WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
        ), weights AS (SELECT source, size, pow(size, 0.7) AS weight FROM sizes
        ), rates AS (
            SELECT source, rate, greatest(ceil(rate / 24.0), 1)::BIGINT AS draws FROM (
                SELECT source, round(weight * (SELECT sum(size) FROM weights) / ((SELECT sum(weight) FROM weights) * size), 9) AS rate FROM weights)
        ), terms AS (
            SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto
            FROM (SELECT source, k, exp(-(rate / draws) + CASE WHEN k > 0 THEN k * ln(rate / draws) ELSE 0 END - lgamma(k + 1)) AS p FROM rates, range(0, 65) t(k))
        ), drawn AS (
            SELECT rowid AS row, doc_id, source, lang, text, ('0x' || substr(md5(CASE WHEN draws = 1 THEN 'copies 1' ELSE 'copies 1 draw' || chr(1) || draw END
                || chr(1) || coalesce(doc_id::VARCHAR, chr(0)) || chr(1) || coalesce(source, chr(0))), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM (SELECT d.*, r.draws, unnest(range(1, r.draws + 1)) AS draw FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source)
        ), counted AS (
            SELECT doc_id, source, lang, text, sum(n)::BIGINT AS copies FROM (
                SELECT d.*, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.upto <= d.u) AS n FROM drawn d)
            GROUP BY row, doc_id, source, lang, text
        )
        SELECT doc_id, source, lang, unnest(range(1, copies + 1))::INTEGER AS copy, strlen(text)::BIGINT AS n_bytes FROM counted WHERE copies > 0
    """,
    "op10_decontamination": r"""
        WITH spelled AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), items AS (
            SELECT item_id, words, len(words) AS n, least(13, len(words)) AS width FROM (
                SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
            WHERE len(words) > 0
        ), item_windows AS (
            SELECT item_id, width, array_to_string(words[start:start + width - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, n - width + 2)) AS start FROM items)
        ), doc_windows AS (
            SELECT doc_id, width, start, array_to_string(words[start:start + width - 1], ' ') AS phrase FROM (
                SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS start
                FROM spelled, (SELECT DISTINCT width FROM items) WHERE len(words) >= width)
        ), hits AS (SELECT doc_id, start, item_id, width FROM doc_windows JOIN item_windows USING (width, phrase)
        ), positions AS (SELECT DISTINCT doc_id, unnest(range(start, start + width)) AS position FROM hits
        ), counted AS (SELECT doc_id, count(*) AS n_hit FROM positions GROUP BY doc_id
        ), named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
        SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
            coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
        FROM spelled LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op12_centroid_clustering": centroids.sql(),
    "op13_hard_negatives": hard_negatives.SQL,
}
