"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import audio, centroids, exact_dedup, fim, fingerprints, html_crf, langid, minhash, mixing, packing, sharding, suffix_dedup, warc
from reelmill.llm.common import documents, stored


def vocabulary() -> tuple[str, str]:
    """The rank file and split pattern of the public 50k byte-level BPE; the ids are those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(audio.store_media(documents(spark, sf_dir)), "media")
    return audio.read_features(stored(audio.store_features(media), "features", compression="zstd"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(documents(spark, sf_dir)).drop("kept", "spans")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = warc.derivatives(warc.page_responses(pages), "key")
    return made.withColumnRenamed("key", "page_id").withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), *vocabulary())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.train(docs.filter(~held_out))
    found = langid.predict(docs, model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("h")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_crf.extract(pages, html_crf.train(pages))


def op10_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.follow(documents(spark, sf_dir))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir), seed=7)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_prob_minhash, op2_exact_dedup, op3_audio_features, op4_suffix_dedup, op5_warc_derivatives, op6_best_fit_packing, op7_language_id, op8_temperature_mix, op9_html_main_text, op10_lpt_sharding, op11_document_fingerprints, op12_fill_in_middle, op13_pivot_clusters)
}

def cluster_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """Lloyd's rounds written out one after the other; every vector is measured against every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (
          SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
          WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
        v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, q FROM kept),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), q) - 1 AS c, q FROM kept
          ORDER BY c LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
          SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
            SELECT r, c, CAST(list_sum([(v.q[j] - m.q[j]) * (v.q[j] - m.q[j]) FOR j IN range(1, {dims + 1})]) AS BIGINT) AS d FROM v, c{i} m) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""u{i} AS MATERIALIZED (
          SELECT c, j, sum(q[j]) AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, {dims + 1})) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j),
        c{i + 1} AS MATERIALIZED (
          SELECT c, coalesce((SELECT list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) FROM u{i} WHERE u{i}.c = c{i}.c), q) AS q FROM c{i})""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} m USING (c)"""


ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS cps, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        g AS (
          SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cps DESC, doc_id NULLS LAST) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, keep_id IS NOT DISTINCT FROM doc_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op12_fill_in_middle": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                 sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
        d AS (
          SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                 CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
        f AS (
          SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                 least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
        p AS (
          SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p
    """,
    "op13_pivot_clusters": cluster_sql(),
}
