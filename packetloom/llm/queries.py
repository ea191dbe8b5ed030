"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.registry import query, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query(
    "op9_kd_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op9_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.kd_search import top_products

    return top_products(table(spark, sf_dir, "embeddings"), queries_every=50, k=5)


@query("op6_warc_round_trip")
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_simhash_groups")
def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op8_chunk_bpe")
def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.chunk_bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), width=100)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query("op4_templates")
def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.templates import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.surrogates import replace_private

    docs = replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), key="a key of the deployment")
    kinds = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e.kind)))
    return docs.select("doc_id", F.size("entities").alias("n_entities"), kinds.alias("kinds"), "text", "entities")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op3_passages")
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.passages import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


@query(
    "op13_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.exact_dedup import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op12_target_resampling")
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.target_resampling import importance_sample

    drawn = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op11_source_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    ),
    w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
    l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
    g AS (
        SELECT s.lang, s.source, coalesce(l.v, 0)::HUGEINT AS v, coalesce(l.n, 0)::HUGEINT AS lang_n, coalesce(x.n, 0)::HUGEINT AS n
        FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) x USING (lang, source)
    ),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p,
            1 + (1000000000::HUGEINT * (k.total + 1)) // (g.lang_n + g.v) AS q
        FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    both_parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
    ),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
    )
    SELECT * FROM r WHERE part = 'pair' OR rank <= 200
    """,
)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.llm.source_audit import divergence_audit

    return divergence_audit(table(spark, sf_dir, "documents"))
