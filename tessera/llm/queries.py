"""The queries of this subpackage, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, exact_dedup, mixing, ngram_join, packing, repeat_index, token_counts, token_store, toxicity, vector_join
from tessera.llm._shared import new_path
from tessera.tables import table

#: op8: slots of each source in a period; all other sources share one.
WEIGHTS = {"src0": 10, **{f"src{i}": 3 for i in range(1, 20)}}


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; imported late, as only the operators with a vocabulary need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(said.unionByName(extra)))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_index.repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path, end_id=0)
    return token_store.read_documents(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_near_vectors": op4_near_vectors,
    "op5_repeats": op5_repeats,
    "op6_token_store": op6_token_store,
    "op7_toxicity": op7_toxicity,
    "op8_mix": op8_mix,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
}

#: Components of links (u, v) by least ids; {nodes} has all ids.
_COMPONENTS = """b AS MATERIALIZED (SELECT u AS x, v AS y FROM links UNION SELECT v, u FROM links),
             c(node, component) USING KEY (node) AS (SELECT id, id FROM {nodes} UNION SELECT b.x, min(n.component) FROM c AS n JOIN b ON b.y = n.node JOIN recurring.c AS own ON own.node = b.x WHERE n.component < own.component GROUP BY b.x)"""

SQL = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
             n AS MATERIALIZED (SELECT w.id, count(g) AS n FROM w LEFT JOIN s ON s.id = w.id GROUP BY w.id),
             p AS (SELECT a.id AS u, b.id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
             links AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 100 * common >= 90 * (x.n + y.n - common)),
             """
    + _COMPONENTS.format(nodes="n")
    + """
        SELECT id AS doc_id, n AS n_shingles, component AS component_id FROM n JOIN c ON c.node = n.id""",
    "op4_near_vectors": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
             g AS MATERIALIZED (SELECT id, label, v FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
             links AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM g a JOIN g b ON a.label = b.label AND a.id < b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
             """
    + _COMPONENTS.format(nodes="e")
    + """
        SELECT id AS vec_id, (SELECT count(*) FROM b WHERE x = id) AS n_links, component AS component_id, id = component AS kept FROM e JOIN c ON c.node = e.id""",
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "op3_chat_format": r"""
        WITH raw AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (
            SELECT *, row_number() OVER w AS i,
                   length('<|turn|>') + length(role) + 1 + length(text) + length('</s>')
                   + 2 * length(role || text) - length(replace(replace(replace(role || text, '~', ''), '<', ''), '[', ''))
                   - length(role || text) AS len,
                   length('<|turn|>') + 2 * length(role) - length(replace(replace(replace(role, '~', ''), '<', ''), '[', '')) + 1 AS head
            FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        s AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY conv_id) AS top FROM n)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END)
                + sum(CASE WHEN i = top AND role <> 'assistant' THEN upto ELSE 0 END))::BIGINT AS formatted_chars,
               count(*) FILTER (role = 'assistant') + count(*) FILTER (i = top AND role <> 'assistant') AS n_examples
        FROM s GROUP BY conv_id""",
}
