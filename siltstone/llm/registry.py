"""The queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from siltstone.llm import impact_search, kneser_ney, mixing, near_dup, packing, suffix_dedup, token_store, toxicity, url_filter, vector_tree
from siltstone.llm.shared import new_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def crc_rest(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learns only from the labels that aren't held out."""
    return toxicity.fit(*toxicity.training_rows(docs, labels.where(crc_rest(5) != 0), "doc_id", "text", "toxic"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_rest(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path)
    return token_store.document_digests(spark, path)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("row")


def op7_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = kneser_ney.score_texts(table(spark, sf_dir, "documents"), crc_rest(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_weights(labels: DataFrame) -> DataFrame | None:
    """doc_id and weight of the documents whose quality is known: good ones are four times as likely as bad ones to be drawn next.

    None where the labels don't tell the quality: all documents weigh the same.
    """
    if "quality" not in labels.columns:
        return None
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality=quality_weights(table(spark, sf_dir, "labels")))


def op10_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_packing, op4_token_store, op5_near_duplicates, op6_suffix_dedup, op7_impact_search, op8_kneser_ney, op9_mixing, op10_vector_tree)}

SQL = {
    "op1_url_filter": """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM p),
r AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM q),
rules(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT page_id, host, path, h || s AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) AS n
  FROM r JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT r.page_id, r.host, r.path, hit.rule, coalesce(hit.v, 'allow') AS verdict FROM r LEFT JOIN hit ON hit.page_id = r.page_id AND hit.n = 1
""",
    "op5_near_duplicates": near_dup.SQL,
    "op7_impact_search": impact_search.SQL,
    "op9_mixing": mixing.SQL,
}
