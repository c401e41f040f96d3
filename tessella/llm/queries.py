"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hard_negatives, langid, lines, lm, merkle, mixing, packing, pages, quality, secrets, simhash, token_files, topk

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(common.crc_of_id("doc_id"), F.lit(4)) == 2
    model = langid.fit(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048, separator=0)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(common.crc_of_id("doc_id"), F.lit(5)) == 1
    scored = lm.score_documents(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20, of components floor(64 * x)."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document, linked at 2 or fewer differing bits."""
    classes = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"), words=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are cut from every document, and a hash of what remains."""
    cut = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    gone = F.coalesce("_deleted", F.array().cast("array<int>"))
    return cut.select("doc_id", F.size(gone).cast("long").alias("n_deleted"), F.array_join(gone.cast("array<string>"), ",").alias("deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents in which no source is repeated more than twice: a row for each copy."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), repetition_limit=2.0, keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.round("_weight", 9).alias("weight"), F.col("_place.col1").alias("block_order"), F.col("_place.col2").alias("order_in_block"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to Arrow token files and read back."""
    docs = _table(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, common.scratch(spark, "token-files"), _tokenizer(), end_id=2)
    return token_files.read_token_files(files, docs.schema["doc_id"].dataType)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, score and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each vector whose id is divisible by 50 and its five best of the same label, of components floor(256 * x)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0, scale=256.0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether what a receiver has of it folds to the root."""
    docs = _table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.col("doc_id").isNotNull() & (common.crc_of_id("doc_id") % 7 == 0)
    bad = F.when(hit, merkle.leaf(*(more if c == "n_chars" else F.col(c) for c in columns)))
    return merkle.manifest(docs, columns, tampered=bad)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    table = _table(spark, sf_dir, "pages")
    return pages.extract(table, pages.fit(table))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_language_id, op2_best_fit_packing, op3_lm_scoring, op4_exact_topk, op5_simhash_near_dedup, op6_line_dedup, op7_secret_scan, op8_source_mixing, op9_token_files, op10_quality_rules, op11_hard_negatives, op12_merkle_manifest, op13_html_extraction)}

ORACLE_SQL: dict[str, str] = {"op4_exact_topk": OP4_SQL, "op6_line_dedup": lines.SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": merkle.SQL}
