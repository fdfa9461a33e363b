"""One query for each operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.llm import bpe, jaccard, merkle, neighbours, oracle, packing, quality, secrets, sharding, simhash, topk, toxicity, urls, whitening

TOKENIZER = {
    "path": public_tokenizers.path("byte_bpe_50k.json"),
    "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "pattern": public_tokenizers.PATTERN,
}


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


QUALITY_CUT = 0.3
UNIFORM = 0.1


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs), uniform=UNIFORM))
    return found.select(
        "doc_id",
        *(F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.as_text(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_within for each id divisible by 50: other documents whose fingerprints are at most three bits away."""
    made = simhash.fingerprints(table(spark, sf_dir, "documents"))
    asked = made.filter("doc_id % 50 = 0")
    copies = made.groupBy("fingerprint").agg(F.count("*").alias("n"))
    met = simhash.within(asked, made).join(copies, "fingerprint").groupBy("query").agg(F.sum("n").alias("met"))
    hexed = {c: simhash.as_hex(F.col(c)) for c in ("fingerprint", "edited_fingerprint")}
    counted = made.join(met.withColumnRenamed("query", "fingerprint"), "fingerprint", "left").withColumn("n_within", F.when(F.col("doc_id") % 50 == 0, F.col("met") - 1))
    return counted.withColumns(hexed).select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", "n_within")


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def held_out(id_col: str = "doc_id"):
    """Whether a document's label may not be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels.filter(~held_out()), cut_score=QUALITY_CUT))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER["path"], TOKENIZER["pattern"])


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **TOKENIZER)


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def row_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=held_out()).drop("path")


def largest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_spans,
        "op2_fingerprints": text_fingerprints,
        "op3_sharding": shards,
        "op4_url_filter": url_verdicts,
        "op5_toxicity": toxicity_scores,
        "op6_neighbours": nearest_vectors,
        "op7_quality": quality_scores,
        "op8_jaccard_join": linked_documents,
        "op9_packing": packed,
        "op10_bpe": bpe_round_trip,
        "op11_whitening": whitened,
        "op12_merkle": row_manifest,
        "op13_topk": largest_products,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_jaccard_join": oracle.JACCARD, "op12_merkle": oracle.MERKLE, "op13_topk": oracle.TOP_PRODUCTS}
