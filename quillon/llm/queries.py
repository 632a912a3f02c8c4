"""Registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, grid_join, katz, packing, piece_counts, pseudonyms, repetition, secrets, sharding, simhash


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_counter():
    """Token counts of the piece vocabulary for rows ``doc_id, text``."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return lambda rows: piece_counts.count_tokens(rows, path, 4096)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts and places of secrets; spans beyond the base are candidates of two owners and two repositories at most."""
    found = secrets.scan(_documents(spark, sf_dir), max_owners=2, max_repos=2)
    count = lambda k: F.expr(f"cast(size(filter(base, m -> m.kind = {k})) as bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.concat("base", "added")).alias("spans"), "n_live", "n_copied",
        *[F.coalesce(F.array_max(f"spread.{c}"), F.lit(0)).alias(f"most_{c}") for c in ("owners", "repos")],
    )


def sharding_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: 40 shards whose counts differ by one at most."""
    return sharding.shard(_documents(spark, sf_dir), 40)


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: links of cosine 0.98 and more within a label."""
    return grid_join.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: groups of documents whose fingerprints differ in 4 bits or fewer, transitively."""
    return simhash.near_duplicates(_documents(spark, sf_dir), 4, 4).select("doc_id", "fingerprint", "component_id")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: tokens of the piece vocabulary."""
    return piece_counter()(_documents(spark, sf_dir))


def pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: personal data by kind, its places and pseudonyms, and the digest of the text with these in place."""
    found = pseudonyms.pseudonymise(_documents(spark, sf_dir), key="of this registered query only")
    kinds = F.array(*map(F.lit, pseudonyms.KINDS))
    listed = F.array_join(F.transform("pii_", lambda m: F.concat_ws(":", kinds[m["kind"]], m["start"].cast("string"), m["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(pii_, m -> m.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(pseudonyms.KINDS)]
    return found.select("doc_id", F.size("pii_").cast("long").alias("n_found"), *counts, listed.alias("spans"), F.array_join(F.col("pii_.pseudonym"), ",").alias("pseudonyms"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: digests of the ids of every text and of the bytes they decode to."""
    import public_tokenizers

    return byte_bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's pieces, in tokens of the piece vocabulary, with their training row, place in it and its length."""
    return packing.pack_docs(_documents(spark, sf_dir), piece_counter())


def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: log probabilities of all documents under a model of nine tenths of them."""
    return katz.score(_documents(spark, sf_dir))


def repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts and verdicts of the quality rules."""
    return repetition.judge_docs(_documents(spark, sf_dir))


QUERIES = {
    "op1_secret_scan": secret_scan, "op2_sharding": sharding_feistel, "op3_embedding_links": embedding_links, "op4_simhash_groups": simhash_groups,
    "op5_token_counts": token_counts, "op6_pii_pseudonyms": pii_pseudonyms, "op7_bpe_digests": bpe_digests, "op8_best_fit_packing": best_fit_packing,
    "op9_katz_scores": katz_scores, "op10_repetition_rules": repetition_rules,
}
#: None of these is expressible in SQL as a whole; the tests hold them against brute force.
ORACLES: dict[str, str] = {}
