"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, langid, minhash, mixing, randomness, substrings, suffixes, urls, winnow
from ._common import table
from .oracles import ORACLE_SQL as ORACLE_SQL


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect equivalence over `pages`."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of `documents`; the fingerprint columns are digests of the selected positions and hashes."""
    found = winnow.fingerprints(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["position"], x["hash"])), ","), 256)
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest("keys").alias("fingerprint"),
        digest("edited_keys").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("keys").alias("n_selected"),
    )


def op3_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents`."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of `documents` for the target weights of the domains in `labels`."""
    found = mixing.mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "words", "domain", *(F.get("posteriors", F.lit(i)).alias(f"p{i}") for i in range(4)), "rate", "copies")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in `documents`."""
    found = randomness.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
        "n_random",
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of `documents` and what they decode to."""
    import public_tokenizers

    ranks = bpe.ranks_from(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of `embeddings` for each row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return covertree.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of `documents` stays without strings of 100 bytes that start earlier."""
    found = suffixes.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of `documents` stays without windows of 35 words that occur more than once."""
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of `documents`."""
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_winnowing,
        op3_min_max_near_dedup,
        op4_soft_mixing,
        op5_secret_scans,
        op6_byte_bpe,
        op7_cover_tree_top_k,
        op8_suffix_array_dedup,
        op9_substring_dedup,
        op10_language_id,
    )
}
