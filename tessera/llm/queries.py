"""The registered queries of this subpackage; ``oracles`` has their SQL.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, exact_dedup, mil_quality, near_dedup, packing, sharding, unigram_count, url_filter, wavelet, weak_rules
from tessera.llm.oracles import MIRROR, ORACLE_SQL  # noqa: F401  (registered with the queries)
from tessera.llm.store import Workspace


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), Workspace(spark, "op1"), percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; the largest id stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), Workspace(spark, "op2"))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts that hold the sources in proportion."""
    return sharding.shard(_table(spark, sf_dir, "documents"), Workspace(spark, "op3"))


def op4_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the vote model's verdict of all documents."""
    return weak_rules.judge(_table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4 alone, which SQL can follow: the base counts and base_failed of every document."""
    return weak_rules.rule_stats(_table(spark, sf_dir, "documents")).drop("pattern")


def op5_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of all pages; aliases come from the pages themselves."""
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"), Workspace(spark, "op5"))


def url_mirror_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator with a redirect table derived from the pages: each url leads to the
    mirror of its path, so pages of one path are aliases whatever their hosts."""
    pages = _table(spark, sf_dir, "pages")
    path = url_filter.path_of(F.col("url"))
    redirects = pages.filter(path != "").select("url", F.concat(F.lit(MIRROR), path).alias("target"))
    return url_filter.url_verdicts(pages, Workspace(spark, "mirror"), redirects=redirects)


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    return mil_quality.score_quality(docs, mil_quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    import public_tokenizers

    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), Workspace(spark, "op8"))


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under a unigram vocabulary."""
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as wavelet matrices and read back from the files."""
    shards = wavelet.write_corpus(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), Workspace(spark, "op10"))
    return wavelet.read_corpus(shards)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_exact_dedup,
        op3_stratified_shards,
        op4_weak_quality_rules,
        op5_url_aliases,
        op6_attention_quality,
        op7_byte_bpe,
        op8_best_fit_packing,
        op9_unigram_counts,
        op10_wavelet_output,
        quality_rule_counts,
        url_mirror_redirects,
    )
}
