"""A corpus pipeline over ``documents``: five stages, each one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the documents that stay, with the columns of ``documents`` - the last one returns the
packed pieces.  ``run`` applies them in turn, each on the written result of the one
before.

Defined results: a null text counts as empty.  The classifier scores empty texts like any
other, and the rules drop them, as they have no 50 words.  Very long texts are read whole.
Of repeated rows (same id and text) one stays after ``exact_duplicates``.  Rows with a null
id are judged by their texts, lose to any copy with an id, and are never near
duplicates.  Extra columns pass all stages but the last untouched, whatever their
names.  Ties go to the larger id among equal texts and to the smaller id among near ones.
An empty table gives an empty result; without labels of both kinds every document has
one score, and all stay or all go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mil_quality, near_dedup, packing, weak_rules
from tessera.llm.queries import tokenizer_file
from tessera.llm.store import Workspace, clear_since, opened


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted quality label of 1; the labels lie beside documents."""
    model = mil_quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_quality.keep_good(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules keep."""
    return weak_rules.keep_good(docs, Workspace(spark, "stage-rules"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(docs, Workspace(spark, "stage-exact"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8) the document with the smallest id."""
    return near_dedup.deduplicate(docs, Workspace(spark, "stage-near"), percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    # executors that ran four stages have less room for a cache than fresh ones
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), Workspace(spark, "stage-pack"), cache_bytes=64 << 20)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("pack_sequences", pack_sequences),
]

#: The classifier, the vote model and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = opened()
        docs = work.keep(stage(spark, docs, sf_dir), name)
        clear_since(before)  # the stage's own tables have served
    return STAGES[-1][1](spark, docs, sf_dir)
