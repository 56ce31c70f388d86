"""Exact deduplication (DataFrame functions only).

Rows are grouped by a 128-bit hash of the normalised text; inside a group texts
are compared byte by byte by grouping on the text itself, so a hash collision
cannot join two texts.  Only hashes that occur at least twice bring their texts
into a shuffle, and equal texts are first counted where they are read, so a
group of copies sends one text per task whatever its size.

Defined results: a null text counts as empty; empty texts are copies of each
other; a null id is below every id.  Rows repeated with the same id and text
count each in ``group_size`` and share ``kept``; ``deduplicate`` then returns one
of them.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import KeyBitmap, anti_by_key, columns_of, fresh, named, possible
from tessera.llm.store import Workspace, rows_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _hashed(docs: DataFrame, id_column: str, text_column: str, content) -> DataFrame:
    folded = docs.select(named(id_column).alias("doc_id"), fold_ascii(named(text_column)).alias("folded"))
    return folded.withColumn("content", content(F.col("folded")))


def _exact_groups(docs, work, id_column, text_column, keep, content) -> tuple[DataFrame, DataFrame]:
    # a null id is below every id
    best = {"largest": F.max("doc_id"), "smallest": F.when(~F.max(F.col("doc_id").isNull()), F.min("doc_id"))}[keep]
    hashed = _hashed(docs, id_column, text_column, content)
    narrow = work.keep(hashed.select("doc_id", "content", F.sha2("folded", 256).alias("text_sha256")), "hashes")
    repeated = work.keep(narrow.groupBy("content").count().filter("count > 1").select("content"), "repeated", rows_of(narrow) // 2)
    copies = possible(hashed, F.col("content"), KeyBitmap(repeated, "content"))
    by_bytes = copies.groupBy("content", "folded").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    classes = work.keep(by_bytes.drop("folded"), "classes")
    clash = work.keep(classes.groupBy("content").count().filter("count > 1").select("content"), "clash", rows_of(classes) // 2)

    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    shape = ["doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256"]
    if not rows_of(clash):
        return work.sized(narrow.join(classes, "content", "left").select(*shape), rows_of(narrow)), narrow
    # One hash, several texts: those rows find their class by their bytes.
    clean = narrow.join(clash, "content", "left_anti").join(classes, "content", "left").select(*shape)
    texts = copies.join(clash, "content", "left_semi").withColumn("text_sha256", F.sha2("folded", 256))
    mixed = texts.join(by_bytes.join(clash, "content", "left_semi"), ["content", "folded"]).select(*shape)
    return clean.unionByName(mixed), narrow


def exact_groups(docs: DataFrame, work: Workspace, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", content=F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the stable id that stays: the "largest" or the "smallest".
    ``content`` is the 128-bit hash of the folded text.
    """
    return _exact_groups(docs, work, id_column, text_column, keep, content)[0]


def deduplicate(docs: DataFrame, work: Workspace, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is known by its id (null as a value of its own) and its text; only rows
    whose id is among those to drop or repeated are looked at by text.
    """
    groups, narrow = _exact_groups(docs, work, id_column, text_column, keep, F.md5)

    def probe(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), named(column).cast("string")), F.lit(""))

    def key(column: str, sha256: Column) -> Column:
        return F.concat(probe(column), F.lit(":"), sha256)

    own = key(id_column, F.sha2(fold_ascii(named(text_column)), 256))
    rows = [probe("doc_id").alias("probe"), key("doc_id", F.col("text_sha256")).alias("key")]
    dropped = work.keep(groups.filter("NOT kept").select(*rows), "dropped", rows_of(narrow))
    again = work.keep(narrow.groupBy(*rows).count().filter("count > 1").select("probe", "key"), "again", rows_of(narrow) // 2)
    kept = anti_by_key(docs, probe(id_column), own, dropped)
    if not rows_of(again):
        return kept
    marked, hit = KeyBitmap(again, "probe").mark(kept, probe(id_column))
    (row_key,) = fresh(marked.columns, "row_key")
    once = marked.filter(hit).withColumn(row_key, own).dropDuplicates([row_key])
    return marked.filter(~hit).select(*columns_of(docs)).unionByName(once.select(*columns_of(docs)))
