"""Sharding by proportional stratified interleaving (DataFrame functions only).

Within each source rows are ranked in a seeded shuffle; all rows are then sorted
by the fractional rank (rank - 1/2) / rows of the source, and the order is cut
into shards whose row counts differ by one at most.  So each shard, and each
stretch of a shard, holds the sources in their overall proportions.

No rank is taken over a whole source or a whole table in one task: rows fall
into hash-range (then fraction-range) buckets, are ranked within a bucket, and
bucket totals give the offsets.  Only ids, sizes, checksums and sources are
shuffled, never texts.

Defined results: null sources are a stratum of their own; a null text has no
bytes; equal rows are interchangeable; null ids are shuffled like a value of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import Workspace

#: Rows that one ranking task is meant to hold.
BUCKET_ROWS = 100_000


def _ranked(rows: DataFrame, strata: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the place from 1 within the strata, by bucket and then order."""
    rows = rows.withColumn("bucket", bucket)
    totals = rows.groupBy(*strata, "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy(*strata).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(before), F.lit(0).cast("long"))).drop("in_bucket")
    within = Window.partitionBy(*strata, "bucket").orderBy(*order)
    placed = rows.withColumn("within", F.row_number().over(within))
    return placed.join(offsets, [*strata, "bucket"]).withColumn(name, F.col("ahead") + F.col("within")).drop("bucket", "ahead", "within")


def shard(docs: DataFrame, work: Workspace, shards: int = 24, seed: str = "tessera", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source per row."""
    data = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source_column)), F.lit(""))
    # the checksum spreads rows whose ids are null or repeated
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit(":"), F.crc32(data).cast("string")))
    narrow = work.keep(
        docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.col(source_column).alias("source"), stratum.alias("stratum"), shuffled.alias("draw")),
        "rows",
    )
    total = narrow.count()
    buckets = min(65536, max(8, math.ceil(total / BUCKET_ROWS)))
    sizes = narrow.groupBy("stratum").agg(F.count("*").alias("stratum_rows"))
    by_draw = F.floor(F.conv(F.substring("draw", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int")
    ranked = _ranked(narrow, ["stratum"], by_draw, ["draw", "doc_id", "text_crc32", "size"], "rank")
    ranked = ranked.join(sizes, "stratum").withColumn("fraction", (F.col("rank") - 0.5) / F.col("stratum_rows"))
    ranked = work.keep(ranked.drop("stratum_rows", "rank"), "fractions")
    by_fraction = F.floor(F.col("fraction") * buckets).cast("int")
    order = ["fraction", "draw", "doc_id", "stratum", "text_crc32", "size"]
    placed = _ranked(ranked.withColumn("every", F.lit(0)), ["every"], by_fraction, order, "place").withColumn("place", F.col("place") - 1)
    # Whole-number division throughout: a double loses places beyond 2**53.
    number = F.expr(f"CAST(CAST(place AS DECIMAL(25)) * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"CAST((CAST(shard AS DECIMAL(25)) * {total} + {shards - 1}) DIV {shards} AS BIGINT)")
    return placed.withColumn("shard", number).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"
    )
