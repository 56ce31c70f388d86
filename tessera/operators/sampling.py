"""Deterministic splits and samples by hashes of ids.

Hashes are md5 and sha-256 of text, so any engine draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)")


def md5_fraction(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:key)."""
    return _hex_number(F.md5(F.concat(F.lit(f"{seed}:"), key)), 8).cast("double") / 4294967296.0


def split_label(key: Column, seed: str, fraction: float = 0.1) -> Column:
    return F.when(md5_fraction(key, seed) < fraction, "val").otherwise("train")


def inner_role(key: Column) -> Column:
    """tune, threshold or fit by the first byte of md5."""
    byte = F.substring(F.md5(key), 1, 2)
    return F.when(byte <= "07", "tune").when(byte <= "0f", "threshold").otherwise("fit")


def percent_role(key: Column) -> Column:
    """0 to 99 from the first 64 bits of sha-256."""
    return (_hex_number(F.sha2(key, 256), 16) % 100).cast("long")


def sha_shard(key: Column, shards: int = 8) -> Column:
    return (_hex_number(F.sha2(key, 256), 8) % shards).cast("long")


def grouped_split(group: Column, seed: str, fraction: float = 0.1) -> Column:
    """Split labels that rows of one group share, so no group is on both sides."""
    return split_label(group, seed, fraction)


def nibble_shard(key: Column) -> Column:
    return F.substring(F.md5(key), 1, 1)


def stratified_sample(rows: DataFrame, strata: list[str], key: str, seed: str, per_stratum: int) -> DataFrame:
    """The first rows of each stratum in the order of md5(key:seed)."""
    order = F.md5(F.concat(F.col(key), F.lit(f":{seed}")))
    w = Window.partitionBy(*strata).orderBy(order, key)
    return rows.withColumn("draw", F.row_number().over(w).cast("long")).filter(F.col("draw") <= per_stratum)


def quota_roles(rows: DataFrame, key: str, quotas: list[tuple[str, int]], rest: str) -> DataFrame:
    """Roles of fixed sizes by the rank of sha-256, taken in turn.

    Only the rows that get a role are ranked: a top-n, which every task cuts for itself.
    Rows of equal keys share one draw and are told apart by no role.
    """
    total = sum(n for _, n in quotas)
    digest = F.sha2(key, 256)
    first = rows.select(F.col(key).alias("first_key"), digest.alias("digest")).orderBy("digest", "first_key").limit(total)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("digest", "first_key"))).groupBy("first_key").agg(F.min("place").alias("place"))
    out, at = F.lit(rest), total
    for name, n in reversed(quotas):
        out = F.when(F.col("place") <= at, name).otherwise(out)
        at -= n
    return rows.join(F.broadcast(ranked), F.col(key) == F.col("first_key"), "left").withColumn("role", out).drop("place", "first_key")


def thinned(rows: DataFrame, key: Column, keep: Column) -> DataFrame:
    """Rows that ``keep`` holds on to, and one in sixteen of the others."""
    return rows.filter(keep | (F.substring(F.md5(key), 1, 1) == "0"))


def hard_negatives(rows: DataFrame, per_source: int, seed: str) -> DataFrame:
    """All links and the hardest non-links of each (s1, source).

    ``rows`` has s1, mid, y and hard_score.
    """
    tie = F.md5(F.concat("mid", F.lit(f":{seed}")))
    w = Window.partitionBy("s1", F.substring("mid", 1, 2), "y").orderBy(F.desc("hard_score"), tie, "mid")
    return rows.withColumn("n", F.row_number().over(w)).filter((F.col("y") == 1) | (F.col("n") <= per_source)).drop("n")


def ranked_negatives(rows: DataFrame, cap: int, *order: Column) -> DataFrame:
    """All links and, of each s1, the first ``cap`` non-links in an order."""
    w = Window.partitionBy("s1", "y").orderBy(*order, F.asc("mid"))
    return rows.withColumn("n", F.row_number().over(w)).filter((F.col("y") == 1) | (F.col("n") <= cap)).drop("n")


def random_negatives(rows: DataFrame, cap: int, seed: str) -> DataFrame:
    """All links and random non-links, by the md5 of their target and a seed."""
    return ranked_negatives(rows, cap, F.md5(F.concat("mid", F.lit(f":{seed}"))))


def mixed_negatives(rows: DataFrame, exact: Column, hard: int = 6, collide: int = 3, random: int = 3, seed: str = "mixed-v1-42") -> DataFrame:
    """All links and, of each (s1, source), hard non-links, colliding ones and random ones.

    ``rows`` has provenance and hard_score; ``exact`` says that the pair has an exact key in
    common.  A pair collides if it does, or if two passes found it.
    """
    per = Window.partitionBy("s1", F.substring("mid", 1, 2), "y")
    collides = exact | (F.bit_count(F.col("provenance").bitwiseAND(15)) >= 2)
    places = {
        "hard_n": [F.desc("hard_score")],
        "collide_n": [exact.desc(), F.desc("provenance"), F.desc("hard_score")],
        "random_n": [F.md5(F.concat("mid", F.lit(f":{seed}")))],
    }
    out = rows.withColumns({name: F.row_number().over(per.orderBy(*order, F.asc("mid"))) for name, order in places.items()})
    keep = (F.col("y") == 1) | (F.col("hard_n") <= hard) | (collides & (F.col("collide_n") <= collide)) | (F.col("random_n") <= random)
    return out.filter(keep).drop(*places)


def mined_negatives(rows: DataFrame, hard: int = 10, random: int = 2, seed: str = "mined") -> DataFrame:
    """All links, the non-links with the best model scores, and random ones."""
    tie = F.md5(F.concat("mid", F.lit(f":{seed}")))
    per = Window.partitionBy("s1", "y")
    out = rows.withColumn("by_score", F.row_number().over(per.orderBy(F.desc("score"), "mid"))).withColumn("by_draw", F.row_number().over(per.orderBy(tie, "mid")))
    return out.filter((F.col("y") == 1) | (F.col("by_score") <= hard) | (F.col("by_draw") <= random)).drop("by_score", "by_draw")
