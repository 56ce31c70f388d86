"""Further retrieval passes: character n-grams, exact keys, seeds and neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import grams, jaro_winkler_similarity
from tessera.operators.blocking import source_of

NAME4, ACRONYM, POSTAL_NUMERIC, ADDRESS4, SISTER_NAME, MULTI_SISTER = 16, 32, 64, 128, 256, 512


def gram_rows(rows: DataFrame, row_id: str, field: str, n: int, low: int, high: int, *keep: str) -> DataFrame:
    """(id, cc, gram): distinct n-grams of fields of ``low`` to ``high`` characters."""
    return rows.filter(F.length(field).between(low, high)).select(row_id, "cc", *keep, F.explode(grams(F.col(field), n)).alias("gram"))


def gram_df(targets: DataFrame, field: str = "name_norm", n: int = 4, low: int = 4, high: int = 64) -> DataFrame:
    return gram_rows(targets, "mid", field, n, low, high).groupBy("cc", "gram").agg(F.count("*").alias("df"))


def rarest(rows: DataFrame, df: DataFrame, by: list[str], cap: int, top: int, key: str = "gram") -> DataFrame:
    """The ``top`` rarest keys of each group of rows among those of df up to ``cap``."""
    eligible = rows.join(df.filter(F.col("df") <= cap), ["cc", key])
    w = Window.partitionBy(*by).orderBy("df", key)
    return eligible.withColumn("key_rank", F.row_number().over(w)).filter(F.col("key_rank") <= top).drop("key_rank")


def log_evidence(total: int) -> Column:
    return F.sum(F.log(1.0 + F.lit(float(total)) / F.col("df")))


def gram_pass(s1: DataFrame, targets: DataFrame, field: str, cap: int, top: int = 4, quota: int = 25, high: int = 64, tie: str | None = None) -> DataFrame:
    """(s1, mid, shared, evidence, source_rank) by the rarest 4-grams of a field.

    Evidence is the sum of ln(1 + N / df) with N all targets; ``tie`` names a field
    whose Jaro-Winkler similarity breaks ties of evidence and shared grams.
    """
    total = targets.count()
    df = gram_df(targets, field, 4, 4, high)
    picked = rarest(gram_rows(s1, "s1", field, 4, 4, high), df, ["s1"], cap, top)
    posting = gram_rows(targets, "mid", field, 4, 4, high).join(picked.select("cc", "gram").distinct(), ["cc", "gram"], "left_semi")
    hits = picked.join(posting, ["cc", "gram"]).groupBy("s1", "mid").agg(F.count("*").alias("shared"), log_evidence(total).alias("evidence"))
    order = [F.round("evidence", 9).desc(), F.desc("shared")]
    if tie:
        hits = hits.join(s1.select("s1", F.col(tie).alias("a")), "s1").join(targets.select("mid", F.col(tie).alias("b")), "mid")
        hits = hits.withColumn("likeness", F.round(jaro_winkler_similarity("a", "b"), 9))
        order.append(F.desc("likeness"))
    w = Window.partitionBy("s1", source_of()).orderBy(*order, F.asc("mid"))
    return hits.withColumn("source_rank", F.row_number().over(w).cast("long")).filter(F.col("source_rank") <= quota).select("s1", "mid", "shared", "evidence", "source_rank")


def key_pass(s1: DataFrame, targets: DataFrame, key: Column, cap: int, quota: int) -> DataFrame:
    """Targets that share the rarest eligible key of an s1.

    ``key`` gives an array of keys of a row.  Ordered by the Jaro-Winkler similarity
    of names, then of addresses, then the key's frequency.
    """
    theirs = targets.select("mid", "cc", "name_norm", "addr_norm", F.explode(key).alias("ky"))
    df = theirs.groupBy("cc", "ky").agg(F.count("*").alias("df"))
    mine = rarest(s1.select("s1", "cc", F.col("name_norm").alias("n1"), F.col("addr_norm").alias("a1"), F.explode(key).alias("ky")), df, ["s1"], cap, 1, "ky")
    like = F.when((F.col("a1") != "") & (F.col("addr_norm") != ""), jaro_winkler_similarity("a1", "addr_norm")).otherwise(0.0)
    hits = mine.join(theirs, ["cc", "ky"]).select("s1", "mid", F.round(jaro_winkler_similarity("n1", "name_norm"), 9).alias("name_similarity"), F.round(like, 9).alias("address_similarity"), "df")
    best = hits.groupBy("s1", "mid").agg(F.max("name_similarity").alias("name_similarity"), F.max("address_similarity").alias("address_similarity"), F.min("df").alias("key_df"))
    w = Window.partitionBy("s1", source_of()).orderBy(F.desc("name_similarity"), F.desc("address_similarity"), "key_df", "mid")
    return best.withColumn("source_rank", F.row_number().over(w).cast("long")).filter(F.col("source_rank") <= quota)


def acronym_key() -> Column:
    return F.when(F.length("name_acronym").between(3, 12), F.array("name_acronym")).otherwise(F.array().cast("array<string>"))


def numeric_key(low: int = 4, high: int = 6) -> Column:
    return F.filter("num_tokens", lambda x: F.length(x).between(low, high))


def _seed_order() -> list[Column]:
    """Best rank first, then the scores, rounded as sums come in any order."""
    scores = (F.round(c, 12).desc_nulls_last() for c in ("name_shared_idf", "address_shared_idf"))
    return [F.col("source_balanced_rank").asc_nulls_last(), *scores, F.asc("mid")]


def best_seeds(pairs: DataFrame, seeds: int) -> DataFrame:
    """(s1, seed, seed_rank): the best-ranked targets of each s1; rank 0 is best."""
    w = Window.partitionBy("s1").orderBy(*_seed_order())
    return pairs.withColumn("seed_rank", F.row_number().over(w).cast("long")).filter(F.col("seed_rank") <= seeds).select("s1", F.col("mid").alias("seed"), "seed_rank")


def interleaved_seeds(pairs: DataFrame, per_source: int, seeds: int) -> DataFrame:
    """(s1, seed, seed_rank): up to ``per_source`` of each source, best first of each in turn."""
    order = _seed_order()
    first = pairs.withColumn("own", F.row_number().over(Window.partitionBy("s1", source_of()).orderBy(*order))).filter(F.col("own") <= per_source)
    w = Window.partitionBy("s1").orderBy("own", *order)
    return first.withColumn("seed_rank", F.row_number().over(w).cast("long")).filter(F.col("seed_rank") <= seeds).select("s1", F.col("mid").alias("seed"), "seed_rank")


def sister_pass(seeds: DataFrame, targets: DataFrame, cap: int, top: int = 4, quota: int = 10) -> DataFrame:
    """Targets of the other source that share rare 4-grams of the name of a seed.

    Contributing seeds rank first, then evidence; a tie goes to the smaller id.
    """
    total = targets.count()
    df = gram_df(targets)
    own = targets.select(F.col("mid").alias("seed"), "cc", "name_norm")
    named = seeds.join(own, "seed")
    picked = rarest(gram_rows(named, "s1", "name_norm", 4, 4, 64, "seed"), df, ["s1", "seed"], cap, top)
    posting = gram_rows(targets, "mid", "name_norm", 4, 4, 64).join(picked.select("cc", "gram").distinct(), ["cc", "gram"], "left_semi")
    hits = picked.join(posting, ["cc", "gram"]).filter(source_of() != source_of("seed"))
    best = hits.groupBy("s1", "mid").agg(F.count("*").alias("shared"), log_evidence(total).alias("evidence"), F.count_distinct("seed").alias("contributing_seeds"))
    w = Window.partitionBy("s1").orderBy(F.desc("contributing_seeds"), F.round("evidence", 9).desc(), F.desc("shared"), "mid")
    return best.withColumn("s1_rank", F.row_number().over(w).cast("long")).filter(F.col("s1_rank") <= quota)


def sorted_name_sisters(pairs: DataFrame, targets: DataFrame, seeds: int = 3, block: int = 20, quota: int = 20) -> DataFrame:
    """New (s1, mid): the other source's records with the sorted name of a seed.

    Seeds have an exact address, a token pass and no sorted name; blocks above
    ``block`` are left out.
    """
    p = F.col("provenance")
    chosen = pairs.filter((p.bitwiseAND(2) > 0) & (p.bitwiseAND(12) > 0) & (p.bitwiseAND(1) == 0))
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("s1").orderBy("mid"))).filter(F.col("r") <= seeds).select("s1", F.col("mid").alias("seed"))
    key = targets.filter(F.length("name_sorted") > 0).select("mid", "cc", "name_sorted", source_of().alias("src2"))
    small = key.groupBy("cc", "name_sorted", "src2").count().filter(F.col("count") <= block).drop("count")
    seeded = chosen.join(key.select(F.col("mid").alias("seed"), "cc", "name_sorted"), "seed")
    found = seeded.join(key.join(small, ["cc", "name_sorted", "src2"], "left_semi"), ["cc", "name_sorted"]).filter(F.col("src2") != source_of("seed")).select("s1", "mid").distinct()
    w = Window.partitionBy("s1").orderBy("mid")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= quota).select("s1", "mid").join(pairs.select("s1", "mid"), ["s1", "mid"], "left_anti")


def neighbour_index(targets: DataFrame, cap: int, top: int = 4, k: int = 20) -> DataFrame:
    """Edges between targets that share rare 4-grams: the ``k`` best per seed and source.

    Shared grams rank before evidence here.
    """
    total = targets.count()
    rows = gram_rows(targets, "mid", "name_norm", 4, 4, 64)
    picked = rarest(rows.withColumnRenamed("mid", "seed"), gram_df(targets), ["seed"], cap, top)
    posting = rows.join(picked.select("cc", "gram").distinct(), ["cc", "gram"], "left_semi").withColumnRenamed("mid", "neighbour")
    hits = picked.join(posting, ["cc", "gram"]).filter("neighbour <> seed").groupBy("seed", "neighbour").agg(F.count("*").alias("shared"), log_evidence(total).alias("evidence"))
    w = Window.partitionBy("seed", source_of("neighbour")).orderBy(F.desc("shared"), F.round("evidence", 9).desc(), "neighbour")
    edges = hits.withColumn("edge_rank", F.row_number().over(w).cast("long")).filter(F.col("edge_rank") <= k)
    return edges.withColumn("direction", F.concat(source_of("seed"), F.lit(">"), source_of("neighbour")))


def seed_edges(seeds: DataFrame, edges: DataFrame, threshold: float, quota: int) -> DataFrame:
    """The ``quota`` best edges of each seed (s1, seed, seed_score) above a score, ranked.

    Edges to the other source come first.
    """
    joined = seeds.filter(F.col("seed_score") >= threshold).join(edges, "seed")
    w = Window.partitionBy("s1", "seed").orderBy((source_of("seed") != source_of("neighbour")).desc(), F.desc("shared"), F.round("evidence", 9).desc(), "neighbour")
    return joined.withColumn("seed_edge", F.row_number().over(w)).filter(F.col("seed_edge") <= quota)


def best_edges(found: DataFrame) -> DataFrame:
    """(s1, mid, seed, seed_score, support): of several edges to one target the best, with the number of all."""
    pair = Window.partitionBy("s1", "neighbour")
    best = pair.orderBy(F.desc("seed_score"), F.desc("shared"), F.round("evidence", 9).desc(), "seed")
    return found.withColumn("chosen", F.row_number().over(best)).withColumn("support", F.count("*").over(pair)).filter("chosen = 1").select("s1", F.col("neighbour").alias("mid"), "seed", "seed_score", "support")


def one_hop(seeds: DataFrame, edges: DataFrame, threshold: float, quota: int) -> DataFrame:
    """(s1, mid, seed, seed_score, support): neighbours of seeds (s1, seed, seed_score)."""
    return best_edges(seed_edges(seeds, edges, threshold, quota))


def new_only(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found pairs that are not known, with empty provenance and ranks."""
    zero = ["provenance", "name_token_rank", "address_token_rank", "source_balanced_rank"]
    fresh = found.select("s1", "mid").distinct().join(known.select("s1", "mid"), ["s1", "mid"], "left_anti")
    return fresh.select("s1", "mid", *(F.lit(0).cast("long").alias(z) for z in zero))


def pass_mask(*passes: DataFrame) -> DataFrame:
    """(s1, mid, mask): bit i is set if pass i found the pair."""
    every = reduce(DataFrame.unionByName, [p.select("s1", "mid", F.lit(1 << i).cast("long").alias("bit")) for i, p in enumerate(passes)])
    return every.groupBy("s1", "mid").agg(F.bit_or("bit").alias("mask"))


def pareto_frontier(table: DataFrame, name: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Rows of a small table that no other row equals or beats throughout.

    The comparison is not an equi join; the table holds one row per policy.
    """
    a, b = table.alias("a"), table.alias("b")
    no_worse = reduce(Column.__and__, [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in higher] + [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in lower])
    better = reduce(Column.__or__, [F.col(f"b.{c}") > F.col(f"a.{c}") for c in higher] + [F.col(f"b.{c}") < F.col(f"a.{c}") for c in lower])
    return a.join(b, (F.col(f"a.{name}") != F.col(f"b.{name}")) & no_worse & better, "left_anti")
