"""Sources and sinks of entity records.

Record files are tab-separated without quoting: entity_id, business_name,
business_address, country.  The source of a record is the prefix of its id; S1 holds
the queries, S2 and S3 the targets.  ``derived_records`` makes such records from the
``documents`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])


def read_source_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """Record files; the header must name the four columns; empty fields are ''."""
    raw = spark.read.csv(list(paths), sep="\t", quote="", escape="", header=True, enforceSchema=False, mode="FAILFAST", schema=SOURCE_SCHEMA)
    return raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in raw.columns))


def write_tsv(df: DataFrame, path: str, *order: str, unique: str | None = None) -> None:
    """One line per row in a global order, with header, without quotes.

    A value of ``unique`` that two rows have is an error, and nothing is written.
    """
    if unique is not None:
        twice = df.groupBy(unique).count().filter("count > 1").select(unique).head(1)
        if twice:
            raise ValueError(f"several lines for {unique} {twice[0][0]}")
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    text.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="")


def read_truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(s1, mid) links; an S1 without links has one row with a null mid.

    A line without a tab is an error, an empty list is a singleton.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("source1_entity_id\t"))
    parts = F.split("value", "\t", 2)
    line = lines.select(F.when(F.assert_true(F.size(parts) == 2, F.concat(F.lit("no tab in: "), "value")).isNull(), parts).alias("p"))
    ids = F.filter(F.transform(F.split(F.col("p")[1], ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return line.select(F.col("p")[0].alias("s1"), F.explode_outer(ids).alias("mid"))


def allowed_truth(truth_lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Truth lines (column value) of allowed S1 only, dropped before their lists are parsed."""
    keyed = truth_lines.withColumn("s1", F.substring_index("value", "\t", 1))
    return keyed.join(allowed.select("s1").distinct(), "s1", "left_semi")


def write_partitioned(keys: DataFrame, path: str, shards: int = 16) -> None:
    """ZSTD Parquet by country and hash shard, sorted by id within each file."""
    sharded = keys.withColumn("shard", F.pmod(F.xxhash64("entity_id"), F.lit(shards)).cast("int"))
    sharded.repartition("cc", "shard").sortWithinPartitions("entity_id").write.mode("overwrite").option("compression", "zstd").partitionBy("cc", "shard").parquet(path)


def write_features(rows: DataFrame, path: str, descriptions: dict[str, str], version: str) -> None:
    """A feature table as ZSTD Parquet of fixed types, sorted by pair within files.

    The columns are s1, mid and those of ``descriptions``, in that order: booleans and whole numbers as
    they are, all others as doubles.  Each column carries its description and the
    version of the features in its metadata, which Spark keeps in the files.
    """
    whole = {name: kind in ("boolean", "int", "bigint") for name, kind in rows.dtypes}
    columns = [F.col(c) if whole[c] else F.col(c).cast("double") for c in descriptions]
    described = [c.alias(name, metadata={"comment": text, "version": version}) for c, (name, text) in zip(columns, descriptions.items())]
    rows.select("s1", "mid", *described).sortWithinPartitions("s1", "mid").write.mode("overwrite").option("compression", "zstd").parquet(path)


def with_role(spark: SparkSession, pattern: str, *paths: str) -> DataFrame:
    """Parquet rows with a ``role`` taken from their file's name."""
    return spark.read.parquet(*paths).withColumn("role", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``documents``: words 1-4 are the name, 5-12 the address.

    doc_id 0, 3, ... are S1, 1, 4, ... are S2 and 2, 5, ... are S3.  Records of one entity
    within a country share ``truth_key``: the words after their fields (13-30), so that
    a link's names and addresses may differ by edits; of shorter documents all letters
    and digits, null if there are none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ", 31)  # 30 words and the rest
    entity = F.when(F.size("w") >= 30, F.array_join(F.slice("w", 13, 18), " ")).otherwise(F.array_join("w", ""))
    src = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    base = docs.select("doc_id", "lang", src.alias("src"), words.alias("w"))
    return base.select(
        F.concat("src", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("entity_id"),
        "src",
        F.array_join(F.slice("w", 1, 4), " ").alias("business_name"),
        F.array_join(F.slice("w", 5, 8), " ").alias("business_address"),
        F.col("lang").alias("country"),
        F.md5(F.nullif(entity, F.lit(""))).alias("truth_key"),
    )


#: The same records for DuckDB, as the CTE ``rec``.
RECORDS_SQL = """
base AS (SELECT doc_id, lang, 'S' || (doc_id % 3 + 1) AS src, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
rec AS (SELECT src || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, src,
  array_to_string(w[1:4], ' ') AS business_name, array_to_string(w[5:12], ' ') AS business_address,
  lang AS country, md5(nullif(CASE WHEN len(w) >= 30 THEN array_to_string(w[13:30], ' ') ELSE array_to_string(w, '') END, '')) AS truth_key FROM base)"""


def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``part``: nine parts in a row share a five-digit code and a country.

    The address is the part's type and the code, so records may agree in code or address
    and have other names, and several records of a source may have one name.
    """
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    src = F.expr("concat('S', p_partkey % 3 + 1)")
    return parts.select(
        F.concat(src, F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("entity_id"),
        src.alias("src"),
        F.lower("p_name").alias("business_name"),
        F.expr("concat(lower(p_type), ' ', p_partkey DIV 9 + 10000)").alias("business_address"),
        F.expr("concat('c', p_partkey DIV 9 % 10)").alias("country"),
        F.expr("md5(string(p_partkey DIV 9))").alias("truth_key"),
    )


#: The same records for DuckDB, as the CTE ``rec``.
NUMBERED_SQL = """
rec AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || lpad(p_partkey::VARCHAR, 8, '0') AS entity_id, 'S' || (p_partkey % 3 + 1) AS src, lower(p_name) AS business_name,
  lower(p_type) || ' ' || (p_partkey // 9 + 10000) AS business_address, 'c' || (p_partkey // 9 % 10) AS country, md5((p_partkey // 9)::VARCHAR) AS truth_key FROM part)"""
