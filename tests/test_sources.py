import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.sources import records as src
from tessera.sources import scratch


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Co\t\tIndia\nS1-2\tÉlan\t1 st\t\n', encoding="utf-8")
    got = src.read_source_tsv(spark, str(path))
    assert [tuple(r) for r in got.orderBy("entity_id").collect()] == [("S1-1", '"Quoted" Co', "", "India"), ("S1-2", "Élan", "1 st", "")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("entity_id\tname\tbusiness_address\tcountry\nS1-1\ta\tb\tc\n")
    with pytest.raises(Exception):
        src.read_source_tsv(spark, str(bad)).collect()


def test_truth_reader(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n")
    got = sorted((r["s1"], r["mid"] or "") for r in src.read_truth_tsv(spark, str(path)).collect())
    assert got == [("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "")]
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\n")
    with pytest.raises(Exception):
        src.read_truth_tsv(spark, str(path)).collect()


def test_sets_keep_their_trailing_tab(spark, tmp_path):
    sets = spark.createDataFrame([("S1-2", ""), ("S1-1", "S2-1,S3-1")], "source1_entity_id string, matched_entity_ids string")
    src.write_tsv(sets, str(tmp_path / "out"), "source1_entity_id")
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert [line for line in lines if not line.startswith("source1")] == ["S1-1\tS2-1,S3-1", "S1-2\t"]


def test_allow_list_comes_first(spark):
    lines = spark.createDataFrame([("S1-1\tS2-1",), ("S1-2\tS2-2",)], "value string")
    allowed = spark.createDataFrame([("S1-2",)], "s1 string")
    assert [r["value"] for r in src.allowed_truth(lines, allowed).collect()] == ["S1-2\tS2-2"]


def test_partitioned_write_and_roles(spark, tmp_path):
    keys = spark.createDataFrame([(f"S1-{i}", "in" if i % 2 else "new zealand") for i in range(50)], "entity_id string, cc string")
    src.write_partitioned(keys, str(tmp_path / "keys"), 4)
    assert spark.read.parquet(str(tmp_path / "keys")).filter(F.col("cc") == "new zealand").count() == 25
    keys.write.parquet(str(tmp_path / "role_val"))
    assert {r["role"] for r in src.with_role(spark, "role_([a-z]+)", str(tmp_path / "role_val")).select("role").collect()} == {"val"}


def test_audits_count_violations(spark):
    s1 = spark.createDataFrame([("S1-1", "in"), ("S1-2", "us")], "s1 string, cc string")
    t = spark.createDataFrame([("S2-1", "in"), ("S3-1", "us")], "mid string, cc string")
    cols = "s1 string, mid string, provenance int, name_token_rank int, address_token_rank int"
    rows = [("S1-1", "S2-1", 4, 1, 0), ("S1-1", "S2-1", 4, 1, 0), ("S1-1", "S3-1", 1, 0, 0), ("S1-2", "S9-1", 8, 0, 0), ("X", "S3-1", 0, 0, 2)]
    got = ev.candidate_audit(spark.createDataFrame(rows, cols), s1, t).first().asDict()
    assert got == {"rows": 5, "duplicates": 1, "bad_s1": 1, "bad_target": 1, "unknown_id": 2, "country_mismatch": 1, "name_rank_mismatch": 0, "address_rank_mismatch": 2, "bad_provenance": 1}
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-2", "S8-1")], "s1 string, mid string")
    assert ev.truth_integrity(truth, s1, t).first().asDict() == {"links": 3, "duplicates": 0, "unknown_s1": 0, "unknown_target": 1, "to_s2": 2, "to_s3": 0, "shared_target_links": 2}


def test_repeated_lines_are_refused(spark, tmp_path):
    sets = spark.createDataFrame([("S1-1", ""), ("S1-1", "S2-1")], "source1_entity_id string, matched_entity_ids string")
    with pytest.raises(ValueError, match="S1-1"):
        src.write_tsv(sets, str(tmp_path / "sets"), "source1_entity_id", unique="source1_entity_id")
    assert not (tmp_path / "sets").exists()


def test_feature_sink_keeps_types_and_descriptions(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x", True, 2, 0.5), ("a", "y", False, 1, 0.25)], "s1 string, mid string, same boolean, n int, part float")
    src.write_features(rows, str(tmp_path / "f"), {"part": "a share", "same": "a flag", "n": "a count"}, "7")
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.dtypes == [("s1", "string"), ("mid", "string"), ("part", "double"), ("same", "boolean"), ("n", "int")]
    assert back.schema["part"].metadata == {"comment": "a share", "version": "7"}
    assert sorted(tuple(r) for r in back.collect()) == [("a", "y", 0.25, False, 1), ("b", "x", 0.5, True, 2)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return spark.sparkContext.getConf()

    if spark.conf.get("spark.checkpoint.dir", ""):
        pytest.skip("this session has a shared folder")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Cluster, "x")
