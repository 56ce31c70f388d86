import random
from collections import Counter

import duckdb
import pyarrow as pa
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import mil_quality, weak_rules
from tessera.llm.oracles import ORACLE_SQL
from tessera.llm.textstats import text_stats
from tests.llm.cases import SCHEMA, cluttered, documents
from tests.llm.test_dedup import LOWER, brute_components, planted_near
from tests.llm.test_quality import brute_em, brute_score, brute_stats, junk, prose
from tests.llm.test_sharding_packing import WORDS, check_packing

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert set(ORACLE_SQL) <= names


def test_oracles(spark):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = __spark_entry__.queries()[name](spark, SF)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr)
        assert rows == sorted(want.fetchall(), key=repr), name


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        rows.append((i, prose(rng, rng.randint(60, 200)) if i % 6 else junk(rng, 90), "en", "s", 1))
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[1:40]]  # exact copies
    near = [(2000 + r[0], r[1] + " tail", *r[2:]) for r in rows[41:60] if r[0] % 6 and len(r[1].split()) > 80]
    rows += near + [(5000, None, "en", "s", None), (5001, "", "en", None, 0), (None, prose(rng, 100), "en", "s", 1)]
    labels = [(r[0], int(r[0] % 6 != 0)) for r in rows[:300]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = cluttered(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack_sequences":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [r["doc_id"] for r in docs.collect()]
    clean = {r[0] for r in rows[:300] if r[0] % 6}
    assert clean <= set(kept["quality_rules"]) and not {r[0] for r in rows[:300] if not r[0] % 6} & set(kept["quality_rules"])
    assert {1000 + i for i in range(1, 40) if i % 6} <= set(kept["exact_duplicates"]) and not {i for i in range(1, 40)} & set(kept["exact_duplicates"])
    assert not {r[0] for r in near} & set(kept["near_duplicates"])
    assert set(kept["pack_sequences"]) == set(kept["near_duplicates"])


def test_near_stage_drops_copies_between_080_and_085(spark, tmp_path):
    rows, alike = planted_near(8, 30, 240, 5)
    assert all(0.80 <= x < 0.85 for x in alike)
    docs = documents(spark, [(i, text, "en", "s", 1) for i, text in rows])
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, [])
    assert docs.schema.simpleString() == f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',').replace('long', 'bigint')}>"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_run_like_brute_force(spark, tmp_path):
    """All stages in turn against loops over rows."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(40, 160)) if i % 6 else junk(rng, 90), "en", "s", 1) for i in range(260)]
    rows += [(500 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s", 1) for i in range(1, 30)]
    rows += [(700 + i, rows[i][1] + " one tail", "en", "s", 1) for i in range(31, 60)]
    rows += [(900, None, "en", None, None), (901, "", "en", None, 0), (902, rows[1][1] + " " + prose(rng, 4000), "en", "s", 1)]
    labels = [(r[0], int(r[0] % 6 != 0)) for r in rows[:260]]
    docs = documents(spark, rows).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    table.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = mil_quality.fit_quality(docs, table)
    stay = [(i, t or "") for i, t, *_ in rows if brute_score(model, t) >= mil_quality.PREDICT_FROM]
    stats = {i: brute_stats(t) for i, t in stay}
    number = {i: int(weak_rules.vote_pattern(text_stats(pa.array([t], pa.string())))[0]) for i, t in stay}
    counts = Counter(number.values())
    good = dict(zip(sorted(counts), brute_em(sorted(counts), [counts[p] for p in sorted(counts)])))
    stay = [(i, t) for i, t in stay if stats[i][0] >= 50 and 100 * stats[i][4] <= 50 * stats[i][0] and good[number[i]] >= weak_rules.KEEP_FROM]
    largest = {}
    for i, t in stay:
        largest[t.translate(LOWER)] = max(i, largest.get(t.translate(LOWER), i))
    stay = [(i, t) for i, t in stay if largest[t.translate(LOWER)] == i]
    least = brute_components(stay, 80)
    stay = {i: t for i, t in stay if least[i][1] == i}
    assert 150 < len(stay) < len(rows) - 90
    assert {r["doc_id"] for r in got} == set(stay)
    check_packing(got, stay, Tokenizer.from_file(WORDS), 2048)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
