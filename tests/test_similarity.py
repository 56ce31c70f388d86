import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import vectors
from tessera.plans import registry

WORDS = st.text(alphabet="abc ", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[j - 1]))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_lcs(a, b):
    assert sim.lcs_length(a, b) == slow_lcs(a, b)
    assert 0 <= sim.indel(a, b) <= 1 and sim.indel(a, a) == 1
    assert 0 <= sim.partial(a, b) <= 1 and sim.partial(a, a) == 1
    assert sim.token_set(a, b) == sim.token_set(b, a)


#: Texts of all kinds: short, long over one and two words of bits, other scripts, empty.
MIXED = ["", "a", "ab ab", "acme tools", "tools acme", "acme and co tools", "ÄÖ ü", "शर्मा स्टोर्स", "日本 日本", "x" * 64, "xy" * 40, "q" * 130 + " r", "12 high street 560001", "high st 12 560001 bangalore", "the quick brown fox " * 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc d", max_size=12), st.text(alphabet="abc d", max_size=30)), max_size=30))
def test_vectors_like_single_pairs(pairs):
    pairs = pairs + [(x, y) for x in MIXED for y in MIXED][:: max(1, len(pairs))]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for fast, slow in (
        (vectors.indels, sim.indel),
        (vectors.partials, sim.partial),
        (lambda x, y: vectors.indels(vectors.sorted_words(x), vectors.sorted_words(y)), sim.token_sort),
        (vectors.token_sets, sim.token_set),
        (vectors.weighted_ratios, sim.weighted),
        (lambda x, y: vectors.jaro_winklers(x, y, sim.jaro_winkler), sim.jaro_winkler),
    ):
        got = fast(a, b)
        assert all(math.isclose(g, slow(x, y), abs_tol=1e-12) for g, x, y in zip(got, a, b)), slow.__name__


def test_vectors_in_small_parts(monkeypatch):
    pairs = [(x, y) for x in MIXED for y in MIXED]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    whole = vectors.indels(a, b), vectors.partials(a, b)
    monkeypatch.setattr(vectors, "TABLE", 50)
    assert (vectors.indels(a, b) == whole[0]).all() and (vectors.partials(a, b) == whole[1]).all()
    assert vectors.over_distinct(vectors.indels, a * 2, b * 2, 0.0)[3] == 0.0 and len(vectors.indels([], [])) == 0


@pytest.mark.parametrize(
    "measure, a, b, want",
    [
        (sim.indel, "lewenstein", "levenshtein", 18 / 21),
        (sim.partial, "fuzzy wuzzy was a bear", "wuzzy", 1.0),
        (sim.token_sort, "new york mets", "mets york new", 1.0),
        (sim.token_set, "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0),
        (sim.token_set, "", "a", 0.0),
        (sim.jaro_winkler, "martha", "marhta", 0.9611111),
        (sim.jaro_winkler, "dixon", "dicksonx", 0.8133333),
        (sim.jaro_winkler, "abc", "xyz", 0.0),
        (sim.weighted, "abc", "abc", 1.0),
        (sim.weighted, "", "abc", 0.0),
    ],
)
def test_known_values(measure, a, b, want):
    assert math.isclose(measure(a, b), want, abs_tol=1e-6)


def test_jaro_winkler_of_empty_texts():
    """0 as in DuckDB, also where both are empty."""
    pairs = [("", ""), ("a", ""), ("", "a"), ("", "q" * 70)]
    want = [duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", p).fetchone()[0] for p in pairs]
    assert [sim.jaro_winkler(*p) for p in pairs] == want == [0.0] * 4
    assert list(vectors.jaro_winklers(*map(list, zip(*pairs)), sim.jaro_winkler)) == want


def test_jaro_winkler_query_on_records_without_address(spark, tmp_path):
    texts = ["one name only here", "one name only here", "one name only there", "", None, "one name only here 5 main street"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["jaro_winkler_sim"])
    got = registry.QUERIES["jaro_winkler_sim"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r["address_jaro_winkler"] == 0 for r in got)


def test_columns(spark):
    rows = spark.createDataFrame([("abcd", "abce"), ("", "x"), ("ab", "ab")], "a string, b string")
    structs = rows.select(sim.fuzzy_ratios("a", "b").alias("f")).select("f.*").collect()
    assert structs[1].asDict() == dict.fromkeys(sim.RATIOS, 0.0) and structs[2].asDict() == dict.fromkeys(sim.RATIOS, 1.0)
    assert structs[0].asDict() == {"ratio": 0.75, "partial_ratio": 6 / 7, "token_sort_ratio": 0.75, "token_set_ratio": 0.75}
    got = rows.select(
        sim.ratio("a", "b").alias("r"), sim.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"), sim.grams(F.col("a"), 2).alias("g"), sim.jaccard(sim.grams(F.col("a"), 2), sim.grams(F.col("b"), 2)).alias("j")
    ).collect()
    assert [r["r"] for r in got] == [0.75, 0.0, 1.0]
    assert [r["l"] for r in got] == [0.75, 0.0, 1.0]
    assert [r["g"] for r in got] == [["ab", "bc", "cd"], [], ["ab"]]
    assert [r["j"] for r in got] == [0.5, 0.0, 1.0]
