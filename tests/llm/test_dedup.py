import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup
from tessera.llm.bitmaps import KeyBitmap, anti_by_key, possible, semi_by_id
from tessera.llm.components import connected_components
from tests.llm.cases import PROSE, ROWS, as_set, cluttered, documents, workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute_components(rows, percent=85):
    """doc_id -> (set size, least reachable id) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    least = {d: d for d in sets}
    changed = True
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {d: (len(sets[d]), least[d]) for d in ids}


def family(seed, n, length=120):
    """Edits of one text, from slight to heavy, so that links and near misses occur."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(length)] = f"e{rng.randrange(60)}"
        out.append(" ".join(words))
    return out


def check_near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df, workspace(spark)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute_components(rows).items()}


def test_near_groups_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(family(1, 70) + family(2, 30, 40) + family(3, 20, 9))]
    rows += [(1000 + i, None if i == 0 else t) for i, t in enumerate(["", "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"])]
    check_near(spark, rows)


def test_near_groups_block_comparison(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    check_near(spark, [(i, t) for i, t in enumerate(family(4, 90))])


def test_sketch_never_rejects_a_link():
    rng = np.random.default_rng(5)
    for size in (1, 7, 146, 1000, 1100, 2047, 5000, 30000):
        for _ in range(20):
            most = int(0.15 * 2 * size / 1.85 / 2)
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            change = rng.integers(0, most + 1) if most else 0
            other = base.copy()
            other[:change] = rng.integers(0, 1 << 63, change, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(base), np.unique(other)
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                sketches = [near_dedup.odd_sketch(x)[None] for x in (a, b)]
                assert near_dedup.may_link(np.array([len(a)]), sketches[0], np.array([len(b)]), sketches[1])[0]


def test_sketch_count_is_difference_for_small_sets():
    a = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a.sort()
    for gone in (1, 5, 20):
        flips = np.bitwise_count(near_dedup.odd_sketch(a)[0] ^ near_dedup.odd_sketch(a[gone:])[0]).sum()
        assert gone - 4 <= flips <= gone


def test_near_awkward_rows(spark):
    got = near_dedup.near_groups(cluttered(spark), workspace(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got.count() == len(ROWS)
    found = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert [found[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 12)] == [0, 0, 0, 1, 1, 1]
    assert all(found[i]["kept"] for i in (0, 1, 2, 3, 4, 5, 8, 10))
    assert found[6]["component_id"] == found[11]["component_id"] == 5
    assert found[9]["component_id"] == 8
    lonely = [r for r in got.collect() if r["doc_id"] is None]
    assert lonely[0]["component_id"] is None and lonely[0]["kept"]


def twins(letters, doublings):
    """Two words for which polynomial hashes modulo a power of two are equal."""
    one = letters[0]
    for _ in range(doublings):
        one += one.translate(str.maketrans(letters, letters[::-1]))
    return one, one.translate(str.maketrans(letters, letters[::-1]))


def test_words_that_linear_hashes_confuse(spark):
    rows = []
    for k, doublings in enumerate((10, 11, 12)):
        one, two = twins("ab", doublings)
        rows += [(10 * k, one), (10 * k + 1, two), (10 * k + 2, f"p q r {one} s t"), (10 * k + 3, f"p q r {two} s t")]
    check_near(spark, rows)


def test_equal_digests_of_unlike_sets_are_no_class(spark, monkeypatch):
    rows = [(i, f"one two three four {i % 3}") for i in range(6)] + [(9, "ONE two  three four 0")]
    monkeypatch.setattr(near_dedup, "_digest", lambda shingles: (1, 2))
    check_near(spark, rows)


def test_confirmation_reads_words_not_hashes(spark, monkeypatch):
    """With sketches that let all pairs pass, unlike texts of one bucket are still no link."""
    monkeypatch.setattr(near_dedup, "may_link", lambda size_a, *rest: np.ones(len(size_a), bool))
    check_near(spark, [(i, t) for i, t in enumerate(family(11, 40))])


def test_ids_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    rows = [(10, a), (10, b), (11, a + " t"), (12, b + " t"), (13, "alone in the wide world")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_set(near_dedup.near_groups(df, workspace(spark)), "doc_id", "component_id", "kept")
    assert got == [(10, 10, True), (10, 10, True), (11, 10, False), (12, 10, False), (13, 13, True)]
    # a row goes by its own text, whatever else bears its id
    rows = [(10, a), (12, a + " t"), (12, b)]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), workspace(spark))
    assert as_set(kept, "doc_id", "text") == [(10, a), (12, b)]


def test_near_empty_table(spark):
    assert near_dedup.near_groups(documents(spark, []), workspace(spark)).count() == 0
    assert near_dedup.deduplicate(documents(spark, []), workspace(spark)).count() == 0


def test_near_deduplicate_keeps_columns(spark):
    kept = near_dedup.deduplicate(cluttered(spark), workspace(spark))
    assert kept.columns == cluttered(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 7, 8, 10, 12, 13, None} - ({7} if brute_components([(5, PROSE), (7, PROSE + "and then some")])[7][1] == 5 else set())


def planted_near(seed, n, words, changed):
    """Rows (id, text) and copies (1000 + id, text) with so many words changed; similarities of the pairs."""
    rng = random.Random(seed)
    rows, alike = [], []
    for i in range(n):
        one = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        two = list(one)
        for at in rng.sample(range(0, words, 10), changed):
            two[at] = f"c{rng.randrange(10**6)}"
        rows += [(i, " ".join(one)), (1000 + i, " ".join(two))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        alike.append(len(a & b) / len(a | b))
    return rows, alike


def test_near_threshold_is_a_parameter(spark):
    rows, alike = planted_near(6, 40, 240, 5)
    assert all(0.80 <= x < 0.85 for x in alike)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda out: {r["doc_id"] for r in out.collect()}
    assert ids(near_dedup.deduplicate(df, workspace(spark))) == set(range(40))
    assert ids(near_dedup.deduplicate(df, workspace(spark), percent=85)) == {r[0] for r in rows}
    assert ids(near_dedup.near_groups(df, workspace(spark), percent=80).filter("kept")) == set(range(40))
    below, alike = planted_near(7, 20, 240, 7)
    assert all(0.70 < x < 0.80 for x in alike)
    assert near_dedup.deduplicate(spark.createDataFrame(below, "doc_id long, text string"), workspace(spark)).count() == 40


def test_bands_miss_no_more_at_a_lower_threshold():
    assert near_dedup.banding(85) == (40, 6) and near_dedup.banding(80) == (48, 5)
    for percent in (50, 70, 80, 85, 90, 100):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-8
    with pytest.raises(ValueError):
        near_dedup.banding(49)


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    return sorted(((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=repr)


def test_exact_groups(spark):
    got = as_set(exact_dedup.exact_groups(cluttered(spark), workspace(spark)), "doc_id", "keep_id", "group_size")
    assert got == brute_exact([(r[0], r[1]) for r in ROWS])


def test_exact_groups_smallest(spark):
    rows = exact_dedup.exact_groups(documents(spark), workspace(spark), keep="smallest").collect()
    # a null id is below every id
    assert {r["keep_id"] for r in rows if r["doc_id"] in (5, 6, 11)} == {None}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    rows = exact_dedup.exact_groups(documents(spark, [r for r in ROWS if r[0] is not None]), workspace(spark), keep="smallest").collect()
    assert {r["keep_id"] for r in rows if r["doc_id"] in (5, 6, 11)} == {5}


def test_exact_collisions_compare_bytes(spark):
    """A hash with two values puts unlike texts together; bytes keep them apart."""
    rows = [(i, f"text {i % 7}" if i % 3 else f"TEXT {i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bad = exact_dedup.exact_groups(df, workspace(spark), content=lambda c: F.when(F.length(c) > 100, "x").otherwise("y"))
    assert as_set(bad, "doc_id", "keep_id", "group_size") == brute_exact(rows)


def test_exact_deduplicate(spark):
    kept = exact_dedup.deduplicate(cluttered(spark), workspace(spark))
    assert kept.columns == cluttered(spark).columns
    found = Counter(r["doc_id"] for r in kept.collect())
    assert found[11] == 1 and found[5] == found[6] == 0 and found[None] == 0
    assert sum(found.values()) == len({(r[1] or "").translate(LOWER) for r in ROWS})


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(documents(spark, []), workspace(spark)).count() == 0
    assert exact_dedup.deduplicate(documents(spark, []), workspace(spark)).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    work = workspace(spark)
    rows = spark.range(5000).withColumnRenamed("id", "k")
    wanted = work.keep(rows.filter("k % 7 = 0"), "wanted")
    hit = possible(rows, F.col("k"), KeyBitmap(wanted, "k"))
    assert hit.join(wanted, "k", "left_semi").count() == wanted.count()
    assert hit.count() < 1.2 * wanted.count()
    full = possible(rows, F.col("k"), KeyBitmap(wanted, "k", bits=1 << 15))  # full bitmaps let more rows pass
    assert full.join(wanted, "k", "left_semi").count() == wanted.count()
    assert semi_by_id(rows, wanted, "k").count() == wanted.count()
    assert anti_by_key(rows, F.col("k"), F.col("k"), wanted.selectExpr("k AS probe", "k AS key")).count() == 5000 - wanted.count()


#: Names that the helpers use for their own columns, and names that need quotes.
INTERNAL = ("bitmap_at", "Bitmap_Bucket", "bitmap_bits", "BITMAP_HIT", "bitmap_hit_", "row_key", "gone_key", "key", "probe", "content", "sha", "a.b", "c`d")


@pytest.mark.parametrize("operator", [exact_dedup.deduplicate, near_dedup.deduplicate])
def test_columns_named_like_internal_ones_stay(spark, operator):
    docs = documents(spark, [*ROWS, (5, "other " + PROSE, "en", "x", 1), (5, "other " + PROSE, "en", "x", 1)])
    for name in INTERNAL:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    kept = operator(docs, workspace(spark))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r[name] == f"{name}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for name in INTERNAL)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 450)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(as_set(connected_components(spark.createDataFrame(edges, "a long, b long"), workspace(spark)), "node", "component"))
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (2, None)], "a long, b long"), workspace(spark)).count() == 0


def test_shingle_sets_are_like_brute_force():
    from tessera.llm.textscan import Words, blocks, shingle_sets

    texts = [r[1] for r in ROWS]
    sizes = []
    for _, raw, offs in blocks(pa.array(texts, pa.string()), 1000):
        words = Words(raw, offs)
        sizes += [len(s) for s in shingle_sets(words.hashes(True), words.first, 5)]
    assert sizes == [len(shingles(t)) for t in texts]
