import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import mil_quality, weak_rules
from tessera.llm.textscan import run_hashes
from tessera.llm.textstats import STATS, text_stats
from tests.llm.cases import ROWS, cluttered, documents, workspace


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def prose(rng, n):
    words = [f"{rng.choice('abcdefghklmnoprst')}{rng.choice(['ar', 'en', 'oi', 'ul'])}{rng.choice(['', 'ta', 'ne', 'so', 'rim'])}{rng.choice(['', 'd', 'ly', 's'])}" for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


def junk(rng, n):
    kind = rng.randrange(4)
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " ".join(x for w in words for x in (w, w))
    return "\n".join(["Same line again."] * (n // 3))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(60, 300)) if i % 5 else junk(rng, rng.randint(60, 200)), "en", "s", 1) for i in range(800)]
    return rows, [(r[0], int(r[0] % 5 != 0)) for r in rows]


def test_text_stats_like_brute_force(corpus):
    rng = random.Random(1)
    texts = [r[1] for r in ROWS] + [r[1] for r in corpus[0][:60]] + ["\n", "a\n", "a\na", "\na\n\na \na", "a b c a b c\nd", "é\né\n"]
    texts += ["".join(rng.choice("ab c\n\t#é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = text_stats(pa.array(texts, pa.string()))
    assert set(got) == set(STATS)
    for i, text in enumerate(texts):
        assert tuple(int(got[k][i]) for k in weak_rules.BASE) == brute_stats(text), text
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert got["n_symbol_words"][i] == sum(bool(set(w) & set("#*$%&|<>")) for w in words)
        assert got["n_marks"][i] == sum(c.isascii() and not c.isalnum() and c > " " and c != "\x7f" for w in words for c in w)


def test_counts_where_linear_hashes_collide():
    """Words that are unlike but have equal polynomials modulo a power of two."""
    one, two = "ab", "ba"
    for _ in range(11):
        one, two = one + two, two + one
    texts = [f"{one}\n{two}\n{one}", f"{one} p q r {two} p q r", f"{one[:1024]} p q r {two[:1024]} p q r"]
    got = text_stats(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(got[k][i]) for k in weak_rules.BASE) == brute_stats(text)
    assert got["n_dup_lines"].tolist() == [1, 0, 0] and got["n_repeat_words"].tolist() == [0, 6, 6]


def test_counts_of_long_texts():
    """Texts longer than the hashing block give the same counts."""
    text = "\n".join(f"one two three w{i % 50}" for i in range(400)) + " " + "z" * 900
    whole = run_hashes(np.arange(5000) % 7 + 1, np.arange(0, 5000, 11))
    for limit in (1, 40, 4999):
        assert np.array_equal(run_hashes(np.arange(5000) % 7 + 1, np.arange(0, 5000, 11), limit), whole)
    assert tuple(int(v[0]) for k, v in text_stats(pa.array([text], pa.string())).items() if k in weak_rules.BASE) == brute_stats(text)


def test_vote_model_learns_without_labels(spark, corpus):
    rows, labels = corpus
    got = {r["doc_id"]: r for r in weak_rules.judge(documents(spark, rows), workspace(spark)).collect()}
    assert all(got[i]["kept"] == bool(y) for i, y in labels)


def pattern(**votes):
    """The number of a pattern: all rules vote good but for those named."""
    out = 0
    for rule in weak_rules.RULES:
        out = out * 3 + votes.get(rule.replace(" ", "_"), weak_rules.GOOD)
    return out


def brute_em(patterns, counts):
    """The same model, one pattern and one rule at a time."""
    names, defects = list(weak_rules.RULES), list(weak_rules.DEFECTS.values())
    m, kinds = len(names), len(defects) + 1
    first = [[weak_rules.FALSE_ALARM] * m] + [[weak_rules.HIT if r in own else weak_rules.OTHER for r in names] for own in defects]
    start = [weak_rules.GOOD_SHARE] + [(1 - weak_rules.GOOD_SHARE) / len(defects)] * len(defects)
    rate, share, belief = first, start, weak_rules.BELIEF * sum(counts)

    def posterior(p):
        votes = [p // 3 ** (m - 1 - j) % 3 for j in range(m)]
        out = []
        for k in range(kinds):
            like = share[k]
            for j, v in enumerate(votes):
                like *= rate[k][j] if v == 2 else 1 - rate[k][j] if v == 0 else 1
            out.append(like)
        return votes, [x / sum(out) for x in out]

    for _ in range(weak_rules.ROUNDS):
        bad, voted, mass = [[0.0] * m for _ in range(kinds)], [[0.0] * m for _ in range(kinds)], [0.0] * kinds
        for p, c in zip(patterns, counts):
            votes, post = posterior(p)
            for k in range(kinds):
                mass[k] += c * post[k]
                for j, v in enumerate(votes):
                    bad[k][j] += c * post[k] * (v == 2)
                    voted[k][j] += c * post[k] * (v != 1)
        rate = [[(bad[k][j] + belief * first[k][j]) / (voted[k][j] + belief) for j in range(m)] for k in range(kinds)]
        weight = [mass[k] + belief * start[k] for k in range(kinds)]
        share = [w / sum(weight) for w in weight]
    return [posterior(p)[1][0] for p in patterns]


def test_vote_model_like_brute_force():
    rng = random.Random(2)
    patterns = sorted({sum(rng.choice([0, 0, 0, 1, 2]) * 3**j for j in range(len(weak_rules.RULES))) for _ in range(60)})
    counts = [rng.randint(1, 500) for _ in patterns]
    model = weak_rules.VoteModel.fit(np.array(patterns), np.array(counts))
    assert np.allclose(model.posterior(np.array(patterns)), brute_em(patterns, counts), atol=1e-9)


#: Mostly good texts, some with a lone weak vote, and junk that several rules see.
VOTES = {
    pattern(): 9000,
    pattern(repeated_lines=2): 150,
    pattern(open_lines=2): 60,
    pattern(symbols=2, words_with_symbols=2, marks_in_words=2): 500,
    pattern(echoed_words=2, few_distinct_words=2, repeated_phrases=1): 200,
    pattern(shouted_words=2, exclamations=2): 90,
}


@pytest.mark.parametrize("scale", [1, 1000])
def test_lone_votes_are_outweighed_and_joint_ones_are_not(scale):
    patterns = np.array(sorted(VOTES))
    model = weak_rules.VoteModel.fit(patterns, np.array([scale * VOTES[p] for p in patterns.tolist()]))
    good = lambda **votes: float(model.posterior(np.array([pattern(**votes)]))[0])
    assert good() > 0.99
    # one weak bad vote, with the other rules for that defect voting good
    assert good(repeated_lines=2) > 0.9 and good(open_lines=2) > 0.5 and good(symbols=2) > 0.5
    # the same vote where the rules that could outweigh it agree or abstain
    assert good(symbols=2, words_with_symbols=2, marks_in_words=2) < 0.01
    assert good(symbols=2, words_with_symbols=1, marks_in_words=2) < 0.1
    assert good(echoed_words=2, few_distinct_words=2) < 0.1
    assert good(shouted_words=2, exclamations=2) < 0.1


def test_verdicts_differ_from_all_must_pass(spark):
    """A text with some repeated lines and nothing else wrong stays."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        text = prose(rng, 150).replace(". ", ".\n")
        if i % 8 == 0:
            text += "\nRead more." * 6
        elif i % 8 == 1:
            text = junk(rng, 150)
        rows.append((i, text, "en", "s", 1))
    table = pa.array([r[1] for r in rows], pa.string())
    votes = weak_rules.decode(weak_rules.vote_pattern(text_stats(table)))
    failing = {i for i in range(400) if (votes[i] == weak_rules.BAD).any()}
    kept = {r["doc_id"] for r in weak_rules.judge(documents(spark, rows), workspace(spark)).filter("kept").collect()}
    assert {i for i in range(400) if i % 8 == 0} <= failing & kept
    assert not {i for i in range(400) if i % 8 == 1} & kept


def test_judge_awkward_rows(spark):
    got = weak_rules.judge(cluttered(spark), workspace(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] in (0, 1, 2):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
        assert not (r["base_failed"] and r["kept"])
    assert weak_rules.judge(documents(spark, []), workspace(spark)).count() == 0


def test_keep_good_rows(spark, corpus):
    kept = weak_rules.keep_good(cluttered(spark, corpus[0]), workspace(spark))
    assert kept.columns == cluttered(spark, corpus[0]).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, y in corpus[1] if y}
    assert weak_rules.keep_good(documents(spark, []), workspace(spark)).count() == 0


def test_passages_cover_whole_texts():
    texts = ["", None, "a", " ".join(["word"] * 64), " ".join(["word"] * 65), " ".join(f"w{i}" for i in range(1000))]
    bags = np.concatenate([b for b, _ in mil_quality.encode_passages(pa.array(texts, pa.string()))])
    assert bags.tolist() == [1, 1, 1, 1, 2, 16]
    x = np.concatenate([x for _, x in mil_quality.encode_passages(pa.array(texts, pa.string()))])
    assert np.isfinite(x).all() and not x[:2].any() and x[2:].any(axis=1).all()


def brute_passages(text):
    """The features of each passage of a text, one passage, word and pair at a time."""
    raw = (text or "").encode()
    found = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out = []
    for at in range(0, max(1, len(found)), mil_quality.PASSAGE_WORDS):
        own = found[at : at + mil_quality.PASSAGE_WORDS]
        x = np.zeros(mil_quality.WIDTH)
        if own:
            follows = found[at + len(own)][0] if at + len(own) < len(found) else len(raw)
            span, words, n = raw[own[0][0] : follows], [w for _, w in own], len(own)
            for a, b in zip(span, span[1:]):
                x[mil_quality._PAIR_SLOT[256 * a + b]] += 1
            x[: mil_quality.PAIRS] = np.sqrt(x[: mil_quality.PAIRS] / max(1, len(span) - 1))
            upper = lambda w: sum(65 <= c <= 90 for c in w)
            lower = lambda w: sum(97 <= c <= 122 for c in w)
            x[mil_quality.PAIRS :] = [
                len(set(words)) / n,
                sum(a == b for a, b in zip(words, words[1:])) / n,
                sum(len(w.decode()) for w in words) / n / 8,
                sum(upper(w) >= 2 and not lower(w) for w in words) / n,
                sum(any(c in b"#*$%&|<>" for c in w) for w in words) / n,
                n / mil_quality.PASSAGE_WORDS,
                sum(w[0] < 65 for w in words) / n,
            ]
        out.append(x)
    return out


def brute_score(model, text):
    """The attention model's score, passage by passage."""
    w = {k: np.asarray(v, np.float64) for k, v in model.weights.items()}
    if "share" in w:
        return float(w["share"])
    hidden, energy = [], []
    for x in brute_passages(text):
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        gate = [1 / (1 + np.exp(-float(h @ u))) for u in w["U"].T]
        hidden.append(h)
        energy.append(sum(a * np.tanh(float(h @ v)) * g for a, v, g in zip(w["a"], w["V"].T, gate)))
    weight = np.exp(np.array(energy) - max(energy))
    z = sum(e * h for e, h in zip(weight / weight.sum(), hidden))
    return 1 / (1 + np.exp(-float(z @ w["c"] + w["d"])))


def test_encoding_and_scores_like_brute_force(spark, corpus):
    rows = ROWS + [(9000, "  \n lead and more\t" * 30, "en", "a", 1), (9001, "\n\n after white space " + "x " * 130, "en", "a", 1), *((5000 + r[0], *r[1:]) for r in corpus[0][:40])]
    texts = [r[1] for r in rows]
    got = np.concatenate([x for _, x in mil_quality.encode_passages(pa.array(texts, pa.string()))])
    assert np.allclose(got, np.concatenate([brute_passages(t) for t in texts]), atol=1e-5)
    model = mil_quality.fit_quality(documents(spark, corpus[0]), spark.createDataFrame(corpus[1], "doc_id long, quality int"))
    assert "share" not in model.weights
    scores = {}
    for r in mil_quality.score_quality(documents(spark, rows), model).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        assert np.allclose(scores[doc_id], brute_score(model, text), atol=1e-3)


def test_encoding_does_not_depend_on_blocks():
    texts = pa.array([r[1] for r in ROWS] + ["  lead", "\n", " and more"], pa.string())
    whole = np.concatenate([x for _, x in mil_quality.encode_passages(texts)])
    one = np.concatenate([x for t in texts for _, x in mil_quality.encode_passages(pa.array([t.as_py()], pa.string()))])
    assert np.allclose(whole, one)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    model = mil_quality.AttentionModel.start(1, hidden=5, gate=4)
    w = model.weights
    for k in w:
        w[k] = w[k].astype(np.float64)
    x, bags, y = rng.normal(size=(9, mil_quality.WIDTH)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    w["mean"], w["scale"] = np.zeros(mil_quality.WIDTH), np.full(mil_quality.WIDTH, 3.0)

    def loss():
        p = model.forward(x, bags)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradients(x, bags, y)
    for k, g in grads.items():
        flat = w[k].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            kept = flat[i].copy()
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - np.asarray(g).reshape(-1)[i]) < 1e-4, k


def test_quality_held_out(spark, corpus):
    rows, labels = corpus
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = documents(spark, rows)
    got = mil_quality.score_quality(docs, mil_quality.fit_quality(docs, table)).collect()
    truth = dict(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_held_out_labels_do_not_matter(spark, corpus):
    rows, labels = corpus
    docs = documents(spark, rows[:200])
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    one, two = (mil_quality.fit_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)


def test_quality_awkward_rows(spark, corpus):
    labels = spark.createDataFrame(corpus[1] + [(None, 1), (9999, None)], "doc_id long, quality int")
    model = mil_quality.fit_quality(documents(spark, corpus[0][:300]), labels)
    got = mil_quality.score_quality(cluttered(spark), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    kept = mil_quality.keep_good(cluttered(spark), model)
    assert kept.columns == cluttered(spark).columns
    assert kept.count() == sum(r["predicted"] for r in got)
    assert mil_quality.score_quality(documents(spark, []), model).count() == 0
    none = mil_quality.fit_quality(documents(spark, []), labels)
    assert {r["score"] for r in mil_quality.score_quality(documents(spark), none).collect()} == {0.5}
