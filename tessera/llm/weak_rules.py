"""Quality rules by weak supervision.

Each rule votes good or bad, or abstains.  Several rules look at each kind of defect
from different sides.  How often good texts and texts of each kind get each rule's
bad vote is estimated without labels by expectation-maximisation over the counts of
vote patterns (at most 3 ** rules of them, whatever the input), and a text is judged
by its posterior probability of being good rather than by having to pass every rule:
a single weak vote is outweighed by the other rules for the same defect.

Priors stand for a share of the rows, so the estimates are alike at every size.

Defined results: null and empty texts have zero counts and fail the base rules;
very long texts are read whole; repeated rows get equal verdicts; an empty table
gives an empty result with the prior model; other columns are ignored (or, in
``keep_good``, returned untouched whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import named
from tessera.llm.caching import owned
from tessera.llm.store import Workspace
from tessera.llm.textstats import STATS, text_stats

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Kinds of defect, each with its rules - name: (counts above and below the line of a
#: ratio, least lower count, good up to, bad from); between the two ratios the rule
#: abstains, and so it does where the lower count is under its least.
DEFECTS = {
    "marks": {
        "symbols": ("n_symbols", "n_words", 20, 0.02, 0.10),
        "words with symbols": ("n_symbol_words", "n_words", 20, 0.02, 0.10),
        "marks in words": ("n_marks", "word_chars", 100, 0.06, 0.10),
    },
    "repetition": {
        "repeated lines": ("n_dup_lines", "n_lines", 3, 0.05, 0.20),
        "repeated phrases": ("n_repeat_words", "n_words", 20, 0.10, 0.25),
        "echoed words": ("n_echo_words", "n_words", 10, 0.03, 0.10),
        "few distinct words": (("n_words", "n_distinct_words"), "n_words", 20, 0.40, 0.50),
    },
    "shouting": {
        "shouted words": ("n_loud_words", "n_words", 5, 0.05, 0.20),
        "exclamations": ("n_bang", "n_words", 5, 0.05, 0.15),
    },
    "layout": {
        "open lines": (("n_lines", "n_closed_lines"), "n_lines", 3, 0.30, 0.60),
        "short lines": ("n_lines", "n_words", 20, 0.20, 0.34),
    },
}
RULES = {name: rule for rules in DEFECTS.values() for name, rule in rules.items()}
GOOD, ABSTAIN, BAD = 0, 1, 2
#: A text stays if its posterior probability of being good is at least this.
KEEP_FROM = 0.5
ROUNDS = 50
#: What is believed beforehand: how often rules vote bad on good texts, on texts with
#: the defect that they look for, and on others; and the share of good texts.
FALSE_ALARM, HIT, OTHER, GOOD_SHARE = 0.02, 0.8, 0.1, 0.9
#: The weight of these beliefs, for each kind, as a share of all rows.
BELIEF = 0.05


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    n = stats["n_words"]
    return (n < 50) | (100 * stats["n_repeat_words"] > 50 * n)


def vote_pattern(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules as one number in base 3."""
    code = np.zeros(len(stats["n_words"]), np.int64)
    for above, below, least, good, bad in RULES.values():
        top = stats[above] if isinstance(above, str) else stats[above[0]] - stats[above[1]]
        bottom = stats[below]
        ratio = top / np.maximum(bottom, 1)
        vote = np.where(bottom < least, ABSTAIN, np.where(ratio >= bad, BAD, np.where(ratio <= good, GOOD, ABSTAIN)))
        code = code * 3 + vote
    return code


def decode(patterns: np.ndarray) -> np.ndarray:
    """Patterns as rows of votes."""
    m = len(RULES)
    return (np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3


class VoteModel:
    """P(bad vote | voted, kind) of each rule, and the share of each kind of text.

    Kind 0 is good, the others have one defect each.  Junk of one kind passes the rules
    for the others, so one class for all junk would let many good votes outweigh the
    few rules that see it.
    """

    def __init__(self, bad_vote: np.ndarray, share: np.ndarray):
        self.bad_vote, self.share = bad_vote, share  # (kinds, rules), (kinds,)

    @classmethod
    def prior(cls) -> "VoteModel":
        bad_vote = [[FALSE_ALARM] * len(RULES)] + [[HIT if rule in own else OTHER for rule in RULES] for own in DEFECTS.values()]
        rest = (1 - GOOD_SHARE) / len(DEFECTS)
        return cls(np.array(bad_vote), np.array([GOOD_SHARE] + [rest] * len(DEFECTS)))

    def kinds(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior probability of each kind for each pattern."""
        votes = decode(patterns)
        z = np.log(self.share) + (votes == BAD) @ np.log(self.bad_vote).T + (votes == GOOD) @ np.log1p(-self.bad_vote).T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with the pattern is good."""
        return self.kinds(patterns)[:, 0]

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> "VoteModel":
        """Expectation-maximisation from the prior, which counts as ``BELIEF`` of the rows."""
        start = model = cls.prior()
        votes, counts = decode(patterns), np.asarray(counts, float)
        belief = BELIEF * counts.sum()
        for _ in range(rounds if belief else 0):
            weight = model.kinds(patterns) * counts[:, None]
            bad, voted = weight.T @ (votes == BAD), weight.T @ (votes != ABSTAIN)
            rates = (bad + belief * start.bad_vote) / (voted + belief)
            share = weight.sum(axis=0) + belief * start.share
            model = cls(rates, share / share.sum())
        return model


def _stat_rows(id_column: str, text_column: str):
    def run(batches):
        owned("rules")
        for batch in batches:
            stats = text_stats(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(stats[k]) for k in BASE), pa.array(base_failed(stats)), pa.array(vote_pattern(stats))],
                ["doc_id", *BASE, "base_failed", "pattern"],
            )

    return run


def _id_type(docs: DataFrame, id_column: str) -> str:
    return docs.schema[id_column].dataType.simpleString()


def rule_stats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed and the vote pattern of each row."""
    schema = f"doc_id {_id_type(docs, id_column)}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, pattern long"
    return docs.select(named(id_column).alias("doc_id"), named(text_column).alias("text")).mapInArrow(_stat_rows(id_column, text_column), schema)


def fit_votes(stats: DataFrame) -> VoteModel:
    """The vote model of a table of ``rule_stats``; collects pattern counts only."""
    rows = stats.groupBy("pattern").count().collect()
    rows.sort(key=lambda r: r["pattern"])
    return VoteModel.fit(np.array([r["pattern"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64))


def judge(docs: DataFrame, work: Workspace, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the base counts, base_failed, kept and p_good."""
    stats = work.keep(rule_stats(docs, id_column, text_column), "stats")
    model = fit_votes(stats)
    every = np.arange(3 ** len(RULES))
    table = [(int(p), float(q)) for p, q in zip(every, model.posterior(every))]
    posterior = docs.sparkSession.createDataFrame(table, "pattern long, p_good double")
    kept = ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)
    return stats.join(F.broadcast(posterior), "pattern").select("doc_id", *BASE, "base_failed", kept.alias("kept"), "p_good")


def keep_good(docs: DataFrame, work: Workspace, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    model = fit_votes(work.keep(rule_stats(docs, id_column, text_column), "stats"))
    stays = model.posterior(np.arange(3 ** len(RULES))) >= KEEP_FROM
    at = docs.columns.index(text_column)

    def run(batches):
        owned("rules")
        for batch in batches:
            stats = text_stats(batch.column(at))
            yield batch.filter(pa.array(~base_failed(stats) & stays[vote_pattern(stats)]))

    return docs.mapInArrow(run, docs.schema)
