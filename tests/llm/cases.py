"""Awkward documents that every operator has to take."""

from __future__ import annotations

from tessera.llm.store import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank. "

ROWS = [
    (0, None, "en", "a", None),
    (1, "", "en", None, 0),
    (2, " \t\n\x0b\x0c\r ", None, "a", 7),
    (3, "one", "en", "a", 3),
    (4, "one two three four", "en", "b", 18),
    (5, PROSE, "en", "b", 1),
    (6, PROSE.upper(), "en", "b", 1),
    (7, PROSE + "and then some", "en", "b", 1),
    (8, " ".join(f"w{i}" for i in range(30000)), "en", "c", 1),
    (9, " ".join(f"w{i}" for i in range(29990)) + " tail", "en", "c", 1),
    (10, "é" * 500 + " ñandú İstanbul ΑΣ 日本語 🙂🙃 <|endoftext|> don't", "es", "c", 1),
    (11, PROSE, "en", "a", 1),
    (11, PROSE, "en", "a", 1),
    (12, "x" * 9000, "en", "a", 1),
    (13, "a\x00b \x1c c\x85d e", "en", "a", 1),
    (None, PROSE, "en", "a", 1),
]

#: Names that operators use themselves, as extra columns of the input.
CLASHING = ("content", "folded", "bitmap_hit", "rank", "shard", "key", "label", "weight", "kept", "score", "n_words", "pattern", "size", "place", "bucket", "component", "hi", "length", "piece")


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def cluttered(spark, rows=ROWS):
    """The documents with clashing extra columns."""
    out = documents(spark, rows)
    for name in CLASHING:
        out = out.selectExpr("*", f"'clash' AS {name}")
    return out


def workspace(spark):
    return Workspace(spark, "test")


def as_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
