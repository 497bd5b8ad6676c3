"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use for results or inside; extra columns of these names must pass through.
CLASHES = ("score", "kept", "keep_id", "size", "component_id", "rank", "_text", "text_sha256", "fp", "_digest", "target")

WORDS = ["the", "river", "carries", "small", "stones", "under", "old", "bridges", "while", "people", "walk", "slowly",
         "toward", "market", "square", "and", "talk", "about", "weather", "bread", "books", "music", "children", "evening"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.1 else "") for _ in range(n)).capitalize() + "."


def documents(spark, rows, extra: bool = False):
    """Documents from (doc_id, text[, source]) tuples; ``extra`` adds columns with clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        df = df.selectExpr("*", *[f"'x' as {name}" for name in CLASHES])
    return df


def awkward(spark, extra: bool = True):
    """Nulls, empty and blank texts, repeats, ties and a long text."""
    long = " ".join(prose(900, s) for s in range(40))
    return documents(spark, [
        (1, "alpha beta gamma delta", "a"), (2, "alpha beta gamma delta", "a"), (2, "alpha beta gamma delta", "a"),
        (3, None, None), (4, "", "b"), (5, " \t\n", None), (None, "alpha beta gamma delta", "b"), (None, None, "a"),
        (6, "Ünïcödé \U0001f600 words 'don't' <|endoftext|> x  y", "b"), (7, long, "c"), (8, "word", "c"),
        (9, prose(60, 1), "a"), (10, prose(60, 1) + " more", "b"), (10, "other text of the same id", "b")], extra)
