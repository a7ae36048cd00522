"""Small corpora for tests: odd rows, repeats, and random texts over few words."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add.
CLASHES = ("hash", "id", "row", "n_words", "kept", "copy", "Size", "fp", "root", "__hash", "__id", "__kept", "__m_id", "__lines", "segment", "items", "posterior", "pattern")


def docs(spark, texts, sources=None):
    """A row per text, numbered from 0; (id, text) pairs keep their ids."""
    rows = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        rows.append((key, text, "en", sources[i] if sources else "web", len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """df with extra columns named as operators' own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


def random_texts(seed: int, n: int, words: int = 6, most: int = 60, newline: float = 0.15) -> list[str | None]:
    """Texts over few words, so that repeats of every kind occur; some null, some empty, some copies."""
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "é", "ω-x", "a1", "BETA"][:words]
    out: list[str | None] = []
    for _ in range(n):
        roll = r.random()
        if roll < 0.05:
            out.append(None)
        elif roll < 0.1:
            out.append("")
        elif roll < 0.2 and out:
            out.append(r.choice(out))
        else:
            out.append("".join(r.choice(vocabulary) + ("\n" if r.random() < newline else r.choice([" ", "  ", "\t"])) for _ in range(r.randint(0, most))))
    return out
