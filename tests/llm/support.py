"""Fixtures of the corpus operators' tests: small documents with odd rows, and the columns that may clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, digest string, n long"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), len(r[1] or ""), "w", "d", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_texts(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    words = ["the", "Thing", "of,", "été", "Straße", "naïve.", "a b", "x\x1cy", "éa", "don't", "we'll!!", "<|endoftext|>", "ab<|endoftext|>cd", "42", "4.2", "İx", "ΣΑΣ", "日本", "🙂!", " ", "#*$", "MIT", "License", "\x0b"]
    out = [None, "", " ", "\n", "a", " ", "x" * 5000, "Ab. " * 4000]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n", ", "]) for _ in range(rng.randint(1, 80))))
    return out
