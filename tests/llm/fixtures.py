"""Small tables with the odd rows every operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def syllables(rng: random.Random, n: int) -> str:
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def odd_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    base = [syllables(rng, rng.randint(15, 80)) for _ in range(12)]
    texts = [*base, None, "", "   \n\t ", "one", "Two words", "the the the", base[0], base[0], "É" * 300, "x" * 20_000, syllables(rng, 4000), "a b \x00 c  d\r\ne", "😀 ▁ </s> <0x0A>", "\x1c\n\x1d \x1e\n\x85\n\xa0 x", "今天天气很好。\nภาษาไทยไม่มีช่องว่าง\nयह हिंदी है।\nهل هذه جملة؟"]
    words = base[1].split(" ")
    texts.append(" ".join([*words[:-1], "changed."]))
    return [(i, t, None if i % 5 == 0 else "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, rows=None):
    """The odd rows, with a repeated row and columns whose names the operators use themselves."""
    rows = odd_rows() if rows is None else rows
    return (
        spark.createDataFrame([*rows, *rows[3:4]], SHAPE)
        .withColumns({c: F.lit("clash") for c in ("node", "score", "word", "label", "k", "t", "row", "size", "held_out_", "prefix", "class")})
        .repartition(3)
    )


def empty(spark):
    return spark.createDataFrame([], SHAPE)
