"""Small documents with nulls, empty and long texts, copies and repeated rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, epoch int, n_words long, starts string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def documents(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(words(rng, 45))
    for i in range(5, 15):
        texts[i] = f"{texts[i]} {passage}\n" + " ".join(words(rng, 10))
    base = words(rng, 90)
    for i in range(15, 22):
        copy = list(base)
        copy[rng.randrange(90)] = f"edit{i}"
        texts[i] = " ".join(copy)
    texts[22] = texts[23] = texts[24] = texts[3]
    texts[25], texts[26], texts[27] = None, "", " \n\t "
    texts[28] = " ".join(words(rng, 5) * 400)
    texts[29] = "x" * 50_000 + " é 漢字 𝒳 " + "y " * 3000
    texts[30] = "one two"
    texts[31] = "a\x0bb\x1cc d  e\r\nf"
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", "src2", None]), len(t or ""), 0.5, 7, 3, 1, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[25], (None, "a text without an id", "en", "src1", 20, None, None, None, None, None)]


def frame(spark, rows: list[tuple] | None = None):  # noqa: ANN001, ANN201
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
