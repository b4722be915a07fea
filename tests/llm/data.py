"""Small documents that hold every awkward case, and plain ones around them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, h string, n_lines long, ids string"

WORDS = "river stone light meadow winter harbour copper lantern quiet garden window thread marble violet thunder candle orchard silver velvet compass".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n)).capitalize() + "."


def paragraph(rng: random.Random, lines: int = 5) -> str:
    return "\n".join(sentence(rng, rng.randint(8, 16)) for _ in range(lines))


def rows(n: int = 30, seed: int = 1, awkward: bool = True) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[tuple] = [(k, paragraph(rng), "en" if k % 3 else "fr", f"s{k % 2}") for k in range(n)]
    if awkward:
        long = " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(60_000))
        texts += [
            (n, None, None, None),
            (n + 1, "", "en", "s0"),
            (n + 2, " \t\n \n", "en", "s0"),
            (n + 3, long, "en", "s0"),
            (n + 4, texts[0][1], "en", "s1"),  # a copy
            (n + 4, texts[0][1], "en", "s1"),  # a repeated row
            (n + 5, "é", "fr", None),
            (n + 6, "word " * 5000, "en", "s0"),
            (n + 7, "x" * 70_000, "en", "s0"),
            (n + 8, "one two", "en", "s0"),
            (n + 9, "Ünï cödé <|endoftext|> \U0001f600 don't 12½\r\nend", "de", "s0"),
        ]
    return [(i, t, lang, source, len(t or ""), -i, 0.5, "h", 7, "x") for i, t, lang, source in texts]


def documents(spark, n: int = 30, seed: int = 1, awkward: bool = True):
    return spark.createDataFrame(rows(n, seed, awkward), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
