from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, h long, key long, shard int, size long, tie long, "
    "words string, score double, bin long, node long, part int, spans string, copied int, _h long, trusted int, word string"
)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "te", "ru", "so", "ne", "va", "di", "po"]
    words = ["".join(rng.choice(syllables) for _ in range(1 + i % 3)) for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows(texts):
    """(doc_id, text) with columns whose names clash with those that operators use inside."""
    return [
        (i, t, ("en", "de", None)[k % 3], None if k % 4 == 0 else f"src{k % 3}", None if t is None else len(t), *[None if k % 2 else 7] * 5,
         *[1, "x", 0.5, 3, 9, None, "y", 1, None, 1, "z"])
        for k, (i, t) in enumerate(texts)
    ]


def edge_texts():
    base, other = prose(1, 120), prose(2, 60)
    passage = prose(3, 30)
    near = base.split()
    near[60] = "changed"
    return [
        (5, base), (1, base), (9, " ".join(near)), (3, None), (4, ""), (12, " \t\n\x0b "), (20, other), (21, passage + " " + prose(4, 15)),
        (22, prose(5, 40) + "\n" + passage + "\r\n" + prose(6, 22)), (23, "one"), (24, "one two"), (25, "a " * 90), (26, prose(7, 20)),
        (27, prose(7, 19)), (28, prose(7, 20)), (30, "Ünïcödé ẞtraße é 日本語 \U0001f600 <|endoftext|> </s>[INST] don't 1234  x y"),
        (31, prose(8, 30_000)), (None, prose(9, 50)), (40, prose(10, 45)), (40, prose(10, 45)), (-7, passage), (50, "x" * 70_000),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(edge_texts()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
