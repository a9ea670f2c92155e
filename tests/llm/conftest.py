import random

import pytest

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "ra", "lis")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus() -> list[tuple]:
    """Edge cases first, then exact and near copies, shared passages and a very long text."""
    rng = random.Random(3)
    rows = [
        (1, None, "en", "b", None), (2, "", "en", "b", 0), (3, " \n\t ", "de", None, 4), (4, "one", None, None, 3),
        (5, "One two THREE", "en", "a", 13), (6, "one two three", "en", "a", 13), (7, "été à la\r\nplage  d'un", "fr", "ü", 22),
        (8, "<|endoftext|> don't 日本語 テスト 12", "ja", "ü", 30), (9, "x" * 5000, "en", "a", 5000),
    ]
    base = [sentence(rng, 80) for _ in range(6)]
    shared = sentence(rng, 60)
    for n, text in enumerate(base):
        rows.append((20 + n, text, "en", "a", len(text)))
        rows.append((30 + n, text, "en", "b", len(text)))
        rows.append((40 + n, edited(rng, text, 1), "de", "a", len(text)))
        body = sentence(rng, 30) + "\n" + shared + "\n" + sentence(rng, 25)
        rows.append((50 + n, body, "fr", None, len(body)))
    long = "\n".join(sentence(rng, 200) for _ in range(40))
    rows += [(70, long, "en", "c", len(long)), (71, long, "en", "c", len(long)), (None, base[0], "en", "a", 5), (20, base[0], "en", "a", 5)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size long, fp long, component_id long, target double, node long, key long, label int, length int, shard int, spans string"


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with further columns whose names the operators use themselves."""
    extra = tuple([None] * len(CLASH.split(", ")))
    return spark.createDataFrame([r + extra for r in corpus()], f"{SCHEMA}, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")
