import random

import pytest

WORDS = "the of tion and è wörd lorem ipsum dolor amet Sit x9 日本 z".split()


def random_text(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n)).strip()


def corpus(seed: int, size: int) -> list[tuple[int, str]]:
    """Documents with exact and near copies, shared passages and repeats."""
    rnd = random.Random(seed)
    passages = [random_text(rnd, 40) for _ in range(4)]
    out: list[tuple[int, str]] = []
    for i in range(size):
        kind = rnd.random()
        if kind < 0.15 and out:
            text = rnd.choice(out)[1]
        elif kind < 0.35 and out:
            letters = list(rnd.choice(out)[1])
            for _ in range(2):
                if letters:
                    letters[rnd.randrange(len(letters))] = rnd.choice("qé")
            text = "".join(letters)
        elif kind < 0.5:
            text = random_text(rnd, 30) + "\n" + rnd.choice(passages) + "\n" + random_text(rnd, 20)
        elif kind < 0.55:
            text = "Shti " * rnd.randint(20, 90)
        else:
            text = random_text(rnd, rnd.randint(0, 120))
        out.append((rnd.randrange(10**6) * 3 + i % 3, text))
    return list(dict(out).items())


@pytest.fixture(scope="session")
def llm_docs(spark):
    rows = corpus(11, 150)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


#: Nulls in both columns, empty and blank texts, repeated rows and ids, a long text.
EDGE_ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id that has more than ten words in it, ok then"),
    (None, None), (5, "same text of a repeated row"), (5, "same text of a repeated row"),
    (6, "one id"), (6, "two texts"), (7, "token = \"abcdef123\" " + "word " * 60_000), (8, "\U0001f600 é" * 20),
]
#: Column names that operators use inside.
CLASHING = "words start end key d t fp band n_words score kept text_key removed spans base count at wid label hot mini".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with many columns whose names operators use themselves."""
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in EDGE_ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def few_labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def few_items(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "repeated row"), (2, None), (3, ""), (4, "word " * 40)]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS words", "'y' AS wid")
