import random

import pytest

SYLLABLES = {
    "en": "the th er on an re he in ed nd ha at en es of or nt ea ti to it st is ar".split(),
    "de": "der die und sch ein ich en ung keit zu ge ver be ach heit tz pf ö ü ä".split(),
}


def sentence(pick: random.Random, words: int, lang: str = "en") -> str:
    part = SYLLABLES[lang]
    return " ".join("".join(pick.choice(part) for _ in range(pick.randint(1, 4)))
                    for _ in range(words))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, odd and missing values."""
    pick = random.Random(7)
    rows: list[tuple] = []

    def add(text, lang="en", source="a"):
        rows.append((len(rows), text, lang, source, len(text) if text else 0))

    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        add(sentence(pick, pick.randint(30, 120), lang), lang, ("a", "b", "c", "d", None)[i % 5])
    base = sentence(pick, 200)
    for i in range(25):  # a large group of near copies, some farther from each other
        words = base.split()
        for _ in range(i % 5):
            words[pick.randrange(200)] = "x" + str(pick.randrange(9999))
        add(" ".join(words), source="b")
    for _ in range(4):
        add(rows[3][1], "de")
    add(rows[5][1].upper())
    for text in (None, "", "  \n\t ", "one", "Two words", "two  words", "a b c", "a b c d", "é è",
                 "<|endoftext|> it's  me ", "12 345 ... !!", "日本 語", "tab\tand\x0bvt \x1c x"):
        add(text, None if text is None else "en", "odd")
    add(" ".join(sentence(pick, 30) for _ in range(300)), source="long")
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Missing ids, rows that repeat, and columns named like those that operators make."""
    rows = [(None, "alpha beta gamma delta", "en", "s", 1), (None, None, None, None, 2),
            (1, "alpha beta gamma delta", "en", "s", 3), (1, "alpha beta gamma delta", "en", "s", 3),
            (2, "alpha beta gamma delta", "en", None, 4), (2, "other words in here", "en", "t", 4)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, size bigint").selectExpr(
        "*", "1 AS key", "'x' AS id", "2 AS n", "3 AS kept", "4 AS part", "5 AS _range",
        "array(1) AS spans", "6 AS rid", "7 AS taken", "8 AS home")
