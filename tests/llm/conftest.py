import random

import pytest

SCHEMA = "doc_id long, text string, kept boolean, rep long, id long, left_text string, n_chars long"


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, periods, nulls, empties, a very long one and ties."""
    random.seed(5)
    vocabulary = ["".join(random.choices("abcdeéz", k=random.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(random.choices(vocabulary, k=n))
    passage, base = prose(60), prose(150)
    rows: list[tuple[int, str | None]] = [(k, prose(random.randint(1, 250))) for k in range(2, 40)]
    rows += [(50 + k, f"{prose(20)}\n{passage} {prose(30)}") for k in range(8)]
    rows += [(70 + k, base) for k in range(6)] + [(80, base.replace(" ", "\n\t", 3)), (81, base.upper())]
    for k in range(25):
        words = base.split()
        for at in random.sample(range(150), k % 9):
            words[at] = random.choice(vocabulary) + "x"
        rows.append((100 + k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "one two three"), (205, "ONE two\tthree")]
    rows += [(210, "ab" * 300), (211, "x" * 900), (212, prose(30) + " " + "na " * 200), (213, "y" * 199), (214, "y" * 200)]
    rows += [(220, prose(15_000)), (221, "▁a  b é\U0001f389 <s> <0x41> <|endoftext|> don't 12")]
    random.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 2, "?", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without id and repeated rows."""
    text = "the same words over and over " * 40
    return spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (None, "other " * 50), (3, None)], "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
