import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, words int, n int"


def nasty_rows():
    """(doc_id, text) rows with nulls, empty and long texts, repeats, copies, near copies, shared passages and odd white space."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randint(1, 6))) for _ in range(120)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    passage = prose(30)
    rows = [(i, prose(rnd.randint(1, 80))) for i in range(40)]
    rows += [(40 + i, f"{prose(5)} {passage}\n{prose(7)}") for i in range(8)]
    rows += [(60, passage), (61, passage), (61, passage), (62, None), (None, passage), (None, None), (63, ""), (64, " \t\n\x0b\x0c\r "), (65, "one"), (66, "Two words joined")]
    near = prose(60).split()
    for i in range(6):
        rows.append((70 + i, " ".join(near[:-1] + [vocabulary[i]])))
    rows += [(80, f"{passage} {passage}"), (81, prose(3000)), (82, "same line\nother line\nthird line\n" * 3), (82, "another text of the id"), (83, "same line\nother line\nthird line"), (84, "日本語 テキスト 🙂 🙂 end"), (85, "x" * 4000)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return nasty_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as documents, with nulls in the other columns and extra columns of clashing names."""
    sources = ["a", "b", None, "Ä"]
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], sources[k % 4], len(t or ""), "c", k, k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def scratch(spark):
    from quern.scratch import Scratch

    return Scratch(spark)


def key(row):
    return tuple((x is None, str(x)) for x in row)
