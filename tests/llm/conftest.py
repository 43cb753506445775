"""Small documents with the cases that every operator must take: nulls, empty and blank texts,
repeated rows, ties, long texts, and extra columns named like the operators' own."""

import random

import pytest

from tests.conftest import spark  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls long, kept boolean, size long, `rank` int, bucket long, path string, m string, failed_bits long, row_key long, k1 long"


def rows_of(texts, first=1, source=lambda i: f"s{i % 3}"):
    return [(first + i, t, "en", source(i), None if t is None else len(t), 7, 7, False, 7, 7, 7, "p", "m", 7, 7, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):  # noqa: F811
    def make(texts, **kw):
        return spark.createDataFrame(rows_of(texts, **kw), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in every column, repeated rows and equal texts under several ids."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(6000))
    passage = " ".join(rnd.choice(words) for _ in range(50))
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 200))) for _ in range(20)]
    texts = [None, "", "  \n\t ", "one", "a b c d", "A B\x0bC D E", long, prose[0], prose[0], prose[1] + " x", prose[1],
             *[p + "\n" + passage + " " + p[::-1] for p in prose[2:8]], *prose[8:], "x y 　 café ß", "same same same same same same"]
    rows = rows_of(texts)
    rows.append(rows[7])  # a repeated row
    none = list(rows[9])
    none[0], none[3] = None, None
    rows.append(tuple(none))
    rows.append(tuple(none))
    rows.append((None,) * len(rows[0]))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):  # noqa: F811
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)
