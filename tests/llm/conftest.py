import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept int, size string, row long, target string, _id int, part int, n int, h string"


def _words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=3):
    """(doc_id, text, source): nulls, empty and blank texts, one very long word and text, copies, near copies, repeated rows, equal ids."""
    rng = random.Random(seed)
    passage, base = _words(rng, 70), _words(rng, 120)
    rows = [(None, "alone without id", "a"), (None, None, None), (1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, "one", "a"), (5, "one two three four", "b")]
    rows += [(6, "x" * 50_000, "a"), (7, _words(rng, 30_000), "b"), (8, "be " * 300, "a"), (9, "be " * 130 + "not to be", "c"), (10, "be not " * 90, "c")]
    rows += [(20 + k, base, "hot") for k in range(8)]
    near = base.split()
    rows += [(40 + k, " ".join([*near[: 10 * k], "edit", *near[10 * k + 1 :]]), "hot") for k in range(9)]
    rows += [(60 + k, f"{_words(rng, rng.randrange(60))} {passage} {_words(rng, rng.randrange(60))}", "hot") for k in range(12)]
    rows += [(80, base, "d"), (80, base, "d"), (80, "another text of this id", "d"), (81, "one two three four", "d")]
    rows += [(100 + k, _words(rng, rng.randrange(1, 200)), rng.choice("abc")) for k in range(40)]
    rows += [(200, "Grüße aus Köln und ΑΘΗΝΑ  doppelt \n neu", None), (-5, "negative id", "a")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, None, s, None, "clash", 1, "clash", d, None, 2, 3, None, "clash") for d, t, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()
