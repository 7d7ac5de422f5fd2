import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans string, label string, component_id string, value string, _row_key string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, and repeated rows."""
    rng = random.Random(7)
    passage = prose(rng, 120)
    base = [prose(rng, n) for n in (3, 30, 60, 200, 400)]
    rows = [(1, base[1]), (2, base[1]), (3, base[2]), (4, base[2] + " extra"), (5, "x " + passage + " y"), (6, prose(rng, 50) + passage), (7, None), (8, ""), (None, "no id here"), (None, None), (9, base[0]), (9, base[0]), (10, " \n\t "), (11, base[3]), (12, base[3].replace("alpha", "ALPHA")), (13, prose(rng, 5000)), (14, "word"), (15, "two words"), (16, "two words"), (17, base[4][:900]), (18, base[4])]
    near = base[3].split()
    for i in range(12):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((20 + i, " ".join(copy)))
    rows += [(40 + i, "é" * 500 + chr(200 + i)) for i in range(3)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
