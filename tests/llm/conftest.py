import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """Rows with nulls, empty and long texts, ties, repeated rows, exact and near copies."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(n) for n in (0, 1, 3, 5, 60, 80, 120, 200, 300, 3000)]
    rows, k = [], 0
    for text in base + [None, "", "   \n\t ", base[5] + "  ", base[5].replace(" ", "\n"), base[6], base[6]]:
        rows.append((k, text, "en", f"src{k % 3}", len(text or "")))
        k += 1
    for n in range(6):  # near copies: a few words changed
        w = base[8].split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w), "en", None, None))
        k += 1
    shared = prose(70)
    for n in range(4):  # one passage in many documents
        rows.append((k, f"{prose(90)}\n{shared}\n{prose(40)}", None, "src0", 0))
        k += 1
    rows += [rows[4], rows[6], (None, base[7], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    return df.withColumnsRenamed({}).selectExpr("*", "1 AS n", "'x' AS key", "2 AS size", "3 AS row", "0.5 AS score")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
