"""Small documents with what goes wrong in large tables: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns that operators use inside
CLASH = ["body", "key", "digest", "group", "shard", "kept", "h", "words", "seed", "bucket", "times", "size", "score", "lang_pred", "topic", "tokens", "weight", "unit", "codes"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):03d}x" for _ in range(n))


def corpus():
    rng = random.Random(4)
    base = [prose(rng, 120, 100000) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    shared = prose(rng, 50, 100000)
    near = base[3].split()
    near[60] = "changed"
    more = [
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        base[0],
        base[0],
        base[1] + " \n " + prose(rng, 30),
        prose(rng, 20) + " " + shared + " " + prose(rng, 25),
        prose(rng, 7) + " " + shared + "\t" + prose(rng, 90),
        " ".join(near),
        " ".join(["again and again"] * 40),
        "x" * 300,
        "éàü" * 100 + " " + "x" * 90,
        prose(rng, 20_000, 100000),
        "A" * 20_000,
        "AB cd EF gh IJ kl",
        "ab cd ef gh ij kl",
    ]
    rows += [(20 + i, t, None if i % 5 == 0 else "de", None if i % 4 == 0 else "s9", None) for i, t in enumerate(more)]
    rows.append(rows[2])  # a repeated row
    rows.append((900, base[5], "en", "s1", None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
