import random

import pytest

from llm_samples import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves, as columns of an input.
CLASHES = ("n_words", "KEPT", "score", "predicted", "n_tokens", "taken", "license", "spans",
           "component_id", "text_key", "key", "n_entities", "size", "coverage", "_found", "n", "u")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashes."""
    rng = random.Random(4)
    plain = prose(rng, 80)
    rows = [(1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (2, plain + " tail", "en", "a", 2),
            (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n", "en", "b", 3),
            (None, plain, None, None, None), (None, None, None, None, None),
            (6, prose(rng, 60_000, 5000), "en", "b", 9), (7, "x" * 300_000, "en", "", 1),
            (8, "three short words", "en", "c", 1), (9, "three short words", "fr", "c", 1),
            (10, "x@y.org +1 (803) 555-5351 \x00 é　日本 😀", "de", "c", 1),
            (11, prose(rng, 90), "en", "b", 1), (-5, prose(rng, 90) + "\n" * 500, "en", "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'own' as `{c}`" for c in CLASHES)).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
