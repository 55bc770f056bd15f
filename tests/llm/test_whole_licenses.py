"""Licences that stand twice in a text."""

import random

import pytest

from asfiled.llm.licenses import TEMPLATES, best_coverage, scan_licenses, words_of


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0-or-later", "ISC"])
@pytest.mark.parametrize("gap", [0, 3, 30, 200])
def test_a_licence_that_stands_twice_is_found(name, gap):
    rng, template = random.Random(gap), words_of(TEMPLATES[name])
    between = [rng.choice(["the", "of", "to", "and", "in", "x", "y"]) for _ in range(3 * gap)]
    text = between[:gap] + template + between[gap:2 * gap] + template + between[2 * gap:]
    assert best_coverage(text, template)[0] > 0.9


@pytest.mark.parametrize("name", sorted(TEMPLATES))
@pytest.mark.parametrize("marks", [("", "", ""), ("1. ", "2. ", "3. "), ("(a) ", "(b) ", "(c) ")])
def test_each_licence_has_its_own_name(spark, name, marks):
    """Also with numbered clauses, in a longer text."""
    text = TEMPLATES[name]
    for clause, mark in zip(("Redistributions of source", "Redistributions in binary", "Neither the name"), marks):
        text = text.replace(clause, mark + clause)
    docs = spark.createDataFrame([(1, f"some words before {text} and some words after")], "doc_id long, text string")
    found = scan_licenses(docs).first()
    assert found.license == name and found.coverage == 1
