"""Words of op8 beside punctuation and spaces beyond ASCII."""

import numpy as np
import pytest

from asfiled.llm.toxicity import features


@pytest.mark.parametrize("text", ["¡vile thing!", "“vile” thing…", "„vile“ thing", "«vile» — thing",
                                  "vile\u00a0thing", "vile\u3000thing", "‘Vile’ thing"])
def test_typographic_marks_are_no_part_of_words(text):
    assert np.array_equal(features(text), features("vile thing"))


def test_letters_beyond_ascii_stay():
    assert len(features("größe señor")) == 3 and not np.array_equal(features("größe"), features("gr e"))
