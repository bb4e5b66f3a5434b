"""Disguises of any length, of several words, and within punctuation beyond ASCII."""

import pyarrow as pa
import pytest

from tests.llm.test_exact import letters_model
from tunelake.llm import texts, toxicity


def restore(value):
    restorer = toxicity.Restorer(letters_model())
    return "".join(bytes(p.data).decode() for p in (toxicity.restored(p, restorer) for p in texts.slices(pa.array([value]))))


@pytest.mark.parametrize(("given", "expected"), [
    ("\u201c1d10t\u201d", '"idiot"'),
    ("id" + "i" * 80 + "ot", "idiot"),
])
def test_restored(given, expected):
    assert restore(given) == expected


def test_spaced_letters_split_into_words():
    said = restore(" ".join("loseridiot" * 10))
    assert said.split() == ["loser", "idiot"] * 10
