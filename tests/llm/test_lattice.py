"""Readings of disguised tokens against an enumeration of all of them; long and hostile tokens; other letters."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_exact import letters_model
from tunelake.llm import texts, toxicity


def random_model(seed):
    counts = np.random.default_rng(seed).random((toxicity.SYMBOLS,) * 4) ** 4
    return np.log(counts / counts.sum(-1, keepdims=True)).astype(np.float32)


def price(model, said):
    """Cost of some letters by the language model, each word with its border."""
    total = 0.0
    for word in said.split(" "):
        before = (0, 0, 0)
        for letter in word:
            code = ord(letter) - 96 if "a" <= letter <= "z" else 27
            total -= float(model[before][code]) if code != 27 else 0.0
            before = (*before[1:], code)
        total -= float(model[before][0])
    return total


def readings(token, apart, at=0):
    """Cost of the channel and letters of every reading from a place on."""
    if at == len(token):
        yield 0.0, ""
        return
    run = len(list(itertools.takewhile(lambda c: c == token[at], token[at:])))
    options = toxicity._options(token[at])
    steps = [(letters, cost, 1) for letters, cost in options]
    if run > 1 and token[at] not in toxicity.DIVIDERS:
        steps += [(letters * n, cost + toxicity.COST_REPEAT, run) for letters, cost in options if letters
                  for n in ((1, 2) if run > 2 else (1,))]
    for space in ("", " ") if apart and at else ("",):
        for letters, cost, used in steps:
            for rest, said in readings(token, apart, at + used):
                yield cost + rest + (toxicity.COST_SPACE if space else 0), space + letters + said


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("wide", [False, True])
def test_best_of_all_readings(seed, wide):
    model = random_model(seed)
    restorer = toxicity.Restorer(model)
    search = restorer.wide.search if wide else restorer._search
    rng = random.Random(seed)
    tokens = ["a*1", "b*0t", "111", "aaab", "1.d-1", "3*", "*1", "s$$", "a.*b", "+", "**"]
    tokens += ["".join(rng.choice("ab13|.$") for _ in range(5)) for _ in range(6)]
    for token, apart in itertools.product(tokens, (False, True)):
        # Spaces at the ends or in a row are no words; the search never has them either.
        best = min((cost + price(model, said), said) for cost, said in readings(token, apart)
                   if said == " ".join(said.split()))
        found = search(token, apart)
        cheapest = min((cost + price(model, said) for cost, said in readings(token, apart) if said == found),
                       default=math.inf)
        assert cheapest == pytest.approx(best[0], abs=1e-4), (token, apart, found, best)


@pytest.mark.parametrize("token", ["x***y", "**a1*", "a*b*c", "1**1**", "***"])
@pytest.mark.parametrize("apart", [False, True])
def test_both_searches_agree(token, apart):
    restorer = toxicity.Restorer(random_model(7))
    assert restorer.wide.search(token, apart) == restorer._search(token, apart)


def test_long_rows_of_wildcards_are_cut_without_loss():
    for model in (letters_model(), random_model(3)):
        wide = toxicity.Restorer(model).wide
        for token in ("st" + "*" * (wide.longest + 25) + "pid", "*" * (wide.longest + 9) + "a1"):
            for apart in (False, True):
                assert wide.search(token, apart) == wide._best(token, apart)


def test_settled_parts_leave_the_reading_as_it_is(monkeypatch):
    wide = toxicity.Restorer(random_model(5)).wide
    token = "st**pid.1d*t-" * 12
    whole = [wide.search(token, apart) for apart in (False, True)]
    monkeypatch.setattr(toxicity, "KEPT_BYTES", 1)
    assert [wide.search(token, apart) for apart in (False, True)] == whole


@pytest.mark.parametrize("token", ["st" + "*" * 10_000 + "pid", "1d10t" * 4_000, "i" * 50_000 + "diot", "a*" * 600])
def test_hostile_tokens_end(token):
    restorer = toxicity.Restorer(letters_model())
    begin = time.monotonic()
    restorer.restore(token)
    assert time.monotonic() - begin < 30
    assert not restorer.known


def restore(value):
    restorer = toxicity.Restorer(letters_model())
    return "".join(bytes(p.data).decode() for p in (toxicity.restored(p, restorer) for p in texts.slices(pa.array([value]))))


@pytest.mark.parametrize(("given", "expected"), [
    ("you іdiot", "you idiot"),
    ("1d10t→", "idiot→"),
    ("ｉｄｉｏｔ", "idiot"),
    ("i​d​iot", "idiot"),
    ("lοser!", "loser!"),
    ("\u0455tupid i\u0301diot", "stupid idiot"),
    ("привет και", "привет και"),
    ("中文， 文", "中文， 文"),
    ("", ""),
])
def test_letters_of_other_forms(given, expected):
    assert restore(given) == expected
