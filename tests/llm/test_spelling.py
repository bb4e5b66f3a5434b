"""Spelling variants against a plain count and all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tunelake.llm import spelling

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows):
    words = counted(rows)
    forms, out = {}, []
    for word, n in words.items():
        others = [other for other in words if near(word, other)]
        best = min(others, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best and words[best] >= 2 * n else None
        out.append([word, n, len(others), forms[word], words.get(forms[word])])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted(map(tuple, out))


def found(spark, rows, **settings):
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, word string, n int")
    return sorted(tuple(r[c] for c in COLUMNS) for r in spelling.variants(docs, **settings).collect())


def corpus(seed=4, n_docs=400):
    draw = np.random.default_rng(seed)
    stems = ["colour", "theatre", "anagram", "colours", "straße", "ÉCOLE", "colourse", "naïve", "granama", "hello", "aaaaa", "zz", "organise", "listen", "silent"]
    out = []
    for key in range(n_docs):
        words = []
        for _ in range(60):
            word = list(stems[min(int(draw.exponential(3)), len(stems) - 1)])
            if draw.random() < 0.3:
                at, kind = int(draw.integers(len(word))), draw.integers(3)
                letter = "abcé×ÿ"[draw.integers(6)]
                word[at: at + (kind != 0)] = [letter] if kind < 2 else []
            words.append("".join(word).title() if draw.random() < 0.1 else "".join(word))
        out.append((key, " ".join(words)))
    return out


@pytest.mark.parametrize("settings", [{}, {"tile_letters": 40}])
def test_against_all_pairs(spark, settings):
    rows = corpus()
    want = expected(rows)
    assert any(form and root != form for _, _, _, form, _, root in want) and len(want) > 100
    assert found(spark, rows, **settings) == want


def test_odd_rows(spark):
    long = "x" * 20_000
    rows = [(1, None), (2, ""), (None, "Hallo hallo HALLO hallp"), (3, f"{long} {long}y {long}"), (3, f"{long} 123 {long}"), (4, "hallp hallp_hallp"),
            (4, "hallp hallp_hallp"), (5, "café-cafés CAFÉS cafés"), (6, "\U0001F600words\U0001F600words words")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, "few words here")]) == []


def test_forms_must_be_more_frequent(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), times=1)
