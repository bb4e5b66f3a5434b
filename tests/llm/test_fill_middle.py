"""Fill-in-the-middle against a plain build from strings, and exact restoration."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tunelake.llm import fill_middle

MARKS = (b"<P>", b"<S>", b"<M>")
TEXTS = [None, "", "\n", "one", "one\ntwo\nthree\n", "a\n\n\nb", "é\n\U0001F600x\r\nß", "has <S> inside\nx", "<P", "<\n<P\n>", "<P<M\n>" * 9,
         "line\n" * 4000, "x" * 300_000, "\n" * 1000, "same\ntext\n", "same\ntext\n"]


def expected(key, text, rate=100, suffix_first=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i: i + 8], 16) for i in range(0, 32, 8)]
    n = len(lines)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("settings", [{}, {"rate": 40, "suffix_first": 10, "seed": 3}])
def test_rows(spark, settings):
    rows = [(key, text, "a", "b") for key, text in enumerate(TEXTS * 3)] + [(None, "x\ny\nz", "a", "b"), (3, "x\ny\nz", "a", "b")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, restored string")
    out = fill_middle.restore(fill_middle.transform(docs, keep=["output", "restored"], **settings))
    found = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"))
                    for r in out.collect()), key=repr)
    assert found == sorted(((key, *expected(key, text, **settings), text or "") for key, text, *_ in rows), key=repr)


def test_empty_table_and_null_outputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restore(fill_middle.transform(docs)).collect() == []
    odd = spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string")
    assert [r.restored for r in fill_middle.restore(odd).collect()] == [None, None]


@given(st.lists(st.sampled_from(["<", "P>", "<P", "<S", "S>", "M>", "\n", "é", "x"]), max_size=30), st.integers(0, 40), st.integers(0, 40))
def test_exchange_undoes_itself(pieces, one, two):
    text = "".join(pieces).encode()
    if any(mark in text for mark in MARKS):
        return
    ends = [0, *fill_middle.line_ends(text).tolist()]
    low, high = sorted((ends[one % len(ends)], ends[two % len(ends)]))
    for form in ("psm", "spm"):
        assert fill_middle.restore_text(bytes(fill_middle.exchange(text, low, high, form, MARKS)), form, MARKS) == text
