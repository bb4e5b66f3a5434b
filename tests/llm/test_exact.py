"""Parts that need no Spark, against brute force."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelake.llm import bpe, near_dedup, quality, search, suffix_dedup, texts, token_store, toxicity

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OURS = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENS = bpe._Tokens(RANKS)
PIECES = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "中文", "😀", "12", "'s", "!", "...", "\x1c", "\x85", "\xa0", "　",
          "ing", "İ", "²", "Ⅷ", "​", "_", "aaaa", "Straße"]


def ids(text):
    return np.frombuffer(OURS.encode(text), np.int32).tolist()


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=14))
def test_encoding_equals_the_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert b"".join(OURS.tokens[i] for i in ids(text)) == text.encode()


def test_long_pieces_take_linear_time():
    for text in ("a" * 200_000, "中文" * 50_000, "ab" * 100_000):
        assert b"".join(OURS.tokens[i] for i in ids(text)) == text.encode()


def split(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_short_pieces_of_a_batch_are_encoded_side_by_side(monkeypatch):
    """one piece after another took about twice the CPU seconds."""
    draw = random.Random(8)
    syllables = ["en", "tion", "sch", "ß", "é", "ñ", "the", "rr", "中", "x", "9", ".", "'s", "\n"]
    words = ["".join(draw.choices(syllables, k=draw.randint(1, 9))) for _ in range(3000)]
    texts_ = [" ".join(draw.choices(words, k=draw.randint(0, 80))) for _ in range(200)]
    single = []
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(own, "encode_piece", lambda piece: single.append(piece) or OURS.encode_piece(piece))
    assert split(*own.encode_all(texts_)) == [LIBRARY.encode_ordinary(text) for text in texts_]
    assert all(len(piece) > bpe.SHORT_BYTES for piece in single)
    long = "ab" * 200
    assert split(*own.encode_all([long, "", f"a {long}"])) == [LIBRARY.encode_ordinary(t) for t in (long, "", f"a {long}")]
    assert {long.encode(), f" {long}".encode()} <= set(single)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=14), max_size=6), st.integers(1, 12))
def test_batches_equal_the_library_whatever_is_remembered(parts, entries):
    batch = ["".join(some).encode("utf-8", "ignore").decode() for some in parts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "MEMO_ENTRIES", entries)
        patch.setattr(bpe, "SIDE_BY_SIDE", 3)
        for _ in range(3):
            ids, counts = OURS.encode_all(batch)
            assert split(ids, counts) == [LIBRARY.encode_ordinary(text) for text in batch] or not batch
            assert len(OURS.piece_ids.numbers) <= entries and len(OURS.chunk_ids.numbers) <= entries
        found, lengths = TOKENS.decode(ids)
        assert b"".join(found).decode() == "".join(batch) and len(lengths) == len(ids)


def test_tokens_that_merges_do_not_reach_are_whole_pieces_only():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bcd": 257, b"abc": 258}
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    batch = ["bcd", "abc", "abcd", "a bcd", "bcd!bcd", "abcbcd abc"]
    assert split(*own.encode_all(batch)) == [library.encode_ordinary(text) for text in batch]


def test_fits_of_many_pairs():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, len(RANKS), (2, 20_000))
    assert OURS._fit_all(a, b).tolist() == [OURS.fits(x, y) for x, y in zip(a.tolist(), b.tolist())]
    for _ in range(2):
        assert OURS._known_fits(a, b).tolist() == OURS._fit_all(a, b).tolist()


def test_unknown_ids_have_no_bytes():
    for wrong in (-1, max(RANKS.values()) + 1, 2_000_000_000):
        with pytest.raises(KeyError):
            TOKENS.decode(np.array([0, wrong], np.int32))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_permutes(size):
    slots = token_store.feistel(np.arange(size), size, 7)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 60:
        assert slots.tolist() != token_store.feistel(np.arange(size), size, 8).tolist() != list(range(size))


def test_binomial_tail():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.02), (400, 9, 0.05), (7, 7, 0.5)):
        exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(exact)


def test_block_max_wand_is_exact():
    draw = random.Random(4)
    for _ in range(120):
        lists, scores = [], {}
        for _ in range(draw.randint(1, 6)):
            rows = sorted(draw.sample(range(400), draw.randint(1, 300)))
            impacts = [round(draw.choice([0.5, 1.0, draw.random() * 3]), 3) for _ in rows]
            lists.append(search.Postings(np.array(rows), np.array(impacts)))
            for row, impact in zip(rows, impacts):
                scores[row] = scores.get(row, 0) + impact
        k = draw.choice([1, 3, 10])
        expected = sorted(((round(s, 6), r) for r, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        assert search.block_max_wand(lists, k) == expected


def test_previous_factors_find_smaller_keys():
    windows = np.array([b"aaaa", b"aaaa", b"aaab", b"aaaa", b"zzzz"], "S4")
    assert suffix_dedup.previous_factors(windows, np.array([2, 1, 1, 2, 5]), 4).tolist() == [4, 0, 0, 4, 0]
    assert suffix_dedup.previous_factors(windows, np.array([2, 1, 1, 2, 5]), 1).tolist() == [4, 0, 0, 4, 0]
    assert suffix_dedup.previous_factors(windows, np.array([1, 2, 3, 4, 5]), 2).tolist() == [0, 4, 3, 4, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", min_size=4, max_size=4), st.integers(0, 5)), min_size=1, max_size=40), st.integers(1, 4))
def test_previous_factors_against_all_pairs(rows, least):
    windows, keys = np.array([w.encode() for w, _ in rows], "S4"), np.array([k for _, k in rows])
    raw = [w.encode() for w, _ in rows]

    def shared(x, y):
        return next((i for i in range(4) if x[i] != y[i]), 4)

    best = [max([shared(raw[i], raw[j]) for j in range(len(raw)) if keys[j] < keys[i]], default=0) for i in range(len(raw))]
    assert suffix_dedup.previous_factors(windows, keys, least).tolist() == [n if n >= least else 0 for n in best]


def thue_morse(n):
    return bytes(97 + bin(i).count("1") % 2 for i in range(n))


def test_hashes_tell_complementary_words_apart():
    for n in (1024, 4096):
        one = thue_morse(n)
        data = np.frombuffer(one + one.translate(bytes.maketrans(b"ab", b"ba")) + one, np.uint8)
        found = texts.span_hashes(texts.prefix_hashes(data), np.arange(3) * n, np.arange(1, 4) * n)
        assert found[0] != found[1] and found[0] == found[2]


def test_products_modulo_the_prime():
    draw = random.Random(3)
    values = [0, 1, texts.PRIME - 1, *(draw.randrange(texts.PRIME) for _ in range(500))]
    a, b = np.array(values, np.uint64), np.array(values[::-1], np.uint64)
    assert texts.times(a, b).tolist() == [x * y % texts.PRIME for x, y in zip(values, values[::-1], strict=True)]


def test_words_and_hashes():
    values = ["a bb  a", None, "", " \t", "bb a\nbb", "é é"]
    for limit in (1, 4, 1 << 20):
        found = []
        for part in texts.slices(pa.array(values), limit):
            starts, ends, bounds = part.words()
            hashes = texts.span_hashes(texts.prefix_hashes(part.data), starts, ends)
            raw = part.data.tobytes()
            for a, b in zip(bounds[:-1], bounds[1:]):
                found.append([raw[s:e] for s, e in zip(starts[a:b], ends[a:b])])
            same = {}
            for s, e, h in zip(starts, ends, hashes):
                assert same.setdefault(raw[s:e], h) == h
        assert found == [[w.encode() for w in (v or "").split()] for v in values]


def letters_model():
    words = "idiot loser stupid moron the and of is this text with more words in it trash scum"
    counts = np.zeros((28,) * 4)
    for word in words.split() * 50:
        line = [0, 0, 0] + [ord(c) - 96 for c in word] + [0]
        for i in range(len(line) - 3):
            counts[tuple(line[i: i + 4])] += 1
    model = np.full(28, 1 / 28)
    for order in range(1, 5):
        level = counts.sum(axis=tuple(range(4 - order)))
        model = (level + 2 * model) / (level.sum(-1, keepdims=True) + 2)
    return np.log(model).astype(np.float32)


def test_disguised_words_are_restored():
    restorer = toxicity.Restorer(letters_model())
    assert [restorer.restore(w) for w in ("1d10t", "l0ser", "stuuupid", "i.d.i.o.t", "tr4sh", "m0r0n", "st*pid")] == [
        "idiot", "loser", "stupid", "idiot", "trash", "moron", "stupid"]
    values = ["The 1D10T and i d i o t, so.", None, "", "Ünïted plain words", "x" * 5000, "a 12 2024 $$$"]
    out = [bytes(p.data[a:b]).decode() for p in (toxicity.restored(p, restorer) for p in texts.slices(pa.array(values)))
           for a, b in zip(p.offsets[:-1], p.offsets[1:])]
    assert out[0].startswith("the idiot and ") and "idiot" in out[0][10:] and out[1:4] == ["", "", "united plain words"]


def removed(docs, length):
    """Brute force of the suffix dedup: spans of bytes under a string that starts in a document of smaller key."""
    first = {}
    for key, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            gram = raw[i: i + length]
            first[gram] = min(first.get(gram, key), key)
    found = []
    for key, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i: i + length]] < key:
                gone[i: i + length] = [True] * length
        found.append((key, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest(), sum(gone)))
    return sorted(found)


def test_long_texts_share_no_sample_by_chance():
    """Disjoint vectors agree in no consistent sample however long they are; similar ones in their similarity's share."""
    draw = np.random.default_rng(1)
    n = 100_000
    one, two = draw.integers(0, 1 << 48, n, dtype=np.uint64), draw.integers(0, 1 << 48, n, dtype=np.uint64)
    like = np.concatenate([one[: n * 8 // 9], two[n * 8 // 9:]])
    found = near_dedup._samples(np.concatenate([one, two, like]), np.full(3 * n, 1.05), np.array([0, n, 2 * n]), 120)
    assert (found[0] == found[1]).sum() == 0
    assert (found[0] == found[2]).mean() == pytest.approx(0.8, abs=0.12)


def test_similarities_by_products_are_those_of_pairs():
    draw = np.random.default_rng(6)
    payloads = []
    for _ in range(40):
        keys = np.unique(draw.integers(0, 300, 80)).astype(np.int64)
        payloads.append(near_dedup.blocks.pack(
            np.diff(keys, prepend=0).astype(np.uint32), draw.choice([1, 1, 1, 2, 3, 9], len(keys)).astype(np.uint32),
            (keys % 20).astype(np.uint8)))
    vectors = near_dedup._Vectors(payloads, 5000)
    found = vectors.all_similarities()
    for i in range(40):
        for j in range(40):
            assert i == j or found[i, j] == pytest.approx(vectors.similarity(i, j), abs=1e-12)
