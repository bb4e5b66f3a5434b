"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_exact import LIBRARY, removed
from tunelake.llm import blocks, bpe, chat_format, mixing, near_dedup, quality, search, suffix_dedup, token_scan, token_store, toxicity

WORDS = [f"w{i}" for i in range(3000)]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.broadcast_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, "two words"), (2, None), (3, ""), (3, ""), (None, "no key"), (4, "long " * 40_000), (5, "\n \t"), (6, "two words")]
    return spark.createDataFrame([(*r, 9, 8, 7) for r in rows], "doc_id long, text string, ids int, bytes int, score int")


def test_bpe(spark, awkward, ranks):
    out = bpe.decode(bpe.encode(awkward, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(out) == 8 and set(out[0].asDict()) == {"doc_id", "ids", "bytes", "score"}
    for row in out:
        text = bytes(row["bytes"]).decode()
        assert row["ids"] == LIBRARY.encode_ordinary(text)
    assert sorted(bytes(r["bytes"]).decode() for r in out) == sorted(r["text"] or "" for r in awkward.collect())
    assert bpe.encode(awkward.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip_equals_both_operators(spark, awkward, ranks):
    apart = bpe.decode(bpe.encode(awkward, ranks, public_tokenizers.PATTERN), ranks).select("doc_id", "score", "ids", "bytes")
    both = bpe.round_trip(awkward, ranks, public_tokenizers.PATTERN)
    assert both.schema == apart.schema
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    kept = bpe.round_trip(awkward, ranks, public_tokenizers.PATTERN, keep=["bytes", "score", "ids"])
    assert kept.columns == ["score", "ids", "bytes"] and kept.count() == 8
    assert bpe.round_trip(awkward.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_near_copies(spark):
    base = {g: prose(g, 120).split() for g in range(6)}
    rows, key, group = [], 0, {}
    for g, words in base.items():
        for copy in range(45 if g == 0 else 3):
            changed = list(words)
            if copy:
                changed[(7 * copy) % 110] = f"new{copy}"
            rows.append((key, " ".join(changed)))
            group[key] = g
            key += 1
    rows += [(900, None), (901, ""), (902, "Only four words here"), (903, "only FOUR words, here"), (904, "!!!"),
             (905, "!!!"), (906, "???"), (0, rows[0][1]), (907, prose(99, 30_000)), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, root int, node int")
    found = {}
    for r in near_dedup.classes(docs).collect():
        found.setdefault(r["doc_id"], set()).add(r["class_id"])
    for k, g in group.items():
        assert found[k] == {min(x for x in group if group[x] == g)}
    assert found[901] == {900} and found[903] == {902} and found[905] == {904} and found[906] == {906}
    assert found[None] == {0} and found[907] == {907}
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({min(x for x in group if group[x] == g) for g in base}
                                                                 | {900, 902, 904, 906, 907})
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, "one two three", "a", 0) for i in range(600)] + [(1000 + i, "x " * 5, "b", 0) for i in range(30)]
    rows += [(2000, None, None, 0), (2001, "", None, 0), (2001, "", None, 0), (None, "q", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(docs)
    out = mixed.collect()
    assert len(out) == len(rows)
    total = 600 * 3 + 150 + 1
    targets = {r["source"]: (r["source_size"], r["target"]) for r in out}
    assert targets[None] == (0, 0.0) and targets["b"] == (150, 450.0) and targets["c"] == (1, 3.0)
    assert sum(t for _, t in targets.values()) == pytest.approx(total)
    taken = {s: sum(r["taken"] for r in out if r["source"] == s) for s in targets}
    assert taken["b"] == 450 and abs(taken["a"] - targets["a"][1]) < 0.1 * targets["a"][1]
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out))
    assert mixing.repeat_documents(mixed, ["doc_id", "text"]).count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_suffix_dedup_with_hot_anchors(spark, monkeypatch):
    """A common line within differing surroundings, with every shared anchor hot and windows put in order in shares."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 1)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 64)
    draw = random.Random(8)
    line = "the very same line that many documents have"
    texts_ = []
    for _ in range(120):
        pieces = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(30))) for _ in range(3)]
        texts_.append(line.join(pieces) + draw.choice(["", "x" * 90, line * 2, texts_[-1] if texts_ else ""]))
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    for length, gram in ((20, 10), (50, 25)):
        out = suffix_dedup.remove_repeats(docs, min_length=length, gram=gram).collect()
        got = sorted((r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest(), sum(s["stop"] - s["start"] for s in r["spans"]))
                     for r in out)
        assert got == removed(list(enumerate(texts_)), length)


@pytest.mark.parametrize("length, gram", [(8, 4), (12, 5)])
def test_suffix_dedup(spark, length, gram):
    draw = random.Random(length)
    rows = [(i, "".join(draw.choice("abc é") for _ in range(draw.randint(0, 60)))) for i in range(150)]
    rows += [(i, "shared passage that is longer than any window" + str(i)) for i in range(200, 230)]
    rows += [(300, None), (301, ""), (7, rows[7][1]), (7, "shared passage that is longer"), (302, "z" * 30_000), (303, "z" * 40)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans int")
    out = suffix_dedup.remove_repeats(docs, min_length=length, gram=gram).collect()
    got = sorted((r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest(), sum(s["stop"] - s["start"] for s in r["spans"]))
                 for r in out)
    assert got == removed(rows, length)
    for r in out:
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    whole = suffix_dedup.remove_repeats(docs, min_length=length, gram=gram, whole_chars=True).collect()
    assert all(bytes(r["kept"]).decode("utf-8") is not None for r in whole)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_null_keys_come_last(spark):
    rows = [(None, "a passage of text that repeats"), (None, "a passage of text that repeats"), (5, "a passage of text that repeats")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r["doc_id"]), len(r["kept"])) for r in suffix_dedup.remove_repeats(docs, min_length=10, gram=5).collect())
    assert out == [("5", 30), ("None", 0), ("None", 0)]


def test_quality_cutoffs(spark):
    good = [(i, prose(i, 30), "en") for i in range(2500)]
    bad = [(5000 + i, " ".join(w + "##" for w in prose(i, 30).split()), "en") for i in range(300)]
    few = [(6000 + i, " ".join(w + "##" for w in prose(i, 30).split()), "xx") for i in range(20)]
    odd = [(7000, None, "en"), (7001, "", None), (7002, "a b c d e f " * 10, "en"), (None, prose(1, 30), None)]
    docs = spark.createDataFrame([(*r, 3) for r in good + bad + few + odd], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad + few] + [(1, None), (None, 1)],
                                   "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert len(out) == len(good + bad + few + odd)
    assert all(out[r[0]]["kept"] for r in good) and not any(out[r[0]]["kept"] for r in bad)
    assert all(out[r[0]]["kept"] for r in few), "too few labels prove no bound"
    assert [out[k]["base_failed"] for k in (7000, 7001, 7002, None)] == [True, True, True, False]
    kept = quality.select_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out.values())
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity(spark):
    rows = [(i, prose(i, 40) + (" you idiot" if i % 4 == 0 else " you friend")) for i in range(400)]
    rows += [(900, prose(7, 20) + " you 1d10t"), (901, prose(8, 20) + " you i d i o t"), (902, None), (903, ""), (None, "x"),
             (904, prose(9, 20) + " you IDIOOOT!!!"), (905, prose(10, 20) + " you friend")]
    docs = spark.createDataFrame([(*r, 4) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.language_model(docs)
    scorer = toxicity.train(docs, labels, model)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model, scorer, keep=["doc_id"], with_text=True).withColumn(
        "held", toxicity.held_out("doc_id")).collect()}
    held = [i for i in range(400) if out[i]["held"]]
    assert 40 < len(held) < 120 and all((out[i]["score"] >= 0.5) == (i % 4 == 0) for i in held)
    assert all(out[i]["score"] >= 0.5 for i in (900, 901, 904)) and out[905]["score"] < 0.5
    assert out[902]["score"] == out[903]["score"] < 0.5 and "idiot" in out[900]["restored"]
    empty = toxicity.train(docs, labels.limit(0), model)
    assert toxicity.score(docs, model, empty).where("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), model, scorer).count() == 0


def test_search_on_awkward_rows(spark, awkward):
    out = search.top_k(awkward, F.lit(True), min_docs=1, k=3).collect()
    assert {r["doc_id"] for r in out if r["query_id"] == 1} == {1, 6}
    assert [r["doc_id"] for r in sorted((r for r in out if r["query_id"] == 6), key=lambda r: r["rank"])] == [1, 6]
    assert search.top_k(awkward.limit(0), F.lit(True)).count() == 0


def test_token_shards(spark, awkward, ranks, tmp_path):
    awkward.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index, path = token_store.materialise(docs, ranks, public_tokenizers.PATTERN, order_key=3, end_id=50_256,
                                          path=str(tmp_path / "out"), length=16, per_shard=500)
    rows = index.collect()
    slots = {r["slot"]: r["ids"] for r in token_store.read_shards(spark, path, 16, 500).collect()}
    assert sorted(slots) == sorted(r["slot"] for r in rows) == list(range(len(rows)))
    back = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        assert r["byte_offset"] == r["slot"] % 500 * token_store.stride(16) and r["shard"] == r["slot"] // 500
        back.setdefault(r["doc_id"], []).append(slots[r["slot"]][: r["n_tokens"]])
    assert sum(back[4], []) == LIBRARY.encode_ordinary("long " * 40_000) + [50_256]
    assert sum(back[1], []) == LIBRARY.encode_ordinary("two words") + [50_256] and back[2] == [[50_256]]
    empty = spark.read.parquet(str(tmp_path / "docs")).limit(0)
    assert token_store.materialise(empty, ranks, public_tokenizers.PATTERN, order_key=3, end_id=50_256,
                                   path=str(tmp_path / "none"))[0].count() == 0


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts(spark, awkward, ranks, tmp_path, block):
    token_scan.write_flat(awkward.coalesce(1), ranks, public_tokenizers.PATTERN, str(tmp_path / "flat"), docs_per_file=3)
    rows = token_scan.count_tokens(spark, str(tmp_path / "flat"), block_bytes=block).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(LIBRARY.encode_ordinary(r["text"] or "")) for r in awkward.collect())
    assert all(r["ended"] for r in rows)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a").write_bytes(b"\x00\x01\xc4\x80\x00\x02\x00\x03")
    (tmp_path / "cut" / "b").write_bytes(b"")
    rows = token_scan.count_tokens(spark, str(tmp_path / "cut"), block_bytes=block).orderBy("ordinal").collect()
    assert [(r["n_tokens"], r["ended"], r["start"]) for r in rows] == [(1, True, 0), (2, False, 2)]


def test_chat_format(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|> [INST] [\\INST] </s>"), (1, 2, "assistant", "a\n1"),
            (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "a\\n\nb", "t"),
            (None, None, None, "x"), (3, 1, "assistant", "r"), (3, 1, "assistant", "r")]
    talk = spark.createDataFrame([(*r, 6) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    pieces = chat_format.format_turns(talk)
    back = [(r["conv_id"], r["role"], r["text"]) for r in chat_format.read_back(pieces).orderBy("conv_id", "seq").collect()]
    assert back == [(None, "", "x")] + [(r[0], r[2], r[3] or "") for r in rows if r[0] is not None]
    whole = {(r["conv_id"], r["example"]): r for r in chat_format.example_texts(pieces).collect()}
    assert len(whole) == chat_format.examples(pieces).count() == 4
    first = whole[1, 0]
    assert first["text"][first["loss_start"]: first["loss_end"]] == "a\n1" and first["text"].count("<|im_end|>") == 3
    assert whole[1, 1]["text"].startswith(first["text"])
    control = re.compile(r"<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]")
    assert all(len(control.findall(r["text"])) % 2 == 0 for r in whole.values())
    assert chat_format.format_turns(talk.limit(0)).count() == 0


def test_chat_roles_with_control_characters(spark):
    """Roles with NUL, backslashes and line feeds, and long texts, come back as written; masks show every reply once."""
    roles = ["a\x00b", "\\n", "\n", "\\\\n", "\\\n", "</s>\\n<|im_end|>", "\x00", "\\", "", None, "assistant"]
    rows = [(1, i, role, f"t{i}", 0) for i, role in enumerate(roles)] + [
        (2, 0, "assistant", "x</s>" * 20_000, 0), (2, 1, "assistant", None, 0), (2, 2, "assistant", "last", 0)]
    pieces = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int"))
    back = [(r["conv_id"], r["role"], r["text"]) for r in chat_format.read_back(pieces).orderBy("conv_id", "seq").collect()]
    assert back == [(c, role or "", text or "") for c, _, role, text, _ in rows]
    found = chat_format.trained_texts(chat_format.examples(pieces)).orderBy("conv_id", "example").collect()
    assert [r["loss_text"] for r in found] == ["t10", "x</s>" * 20_000, "", "last"]
    assert [r["context_turns"] for r in found] == [10, 0, 1, 2]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.trained_texts(chat_format.examples(chat_format.format_turns(none))).collect() == []


@pytest.mark.parametrize("replies", [1, 3, 64])
def test_examples_are_written_out(spark, replies, monkeypatch):
    """Every example's text is its whole prefix, however many tasks write a conversation; masks are read from it."""
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i} </s> é") for i in range(20)] + [
        (None, 0, "user", "a"), (None, 1, "assistant", None), (None, 2, "user", "z"), (3, 0, "user", "no reply"),
        (4, 0, "assistant", "first"), (4, 0, "assistant", "first")]
    monkeypatch.setattr(chat_format, "BATCH_CHARS", 200)
    pieces = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = pieces.orderBy("conv_id", "seq").collect()
    expected = []
    for p in (p for p in told if p.trainable):
        before = [q.piece for q in told if q.conv_id == p.conv_id and q.seq <= p.seq]
        expected.append((p.conv_id, p.example, p.seq, "".join(before), len("".join(before[:-1]))))
    found = chat_format.examples(pieces, replies)
    got = [(r.conv_id, r.example, r.context_turns, r.text, r.context_chars) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) == 16
    masks = chat_format.trained_texts(found.select("conv_id", "example", "context_turns", "text", "loss_start", "loss_end"))
    assert sorted(r.loss_text for r in masks.collect()) == sorted(r[3] or "" for r in rows if r[2] == "assistant")


def test_anchors_are_dealt_evenly():
    """The ranges that anchors are dealt to get about as much each, though anchors are minima of hashes."""
    n, rng = 100, random.Random(5)
    words = [bytes(rng.choices(b"abcdefghijklmnop ", k=20_000)) for _ in range(20)]
    given = pa.record_batch({"_text": pa.array(words, pa.binary()), "_block": pa.array([0] * 20, pa.int32()),
                             "_id": pa.array(range(20), pa.int64())})
    table = pa.Table.from_batches(blocks._compressed(iter([given])))
    asked = suffix_dedup._ask(table, n, suffix_dedup.MIN_LENGTH, suffix_dedup.GRAM)
    sizes = [len(blocks.unpack(v, np.uint32)[0]) for v in asked["payload"].to_pylist()]
    assert len(sizes) == n and max(sizes) < 2 * sum(sizes) / n
