"""The decode policy against a brute-force one on a small table."""

import numpy as np
import pytest

from tunelake.operators import decode

FIELDS = ("request_id int, candidate int, logit double, used boolean, is_end boolean, n_generated int, "
          "temperature double, top_p double, top_k int, repetition_penalty double, min_new_tokens int")


def table(top_k, scale=1.0, n_requests=6, n=60):
    rng = np.random.default_rng(3)
    rows = []
    for request in range(n_requests):
        logits = np.round(rng.normal(0, 2, n), 1) * scale
        for c in range(n):
            rows.append((request, c, float(logits[c]), bool(c % 5 == 0), bool(c == 3), request, 0.5 + request / 4,
                         [0.9, 0.3, 1.0][request % 3], top_k, 1.3, 3))
    return rows


def brute(rows):
    kept = {}
    for request in {r[0] for r in rows}:
        scored = []
        for _, c, logit, used, end, n_generated, temperature, top_p, top_k, penalty, least in (
            r for r in rows if r[0] == request
        ):
            if end and n_generated < least:
                continue
            if used:
                logit = logit / penalty if logit > 0 else logit * penalty
            scored.append((-logit / temperature, c))
        scored.sort()
        if top_k > 0:
            scored = scored[:top_k]
        scores = -np.array([s for s, _ in scored])
        weight = np.exp(scores - scores.max())
        share, before = weight / weight.sum(), 0.0
        chosen = []
        for (_, c), p in zip(scored, share):
            if round(before, 9) >= top_p:
                break
            chosen.append((c, p))
            before += p
        mass = sum(p for _, p in chosen)
        assert mass >= top_p - 1e-9 and (len(chosen) == 1 or mass - chosen[-1][1] < top_p)
        kept[request] = {c: p / mass for c, p in chosen}
    return kept


@pytest.mark.parametrize("top_k, scale", [(0, 1.0), (7, 1.0), (900, 1.0), (0, 400.0)])
@pytest.mark.parametrize("hot_rows", [0, 1_000_000])
def test_policy(spark, top_k, scale, hot_rows):
    rows = table(top_k, scale)
    got = {}
    for r in decode.decode_policy(spark.createDataFrame(rows, FIELDS), hot_rows).collect():
        got.setdefault(r["request_id"], {})[r["candidate"]] = r["probability"]
    expected = brute(rows)
    assert got.keys() == expected.keys()
    for request in expected:
        assert got[request] == pytest.approx(expected[request])


@pytest.mark.parametrize("hot_rows", [0, 1_000_000])
def test_masked_candidates_are_never_drawn(spark, hot_rows):
    rows = [r if r[1] % 4 else r[:2] + (float("-inf"),) + r[3:] for r in table(0)]
    got = {}
    for r in decode.decode_policy(spark.createDataFrame(rows, FIELDS), hot_rows).collect():
        got.setdefault(r["request_id"], {})[r["candidate"]] = r["probability"]
    expected = brute([r for r in rows if r[1] % 4])
    assert got.keys() == expected.keys()
    for request in expected:
        assert got[request] == pytest.approx(expected[request])


def test_large_top_k_cuts_by_rank(spark):
    rows = [r[:8] + (1_200,) + r[9:] for r in table(1_200, n_requests=1, n=1_500)]
    rows = [r[:7] + (1.0,) + r[8:] for r in rows]
    policy = decode.decode_policy(spark.createDataFrame(rows, FIELDS), hot_rows=100).collect()
    assert sorted(r["rank"] for r in policy) == list(range(1, 1_201))
    assert max(r["cumulative"] for r in policy) == pytest.approx(1.0)


def test_sample_is_seeded_and_follows_the_policy(spark):
    rows = table(0, n_requests=200, n=4)
    policy = decode.decode_policy(spark.createDataFrame(rows, FIELDS)).cache()
    first = {r["request_id"]: r["candidate"] for r in decode.decode_sample(policy, 1).collect()}
    again = {r["request_id"]: r["candidate"] for r in decode.decode_sample(policy, 1).collect()}
    other = {r["request_id"]: r["candidate"] for r in decode.decode_sample(policy, 2).collect()}
    allowed = {(r["request_id"], r["candidate"]) for r in policy.collect()}
    assert first == again != other and len(first) == 200 and set(first.items()) <= allowed
