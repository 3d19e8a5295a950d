import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import mixing


def test_sainte_lague_by_hand():
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 1, "b": 1}, 5, {"a": 1, "b": 9}) == {"a": 1, "b": 4}


@pytest.mark.parametrize("tokens", [1e3, 1e6, 1e9, 1e10, 1.6e11, 1e12, 1e13])
def test_quotas_hold_at_every_size(tokens):
    held = {"a": int(tokens), "b": int(tokens / 3), "c": int(tokens / 50)}
    aims = {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 4)}
    got = mixing.source_quotas(held, aims, 20_000)
    total = min(held[k] * r / s for k, (s, r) in aims.items())
    for k, (s, r) in aims.items():
        assert abs(got[k] - s * total) <= total / min(20_000, total) + 1 and got[k] <= held[k] * r


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.integers(1, 5), st.floats(0.001, 1.2))
def test_shards_give_exactly_the_quota(tokens, repeats, share):
    t = np.array(tokens)
    quota = int(sum(tokens) * repeats * share)
    want = mixing.shard_quotas(t, repeats, quota)
    assert int(want.sum()) == min(quota, sum(tokens) * repeats)
    assert all(0 <= w <= x * repeats for w, x in zip(want, tokens))


def test_large_shards_lose_nothing():
    """4096 shards of 2.4e9 tokens each, as a corpus of 1e13 tokens has."""
    t = np.full(4096, 2_400_000_000)
    assert int(mixing.shard_quotas(t, 3, int(t.sum()) * 3).sum()) == int(t.sum()) * 3
    assert int(mixing.shard_quotas(t, 1, int(t.sum()) // 7).sum()) == int(t.sum()) // 7


DOCS = "doc_id bigint, text string, source string, repeats string"
TARGETS = "source string, target_share double, max_repeats int"


def test_small_mix(spark):
    rows = [(i, f"text number {i} of the wiki", " Wiki ", "x") for i in range(40)] + [(100 + i, f"letter {i} to a friend", "LETTERS", "x") for i in range(10)]
    rows += [(200, "text number 3 of the wiki", "wiki", "x"), (201, None, "wiki", "x"), (202, " ", "wiki", "x"), (203, "lost", None, "x"), (204, "lost too", "nowhere", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("letters", 0.5, 3), ("absent", 0.2, 1)], TARGETS)
    mix = mixing.mix_sources(docs, targets, shard_tokens=50).collect()
    assert {r["doc_id"] for r in mix}.isdisjoint({200, 201, 202, 203, 204})
    assert all(r["repeats"] <= (1 if r["source"] == "wiki" else 3) for r in mix)
    tokens = {s: sum(r["n_tokens"] * r["repeats"] for r in mix if r["source"] == s) for s in ("wiki", "letters")}
    assert abs(tokens["wiki"] - tokens["letters"]) / tokens["letters"] < 0.1
    assert mixing.mix_sources(docs.where("false"), targets).count() == 0
    assert mixing.mix_sources(docs, targets.where("false")).count() == 0
