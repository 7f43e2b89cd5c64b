"""A passage that most documents hold, each between other neighbours, against brute force."""

import random

import numpy as np
import pytest

from roamgrid.llm import _repeats, substring_dedup, suffix_dedup


@pytest.mark.parametrize("bits", [1 << 24, 64])  # with 64 bits, other keys go the way of hot ones
@pytest.mark.parametrize(("module", "op", "removed"), [(suffix_dedup, suffix_dedup.dedup_bytes, "n_removed"), (substring_dedup, substring_dedup.dedup_substrings, "n_removed")])
def test_hot_passage(spark, monkeypatch, module, op, removed, bits):
    monkeypatch.setattr(_repeats, "SAMPLE", 1)
    monkeypatch.setattr(_repeats, "HOT_CONTEXTS", 20)
    monkeypatch.setattr(_repeats, "HOT_BITS", bits)
    monkeypatch.setattr(_repeats, "PARTS", 3)
    rng = random.Random(4)
    words = module is substring_dedup
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)] if words else [rng.choice("abcdefgh ij") for _ in range(n)]
    passage, other = some(54), some(70)
    units = {i: some(40) + (passage[i % 3 :] if i % 4 else other) + some(40) for i in range(120)}
    units |= {120: units[5], 121: some(30) + passage[2:52] + some(30), 122: passage[4:]}
    text = (" " if words else "").join
    docs = spark.createDataFrame([(i, text(u)) for i, u in units.items()], "doc_id long, text string").repartition(4)
    hot = _repeats.hot_keys(docs, module.finder())
    assert hot.any() and len(hot) == bits // 8
    got = {r["doc_id"]: r[removed] for r in op(docs).collect()}
    first = {}
    for i, u in units.items():
        for s in range(len(u) - 49):
            first.setdefault(tuple(u[s : s + 50]), i)
    want = {i: len({k for s in range(len(u) - 49) if first[tuple(u[s : s + 50])] < i for k in range(s, s + 50)}) for i, u in units.items()}
    assert got == want and sum(want.values()) > 50 * 80
    # No context of a hot key goes to a bucket that compares all contexts of its keys.
    sent = []
    real = _repeats._contexts
    monkeypatch.setattr(_repeats, "_contexts", lambda f, n, h: sent.append(h.value.tolist()) or real(f, n, h))
    op(docs)
    assert sent == [hot.tolist()]


@pytest.mark.parametrize(("module", "op"), [(suffix_dedup, suffix_dedup.dedup_bytes), (substring_dedup, substring_dedup.dedup_substrings)])
def test_hot_keys_in_proportion_to_documents(spark, monkeypatch, module, op):
    """Every few documents share a passage of their own, and each such key counts as hot: what the driver holds stays as large as it is."""
    monkeypatch.setattr(_repeats, "SAMPLE", 1)
    monkeypatch.setattr(_repeats, "HOT_CONTEXTS", 2)
    rng = random.Random(6)
    words = module is substring_dedup
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)] if words else [rng.choice("abcdefgh ij") for _ in range(n)]
    text = (" " if words else "").join
    sizes, set_bits = [], []
    for n in (60, 240):
        passages = [some(60) for _ in range(n // 6)]
        units = {i: some(30) + passages[i % len(passages)] + some(30) for i in range(n)}
        docs = spark.createDataFrame([(i, text(u)) for i, u in units.items()], "doc_id long, text string").repartition(4)
        hot = _repeats.hot_keys(docs, module.finder())
        sizes.append(len(hot))
        set_bits.append(int(np.unpackbits(hot).sum()))
        first = {}
        for i, u in units.items():
            for s in range(len(u) - 49):
                first.setdefault(tuple(u[s : s + 50]), i)
        want = {i: len({k for s in range(len(u) - 49) if first[tuple(u[s : s + 50])] < i for k in range(s, s + 50)}) for i, u in units.items()}
        assert {r["doc_id"]: r["n_removed"] for r in op(docs).collect()} == want
    assert sizes[0] == sizes[1] == _repeats.HOT_BITS // 8 and set_bits[1] > 3 * set_bits[0]
