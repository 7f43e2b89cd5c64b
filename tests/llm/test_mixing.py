"""The schedule of the mix against the ideal one, and placement on fixtures."""

import random
from fractions import Fraction

import pytest

from roamgrid.llm import mixing


@pytest.mark.parametrize("seed", range(6))
def test_less_than_a_block_from_the_ideal_mix(seed):
    rng = random.Random(seed)
    names = [f"s{i:02}" for i in range(rng.choice([1, 2, 5, 12]))]
    blocks = {s: rng.choice([1, 2, 30, 200]) for s in names}
    weights = {s: rng.choice([1, 7, 1000, 999_999, rng.randrange(1, 10**9)]) for s in names}
    got = mixing.schedule(blocks, weights)
    assert [slot for *_, slot in got] == list(range(sum(blocks.values())))
    done = dict.fromkeys(names, 0)
    flowed = {s: Fraction(0) for s in names}
    for source, block, _ in got:
        assert block == done[source]
        done[source] += 1
        # One slot of the ideal mix; within it sources may end.
        left = Fraction(1)
        while left:
            live = [s for s in names if flowed[s] < blocks[s]]
            total = sum(weights[s] for s in live)
            step = min([left / total, *((blocks[s] - flowed[s]) / weights[s] for s in live)])
            for s in live:
                flowed[s] += step * weights[s]
            left -= step * total
        assert all(abs(done[s] - flowed[s]) < 1 for s in names)
    assert done == blocks


def test_every_document_has_a_place(spark, monkeypatch):
    rows = [(i, "abc"[i % 3] if i % 7 else None, i % 50 * 10) for i in range(300)] + [(1, "b", 10), (None, "a", None), (400, "a", -5), (401, "c", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    for most in (65_536, 40):
        monkeypatch.setattr(mixing, "MAX_BLOCKS", most)
        got = mixing.mix(docs, block_size=500).collect()
        assert len(got) == len(rows)
        assert max(r["position"] for r in got) < (most + 4 if most == 40 else 10**6)
        at = {}
        for r in got:
            assert at.setdefault((r["source"], r["block"]), r["position"]) == r["position"]
        assert len(set(at.values())) == len(at)
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(docs, weights={"a": 1.0, "b": 0.0, "c": 1.0})
    assert mixing.mix(docs, weights={"a": 1.0, "b": 5.0, "c": 1.0, "": 1.0}).count() == len(rows)
