import random

import pytest

from roamgrid.llm import jaccard_join


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("first_lists", [1, 32])
def test_long_lists_lose_no_link(spark, monkeypatch, first_lists):
    """Many texts that share a passage, few of them similar: hubs miss most links, so the lists must find them."""
    monkeypatch.setattr(jaccard_join, "FIRST_LISTS", first_lists)
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for group in range(25):
        own = [f"g{group}-{k}" for k in range(rng.randint(5, 25))]
        for _ in range(rng.randint(1, 6)):
            words = passage + own
            for _ in range(rng.randint(0, 2)):
                words = list(words)
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs).collect()}
    want = brute_force(rows)
    assert len(set(want.values())) > 5
    assert got == want


def test_buckets_grow_with_the_input(spark, monkeypatch):
    """A task holds a bucket of prefixes, or of cells, at a time: with more sets there are more of them, not larger ones."""
    asked, post = [], jaccard_join._post
    monkeypatch.setattr(jaccard_join, "_post", lambda buckets, *more: asked.append(buckets) or post(buckets, *more))
    monkeypatch.setattr(jaccard_join, "BUCKET_POSTS", 20)
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 20)
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join(passage + [f"g{i % 60}-{k}" for k in range(12)] + [f"x{rng.randrange(10**6)}" for _ in range(i % 3)])) for i in range(240)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)
    posts = sum(jaccard_join.prefix_lengths(len(shingles(t)))[0] for _, t in rows)
    assert asked == [-(-posts // 20)] and asked[0] > 100
