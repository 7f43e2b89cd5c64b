"""The ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from roamgrid.llm import lexical_search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score long, rank int, query string"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def plain(docs, items, best=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is not None, i if i is not None else 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:best])]
    return out


def made(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Über", "über", "x_y", "İ", "100", "ß"]
    share = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, share, k=rng.choice([1, 5, 60, 300])))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(120)]  # ties by copies
    docs += [(n + 500, None), (n + 501, ""), (n + 502, " .;"), (None, docs[3][1]), (5, docs[3][1]), (5, docs[3][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 8, 40])))) for k in range(40)]
    items += [(90, docs[3][1].upper()), (91, None), (92, ""), (93, "unknownterm"), (94, "w0"), (94, "w1 w1"), (None, "w2"), (95, "ÜBER straße")]
    return docs, items


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain(spark, monkeypatch, small):
    if small:  # many buckets, slices and rounds
        monkeypatch.setattr(lexical_search, "BUCKET", 16)
        monkeypatch.setattr(lexical_search, "ENTRIES", 500)
    docs, items = made(700)
    d = spark.createDataFrame([(*r, 1, 2, "q") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical_search.search(d, i)) == sorted(plain(docs, items), key=str)


def test_blocks_of_queries(spark):
    docs, items = made(200, 8)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical_search.search(d, i, best=7, block_chars=1000)) == sorted(plain(docs, items, 7), key=str)


def test_long_text(spark):
    docs = [(1, "aa bb " * 300_000 + "cc"), (2, "cc dd"), (3, "dd " * 40)]
    items = [(1, "cc aa"), (2, "dd")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical_search.search(d, i)) == sorted(plain(docs, items), key=str)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), items.filter("false")).collect() == []
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert lexical_search.search(only_null, items).collect() == []


def test_registered_query(spark, tmp_path):
    docs, items = made(150, 5)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(lexical_search.query(spark, str(tmp_path))) == sorted(plain(docs, items), key=str)


def test_buckets_are_pruned():
    """A bucket of short vectors, and one without enough of the heavy terms, is left by its bounds; exact ties at the threshold stay."""
    b = lexical_search.Bucket(np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([10, 5, 5]), 12.0)
    asked = np.array([0, 1]), np.array([3, 2])
    length = float(np.sqrt(13))
    assert len(b.search(*asked, length, 44)[0]) == 0  # sqrt(13) x 12 < 44
    assert [x.tolist() for x in b.search(*asked, length, 40)] == [[0], [40]]
    assert [x.tolist() for x in b.search(*asked, length, 1)] == [[0, 1], [40, 10]]
    assert len(b.search(*asked, length, 41)[0]) == 0  # by coordinates
