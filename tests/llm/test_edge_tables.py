"""Empty tables, repeated and null ids, and columns with clashing names, for the operators and stages that had no such test."""

import corpus_pipeline
import numpy as np
import pytest

from roamgrid.llm import chat_format, embedding_dedup, exact_dedup, jaccard_join, mixing, packing, quality, suffix_dedup
from tests.llm.test_brute_force import rated

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    ratings = quality.graded(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.classify(empty, ratings).collect() == [] and quality.keep_good(empty, ratings).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link_vectors(vectors).collect() == []
    assert suffix_dedup.dedup_bytes(empty).collect() == []
    assert exact_dedup.keep_one(empty).collect() == [] and jaccard_join.keep_one_of_each(empty).collect() == []
    assert mixing.in_mixed_order(empty).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.format_chats(turns).collect() == []


def test_empty_pipeline(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert packing.pack(empty).collect() == []


def test_ids_of_vectors(spark):
    """Null and repeated ids, and columns named like the operator's own."""
    rows = [(1, [1.0, 0.0], 5, "a", 9), (1, [0.0, 1.0], 5, "a", 9), (None, [1.0, 0.001], 5, "a", 9), (None, [3.0, 4.0], 5, "a", 9), (2, [0.0, 2.0], 5, "b", 9), (3, [0.0, 2.0], None, "b", 9)]
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h1 string, copies int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert sorted((r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None) == [(0, None), (1, 1)]


def test_rows_that_repeat_a_rated_id_count_once(spark, monkeypatch):
    rows = rated(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows for _ in range(5)] + [(None, "x"), (3, None)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(99_999, 0)], "doc_id long, grade int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda index, value, grade, **k: seen.append(len(grade)) or fit(index, value, grade, **k))
    assert quality.classify(docs, ratings).count() == 5 * 400 + 2 and seen == [400]
    quality.train(docs, ratings, 50)
    assert seen[1] <= 50


def test_only_telling_features_reach_the_driver(spark, monkeypatch):
    """The fit gets no feature that it would drop, and drops no other than with all of them."""
    rows = rated(400)
    docs = spark.createDataFrame([(i, f"{t} rare{i} seldom{i}") for i, t, _ in rows], "doc_id long, text string")
    given, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda index, value, grade, **k: given.extend(index) or fit(index, value, grade, **k))
    weights, _ = quality.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"))
    every = {i: quality.features(np.frombuffer(t.encode(), np.uint8)) for i, t in docs.collect()}
    grade = dict((i, g) for i, _, g in rows)
    whole, _ = fit([x for x, _ in every.values()], [v for _, v in every.values()], np.array([grade[i] for i in every]))
    assert np.array_equal(np.flatnonzero(weights), np.flatnonzero(whole))
    count = np.bincount(np.concatenate([np.unique(x) for x, _ in every.values()]), minlength=quality.DIMENSIONS)
    assert len(given) == 400 and all(count[i] >= quality.LEAST or i in quality._FORMS for x in given for i in x)
