"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the sum of shared weights of its hashed features; ordered thresholds turn it into
P(grade <= k) = 1 / (1 + exp(score - threshold k)). Expected grade and tail probability follow.
Grades here: 0 low quality, 1 toxic, 2 neither.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _LOWER, Prefix, byte_values, mix, texts
from ._common import cut, documents

U = np.uint64
GRADES = 3
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 12_000
DIMENSIONS = 1 << 22
#: A text is kept if P(grade >= KEEP_GRADE) is at least KEEP_PROBABILITY.
KEEP_GRADE, KEEP_PROBABILITY = 2, 0.6
#: Bytes of the word beginnings that count beside whole words.
HEADS = (4, 5, 6)
_CLASS = np.full(256, 3, np.uint8)  # symbols
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_CLASS[range(48, 58)] = 2
_FORMS = DIMENSIONS - np.arange(1, 5)


def features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: presence of letter runs in lower case and of their beginnings, shares of symbol runs, and the text's form."""
    if not len(raw):
        return _FORMS[:1], np.ones(1, np.float32)
    kind = _CLASS[raw]
    at = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    end = np.r_[at[1:], len(raw)]
    kind = kind[at]
    prefix = Prefix(byte_values(_LOWER[raw]))
    h = mix(prefix.span(at, end) + kind)
    words, symbols = h[kind == 1], h[kind == 3]
    n = max(1, len(words))
    at, end = at[kind == 1], end[kind == 1]
    heads = [mix(prefix.span(a := at[end - at > k], a + k) + U(k)) for k in HEADS]
    present = np.unique(np.concatenate([words, *heads]))
    signs, count = np.unique(symbols, return_counts=True)
    ascii_letters = (raw < 0x80) & (_CLASS[raw] == 1)
    upper = np.count_nonzero(ascii_letters & (raw < 97)) / max(1, np.count_nonzero(ascii_letters))
    again = np.count_nonzero(words[1:] == words[:-1]) / n
    index = np.r_[(np.r_[present, signs] % U(DIMENSIONS - 8)).astype(np.int64), _FORMS[1:]]
    value = np.r_[np.ones(len(present)), 3 * np.sqrt(np.minimum(1, count / n)), 3 * np.sqrt(upper), 3 * np.sqrt(again), 3 * np.sqrt(len(present) / (4 * n))]
    return index, value.astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Features of fewer than LEAST rows, or with a mean grade less than FAR standard errors from that of all, get no weight.
LEAST, FAR = 20, 8.0


def telling(seen: np.ndarray, total: np.ndarray, grade: np.ndarray, z: float = FAR) -> np.ndarray:
    """Which features, seen in so many rows with such a sum of grades, have a mean grade far enough from that of all."""
    return np.abs(total / seen - grade.mean()) >= z * grade.std() / np.sqrt(seen)


def fit(index: list, value: list, grade: np.ndarray, *, epochs: int = 25, batch: int = 256, rate: float = 0.3, ridge: float = 1e-5, least: int = LEAST, z: float = FAR):
    """Weights and thresholds by minibatches with rates that adapt to each weight. Features of fewer than `least` rows get no weight, nor do those whose rows' mean grade is less than `z` standard errors from that of all: many small weights would only add up with a text's length."""
    seen, total = np.zeros(DIMENSIONS, np.int32), np.zeros(DIMENSIONS, np.float32)
    for i, y in zip(index, grade, strict=True):  # row by row: all indices at once would take much memory
        i = np.unique(i)
        seen[i] += 1
        total[i] += y
    enough = np.flatnonzero(seen >= least)
    known = np.union1d(enough[telling(seen[enough], total[enough], grade, z)], _FORMS)
    rows_of = []
    for i, v in zip(index, value, strict=True):
        at = np.minimum(np.searchsorted(known, i), len(known) - 1)
        ok = known[at] == i
        rows_of.append((at[ok], v[ok].astype(np.float64)))
    w, g2 = np.zeros(len(known)), np.full(len(known), 1e-6)
    t, t2 = np.linspace(-1, 1, GRADES - 1), np.full(GRADES - 1, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            idx, val = (np.concatenate([rows_of[r][k] for r in rows]) for k in (0, 1))
            row = np.repeat(np.arange(len(rows)), [len(rows_of[r][0]) for r in rows])
            score = np.bincount(row, w[idx] * val, minlength=len(rows))
            y = grade[rows]
            high, low = np.r_[t, np.inf][y], np.r_[-np.inf, t][y]
            a, b = _sigmoid(high - score), _sigmoid(low - score)
            da, db = a * (1 - a), b * (1 - b)
            p = np.maximum(a - b, 1e-9)
            slope = (da - db) / p / len(rows)  # of the loss by the score
            g = np.bincount(idx, slope[row] * val, minlength=len(w)) + ridge * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gt = np.array([(-(da / p)[y == k].sum() + (db / p)[y == k + 1].sum()) / len(rows) for k in range(GRADES - 1)])
            t2 += gt * gt
            t = np.sort(t - rate * gt / np.sqrt(t2))
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[known] = w
    return weights, t


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) to (doc_id, grade); rows with a null are left out, of repeated ids the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_TRAIN_ROWS):
    """Fits on at most max_rows of ratings(doc_id, grade) and their texts in docs(doc_id, text). None without any.

    Of rows that repeat an id one counts, that with the smallest text: what comes to the driver is bounded by max_rows, and of
    these rows it gets the features that tell grades apart.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            got = [features(raw) for raw in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.float32()))], names=["grade", "index", "value"])

    def counted(batches):
        every = [(np.unique(i.values.to_numpy()), g) for batch in batches for i, g in zip(batch.column("index"), batch.column("grade").to_pylist(), strict=True)]
        if every:
            index = np.concatenate([i for i, _ in every])
            value, at = np.unique(index, return_inverse=True)
            total = np.bincount(at, np.repeat([g for _, g in every], [len(i) for i, _ in every]))
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(np.bincount(at)), pa.array(total.astype(np.int64))], names=["index", "seen", "total"])

    # Features that fit() would leave out anyway, which most are, stay where they are: few KB a row would be many MB on the driver.
    shown = cut(rows.mapInArrow(run, "grade int, index array<int>, value array<float>"))
    grade = shown.select("grade").toArrow().column("grade").to_numpy()
    if not len(grade):
        return None
    often = shown.select("grade", "index").mapInArrow(counted, "index int, seen long, total long").groupBy("index").agg(F.sum("seen").alias("seen"), F.sum("total").alias("total"))
    index, seen, total = (c.to_numpy() for c in often.filter(F.col("seen") >= LEAST).select("index", "seen", "total").toArrow().columns)
    # A hair wider than fit()'s own test, which decides.
    known = np.union1d(index[telling(seen, total, grade, FAR * (1 - 1e-3))], _FORMS).astype(np.int32)

    def told(batches):
        for batch in batches:
            got = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(batch.column("index"), batch.column("value"), strict=True)]
            ok = [np.isin(i, known) for i, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([i[k] for (i, _), k in zip(got, ok, strict=True)], pa.list_(pa.int32())), pa.array([v[k] for (_, v), k in zip(got, ok, strict=True)], pa.list_(pa.float32()))], names=["grade", "index", "value"])

    found = shown.mapInArrow(told, "grade int, index array<int>, value array<float>").toArrow()
    listed = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in found.column(c)]
    return fit(listed("index"), listed("value"), found.column("grade").to_numpy())


def _score(model, raws):
    """Expected grade and tail probability of each text."""
    weights, thresholds = model
    score = np.array([float(weights[i] @ v) for i, v in map(features, raws)]).reshape(-1, 1)
    above = 1 - _sigmoid(thresholds - score)  # P(grade > k)
    return above.sum(1), above[:, KEEP_GRADE - 1]


def classify(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, expected_grade, p_tail, kept. Null texts count as empty; empty
    texts are scored like others. Without ratings everything is kept, with null scores. Each row is scored by itself,
    also where ids are null or repeat; a null id has no rating. No rows in: no rows out."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if (model := train(d, ratings, max_rows)) is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_tail"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            grade, tail = _score(shared.value, texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(tail), pa.array(tail >= KEEP_PROBABILITY)], names=["doc_id", "expected_grade", "p_tail", "kept"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, expected_grade double, p_tail double, kept boolean")


def keep_good(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns; nulls, repeated ids and empty tables as there."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if (model := train(d, ratings, max_rows)) is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            tail = _score(shared.value, texts(batch.column(column)))[1]
            yield batch.filter(pa.array(tail >= KEEP_PROBABILITY))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
