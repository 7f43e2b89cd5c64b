"""Ranked lexical search: an exact top-k by norm buckets.

A document is a sparse vector of impacts, a query a vector of weights over its terms; the score is their
product. Documents are ordered by length (norm) into buckets. The longest ones are scored first, which gives
each query a threshold, the score of its k-th best so far. Then, in each bucket: by Cauchy-Schwarz no
document scores more than |query| x the greatest length of the bucket, and buckets below a query's threshold
are left out; coordinate bounds (the greatest impact of each term in the bucket) leave of the others only
documents that hold enough of a query's heavy terms; these are scored exactly in 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, cut, documents

#: What a term is, and the constants of weights and impacts.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCALE, STEP, SLOPE, BASE, SHARE = 1_000_000_000, 1000, 20, 100, 50
BEST = 50
#: Characters of queries that are searched in one go: they bound what is shipped with a pass. More queries take more passes.
BLOCK_CHARS = 16_000_000
#: Rows of a bucket, and entries of all vectors that a task holds at a time.
BUCKET, ENTRIES = 1024, 2_000_000
#: Documents of the first round: those longer than all but a share of FIRST.
FIRST = 1 / 16
_LOWER = str.maketrans(UPPER, LOWER)
VECTOR = "doc_id {}, n long, terms array<int>, tf array<long>"


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.translate(_LOWER) if not text.islower() else text)


def vectors(docs: DataFrame, number: dict) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n (terms with repeats), and of the terms that have a number these and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        known = shared.value
        for batch in batches:
            ns, sizes, terms, tf = [], [0], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py()) if text.is_valid else []
                ns.append(len(found))
                held = Counter(found)
                for term in held.keys() & known.keys():
                    terms.append(known[term])
                    tf.append(held[term])
                sizes.append(len(terms))
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, kind))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), lists(terms, pa.int32()), lists(tf, pa.int64())], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, VECTOR.format(dict(docs.dtypes)["doc_id"]))


class Bucket:
    """Vectors of similar length: rows of sorted (term, impact), and where each term occurs."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, longest: float):
        self.starts, self.terms, self.impacts, self.longest = starts, terms, impacts, longest
        self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.by_term = np.argsort(terms, kind="stable")
        of = terms[self.by_term]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
        self.known, self.at = of[at], np.r_[at, len(of)]
        self.most = np.maximum.reduceat(impacts[self.by_term], at) if len(of) else impacts[:0]

    def search(self, terms: np.ndarray, weights: np.ndarray, length: float, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may score at least `threshold` (and more than 0), and their exact scores."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if length * self.longest * (1 + 1e-9) < threshold or not len(self.known):
            return none
        k = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        here = self.known[k] == terms
        k, w = k[here], weights[here]
        bound = w * self.most[k]
        order = np.argsort(-bound, kind="stable")
        k, w, bound = k[order], w[order], bound[order]
        rest = np.r_[np.cumsum(bound[::-1])[::-1], 0]  # what terms from here on can add at most
        if rest[0] < max(threshold, 1):
            return none
        # A document without any of the first terms can't reach the threshold by the others.
        first = int(np.count_nonzero(rest >= max(threshold, 1)))
        part = np.zeros(len(self.starts) - 1, np.int64)
        for j in range(first):
            at = self.by_term[self.at[k[j]] : self.at[k[j] + 1]]
            part[self.row[at]] += w[j] * self.impacts[at]
        rows = np.flatnonzero((part > 0) & (part + rest[first] >= threshold))
        # The others are added term by term; after each, documents that the rest can't lift go.
        score = part[rows]
        for j in range(first, len(k)):
            if not len(rows):
                return none
            at = self.by_term[self.at[k[j]] : self.at[k[j] + 1]]
            here = np.zeros(len(part), np.int64)
            here[self.row[at]] = self.impacts[at]
            score = score + w[j] * here[rows]
            keep = score + rest[j + 1] >= threshold
            rows, score = rows[keep], score[keep]
        return rows, score


class Queries:
    """Queries of a block: sorted terms with their weights, and the queries' lengths."""

    def __init__(self, queries: list, number: dict, weight: np.ndarray):
        self.keys = [key for key, _ in queries]
        self.terms = [np.array(sorted(number[t] for t in terms), np.int64) for _, terms in queries]
        self.weights = [weight[t] for t in self.terms]
        self.lengths = [float(np.sqrt((w.astype(float) ** 2).sum())) for w in self.weights]


def impacts_of(n, tf, total: int, all_terms: int):
    """Impacts of terms that occur tf times in documents of n terms."""
    m = BASE - SHARE + (SHARE * n * total) // max(1, all_terms)
    return (SCALE * tf) // (STEP * tf + SLOPE * m)


def slices(batch, total: int, all_terms: int):
    """(rows, row starts, terms, impacts, lengths) of a batch, in parts of at most ENTRIES entries or one row."""
    starts = batch.column(2).offsets.to_numpy().astype(np.int64)
    starts, first = starts - starts[0], 0
    n = batch.column(1).to_numpy()
    terms, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + ENTRIES, "right")) - 1)
        a, b = starts[first], starts[last]
        own = starts[first : last + 1] - a
        row = np.repeat(np.arange(last - first), np.diff(own))
        impacts = impacts_of(n[first:last][row], tf[a:b], total, all_terms)
        lengths = np.sqrt(np.bincount(row, impacts.astype(float) ** 2, minlength=last - first))
        yield np.arange(first, last), own, terms[a:b], impacts, lengths
        first = last


def buckets(starts, terms, impacts, lengths):
    """Parts of BUCKET rows, longest vectors first, with the rows' places."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    size = np.diff(starts)
    for i in range(0, len(order), BUCKET):
        rows = order[i : i + BUCKET]
        new = np.r_[0, np.cumsum(size[rows])]
        take = np.repeat(starts[rows] - new[:-1], size[rows]) + np.arange(new[-1])
        yield rows, Bucket(new, terms[take], impacts[take], float(lengths[rows[0]]))


def search_vectors(found: DataFrame, queries: Queries, total: int, all_terms: int, best: int, *, above: float | None = None, upto: float | None = None, thresholds: dict | None = None) -> DataFrame:
    """(query, doc_id, score): in each task the best documents of each query (ties at the end all stay), among vectors
    longer than `above`, or not longer than `upto`."""
    shared = found.sparkSession.sparkContext.broadcast((queries, thresholds or {}))
    kind = dict(found.dtypes)["doc_id"]

    def run(batches):
        q, known = shared.value
        least = np.array([known.get(i, 1) for i in range(len(q.keys))], np.int64)
        kept: list = [(pa.array([], pa.int64()), np.zeros(0, np.int64)) for _ in q.keys]
        ids_kind = None
        for batch in batches:
            ids_kind = batch.column(0).type
            for places, starts, terms, impacts, lengths in slices(batch, total, all_terms):
                if above is not None:
                    lengths = np.where(lengths > above, lengths, 0.0)
                if upto is not None:
                    lengths = np.where(lengths <= upto, lengths, 0.0)
                for rows, bucket in buckets(starts, terms, impacts, lengths):
                    for i in range(len(q.keys)):
                        at, score = bucket.search(q.terms[i], q.weights[i], q.lengths[i], least[i])
                        if not len(at):
                            continue
                        ids, scores = kept[i]
                        new = pc.take(batch.column(0), pa.array(places[rows[at]]))
                        ids, scores = pa.concat_arrays([ids.cast(ids_kind) if not len(ids) else ids, new]), np.r_[scores, score]
                        if len(scores) > best:
                            chosen = pc.sort_indices(pa.table({"s": scores, "d": ids}), [("s", "descending"), ("d", "ascending")], null_placement="at_start")[:best]
                            ids, scores = pc.take(ids, chosen), scores[chosen.to_numpy()]
                            least[i] = max(least[i], scores[-1])
                        kept[i] = ids, scores
        for i, (ids, scores) in enumerate(kept):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i)), ids, pa.array(scores)], names=["query", "doc_id", "score"])

    return found.mapInArrow(run, f"query long, doc_id {kind}, score long")


def _best(rows: DataFrame, best: int) -> DataFrame:
    """The best rows of each query with their rank: first of each of a number of parts, so that no task has all rows of a query."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")
    some = rows.select("*", part).withColumn("rank", rank(["query", "part"])).filter(F.col("rank") <= best)
    return some.withColumn("rank", rank(["query"])).filter(F.col("rank") <= best).drop("part")


def _search_block(d: DataFrame, asked: list, best: int, item_kind: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for [(item_id, terms)]."""
    number = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    found = cut(vectors(d, number))
    stats = found.agg(F.count_if(F.col("n") > 0).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    total, all_terms = stats["total"], stats["terms"]
    df = np.zeros(len(number), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a number for each term of the block
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    queries = Queries(asked, number, weight)

    def run(batches):
        for batch in batches:
            for *_, lengths in slices(batch, total, all_terms):
                yield pa.RecordBatch.from_arrays([pa.array(lengths[lengths > 0])], names=["length"])

    limit = found.mapInArrow(run, "length double").agg(F.percentile_approx("length", 1 - FIRST, 1000)).first()[0]
    run = lambda **k: search_vectors(found, queries, total, all_terms, best, **k)
    if limit is None:
        limit = 0.0
    first = cut(_best(run(above=limit), best))
    # The k-th best score of the longest documents; a query that has fewer of them has no threshold yet.
    least = {r["query"]: r["score"] for r in first.filter(F.col("rank") == best).collect()}
    rest = run(upto=limit, thresholds=least)
    out = _best(first.drop("rank").unionByName(rest), best)
    names = d.sparkSession.createDataFrame(list(enumerate(queries.keys)), f"query long, item_id {item_kind}")
    return out.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `best` documents of each item with a score above 0, equal scores by ascending doc_id, null first.

    Every row of docs counts, repeated ids too. A null or empty text has no terms, and counts neither in the number of
    documents nor among results. An item without terms, or whose terms occur nowhere, has no rows; rows of
    items are searched one by one, so that a repeated item_id has several lists. Items are searched in blocks of
    block_chars characters, each with its passes over all documents. No rows in: no rows out.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    q = cut(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").withColumn("row", F.monotonically_increasing_id()))
    chars = q.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars) or 1
    out = []
    for b in range(n):
        rows = q.filter(F.pmod(F.xxhash64("row"), F.lit(n)) == b).collect()  # about block_chars characters
        asked = [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in rows]
        if asked := [x for x in asked if x[1]]:
            found = _search_block(d, asked, best, dict(q.dtypes)["item_id"])
            out.append(cut(found) if n > 1 else found)
    if not out:
        return q.join(d.select("doc_id"), F.lit(False)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def query(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
