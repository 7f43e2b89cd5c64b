"""N-gram Jaccard join: count vectors in an R-tree bound the overlap of sets, and what survives is verified.

A document's set is its distinct 5-word shingles. Shingles are hashed into groups, and the counts
per group make a point; the sum over groups of the smaller counts bounds the overlap of two sets
from above. Points of long texts are all about as far from each other in so many dimensions, so that
one tree over the whole corpus would compare every document with every other. The join is therefore
in three steps, none of which loses a link:

1. Prefixes. Under one global order of shingles (those that are frequent anywhere last, else by
   hash) two sets with Jaccard >= 0.75 share a shingle among the first quarter of each. Lists of sets
   by shingle are made with numpy blobs; short lists give all their pairs, long ones pairs with one
   hub only.
2. The pairs' bounds are tested on the count vectors and survivors are verified on whole sets. Links
   are joined to components.
3. In long lists whose sets aren't all in one component yet, an R-tree over count vectors finds the
   remaining pairs across components within the bound; they are verified too: first the few most
   promising ones of each set, which mostly join a dense group, then all that are left across components.
   Of the lists that two sets share the smallest gives the pair, so that a pair found by many shingles is few rows.

Equal sets are one set throughout; they are told apart by BLAKE2b digests of their shingles' hashes, two
for each set, and should two sets share one digest and not the other, all is done again with other digests.
Candidates and bounds go by 64-bit hashes of shingles; a pair is verified on the words of both texts.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import gram_hashes, mix, texts, word_hashes, words
from ._common import cut, documents, join_with_hot, partitions
from ._components import components
from ._repeats import _batch

U = np.uint64
WORDS = 5
#: Least similarity, in hundredths.
PERCENT = 75
#: Dimensions of the count vectors.
GROUPS = 256
#: Words of verified sets that a task keeps, about.
HELD_WORDS = 500_000
#: Digests that are tried before different sets with equal ones are an error.
SEEDS = 4
#: Lists up to this length give all their pairs.
SHORT = 24
#: A shingle is frequent if a task meets it in this many sets; so many of these are ordered last at most.
FREQUENT, MAX_FREQUENT = 3, 400_000
#: Each set carries so many of its smallest long lists, so that few pairs are found in more than one.
FIRST_LISTS = 32
LEAF = 16
#: Pairs of a set in the first search of the long lists.
PROMISING = 4
#: Members of a long list that a task takes, about: as points of its tree, and as queries.
BLOCK = 4096
#: Posts of one bucket of prefixes, and rows of one bucket of cells, about: a task holds one bucket at a time.
BUCKET_POSTS, BUCKET_ROWS = 250_000, 16_384
_SETS = "kind int, doc_id long, n long, set_id long, check long, counts binary"


def shingles(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words, of the whole sequence."""
    h = word_hashes(raw, lower=True)
    k = min(WORDS, len(h))
    if not k:
        return h
    s = np.sort(gram_hashes(h, k) + U(k))
    return s[np.r_[True, s[1:] != s[:-1]]]


def identity(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two digests of a set as signed 64-bit numbers."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16, salt=bytes([seed])).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _describe(batches, seed: int):
    """Kind 0: each document's set; kind 1: shingles that this task meets often (hash, count in n)."""
    held, size = [], 0

    def often():
        value, count = np.unique(np.concatenate(held), return_counts=True)
        pick = np.flatnonzero(count >= FREQUENT)
        pick = pick[np.argsort(-count[pick], kind="stable")][:MAX_FREQUENT]
        value, count = value[pick].view(np.int64), count[pick]
        zero = np.zeros(len(pick), np.int64)
        held.clear()
        return _batch(_SETS, kind=np.ones(len(pick), np.int32), doc_id=zero, n=count, set_id=value, check=zero, counts=[b""] * len(pick))

    for batch in batches:
        rows = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            s = shingles(raw)
            rows.append((0, doc_id, len(s), *(identity(s, seed) if len(s) else (0, 0)), count_vector(s).tobytes()))
            held.append(s)
            size += len(s)
            if size > 3_000_000:
                yield often()
                size = 0
        if rows:
            yield _batch(_SETS, **dict(zip(("kind", "doc_id", "n", "set_id", "check", "counts"), zip(*rows, strict=True), strict=True)))
    if held:
        yield often()


_POSTS = "bucket int, token binary, set_id binary, n binary, front binary"
_PAIRS = "kind int, list long, a long, b long, n long"


def prefix_lengths(n: int) -> tuple[int, int]:
    """Shingles that a set of n must show as the longer, and as the shorter (or equal) of two similar sets."""
    longer = n - -(-PERCENT * n // 100) + 1
    shorter = n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
    return longer, shorter


def _post(buckets: int, frequent, seed: int):
    def run(batches):
        last, count = frequent.value
        known: set[int] = set()
        held, size = [], 0

        def flush():
            token = np.concatenate([h[0] for h in held])
            lens = [len(h[0]) for h in held]
            set_id, n = (np.repeat(np.array([h[k] for h in held], np.int64), lens) for k in (1, 2))
            front = np.concatenate([np.arange(x) < h[3] for x, h in zip(lens, held, strict=True)]).astype(np.uint8)
            bucket = ((token >> U(32)) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            parts = lambda x, t: [y.astype(t).tobytes() for y in np.split(x[order], at[1:])]
            held.clear()
            return _batch(_POSTS, bucket=bucket[order][at], token=parts(token & U(0xFFFFFFFF), "<u4"), set_id=parts(set_id, "<i8"), n=parts(n, "<i4"), front=parts(front, "u1"))

        for batch in batches:
            for raw in texts(batch.column(0)):
                s = shingles(raw)
                if not len(s):
                    continue
                set_id = identity(s, seed)[0]
                if set_id in known:  # an equal set was here
                    continue
                known.add(set_id)
                longer, shorter = prefix_lengths(len(s))
                rank = np.zeros(len(s), np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    rank = np.where(last[at] == s, count[at], 0)
                prefix = s[np.lexsort((mix(s), rank))][:longer]
                held.append((mix(prefix), set_id, len(s), shorter))
                size += longer
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _buckets(spark, rows: int | None, each: int) -> int:
    """So many that one holds about `each` of the rows, whatever the size of the input."""
    return max(4 * partitions(spark), -(-(rows or 0) // each))


def _fits(n_short, n_long):
    return 100 * n_short >= PERCENT * n_long


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Kind 0: pairs to test; kind 1: the members of long lists; kind 2: members (a) and hubs (b) of these."""
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    token, set_id, n, front = join("token", "<u4"), join("set_id", "<i8"), join("n", "<i4").astype(np.int64), join("front", "u1").astype(bool)
    order = np.lexsort((set_id, n, token))
    token, set_id, n, front = token[order], set_id[order], n[order], front[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (set_id[1:] != set_id[:-1])] if len(token) else np.zeros(0, bool)
    token, set_id, n, front = token[keep], set_id[keep], n[keep], front[keep]
    at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    size = np.diff(np.r_[at, len(token)])
    group = np.repeat(np.arange(len(at)), size)
    short = np.flatnonzero((size > 1) & (size <= SHORT))
    a, b = [], []
    pick = np.flatnonzero(np.isin(group, short))
    g, s, m, f = group[pick], set_id[pick], n[pick], front[pick]
    for step in range(1, SHORT):
        if len(g) <= step:
            break
        ok = (g[step:] == g[:-step]) & f[:-step] & _fits(m[:-step], m[step:])
        a.append(s[:-step][ok])
        b.append(s[step:][ok])
    rows = {c: [] for c in ("kind", "list", "a", "b", "n")}

    def add(kind, lists, x, y, n):
        rows["kind"].append(np.full(len(x), kind, np.int32))
        for c, v in (("list", lists), ("a", x), ("b", y), ("n", n)):
            rows[c].append(v.astype(np.int64))

    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        zero = np.zeros(both.shape[1], np.int64)
        add(0, zero, both[0], both[1], zero)
    for i in np.flatnonzero(size > SHORT):
        part = slice(at[i], at[i] + size[i])
        s, m = set_id[part], n[part]
        # Hubs by size class, the same for all lists with the same members.
        cls = np.floor(np.log(m) / np.log(100 / PERCENT)).astype(np.int64)
        for c in np.unique(cls):
            own = s[cls == c]
            hub = own.min()
            near = np.abs(cls - c) <= 1
            other = s[near][s[near] != hub]
            add(2, np.zeros(len(other)), other, np.full(len(other), hub), np.zeros(len(other)))
        number = (int(key[0].as_py()) << 32) + int(token[at[i]])
        add(1, np.full(len(s), number, np.int64), s, front[part], m)
    if not rows["kind"]:
        return pa.Table.from_batches([], schema=_batch(_PAIRS, kind=[], list=[], a=[], b=[], n=[]).schema)
    return pa.Table.from_batches([_batch(_PAIRS, **{c: np.concatenate(v) for c, v in rows.items()})])


def count_vector(s: np.ndarray) -> np.ndarray:
    """How many shingles each group has."""
    counts = np.bincount((mix(s) >> U(56)).astype(np.int64), minlength=GROUPS)
    return counts.astype("<u2" if counts.max(initial=0) < 1 << 16 else "<u4")


def _counts(column) -> np.ndarray:
    """Count vectors of a column, one row each."""
    rows = column.to_pylist()
    if all(len(x) == 2 * GROUPS for x in rows):
        return np.frombuffer(b"".join(rows), "<u2").reshape(-1, GROUPS).astype(np.int64)
    return np.array([np.frombuffer(x, "<u2" if len(x) == 2 * GROUPS else "<u4") for x in rows]).reshape(-1, GROUPS).astype(np.int64)


def _contents(seed: int):
    """(set_id, text) to the text's words, lower-cased and joined by one space; only where the text still has that set."""

    def run(batches):
        for batch in batches:
            raws = list(texts(batch.column(1)))
            sets = [shingles(raw) for raw in raws]
            same = [len(s) > 0 and identity(s, seed)[0] == i for s, i in zip(sets, batch.column(0).to_pylist(), strict=True)]
            said = [b" ".join(words(raw, lower=True)) for raw, ok in zip(raws, same, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same, pa.bool_())), pa.array(said, pa.binary())], names=["set_id", "words"])

    return run


def word_shingles(said: bytes) -> set:
    """The shingles themselves of words joined by one space."""
    w = said.split(b" ")
    k = min(WORDS, len(w))
    return set(zip(*(w[i:] for i in range(k)), strict=False))


def within_bound(counts_a, counts_b, n_a, n_b):
    """Whether the sum of smaller counts allows the similarity: overlap o needs 100 o >= PERCENT (n_a + n_b - o)."""
    return (100 + PERCENT) * np.minimum(counts_a, counts_b).sum(-1) >= PERCENT * (n_a + n_b)


def _bounded(batches):
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        both = [_counts(batch.column(c)) for c in ("counts_a", "counts_b")]
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(within_bound(*both, n_a, n_b)))


def _verified(batches):
    known, size = {}, 0

    def of(set_id: int, said) -> set:
        nonlocal size
        if set_id not in known:
            if size > HELD_WORDS:
                known.clear()
                size = 0
            known[set_id] = word_shingles(said.as_py())
            size += len(known[set_id])
        return known[set_id]

    for batch in batches:
        ok = []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            x, y = of(a, batch.column("words_a")[i]), of(b, batch.column("words_b")[i])
            both = len(x & y)
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """pairs(a, b) to those that are similar: first by bounds on count vectors, then on whole sets,
    which only documents that pass the bounds are read again for."""
    side = lambda c, what: sets.select(F.col("set_id").alias(c), F.col(what).alias(f"{what}_{c}"), F.col("n").alias(f"n_{c}"))
    near = pairs.join(side("a", "counts"), "a").join(side("b", "counts"), "b").select("a", "b", "counts_a", "counts_b", "n_a", "n_b")
    near = cut(near.mapInArrow(_bounded, "a long, b long, n_a long, n_b long"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    shown = sets.join(wanted, "set_id").select("doc_id", "set_id")
    held = cut(docs.join(shown, "doc_id").select("set_id", "text").mapInArrow(_contents(seed), "set_id long, words binary"))
    whole = near.join(held.toDF("a", "words_a"), "a").join(held.toDF("b", "words_b"), "b").select("a", "b", "words_a", "words_b")
    return cut(whole.mapInArrow(_verified, "a long, b long").distinct())


class CountTree:
    """R-tree over count vectors: sorted into leaves by recursive halving along the widest dimension."""

    def __init__(self, counts: np.ndarray, n: np.ndarray) -> None:
        self.order = np.concatenate(self._halve(counts, np.arange(len(counts))))
        self.counts, self.n = counts[self.order], n[self.order]
        self.levels = []  # (start of each box, its upper corner, its smallest and largest n), from leaves up
        at = np.arange(0, len(counts), LEAF)
        self.levels.append((at, np.maximum.reduceat(self.counts, at), np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at)))
        while len(self.levels[-1][0]) > LEAF:
            _, high, low_n, high_n = self.levels[-1]
            at = np.arange(0, len(high), LEAF)
            self.levels.append((at, np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)))

    def _halve(self, counts, rows):
        if len(rows) <= LEAF:
            return [rows]
        part = counts[rows]
        widest = np.argmax(part.max(0) - part.min(0))
        rows = rows[np.argsort(part[:, widest], kind="stable")]
        half = -(-len(rows) // 2 // LEAF) * LEAF
        return self._halve(counts, rows[:half]) + self._halve(counts, rows[half:])

    def search(self, counts: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points that the bounds allow to be similar."""
        at, high, low_n, high_n = self.levels[-1]
        boxes = np.arange(len(at))
        for depth in range(len(self.levels) - 1, -1, -1):
            _, high, low_n, high_n = self.levels[depth]
            need = PERCENT * (n + np.maximum(low_n[boxes], -(-PERCENT * n // 100)))
            ok = ((100 + PERCENT) * np.minimum(counts, high[boxes]).sum(1) >= need) & (100 * high_n[boxes] >= PERCENT * n) & (PERCENT * low_n[boxes] <= 100 * n)
            boxes = boxes[ok]
            below = len(self.levels[depth - 1][0]) if depth else len(self.n)
            boxes = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            boxes = boxes[boxes < below]
        ok = within_bound(self.counts[boxes], counts, self.n[boxes], n)
        return self.order[boxes[ok]]


def _across(most: int | None):
    """Pairs within the bound across components, for the blocks of lists of one bucket: of each set in a list
    all, or the `most` that the bound leaves the greatest overlap. A pair is left to
    the smallest list that both have, as far as `firsts`, the smallest lists of each set, show it."""

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        table = table.sort_by([("list", "ascending"), ("cell", "ascending")])
        lists, cells = table.column("list").to_numpy(), table.column("cell").to_numpy()
        at = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (cells[1:] != cells[:-1])])
        for i, j in zip(at, np.r_[at[1:], len(lists)], strict=True):
            part = table.slice(i, j - i)
            s, n, comp, main, role = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "n", "component", "main", "role"))
            counts = _counts(part.column("counts"))
            firsts = [set(x) for x in part.column("firsts").to_pylist()]
            points = np.flatnonzero(role != 1)
            # The members of the list's main component needn't be queries: links across have another end.
            asked = np.flatnonzero((role != 0) & (comp != main))
            if not len(points) or not len(asked):
                continue
            tree = CountTree(counts[points], n[points])
            for q in asked:
                hit = points[tree.search(counts[q], int(n[q]))]
                hit = hit[comp[hit] != comp[q]]
                if smaller := {x for x in firsts[q] if x < lists[i]}:
                    hit = hit[np.array([smaller.isdisjoint(firsts[h]) for h in hit], bool)]
                if most and len(hit) > most:
                    left = np.minimum(counts[hit], counts[q]).sum(1) / (n[hit] + n[q])
                    # Of equal bounds those that are drawn by the pair, so that sets don't all choose the same partners.
                    drawn = mix((s[hit] ^ s[q]).view(np.uint64))
                    hit = hit[np.lexsort((drawn, -left))[:most]]
                a.append(np.minimum(s[hit], s[q]))
                b.append(np.maximum(s[hit], s[q]))
        both = np.unique(np.stack([np.concatenate(a or [lists[:0]]), np.concatenate(b or [lists[:0]])]), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return run


def _open_lists(labelled: DataFrame, members: DataFrame) -> DataFrame:
    """Members of lists that hold several components, dealt to cells. A list of up to BLOCK members is one
    cell, where each is point and query (role 2); a longer one is cut into blocks, and each block of points
    (role 0) meets each block of queries (role 1) in a cell of its own. main: the component that most members of the list have."""
    each = labelled.groupBy("list", "component").agg(F.count(F.lit(1)).alias("rows"))
    found = each.groupBy("list").agg(F.count(F.lit(1)).alias("several"), F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("rows"))
    found = cut(found.filter("several > 1").select("list", "main", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    dealt_rows = found.agg(F.sum(F.col("rows") * F.when(F.col("blocks") == 1, 1).otherwise(2 * F.col("blocks")))).first()[0]
    buckets = _buckets(labelled.sparkSession, dealt_rows, BUCKET_ROWS)
    mixed = join_with_hot(labelled, found, "list", "rows").filter("main is not null")
    own = F.pmod(F.xxhash64("a"), "blocks").cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda p, q, role: F.struct((p * F.col("blocks") + q).cast("long").alias("cell"), F.lit(role).alias("role"))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(2).alias("role")))
    split = F.concat(F.transform(others, lambda q: cell(F.col("own"), q, 0)), F.transform(others, lambda p: cell(p, F.col("own"), 1)))
    dealt = mixed.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("blocks") == 1, alone).otherwise(split)))
    dealt = dealt.select("list", "a", "n", "component", "main", "at.cell", "at.role").filter("role <> 1 or component <> main")
    bucket = F.pmod(F.xxhash64("list", "cell"), F.lit(buckets)).alias("bucket")
    return dealt.join(members, "a").select(bucket, "list", "cell", "role", "a", "n", "component", "main", "counts", "firsts")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Null, empty and blank texts have no shingles and link with nothing, so each is its own
    component. Rows that repeat an id and text have one component. A set that only rows with a null
    id hold links with nothing, and its component_id is null. No rows in: no rows out.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for seed in range(SEEDS):
        described = cut(d.mapInArrow(partial(_describe, seed=seed), _SETS))
        own = described.filter("kind = 0").drop("kind")
        shared = own.filter("n > 0").groupBy("set_id").agg(F.min(F.struct("check", "n")).alias("low"), F.max(F.struct("check", "n")).alias("high"))
        if shared.filter("low <> high").isEmpty():
            break
    else:
        raise RuntimeError(f"different sets with equal digests for each of {SEEDS} salts")
    often = described.filter("kind = 1").groupBy("set_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "set_id").limit(MAX_FREQUENT).toArrow()
    value, count = often.column("set_id").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(value)
    frequent = spark.sparkContext.broadcast((value[order], count[order]))  # MAX_FREQUENT rows at most
    shown = own.filter("n > 0").agg(F.sum(F.expr(f"n - ceil({PERCENT} * n / 100) + 1"))).first()[0]  # as prefix_lengths(), with all copies
    buckets = _buckets(spark, shown, BUCKET_POSTS)
    posts = d.select("text").mapInArrow(_post(buckets, frequent, seed), _POSTS)
    found = cut(posts.groupBy("bucket").applyInArrow(_pairs, _PAIRS))
    # One hub for each set: that links most of a dense group, and what it leaves is found in the lists.
    hubs = found.filter("kind = 2").groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(found.filter("kind = 0").select("a", "b").unionByName(hubs).distinct())
    lists = found.filter("kind = 1").select("list", "a", "n")

    # One document for each set, and what bounds those that are in a pair or a list.
    reps = own.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(lists.select(F.col("a").alias("set_id"))).distinct()
    sets = cut(own.join(reps.join(wanted, "set_id").select("set_id", "doc_id"), ["set_id", "doc_id"]).select("set_id", "doc_id", "n", "counts").dropDuplicates(["set_id"]))

    own_lists = lists.groupBy("a").agg(F.slice(F.array_sort(F.collect_list("list")), 1, FIRST_LISTS).alias("firsts"))  # no more lists than the prefix has shingles
    members = cut(own_lists.join(sets.select(F.col("set_id").alias("a"), "counts"), "a"))

    joined = components(_verify(pairs, sets, d, seed))
    for most in (PROMISING, None):
        labelled = cut(lists.join(joined.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")))
        more = _open_lists(labelled, members).groupBy("bucket").applyInArrow(_across(most), "a long, b long").distinct()
        new = cut(more.join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.unionByName(new)
        joined = components(joined.toDF("a", "b").unionByName(_verify(new, sets, d, seed)))

    # From sets to documents: the smallest id of any copy of any set of the component.
    sets_in = reps.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    low = sets_in.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = sets_in.join(low, "component").select("set_id", "copies", "component_id")
    full = join_with_hot(own.filter("n > 0").select("doc_id", "n", "set_id"), named, "set_id", "copies")
    empty = own.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "component_id").unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest, with all their columns."""
    drop = similar_components(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))
