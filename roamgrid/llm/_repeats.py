"""Long repeats across documents: what of a document is covered by a window (so many consecutive
bytes or words) that also starts in a document with a smaller id.

1. Each document is read as a sequence of units and leaves anchors, chosen by content alone: every
   window holds one, and equal windows hold equal ones at the same place. An anchor is shipped as
   the hash of the units that all its windows share (key) and of all units that any of its windows
   can reach (context). Within a task, anchors whose context is already there from a smaller
   document are settled at once, which keeps what is shipped for a very common passage to one
   anchor per task.
2. Anchors meet by key. Those with the same context as a smaller document's are settled; where
   contexts under one key differ, the smallest documents of each are looked at again.
3. For these the units themselves are fetched, and each of their windows is compared by the
   operator's own compare().
   Contexts of a hot key (many contexts in a sample of the documents) don't meet: their anchors are
   dealt by context, all that are not settled are looked at again, and of their windows a Spark
   groupBy gives the smallest document of each hash, which is joined back. The sample decides only
   the way a key takes; the result is the same either way. Hot keys are known by a bitmap of fixed size.
4. What was found so far is equal by 64-bit hash. Matches of one document with another at one
   distance are joined to spans; of these as many as cover all are kept, and each is verified by BLAKE2b digests of the very texts at
   both ends. If one fails (two texts with one hash), all is done again with other hashes.
5. What verified spans cover is taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Prefix, mix, texts
from ._common import cut, join_with_hot, partitions

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
_ANCHORS = "kind int, bucket int, doc binary, key binary, ctx binary, pos binary, reach binary"
#: Kind 1: matches by hash; 2: anchors to be looked at again; 4: matches whose units were compared. spans holds MATCH records.
_MARKS = "kind int, doc_id long, spans binary"
#: Units pos - left to pos + right of a document equal those around `at` in document src.
MATCH = np.dtype([("pos", "<i4"), ("at", "<i4"), ("src", "<i8"), ("left", "u1"), ("right", "u1")])
#: Anchors that a task settles at a time.
ANCHORS = 1_000_000
#: A key is hot if one in SAMPLE documents leave it with more than HOT_CONTEXTS contexts: about 16,384 in all. Bits that
#: stand for hot keys: 2 MB, however many there are. A key whose bit another one has set goes the longer way, to the same result.
SAMPLE = 32
HOT_CONTEXTS = 512
HOT_BITS = 1 << 24
#: Parts of one document that a row has digests made of, about.
PARTS = 4096
#: Hash functions that are tried before different texts with equal hashes are an error.
SEEDS = 4


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w consecutive values."""
    n = 1
    while n * 2 <= w:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def chosen(rank: np.ndarray, w: int) -> np.ndarray:
    """Positions with the smallest rank of some w consecutive ones (all, if several are smallest)."""
    if len(rank) < w:
        return np.zeros(0, np.int64)
    low = slide(rank, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    reach = slide(np.concatenate([pad, low, pad]), w, np.maximum)
    return np.flatnonzero((reach == rank) & (rank != TOP))


class Finder:
    """How an operator reads a text. All hashes depend on `seed`.

    units(raw): 64-bit values of the units. ranks(units): a rank for each start of `span` units,
    TOP where no anchor may be; among the window - span + 1 starts in a window one is less than TOP.
    pieces(raw): a function from (a, b) to the bytes of units a to b, for digests.
    codes(raw): shorter stand-ins of the units to ship, where compare() wants them.
    compare(finder, contexts): matches among the windows of Contexts, and their kind.
    """

    def __init__(self, units: Callable, ranks: Callable, window: int, span: int, pieces: Callable, compare: Callable, codes: Callable | None = None, seed: int = 0) -> None:
        self.seed = U((seed * 0x9E3779B97F4A7C15 + (seed > 0)) & 0xFFFFFFFFFFFFFFFF)
        self.units = (lambda raw: mix(units(raw) ^ self.seed)) if seed else units
        self.ranks, self.window, self.span, self.pieces, self.compare, self.codes = ranks, window, span, pieces, compare, codes

    def anchors(self, raw: np.ndarray):
        """pos, key, ctx, left, right of the anchors; None if the text has no window."""
        values = self.units(raw)
        n = len(values)
        if n < self.window:
            return None
        pos = chosen(self.ranks(values), self.window - self.span + 1)
        prefix = Prefix(values)
        a, b = self.reach(pos, n)
        ctx = mix(prefix.span(a, b) + mix((pos - a).astype(np.uint64) * U(4096) + (b - pos).astype(np.uint64)))
        return pos, mix(prefix.span(pos, pos + self.span)), ctx, pos - a, b - pos

    def reach(self, pos: np.ndarray, n: int):
        """The units that the windows around each anchor reach."""
        return np.maximum(pos + self.span - self.window, 0), np.minimum(pos + self.window, n)


def _settle(key, ctx, doc, pos, left, right):
    """Anchors sorted by key, ctx, doc, pos; which of them have a (key, ctx) that a smaller document has; and these as matches."""
    order = np.lexsort((pos, doc, ctx, key))
    key, ctx, doc, pos, left, right = (x[order] for x in (key, ctx, doc, pos, left, right))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, int)
    done = doc > doc[first]
    return (key, ctx, doc, pos, left, right), done, matches(pos[done], pos[first[done]], doc[first[done]], left[done], right[done])


def matches(pos, at, src, left, right) -> np.ndarray:
    out = np.empty(len(pos), MATCH)
    for name, value in (("pos", pos), ("at", at), ("src", src), ("left", left), ("right", right)):
        out[name] = value
    return out


def _by_doc(doc, rows):
    """(doc_id, matches as bytes) for each document."""
    order = np.lexsort((rows["pos"], doc))
    doc, rows = doc[order], rows[order]
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
    return doc[at], [x.tobytes() for x in np.split(rows, at[1:])] if len(doc) else []


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def _pairs(finder: Finder):
    """Distinct keys and contexts of the anchors of each batch."""

    def run(batches):
        for batch in batches:
            found = [x[1:3] for raw in texts(batch.column(0)) if (x := finder.anchors(raw)) is not None]
            if found:
                pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)]), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["key", "ctx"])

    return run


def hot_keys(docs: DataFrame, finder: Finder) -> np.ndarray:
    """Bits of the keys with more than HOT_CONTEXTS contexts in one of SAMPLE documents, as bytes; for is_hot()."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    pairs = some.mapInArrow(_pairs(finder), "key long, ctx long").distinct()
    hot = pairs.groupBy("key").count().filter(F.col("count") > HOT_CONTEXTS)
    hot = hot.select(F.col("key").bitwiseAND(F.lit(HOT_BITS - 1)).alias("bit"))
    words = hot.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = words.toArrow()  # HOT_BITS / 64 rows at most
    out = np.zeros(max(1, HOT_BITS // 64), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def is_hot(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys have their bit set; their lower 32 bits are enough."""
    i = (key & key.dtype.type(8 * len(bits) - 1)).astype(np.int64)
    return (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 > 0


def _emit(finder: Finder, buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            (key, ctx, doc, pos, left, right), done, found = _settle(*(np.concatenate([h[i] for h in held]) for i in range(6)))
            held.clear()
            ids, spans = _by_doc(doc[done], found)
            if len(ids):  # settled here: they pass through
                none = [b""] * len(ids)
                yield _batch(_ANCHORS, kind=[1] * len(ids), bucket=(ids % buckets).astype(np.int32), doc=[np.int64(i).tobytes() for i in ids], key=none, ctx=none, pos=spans, reach=none)
            key, ctx, doc, pos, left, right = (x[~done] for x in (key, ctx, doc, pos, left, right))
            # Hot keys are dealt by context.
            bucket = ((np.where(is_hot(hot.value, key), mix(key ^ ctx), key) >> U(32)) % U(buckets)).astype(np.int32)
            # In each bucket by document, so that ids and places compress well.
            order = np.lexsort((pos, doc, bucket))
            key, ctx, doc, pos, bucket, left, right = (x[order] for x in (key, ctx, doc, pos, bucket, left, right))
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
            cut_up = lambda x, kind: [y.astype(kind).tobytes() for y in np.split(x, at[1:])] if len(at) else []
            reach = cut_up(np.stack([left, right], axis=1), "u1")
            yield _batch(_ANCHORS, kind=[0] * len(at), bucket=bucket[at], doc=cut_up(doc, "<i8"), key=cut_up(key & U(0xFFFFFFFF), "<u4"), ctx=cut_up(ctx, "<u8"), pos=cut_up(pos, "<i4"), reach=reach)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_numpy(zero_copy_only=False), texts(batch.column(1)), strict=True):
                if (found := finder.anchors(raw)) is not None and len(found[0]):
                    pos, key, ctx, left, right = found
                    held.append((key, ctx, np.full(len(pos), doc_id, np.int64), pos.astype(np.int32), left.astype(np.uint8), right.astype(np.uint8)))
                    size += len(pos)
                    if size >= ANCHORS:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return run


def _meet(hot):
    """Anchors of one bucket to marks: kind 1 settled, kind 2 to be looked at again."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        pick = table.filter(pa.array(kind == 0))
        join = lambda c, t: np.frombuffer(b"".join(pick.column(c).to_pylist()), t)
        reach = join("reach", "u1").reshape(-1, 2)
        (key, ctx, doc, pos, left, right), done, found = _settle(join("key", "<u4"), join("ctx", "<u8"), join("doc", "<i8"), join("pos", "<i4"), reach[:, 0], reach[:, 1])
        ids, spans = _by_doc(doc[done], found)
        key, doc, pos, left, right = (x[~done] for x in (key, doc, pos, left, right))
        # Keys that still hold more than one document: their contexts differ.
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        if len(key):
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))[group]
        else:
            several = np.zeros(0, bool)
        # The other contexts of a hot key are in other buckets.
        several = several | is_hot(hot.value, key)
        more, again = _by_doc(doc[several], matches(*(x[several] for x in (pos, pos, doc, left, right))))
        passed = table.filter(pa.array(kind == 1))
        kinds = [1] * (len(ids) + passed.num_rows) + [2] * len(more)
        docs = [*ids.tolist(), *(int.from_bytes(x, "little", signed=True) for x in passed.column("doc").to_pylist()), *more.tolist()]
        return pa.Table.from_batches([_batch(_MARKS, kind=kinds, doc_id=docs, spans=[*spans, *passed.column("pos").to_pylist(), *again])])

    return run


def _contexts(finder: Finder, buckets: int, hot):
    """(doc_id, text, spans) to the units around each anchor of a key that isn't hot, by bucket of its key."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, raw, spots in zip(batch.column(0).to_numpy(zero_copy_only=False), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                pos = np.unique(np.frombuffer(b"".join(spots), MATCH)["pos"]).astype(np.int64)
                values = finder.units(raw)
                key = mix(Prefix(values).span(pos, pos + finder.span))
                rest = ~is_hot(hot.value, key)
                pos, key = pos[rest], key[rest]
                bucket = ((key >> U(32)) % U(buckets)).astype(np.int32)
                a, b = finder.reach(pos, len(values))
                sent = finder.codes(raw) if finder.codes else values
                for i in range(len(pos)):
                    out.append((bucket[i], doc_id, pos[i], key[i], pos[i] - a[i], sent[a[i] : b[i]].tobytes(), b[i] - a[i]))
            out.sort(key=lambda x: x[0])
            i = 0
            rows = {c: [] for c in ("bucket", "doc", "pos", "key", "left", "size", "units")}
            while i < len(out):
                j = i
                while j < len(out) and out[j][0] == out[i][0]:
                    j += 1
                part = out[i:j]
                rows["bucket"].append(int(part[0][0]))
                for c, k, t in (("doc", 1, "<i8"), ("pos", 2, "<i4"), ("key", 3, "<u8"), ("left", 4, "<i2")):
                    rows[c].append(np.array([x[k] for x in part]).astype(t).tobytes())
                rows["size"].append(np.array([x[6] for x in part], "<i2").tobytes())
                rows["units"].append(b"".join(x[5] for x in part))
                i = j
            yield _batch(_CONTEXTS, **rows)

    return run


_CONTEXTS = "bucket int, doc binary, pos binary, key binary, left binary, size binary, units binary"


def _windows(finder: Finder, hot):
    """(doc_id, text, spans) to hash, doc_id and start of the windows around each anchor of a hot key."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, raw, spots in zip(batch.column(0).to_numpy(zero_copy_only=False), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                pos = np.unique(np.frombuffer(b"".join(spots), MATCH)["pos"]).astype(np.int64)
                values = finder.units(raw)
                prefix = Prefix(values)
                key = mix(prefix.span(pos, pos + finder.span))
                pick = is_hot(hot.value, key)
                pos, key = pos[pick], key[pick]
                start = (pos[:, None] - np.arange(finder.window - finder.span + 1)).ravel()
                key = np.repeat(key, finder.window - finder.span + 1)
                ok = (start >= 0) & (start + finder.window <= len(values))
                start, key = start[ok], key[ok]
                h = mix(prefix.span(start, start + finder.window) + key)
                rows.append((h.view(np.int64), np.full(len(h), doc_id, np.int64), start.astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["h", "doc_id", "start"])

    return run


def _marked(window: int):
    """(doc_id, start, src, at) to matches of windows."""

    def run(batches):
        for batch in batches:
            doc, start, src, at = (batch.column(i).to_numpy() for i in range(4))
            ids, spans = _by_doc(doc, matches(start, at, src, 0, window))
            yield _batch(_MARKS, kind=[1] * len(ids), doc_id=ids, spans=spans)

    return run


def _compare_hot(spots: DataFrame, finder: Finder, hot) -> DataFrame:
    """The same as compare() for windows around anchors of hot keys, by groupBy and join over window hashes."""
    windows = cut(spots.mapInArrow(_windows(finder, hot), "h long, doc_id long, start int"))
    firsts = windows.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.filter("first.doc_id < last").select("h", F.col("first.doc_id").alias("src"), F.col("first.start").alias("at"), "n"))
    later = join_with_hot(windows, firsts, "h", "n").filter("src < doc_id")
    return later.select("doc_id", "start", "src", "at").mapInArrow(_marked(finder.window), _MARKS)


class Contexts:
    """Units around anchors that meet: for each its document, its place there, its key, and how many
    units of `size` lie before it; `data` holds all units (or codes), `begin` where each context's start."""

    def __init__(self, table: pa.Table, kind: str) -> None:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        self.doc, self.pos, self.key = join("doc", "<i8"), join("pos", "<i4").astype(np.int64), join("key", "<u8")
        self.left, self.size = join("left", "<i2").astype(np.int64), join("size", "<i2").astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.data = join("units", kind)


def window_matches(contexts: Contexts, window: int, span: int, name: Callable) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and matches of windows that a smaller document has. name(back, at, rows): for windows that
    start `back` units before the anchors of `rows`, at `at` in the data, numbers that are equal where
    windows are. One place of the window against the anchor at a time, so that memory stays at a few columns."""
    docs, found = [contexts.doc[:0]], [np.empty(0, MATCH)]
    for back in range(window - span + 1):
        a = contexts.left - back
        rows = np.flatnonzero((a >= 0) & (a + window <= contexts.size))
        if not len(rows):
            continue
        h = name(back, contexts.begin[rows] + a[rows], rows)
        d, s = contexts.doc[rows], contexts.pos[rows] - back
        order = np.lexsort((s, d, h))
        h, d, s = h[order], d[order], s[order]
        first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], np.arange(len(h)), 0))
        later = d > d[first]
        docs.append(d[later])
        found.append(matches(s[later], s[first[later]], d[first[later]], 0, window))
    return np.concatenate(docs), np.concatenate(found)


def compare_hashes(finder: Finder, contexts: Contexts):
    """Windows are equal where their hashes are; still to be verified."""
    prefix = Prefix(contexts.data)
    return 1, *window_matches(contexts, finder.window, finder.span, lambda back, at, rows: mix(prefix.span(at, at + finder.window) + contexts.key[rows]))


def _compare(finder: Finder):
    def run(table: pa.Table) -> pa.Table:
        kind, doc, found = finder.compare(finder, Contexts(table, "u1" if finder.codes else "<u8"))
        ids, spans = _by_doc(doc, found)
        return pa.Table.from_batches([_batch(_MARKS, kind=[kind] * len(ids), doc_id=ids, spans=spans)])

    return run


_SPANS = "kind int, doc_id long, a int, b int, src long, at int"


def _cover(a: list, b: list) -> list[int]:
    """Which intervals (sorted by start, then longest first) cover all that these cover: from each end on, the one that reaches farthest."""
    picked, end, best = [], -1, -1
    for i in range(len(a)):
        if best >= 0 and a[i] > end and b[best] > end:
            picked.append(best)
            end = b[best]
        if a[i] > end:  # nothing reaches it
            picked.append(i)
            end, best = b[i], i
        elif best < 0 or b[i] > b[best]:
            best = i
    if best >= 0 and b[best] > end:
        picked.append(best)
    return picked


def _joined(batches):
    """(doc_id, marks) to spans: what matches with one document at one distance cover, joined where they
    overlap or touch; of these as many as are needed to cover what all of them do."""
    for batch in batches:
        out = []
        for doc_id, marks in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            m = np.frombuffer(b"".join(x["spans"] for x in marks), MATCH)
            kind = np.repeat([x["kind"] for x in marks], [len(x["spans"]) // MATCH.itemsize for x in marks])
            true = kind == 4  # compared already: with which document doesn't matter any more
            a, b = m["pos"].astype(np.int64) - m["left"], m["pos"].astype(np.int64) + m["right"]
            src = np.where(true, -1, m["src"])
            shift = np.where(true, 0, m["at"].astype(np.int64) - m["pos"])
            order = np.lexsort((b, a, shift, src, kind))
            a, b, shift, src, kind = a[order], b[order], shift[order], src[order], kind[order]
            other = np.r_[True, (src[1:] != src[:-1]) | (shift[1:] != shift[:-1]) | (kind[1:] != kind[:-1])]
            # The farthest end so far within a group: ends are lifted by the group's number.
            lift = np.cumsum(other) * (1 << 40)
            far = np.maximum.accumulate(b + lift)
            at = np.flatnonzero(other | np.r_[True, a[1:] + lift[1:] > far[:-1]])
            ends, a, shift, src, kind = np.maximum.reduceat(b, at), a[at], shift[at], src[at], kind[at]
            order = np.lexsort((-kind, -ends, a))
            pick = order[_cover(a[order].tolist(), ends[order].tolist())]
            out.append((kind[pick].astype(np.int32), np.full(len(pick), doc_id, np.int64), a[pick].astype(np.int32), ends[pick].astype(np.int32), src[pick].astype(np.int64), (a[pick] + shift[pick]).astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[x.split()[0] for x in _SPANS.split(", ")])


def _digests(finder: Finder):
    """(doc_id, text, parts) to the digest of each part (a, n) of the text's units."""

    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "a": [], "n": [], "digest": []}
            for doc_id, raw, parts in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                piece = finder.pieces(raw)
                for p in parts:
                    out["doc_id"].append(doc_id)
                    out["a"].append(p["a"])
                    out["n"].append(p["n"])
                    out["digest"].append(hashlib.blake2b(piece(p["a"], p["a"] + p["n"]), digest_size=16).digest())
            yield _batch("doc_id long, a int, n int, digest binary", **out)

    return run


def _verified(spans: DataFrame, known: DataFrame, finder: Finder) -> DataFrame | None:
    """Spans whose texts have the same digest at both ends, as (doc_id, a, b); None if the hashes of some were equal and the texts not."""
    found = spans.filter("kind = 1").select("doc_id", "a", "b", "src", "at", (F.col("b") - F.col("a")).alias("n"))
    asked = found.select("doc_id", "a", "n").unionByName(found.select(F.col("src").alias("doc_id"), F.col("at").alias("a"), "n")).distinct()
    # A document of which many parts are asked for has several rows.
    rows = asked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("split", F.ceil(F.col("rows") / PARTS).cast("long"))
    dealt = join_with_hot(asked, rows, "doc_id", "rows")
    parts = dealt.groupBy("doc_id", F.pmod(F.xxhash64("a", "n"), "split").alias("part")).agg(F.collect_list(F.struct("a", "n")).alias("parts"))
    # Rows that repeat an id are taken to repeat its text.
    digests = known.join(parts, "doc_id").select("doc_id", "text", "parts").mapInArrow(_digests(finder), "doc_id long, a int, n int, digest binary")
    digests = cut(digests.groupBy("doc_id", "a", "n").agg(F.min("digest").alias("digest")))
    own = found.join(digests, ["doc_id", "a", "n"])
    # One source may be that of a third of all spans: keys with many are joined by broadcast.
    key = lambda *c: F.concat_ws(":", *c)
    many = found.groupBy(key("src", "at", "n").alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    theirs = digests.select(key("doc_id", "a", "n").alias("k"), F.col("digest").alias("theirs")).join(many, "k")
    both = join_with_hot(own.withColumn("k", key("src", "at", "n")), theirs, "k", "rows")
    both = cut(both.select("doc_id", "a", "b", F.coalesce(F.col("digest") == F.col("theirs"), F.lit(False)).alias("same")))
    if not both.filter("not same").isEmpty():
        return None
    return both.select("doc_id", "a", "b").unionByName(spans.filter("kind = 4").select("doc_id", "a", "b"))


def _found(known: DataFrame, finder: Finder) -> DataFrame:
    """Spans of all documents, by hash (kind 1) or compared (kind 4)."""
    spark = known.sparkSession
    n = 4 * partitions(spark)
    keys = hot_keys(known, finder)
    hot = spark.sparkContext.broadcast(keys)
    anchors = known.mapInArrow(_emit(finder, n, hot), _ANCHORS)
    marks = cut(anchors.groupBy("bucket").applyInArrow(_meet(hot), _MARKS))
    again = marks.filter("kind = 2").groupBy("doc_id").agg(F.collect_list("spans").alias("spots"))
    spots = known.join(again, "doc_id").select("doc_id", "text", "spots")
    more = spots.mapInArrow(_contexts(finder, n, hot), _CONTEXTS).groupBy("bucket").applyInArrow(_compare(finder), _MARKS)
    if keys.any():
        more = more.unionByName(_compare_hot(spots, finder, hot))
    every = marks.filter("kind = 1").unionByName(more)
    return cut(every.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "spans")).alias("marks")).mapInArrow(_joined, _SPANS))


def repeats(docs: DataFrame, finder: Callable[[int], Finder], report: Callable, schema: str) -> DataFrame:
    """docs(doc_id, text) to report(raw, a, b) per row, where a and b hold the starts and ends of its
    verified spans; it returns the values of `schema`, which follow doc_id. finder(seed) makes the finder.

    Null texts count as empty. Rows that repeat an id are taken to repeat its text, and don't count
    as smaller than each other. Rows with a null id take no part: nothing of them is removed, and
    they remove nothing. No rows in: no rows out.
    """
    # The same filter everywhere, so that the texts' exchange by id is made once and used again.
    known = docs.filter("doc_id is not null")
    for seed in range(SEEDS):
        with_seed = finder(seed)
        spans = _verified(_found(known, with_seed), known, with_seed)
        if spans is not None:
            break
    else:
        raise RuntimeError(f"different texts with equal hashes for each of {SEEDS} hash functions")
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def last(batches):
        for batch in batches:
            rows = []
            for doc_id, raw, found in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2), strict=True):
                pairs = found.values.flatten() if found.is_valid else None
                a, b = (x.to_numpy(zero_copy_only=False) for x in pairs) if pairs is not None else (None, None)
                rows.append((doc_id, *report(raw, a, b)))
            if rows:
                yield _batch(full, **dict(zip(names, zip(*rows, strict=True), strict=True)))

    full = f"doc_id long, {schema}"
    names = [x.split()[0] for x in full.split(", ")]
    rest = docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    whole = known.join(per_doc, "doc_id", "left").select("doc_id", "text", "spans").unionByName(rest)
    return whole.mapInArrow(last, full)


def covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n units the spans a to b cover."""
    turn = np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(b, minlength=n + 1)[: n + 1]
    return np.cumsum(turn)[:n] > 0
