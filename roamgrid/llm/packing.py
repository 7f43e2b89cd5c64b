"""Best-fit packing by minimum bin slack.

What is packed is counts of lengths, at most 1024 of them whatever the corpus. For each bin a bitset
holds which sums the available lengths can reach; the fullest combination that holds the largest
length left is taken, as often as the counts allow, and removed. Then Spark ranks the pieces of each
length and looks up each rank's place.
"""

from __future__ import annotations

import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, documents, partitions

CAPACITY = 1024
EOS = 2
VOCABULARY = "byte_bpe_50k"
#: Documents in a row that pack_in_order() packs by themselves.
SEGMENT = 8192
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PLACED.split(", ")]
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, place long"
WHITE = 50_000
SPACES = re.compile(r"\s+")
_ENCODERS: dict[str, object] = {}


def encoder(name: str):
    """A function from texts to lists of ids.

    The vocabulary is the one of the tokenizers file; tiktoken reads the same as ranks and gives the
    same ids in a quarter of the time (tests compare both). The file's added tokens are matched in the
    text first, as tokenizers does. tiktoken gives up on white space of about a million characters; texts
    with WHITE of them in a row go to tokenizers itself. One encoder per worker process.
    """
    if name not in _ENCODERS:
        import base64
        import json

        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(P.path(f"{name}.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]:
            raise ValueError(f"added tokens that aren't matched as they stand: {odd}")
        encoding = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
        whole = []

        def encode(text: str):
            if len(text) >= WHITE and any(m.end() - m.start() >= WHITE for m in SPACES.finditer(text)):
                if not whole:
                    import tokenizers

                    whole.append(tokenizers.Tokenizer.from_file(P.path(f"{name}.json")))
                return whole[0].encode(text, add_special_tokens=False).ids
            return encoding.encode(text, allowed_special="all")

        _ENCODERS[name] = encode
    return _ENCODERS[name]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens; only the first may be shorter than capacity."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, place) to pieces: doc_id, piece, start, length, ids_crc32, place, with ids on demand."""

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text, spot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.array([*encode(text.as_py() or ""), eos], "<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    part = ids[at : at + n]
                    rows.append((doc_id, k, at, n, zlib.crc32(part.tobytes()), spot, *([part.astype(np.int32)] if with_ids else [])))
                    at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "place", "ids"][: len(rows[0])])

    return docs.mapInArrow(run, _PIECES + ", ids array<int>" * with_ids)


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The fullest combination, as (length, times), of the largest length left and others: subset sums by bitset."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    first, room = lengths[0], capacity - lengths[0]
    everything = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        left = int(counts[n]) - (n == first)
        most = min(left, room // n) if n <= room else 0
        if not most:
            continue
        before = reach
        # All multiples up to `most`, by doubling.
        have = 1
        while most:
            take = min(have, most)
            reach |= (reach << (n * take)) & everything
            most -= take
            have *= 2
        steps.append((n, before, min(left, room // n)))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    picked = {first: 1}
    for n, before, most in reversed(steps):
        times = next(t for t in range(most + 1) if total >= t * n and before >> (total - t * n) & 1)
        if times:
            picked[n] = picked.get(n, 0) + times
            total -= times * n
    return sorted(picked.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, times in a bin, first bin, offset) that place all ranks of all lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    used = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    while counts.any():
        bin_ = fullest(counts, capacity)
        again = min(int(counts[n]) // t for n, t in bin_)
        at = 0
        for n, t in bin_:
            rows.append((n, used[n], again * t, t, bins, at))
            used[n] += again * t
            counts[n] -= again * t
            at += n * t
        bins += again
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one token `eos`. Repeated rows and rows with a null id are packed as
    rows like others. No rows in: no rows out.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("place")), vocabulary, capacity, eos)
    buckets = 4 * partitions(spark)
    pieces = cut(tokens.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))))
    # Ranks within a length in two levels: one length may be that of a third of all pieces.
    counts = pieces.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("earlier"))
    here = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("here", here).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("here") + F.col("earlier"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(plan(histogram, capacity))

    def place(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            sequence, at = placed(table.value, n, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(n), batch.column("ids_crc32"), pa.array(sequence), pa.array(at)], names=_NAMES)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, _PLACED)


def placed(table: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the rank-th piece of length n, by the rows of plan()."""
    length, first, _, times, bin_, offset = table.T
    i = np.searchsorted((length << 44) + first, (n << 44) + rank, side="right") - 1
    k = rank - first[i]
    return bin_[i] + k // times[i], offset[i] + k % times[i] * n


def pack_in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, eos: int = EOS, segment: int = SEGMENT, place_col: str | None = None) -> DataFrame:
    """As pack(), for docs whose order is to show in the sequences: each `segment` documents in a row
    are packed by themselves, and sequences are numbered by segment, gapless from 0, and in it by their first
    document. That takes at most a few sequences more for each segment. The order is that of place_col,
    whole numbers from 0 with few gaps, or else of the files that docs is read from, by file name and row. Where docs
    isn't read from files as it is, its rows have no order: segments are made by a hash of the id, and a warning says so.
    """
    named = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if place_col is None and not _from_files(docs):
        warnings.warn("docs isn't read from files as it is and has no place_col: its rows have no order", stacklevel=2)
    if place_col is not None:
        rows = docs.select(*named, F.col(place_col).cast("long").alias("place"))
    elif _from_files(docs):
        d = docs.select(*named, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        files = d.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # one row for each file
        earlier = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        files = files.select("file", F.coalesce(earlier, F.lit(0)).alias("earlier"))
        rows = d.join(F.broadcast(files), "file").select("doc_id", "text", (F.col("earlier") + F.col("row")).alias("place"))
    else:
        rows = docs.select(*named).withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count()))))
    pieces = tokenize(rows, vocabulary, capacity, eos)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("place", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        n, spot = table.column("length").to_numpy().astype(np.int64), table.column("place").to_numpy()
        lengths, first, count = np.unique(n, return_index=True, return_counts=True)
        rank = np.arange(len(n)) - np.repeat(first, count)
        bin_, at = placed(plan(dict(zip(lengths.tolist(), count.tolist(), strict=True)), capacity), n, rank)
        earliest = np.full(bin_.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, bin_, spot)
        number = np.empty(len(earliest), np.int64)
        number[np.argsort(earliest, kind="stable")] = np.arange(len(earliest))
        return pa.table([*(table.column(c) for c in ("doc_id", "piece", "start")), pa.array(n), table.column("ids_crc32"), pa.array(number[bin_]), pa.array(at), table.column("segment")], names=[*_NAMES, "segment"])

    filled = cut(pieces.withColumn("segment", F.expr(f"place div {segment}")).groupBy("segment").applyInArrow(fill, f"{_PLACED}, segment long"))
    used = filled.groupBy("segment").agg((F.max("sequence_id") + 1).alias("n"))  # one row for each segment
    earlier = F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    used = used.select("segment", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    return filled.join(used, "segment").withColumn("sequence_id", F.col("sequence_id") + F.col("earlier")).select(*_NAMES)


def _from_files(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def sequences(docs: DataFrame, packed: DataFrame, **options) -> DataFrame:
    """The token ids of each sequence: sequence_id, ids. docs(doc_id, text) as packed, ids distinct."""
    pieces = tokenize(docs.select("doc_id", "text", F.lit(0).cast("long").alias("place")), with_ids=True, **options)
    placed = pieces.select("doc_id", "piece", "ids").join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
