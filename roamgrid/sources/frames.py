"""Binary frames of position updates (S3, S4): 32 bytes, big-endian long, double, double, long.

`frames` is a Python data source: spark.read, readStream and write with format("frames"), after register(spark).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Fixed layout of a frame.
FRAME = np.dtype([("vehicle_id", ">i8"), ("x", ">f8"), ("y", ">f8"), ("ts_ms", ">i8")])
SIZE = FRAME.itemsize
UPDATES = "vehicle_id long, x double, y double, ts_ms long"
#: Bytes of a file that a task reads, by default, and of those that it decodes at a time.
PART, BLOCK = 1 << 25, SIZE << 15


def frames_of(data: bytes) -> pa.RecordBatch:
    """The whole frames of some bytes; a trailing part is left out."""
    a = np.frombuffer(data, FRAME, len(data) // SIZE)
    return pa.RecordBatch.from_arrays([pa.array(a[n].astype(a[n].dtype.newbyteorder("="))) for n in FRAME.names], names=list(FRAME.names))


@dataclass
class Range(InputPartition):
    """Bytes of a file from `start` up to `stop`, both multiples of a frame."""

    path: str
    start: int
    stop: int


class _Files:
    """Files of a folder (or one file) in any store that pyarrow knows by the path's scheme."""

    def __init__(self, options):
        self.path, self.part = options["path"], max(1, int(options.get("part", PART)) // SIZE) * SIZE

    def sizes(self) -> dict[str, int]:
        """Whole frames of each file, in bytes. Names that begin with a dot or an underscore aren't read."""
        store, root = fs.FileSystem.from_uri(_uri(self.path))
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return {}
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
        return {f.path: f.size // SIZE * SIZE for f in found if f.is_file and f.base_name[0] not in "._"}

    def ranges(self, sizes: dict[str, int], since: dict[str, int]) -> list[Range]:
        return [Range(p, a, min(a + self.part, n)) for p, n in sorted(sizes.items()) for a in range(since.get(p, 0), n, self.part)]

    def read(self, partition):
        if partition is None:  # an empty folder
            return
        store, _ = fs.FileSystem.from_uri(_uri(self.path))
        with store.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.stop, BLOCK):
                f.seek(at)
                yield frames_of(f.read(min(BLOCK, partition.stop - at)))


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


class FrameReader(DataSourceReader, _Files):
    def __init__(self, options):
        _Files.__init__(self, options)

    def partitions(self):
        return self.ranges(self.sizes(), {})

    def read(self, partition):
        return _Files.read(self, partition)


class FrameStreamReader(DataSourceStreamReader, _Files):
    """The offset is how much of each file was read. Files only grow; a part of a frame waits until the rest is there."""

    def __init__(self, options):
        _Files.__init__(self, options)

    def initialOffset(self):
        return {"read": "{}"}

    def latestOffset(self):
        return {"read": json.dumps(self.sizes(), sort_keys=True)}

    def partitions(self, start, end):
        return self.ranges(json.loads(end["read"]), json.loads(start["read"]))

    def read(self, partition):
        return _Files.read(self, partition)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str


class FrameWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; those of the tasks that count get their names when all have ended."""

    def __init__(self, options, overwrite):
        if overwrite:
            raise ValueError("frames are only appended")
        self.path = options["path"]

    def write(self, iterator):
        store, root = fs.FileSystem.from_uri(_uri(self.path))
        store.create_dir(root)
        name = f"part-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(posixpath.join(root, f"_{name}")) as f:
            for batch in iterator:
                a = np.empty(batch.num_rows, FRAME)
                for n in FRAME.names:
                    a[n] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
                f.write(a.tobytes())
        return Written(name)

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(_uri(self.path))
        for m in messages:
            if m is not None:
                store.move(posixpath.join(root, f"_{m.name}"), posixpath.join(root, m.name))

    def abort(self, messages):
        store, root = fs.FileSystem.from_uri(_uri(self.path))
        for m in messages:
            if m is not None:
                store.delete_file(posixpath.join(root, f"_{m.name}"))


class FrameSource(DataSource):
    """Options path and part (bytes that a task reads)."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return UPDATES

    def reader(self, schema):
        return FrameReader(self.options)

    def streamReader(self, schema):
        return FrameStreamReader(self.options)

    def writer(self, schema, overwrite):
        return FrameWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def read_frame_files(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """S3: updates of captured files, however large: ranges of `part` bytes, each read by its own task. A trailing part
    of a frame is left out; no files: no rows."""
    register(spark)
    return spark.read.format("frames").option("part", part).load(path)


def read_frame_stream(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """S3: updates of captured files as they grow; a trailing part is taken up once the rest of its frame is there."""
    register(spark)
    return spark.readStream.format("frames").option("part", part).load(path)


def write_frame_files(df: DataFrame, path: str) -> None:
    """Updates as files of frames, one for each task, added to the folder."""
    register(df.sparkSession)
    df.select(*FRAME.names).write.format("frames").mode("append").save(path)


def append_bytes(path: str, data: bytes, names: list[str] | None = None) -> list[str]:
    """Adds some bytes to the files of a folder, or to those with the given names, as a capture does that goes on; returns the names."""
    store, root = fs.FileSystem.from_uri(_uri(path))
    found = [f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._"]
    done = [n for n in found if names is None or n in names]
    for n in done:
        with store.open_append_stream(posixpath.join(root, n)) as out:
            out.write(data)
    return done


def decode_frames(df: DataFrame, col: str = "content") -> DataFrame:
    """S3: all whole frames of a binary column (Kafka values); a trailing part of a value is left out.

    The values of a batch are joined and decoded at once."""

    def run(batches):
        for batch in batches:
            yield frames_of(b"".join(v[: len(v) // SIZE * SIZE] for v in batch.column(0).to_pylist() if v))

    return df.select(col).mapInArrow(run, UPDATES)


def encode_frames(df: DataFrame) -> DataFrame:
    """Updates to one binary value per batch of rows."""

    def run(batches):
        for pdf in batches:
            a = np.empty(len(pdf), FRAME)
            for n in FRAME.names:
                a[n] = pdf[n]
            yield pd.DataFrame({"content": [a.tobytes()]})

    return df.select(*FRAME.names).mapInPandas(run, "content binary")
