"""Files of frames: of any length, with a partial tail, read in ranges, as a batch and as a stream."""

import pytest

from roamgrid.sources import frames

ROWS = [(i, i / 2, i / 4, i * 10) for i in range(1000)]


@pytest.fixture(scope="module")
def data(spark):
    return frames.encode_frames(spark.createDataFrame(ROWS, frames.UPDATES).coalesce(1)).first()["content"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_of_files(spark, tmp_path, data):
    (tmp_path / "a.bin").write_bytes(data[:3207])
    (tmp_path / "b.bin").write_bytes(data[3200:] + b"1234567")
    (tmp_path / "c.bin").write_bytes(b"1234567")
    (tmp_path / "d.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(data)
    df = frames.read_frame_files(spark, str(tmp_path), part=3210)  # taken as 3200
    assert df.rdd.getNumPartitions() == 10 and rows(df) == ROWS
    assert rows(frames.read_frame_files(spark, str(tmp_path / "a.bin"))) == ROWS[:100]
    assert rows(frames.read_frame_files(spark, f"file://{tmp_path}", part=1)) == ROWS


def test_three_frames_and_seven_bytes(spark, tmp_path, data):
    (tmp_path / "x").write_bytes(data[: 3 * 32 + 7])
    assert rows(frames.read_frame_files(spark, str(tmp_path))) == ROWS[:3]


def test_no_files(spark, tmp_path):
    assert rows(frames.read_frame_files(spark, str(tmp_path))) == [] and rows(frames.read_frame_files(spark, f"{tmp_path}/none")) == []


def test_blocks_of_a_range(spark, tmp_path, data, monkeypatch):
    (tmp_path / "x").write_bytes(data * 40)  # more than one block of 1 MB
    assert frames.read_frame_files(spark, str(tmp_path)).count() == 40_000


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame(ROWS, frames.UPDATES).repartition(3)
    frames.write_frame_files(df.withColumn("more", df["x"]), f"{tmp_path}/out")
    frames.write_frame_files(df.limit(0), f"{tmp_path}/out")
    assert rows(frames.read_frame_files(spark, f"{tmp_path}/out")) == ROWS
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_a_tail_that_grows_between_batches(spark, tmp_path, data):
    inp, out = tmp_path / "in", f"{tmp_path}/out"
    inp.mkdir()

    def run():
        q = frames.read_frame_stream(spark, str(inp), 640).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.schema(frames.UPDATES).parquet(out))

    (inp / "a").write_bytes(data[:3205])
    assert run() == ROWS[:100]
    with (inp / "a").open("ab") as f:
        f.write(data[3205:3210])
    (inp / "b").write_bytes(data[6400:9601])
    assert run() == ROWS[:100] + ROWS[200:300]
    with (inp / "a").open("ab") as f:
        f.write(data[3210:6400])
    assert run() == ROWS[:300]
    assert run() == ROWS[:300]  # nothing new
