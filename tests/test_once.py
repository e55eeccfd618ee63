"""The exactly-once sink and attempts over time."""

from __future__ import annotations

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pairforge.operators import filters
from pairforge.sources import once_sink
from pairforge.streaming import attempts

SCHEMA = "id long, name string"


def rows(spark, first, last):
    return spark.range(first, last, numPartitions=3).select("id", F.concat(F.lit("n"), "id").alias("name"))


def test_repeated_batches_add_nothing(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert once_sink.read(spark, path, SCHEMA).collect() == [] and once_sink.batches(path) == {}
    for batch, first in (("a", 0), ("b", 50), ("a", 0), ("a", 0), ("b", 50)):
        once_sink.append(rows(spark, first, first + 50), path, batch)
    assert sorted(r.id for r in once_sink.read(spark, path, SCHEMA).collect()) == list(range(100))
    assert once_sink.batches(path) == {"a": 50, "b": 50}
    # what repeated batches wrote is gone again
    assert len(glob.glob(f"{path}/data/*")) == 6
    once_sink.append(rows(spark, 0, 0), path, "empty")
    assert once_sink.batches(path)["empty"] == 0


def test_failed_tasks_leave_no_row(spark, tmp_path):
    path = str(tmp_path / "sink")

    @F.udf("string")
    def breaks(i):
        if i == 77:
            raise ValueError("a task fails")
        return f"n{i}"

    df = rows(spark, 0, 100)
    with pytest.raises(Exception, match="a task fails"):
        once_sink.append(df.select("id", breaks("id").alias("name")), path, "a")
    assert once_sink.read(spark, path, SCHEMA).collect() == [] and once_sink.batches(path) == {}
    once_sink.append(df, path, "a")
    # files that a lost executor left behind belong to no manifest
    left = glob.glob(f"{path}/data/*")[0]
    with open(left, "rb") as f, open(f"{path}/data/left.parquet", "wb") as g:
        g.write(f.read())
    assert once_sink.read(spark, path, SCHEMA).count() == 100


def test_options(spark, tmp_path):
    once_sink.register(spark)
    for options, mode in (({}, "append"), ({"path": str(tmp_path / "x")}, "append"), ({"path": str(tmp_path / "x"), "batch": "../x"}, "append"), ({"path": str(tmp_path / "x"), "batch": "1"}, "overwrite")):
        with pytest.raises(Exception):
            rows(spark, 0, 3).write.format("once").mode(mode).options(**options).save()


def test_stream_repeats_its_last_batch(spark, tmp_path):
    """A stream that stops between the sink's commit and its own comes again with the same number."""
    drop, path, checkpoint = (str(tmp_path / x) for x in ("drop", "sink", "checkpoint"))
    once_sink.register(spark)

    def run(first, last):
        rows(spark, first, last).write.mode("append").json(drop)
        stream = spark.readStream.schema(SCHEMA).json(drop)
        stream.writeStream.format("once").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(0, 30)
    run(30, 60)
    assert once_sink.batches(path) == {"stream-0": 30, "stream-1": 30}
    os.remove(f"{checkpoint}/commits/1")
    for crc in glob.glob(f"{checkpoint}/commits/.1.crc"):
        os.remove(crc)
    run(60, 70)
    assert sorted(r.id for r in once_sink.read(spark, path, SCHEMA).collect()) == list(range(70))


# -- attempts --------------------------------------------------------------------------------------
ATTEMPTS = "row_id string, n int, score double, at timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_attempts_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    made = [(f"r{i}", n, round(rng.random(), 3), f"2024-01-01 00:{rng.randrange(9):02d}:{rng.randrange(60):02d}") for i in range(40) for n in range(1, rng.randint(2, 6)) if rng.random() < 0.9]
    made += rng.choices(made, k=15)  # some come twice
    rng.shuffle(made)
    want = filters.first_kept(spark.createDataFrame(made, "row_id string, n int, score double, at string").distinct(), "row_id", "n", F.col("score") > 0.5)
    for k, v in attempts.STATE_STORE.items():
        spark.conf.set(k, v)
    drop = tmp_path / "drop"
    drop.mkdir()
    parts = [made[i::4] for i in range(4)] + [[("end", 9, 0.0, "2024-01-01 02:00:00")], [("end", 9, 0.0, "2024-01-01 02:00:01")]]
    for i, part in enumerate(parts):
        (drop / f"{i}.json").write_text("".join(json.dumps(dict(zip(("row_id", "n", "score", "at"), r, strict=True))) + "\n" for r in part))
        os.utime(drop / f"{i}.json", (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).json(str(drop)).withWatermark("at", "10 minutes")
    out = attempts.first_kept(stream, "row_id", "n", F.col("score") > 0.5, "at")
    name = f"attempts_{seed}"
    try:
        out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k in attempts.STATE_STORE:
            spark.conf.unset(k)
    got = spark.table(name).collect()
    assert sorted((r.row_id, r.n, r.score) for r in got) == sorted((r.row_id, r.n, r.score) for r in want.collect())
