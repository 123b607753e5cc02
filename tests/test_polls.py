"""The polled source: every row once, in order of time, over batches and restarts."""

from datetime import datetime, timedelta, timezone

import pytest

from almanac.session import new_path, ship
from almanac.sources.polls import Polled, PolledReader, stream_polls
from almanac.streaming.run import replay

SCHEMA = "id long, ts timestamp, v double"
DAY = datetime(2024, 3, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def feed(spark):
    """Rows of two days over several files out of order, ties on a step's border, and rows without a time."""
    ship(spark)
    rows = [(i, DAY + timedelta(minutes=13 * (i * 37 % 200)), float(i)) for i in range(200)]
    rows += [(200 + i, DAY + timedelta(hours=6), None) for i in range(5)] + [(900, None, 1.0), (901, None, 2.0)]
    path = new_path(spark, "feed")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    return path, sorted(r[0] for r in rows if r[1])


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("step, polls", [(900, 40), (3600, 100)])
def test_every_row_once(spark, feed, step, polls):
    path, want = feed
    out = new_path(spark, "polled")
    s = stream_polls(spark, path, SCHEMA, "ts", step, polls)
    assert ids(replay(s, path=out, polled=True)) == want


def test_batches_are_bounded_and_restarts_lose_nothing(spark, feed):
    path, want = feed
    out, checkpoint, progress = (new_path(spark, x) for x in ("polled", "checkpoint", "progress"))

    def begin():
        s = stream_polls(spark, path, SCHEMA, "ts", 6 * 3600, 1, progress)
        return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)

    seen = []
    for _ in range(12):  # one batch, then the query ends and starts again
        q = begin().trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(ids(spark.read.schema(SCHEMA).parquet(out)))
        if seen[-1] == want:
            break
    assert seen[-1] == want and len(seen) > 3
    assert all(set(a) <= set(b) and len(b) == len(set(b)) for a, b in zip(seen, seen[1:]))
    begin().trigger(availableNow=True).start().awaitTermination()
    assert ids(spark.read.schema(SCHEMA).parquet(out)) == want


def test_positions(spark, feed, tmp_path):
    """Batches end on whole steps; a new reader goes on two batches past its last commit, never back."""
    options = {"path": feed[0], "time": "ts", "step": "3600", "polls": "5", "progress": str(tmp_path / "p" / "at")}
    reader = Polled(options).streamReader(spark.createDataFrame([], SCHEMA).schema)
    start = reader.initialOffset()["at"]
    one, two = reader.latestOffset(), reader.latestOffset()
    assert one["at"] - start == two["at"] - one["at"] == 5 * 3_600_000_000
    rows = [r for g in reader.partitions({"at": start}, one) for b in reader.read(g) for r in b.column(1).to_pylist()]
    assert rows and all(DAY <= t < DAY + timedelta(hours=5) for t in rows)
    reader.commit(one)
    again = PolledReader(reader.schema, options)
    assert again.latestOffset()["at"] == one["at"] + 2 * 5 * 3_600_000_000
    while reader.latestOffset() != (last := reader.latestOffset()):
        pass
    assert again.bounds()[1] == last["at"]
    with pytest.raises(ValueError):
        PolledReader(reader.schema, options | {"step": "0"})


def test_empty_table(spark):
    path = new_path(spark, "feed")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert replay(stream_polls(spark, path, SCHEMA, "ts", 60), polled=True).count() == 0
