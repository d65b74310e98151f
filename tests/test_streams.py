"""Streams on event time: order over triggers, late rows, and feeds that fall silent."""

from __future__ import annotations

from tickloom.session import checkpoint_dir
from tickloom.sources.messages import level_changes
from tickloom.streaming import flows, stateful, timed

S = 1_000_000


def fed(spark, schema, triggers):
    """A stream with one list of rows a trigger."""
    import time
    import uuid

    path = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    for rows in triggers:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENTS = "symbol string, us long, kind int, id long, value double"


def test_events_leave_in_order_over_triggers(spark):
    first = [("s", 20 * S, 1, 1, 1.0), ("s", 12 * S, 1, 2, 2.0), ("t", 13 * S, 1, 9, 0.0)]
    second = [("s", 15 * S, 1, 3, 3.0), ("s", 15 * S, 0, 4, 4.0), ("s", 60 * S, 0, 5, 5.0)]
    third = [("s", 16 * S, 0, 6, 6.0), ("s", 100 * S, 0, 7, 7.0)]  # 16 s still comes before 20 s have left
    fourth = [("s", 17 * S, 0, 8, 8.0), ("s", 101 * S, 0, 9, 9.0)]  # 17 s comes after them and is dropped
    stream = fed(spark, EVENTS, [first, second, third, fourth])
    out = flows.drained(timed.merged(stream, "10 seconds"), typed=True)
    got = [(r["symbol"], r["us"] // S, r["kind"], r["id"], r["place"]) for r in out.orderBy("symbol", "place").collect()]
    assert got == [
        ("s", 12, 1, 2, 1), ("s", 15, 0, 4, 2), ("s", 15, 1, 3, 3), ("s", 16, 0, 6, 4), ("s", 20, 1, 1, 5),
        ("s", 60, 0, 5, 6), ("t", 13, 1, 9, 1),
    ]


def test_a_feed_that_stops_is_reported_by_timer(spark):
    first = [("s", 10 * S), ("t", 10 * S)]
    second = [("s", 50 * S), ("s", 200 * S)]  # t is silent
    third = [("s", 210 * S)]
    stream = fed(spark, "symbol string, us long", [first, second, third])
    out = flows.drained(timed.silent(stream, 100, "10 seconds"), typed=True)
    got = sorted((r["symbol"], r["from_us"] // S, None if r["to_us"] is None else r["to_us"] // S) for r in out.collect())
    assert got == [("s", 50, 200), ("t", 10, None)]


def test_without_a_grid_every_message_leaves_a_row(spark):
    two = [["10", "1"], ["9", "1"]], [["11", "1"], ["12", "1"]]
    rows = [("s", 0, 0, 1, "snapshot", *two), ("s", 30_000, 1, 2, "delta", [["10", "5"]], []), ("s", 30_000, 2, 3, "delta", [["9", "2"]], [])]
    schema = "symbol string, us long, recv long, update_id long, kind string, b array<array<string>>, a array<array<string>>"
    out = flows.drained(stateful.book_state(level_changes(fed(spark, schema, [rows])), 2, grid_us=None))
    got = [(r["us"], r["seq"], r["bid_size_0"], r["bid_size_1"]) for r in out.orderBy("seq").collect()]
    assert got == [(0, 1, 1.0, 1.0), (30_000, 2, 5.0, 1.0), (30_000, 3, 5.0, 2.0)]


def test_large_tables_are_replayed_in_more_parts(spark, monkeypatch):
    from tickloom.streaming import flows

    monkeypatch.setattr(flows, "ROWS_A_PART", 100)
    rows = spark.range(1000).selectExpr("'s' AS symbol", "id * 1000 AS us", "id AS seq")
    written = []
    monkeypatch.setattr(flows, "materialised", lambda df: written.append(df) or df)
    stream = flows.replay(rows)
    assert len(written) == 1
    back = flows.drained(stream)
    assert back.count() == 1000 and len(back.inputFiles()) >= 10


def test_no_part_reads_the_whole_table(spark, monkeypatch):
    """Each part is written from its own rows: with ten parts the table is not read ten times."""
    from tickloom.session import materialised

    monkeypatch.setattr(flows, "ROWS_A_PART", 100)
    stored = materialised(spark.range(1000).selectExpr("'s' AS symbol", "id * 1000 AS us", "id AS seq"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(flows, "materialised", lambda df: df.mapInArrow(counted, df.schema))
    stream = flows.replay(stored)
    assert seen.value <= 3 * 1000  # counted, cut, dealt
    assert sorted(r["seq"] for r in flows.drained(stream).collect()) == list(range(1000))


def test_events_wait_in_state_as_blocks(spark):
    """A trigger's rows of an instrument take one value of state a block, not one a row."""
    from pyspark.sql.streaming.stateful_processor import ListState

    events = [("s", k * S, k % 2, k, float(k)) for k in range(1, 1001)]
    late = [("s", 2000 * S, 0, 2000, 0.0)]
    stream = fed(spark, EVENTS, [events[500:], events[:500], late])
    out = flows.drained(timed.merged(stream, "1000 seconds"), typed=True).orderBy("place").collect()
    assert [(r["us"] // S, r["kind"], r["place"]) for r in out] == [(k, k % 2, k) for k in range(1, 1000)]

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return held

        def getValueState(self, *_):  # noqa: N802
            return None

        def registerTimer(self, *_):  # noqa: N802
            pass

    class Held(ListState):
        def __init__(self):
            self.values = []

        def appendValue(self, value):  # noqa: N802
            self.values.append(value)

        def appendList(self, values):  # noqa: N802
            self.values += values

    import pandas as pd

    held, merge = Held(), timed.Merge()
    merge.init(Handle())
    list(merge.handleInputRows(("s",), iter([pd.DataFrame(events, columns=["symbol", "us", "kind", "id", "value"])]), None))
    assert len(held.values) == 1
