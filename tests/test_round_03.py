"""Findings of the third round: orders that a shuffle loses, rounded seconds, groups, buckets and state of bounded work."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from basinflow.operators.layout import buckets_for
from basinflow.plans import advanced, analytic, extended
from basinflow.streaming import idle
from tests import parity


def folder(monkeypatch, tmp_path, **tables) -> None:
    """The tests' tables with some replaced."""
    source = Path(parity.DATA)
    for p in source.glob("*.parquet"):
        if p.stem not in tables:
            (tmp_path / p.name).symlink_to(p)
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        (part,) = Path(f"{tmp_path}/{name}").glob("*.parquet")
        (tmp_path / f"{name}.parquet").symlink_to(part)
    monkeypatch.setattr(parity, "DATA", str(tmp_path))


def events(spark, rows):
    return spark.createDataFrame([(*r, "{}") for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1)


def test_latest_two_are_ordered_by_the_window(spark, monkeypatch, tmp_path):
    day = datetime(1997, 1, 1)
    customers = spark.createDataFrame([(i, f"c{i}", 3, 1.0, "s") for i in range(5)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1)
    orders = [(7 * i % 400, i % 5, "F", 1.0, day, "p") for i in range(400)] + [(None, i % 5, "F", 1.0, day, "p") for i in range(20)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1)
    folder(monkeypatch, tmp_path, customer=customers, orders=orders)
    plan = analytic.QUERIES["lateral_latest_two"](spark, parity.DATA)._jdf.queryExecution().executedPlan().toString()
    assert all("o_orderdate" in line for line in plan.split("\n") if "Window [" in line or "WindowGroupLimit [" in line)
    parity.check(spark, analytic.QUERIES["lateral_latest_two"], analytic.SQL["lateral_latest_two"])


def test_range_frame_rounds_seconds(spark, monkeypatch, tmp_path):
    """A day and a fraction apart, on either side of the rounding."""
    at = [(1, 0, 600_000), (2, 1, 0), (2, 0, 400_000), (3, 0, 500_000), (4, 1, 500_000), (5, 1, 499_999), (5, 2, 500_000), (6, 3, 0)]
    rows = [(i, datetime(2024, 1, day, 0, 0, sec, us), 1, "view", 1.0) for i, (day, sec, us) in enumerate(at)]
    folder(monkeypatch, tmp_path, events=events(spark, rows))
    parity.check(spark, analytic.QUERIES["range_frame"], analytic.SQL["range_frame"])


def test_pandas_groups_hold_many_small_keys(spark, monkeypatch, tmp_path):
    """2,000 users of one event, one of 500 (with repeated ids) and rows with nulls make groups of about a portion, not one for each user."""
    monkeypatch.setattr(extended, "PORTION", 100)
    day = datetime(2024, 1, 1)
    rows = [(i, day, i, "error", i / 7) for i in range(2000)] + [(i % 250, day, 5000, "error", i / 3) for i in range(500)]
    rows += [(9000, day, None, "error", 1.5), (9001, day, None, "error", None), (9002, day, 3, "error", None), (None, day, 4, "error", 2.0)]
    folder(monkeypatch, tmp_path, events=events(spark, rows))
    plan = extended.QUERIES["pandas_grouped_map"](spark, parity.DATA)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas [cell" in plan
    plan = extended.QUERIES["pandas_cogroup"](spark, parity.DATA)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas [cell" in plan
    n = len(rows)
    keys = spark.createDataFrame([(r[2],) for r in rows if r[2] is not None], "user_id long")
    groups = keys.groupBy(extended.cell_of(F.col("user_id"), n)).agg(F.count_if(F.col("user_id") != 5000).alias("small")).collect()
    assert len(groups) <= 1 + n // 100 and max(r.small for r in groups) < 300
    ids = spark.range(500).groupBy(extended.portion_of(F.col("id"), F.lit(500))).count().collect()
    assert len(ids) == 5 and max(r["count"] for r in ids) < 200
    for name in ("pandas_grouped_map", "pandas_cogroup"):
        parity.check(spark, extended.QUERIES[name], extended.SQL[name])


def test_buckets_grow_with_the_table(spark, monkeypatch):
    assert buckets_for(0) == 8 and buckets_for(36_000_000) == 180 and buckets_for(216_000_000) == 1080
    made = []
    write = advanced.write_bucketed
    monkeypatch.setattr("basinflow.operators.layout.BUCKET_ROWS", 300)
    monkeypatch.setattr(advanced, "write_bucketed", lambda df, name, key, buckets: made.append(buckets) or write(df, name, key, buckets))
    parity.check(spark, advanced.QUERIES["bucketed_join"], advanced.SQL["bucketed_join"])
    lines = spark.read.parquet(f"{parity.DATA}/lineitem.parquet").count()
    assert made == [-(-lines // 300)] * 2


class Kept(list):
    """A list, value or map state and a handle that count calls."""

    def __init__(self):
        super().__init__()
        self.calls, self.timers, self.map = 0, set(), {}

    def get(self):
        self.calls += 1
        return iter(list(self))

    def put(self, rows):
        self.calls += 1
        self[:] = rows

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def keys(self):
        self.calls += 1
        return iter([(k,) for k in self.map])

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key[0]] = value


class Number(Kept):
    def get(self):
        return self[0] if self else None

    def update(self, value):
        self[:] = [value]


def test_a_key_has_one_timer_however_many_spells():
    users = idle.IdleUsers(1000)
    users.handle, users.spells, users.sent = Kept(), Kept(), Number()
    rows = [Row(at=i * 5_000_000) for i in range(50)]
    assert list(users.handleInputRows((7,), iter(rows[::-1]), None)) == []
    assert users.handle.timers == {1000} and users.handle.calls + users.spells.calls == 3
    list(users.handleInputRows((7,), iter([Row(at=900_000)]), None))  # the first spell goes on
    assert users.handle.timers == {1900}
    sent = list(users.handleExpiredTimer((7,), TimerValues(-1, 101_500), None))
    assert [(r.nth, r.start, r.n) for r in sent] == [(i + 1, i * 5_000_000, 2 if i == 0 else 1) for i in range(21)]
    assert len(users.spells) == 29 and 106_000 in users.handle.timers
    assert [r.nth for r in users.handleExpiredTimer((7,), TimerValues(-1, 10**9), None)] == list(range(22, 51)) and not users.spells


def test_known_kinds_cost_one_call():
    first = idle.FirstOfKind(1)
    first.seen = Kept()
    rows = [Row(event_type=f"t{i % 5}", event_id=100 - i) for i in range(50)] + [Row(event_type=None, event_id=3)]
    assert {(r.event_type, r.event_id) for r in first.handleInputRows((1,), iter(rows), None)} == {(f"t{i}", 55 - i) for i in range(5)} | {(None, 3)}
    first.seen.calls = 0
    assert list(first.handleInputRows((1,), iter(rows), None)) == [] and first.seen.calls == 1
