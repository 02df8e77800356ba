import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.streaming import feeds

START = datetime(2026, 1, 1)
RULES = "alert_id long, market long, commodity string, target double, condition string, freshness_hours int"


def written(spark, folder, batches):
    """One file for each batch of rows (event_id, ts, user, price, is_sample)."""
    for k, rows in enumerate(batches):
        data = [(i, t, u, "click", p, '{"k": %d}' % (10 if sample else 3)) for i, t, u, p, sample in rows]
        df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/{k:02d}")


def expected(rows, rules):
    """By the definition: judged three days on or at the end, if no newer report came meanwhile, and fresh."""
    end, wait, out = max(r[1] for r in rows), timedelta(days=3), []
    good = [r for r in rows if not r[4] and r[3] > 0]
    for i, t, u, p, _ in good:
        if any(v == u and (t, i) < (s, j) and s <= t + wait for j, s, v, _, _ in good):
            continue
        day_end = datetime(t.year, t.month, t.day) + timedelta(days=1) - timedelta(milliseconds=1)
        for a, market, _, target, condition, hours in rules:
            if market == u and (p >= target if condition == "gte" else p <= target) and day_end + timedelta(hours=hours) >= min(t + wait, end):
                out.append((a, i))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 100])
def test_alerts_do_not_depend_on_batches(spark, tmp_path, files):
    r = random.Random(7)
    rows = [(i, START + timedelta(hours=5 * i + r.randrange(5), microseconds=i), r.randrange(3), round(r.uniform(-5, 50), 2), r.random() < 0.2) for i in range(70)]
    rows += [(900, START + timedelta(days=9), 5, 20.0, False), (901, START + timedelta(days=8), 5, 21.0, False)]  # of the 10th, then one of the 9th
    late = sorted(rows, key=lambda x: x[1] + timedelta(hours=r.randrange(60)))  # later by less than three days
    late.remove(rows[-1])
    late.insert(late.index(rows[-2]) + 1, rows[-1])
    rules = [(1, 0, "click", 20.0, "gte", 80), (2, 0, "click", 20.0, "gte", 60), (3, 1, "click", 30.0, "lte", 55), (4, 2, "click", 0.0, "gte", 100), (5, 5, "click", 1.0, "gte", 100), (6, 8, "click", 1.0, "gte", 100)]
    written(spark, tmp_path / "in", [late[k : k + 9] for k in range(0, len(late), 9)])
    end = F.lit(max(x[1] for x in rows)).cast("timestamp")
    feed = feeds.reports(spark, str(tmp_path / "in/*"), files)
    found = sorted((x.alert_id, x.report_id) for x in feeds.alerts(feed, spark.createDataFrame(rules, RULES), str(tmp_path / "out"), end).collect())
    assert found == expected(rows, rules)
    assert (5, 900) in found and (5, 901) not in found


def files_of(folder):
    return {p: p.stat().st_size for p in Path(folder).rglob("*.parquet")}


def test_an_upsert_writes_what_its_batch_touches(spark, tmp_path):
    sink = feeds.Upserts(str(tmp_path), ("market", "commodity"), buckets=16)
    batch = lambda rows: spark.createDataFrame(rows, "market long, commodity string, ts timestamp, report_id long, price double")
    sink(batch([(m, "x", START, m, 1.0) for m in range(4000)]), 0)
    first = files_of(tmp_path / "state")
    assert len(first) == 16
    one = [(7, "x", START + timedelta(days=1), 9000, 2.0), (8, "x", START - timedelta(days=1), 9001, 3.0)]
    for again in range(2):  # a batch that is run again gives the same state
        sink(batch(one), 1)
        now = files_of(tmp_path / "state")
        new = {k: v for k, v in now.items() if "version=1" in str(k)}
        assert 1 <= len(new) <= 2 and sum(new.values()) < 0.2 * sum(first.values())
        state = {r.market: r.price for r in sink.state(spark).collect()}
        assert len(state) == 4000 and state[7] == 2.0 and state[8] == 1.0
        assert [(r.market, r.previous_price, r.price) for r in sink.revisions(spark).collect()] == [(7, 1.0, 2.0)]
    sink(batch([(7, "x", START + timedelta(days=2), 9002, 4.0)]), 2)
    sink(batch([(7, "x", START + timedelta(days=3), 9003, 5.0)]), 3)
    kept = {p.parts[-3] for p in files_of(tmp_path / "state") if p.parts[-2] == next(q.parts[-2] for q in files_of(tmp_path / "state") if "version=3" in str(q))}
    assert kept == {"version=2", "version=3"}  # the last version and the one before it
    assert {r.market: r.price for r in sink.state(spark).collect()}[7] == 5.0


def test_alerts_wait_to_the_microsecond_and_without_python(spark, tmp_path, monkeypatch):
    """A report that comes three days later, to the microsecond, silences the one before it; one microsecond more and both fire."""
    wait, step = timedelta(days=3), timedelta(microseconds=1)
    rows = [(1, START, 0, 5.0, False), (2, START + wait, 0, 6.0, False), (3, START, 1, 5.0, False), (4, START + wait + step, 1, 6.0, False), (5, START, 2, 5.0, False), (6, START, 2, 6.0, False), (7, START + timedelta(days=30), 3, 1.0, False)]
    rules = [(10 + m, m, "click", 0.0, "gte", 1000) for m in range(4)]
    assert expected(rows, rules) == [(10, 2), (11, 3), (11, 4), (12, 6), (13, 7)]
    plans, run = [], feeds.run
    monkeypatch.setattr(feeds, "run", lambda out, *more: (plans.append(out._jdf.queryExecution().analyzed().toString()), run(out, *more)))
    for name, batches in (("one", [rows]), ("two", [rows[:4], rows[4:]])):
        written(spark, tmp_path / name, batches)
        found = feeds.alerts(feeds.reports(spark, str(tmp_path / name / "*"), 1), spark.createDataFrame(rules, RULES), str(tmp_path / f"{name}-out"), F.lit(rows[-1][1]).cast("timestamp"))
        assert sorted((x.alert_id, x.report_id) for x in found.collect()) == expected(rows, rules)
    assert plans and not any("Python" in plan or "Pandas" in plan for plan in plans)
