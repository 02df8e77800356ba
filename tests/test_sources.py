import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.sources import files
from granary.streaming import feeds


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None, date(2026, 1, 2), 1.5, ["x", "y"]), (None, "q\"z", date(2026, 2, 1), None, [])], "a string, b string, day date, n double, flags array<string>")
    files.write_csv(df, str(tmp_path / "c"), "day")
    assert sorted(p.name for p in (tmp_path / "c/year=2026").iterdir()) == ["month=01", "month=02"]
    back = files.read_csv(spark, str(tmp_path / "c"), "a string, b string, day date, n double, flags string").select("a", "b", "day", "n", "flags")
    assert {tuple(r) for r in back.collect()} == {("a,b", None, date(2026, 1, 2), 1.5, "x|y"), (None, "q\"z", date(2026, 2, 1), None, None)}
    assert files.digest(back).first() == files.digest(back.orderBy(F.desc("day"))).first() != files.digest(back.limit(1)).first()


def test_rows_of_an_export_are_shuffled_before_they_are_text(spark):
    df = spark.createDataFrame([("a", 1.5, date(2026, 2, 1), ["x", "y"]), (None, None, None, None)], "a string, n double, day date, flags array<string>")
    out = files._by_month(df, "day")
    assert out.columns == ["a", "n", "day", "flags", "year", "month"] and {tuple(r) for r in out.collect()} == {("a", "1.5", "2026-02-01", "x|y", "2026", "02"), (None,) * 6}
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RebalancePartitions":
        plan = plan.children().head()
    assert [plan.output().apply(k).dataType().simpleString() for k in range(6)] == ["string", "double", "date", "array<string>", "int", "int"]


def test_wide_report(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Daily report\n,,,sub,header,x,y\nCommodity Group,Commodity,MSP (Rs./Quintal),"Price on 06 Oct, 2026","Price on 05 Oct, 2026","Arrival on 06 Oct, 2026","Arrival on 05 Oct, 2026"\nCereals,"Paddy, Common","2,300",100,-,0,NA\nPulses,Gram,,,"1,250.5",null,3\n')
    out = {(r.commodity, r.report_date): (r.msp, r.price, r.arrivals) for r in files.wide_report(spark, str(tmp_path / "r.csv")).collect()}
    assert out == {("Paddy, Common", date(2026, 10, 6)): (2300.0, 100.0, 0.0), ("Paddy, Common", date(2026, 10, 5)): (2300.0, None, None), ("Gram", date(2026, 10, 6)): (None, None, None), ("Gram", date(2026, 10, 5)): (None, 1250.5, 3.0)}


class Api(BaseHTTPRequestHandler):
    down: set = set()

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if q["arrival_date"] in self.down:  # fails once a day
            self.down.discard(q["arrival_date"])
            self.send_response(503)
            self.end_headers()
            return
        total = {"01/09/2026": 5, "02/09/2026": 0, "03/09/2026": 4}[q["arrival_date"]]
        rows = [{"State": q["state"], "market": f" m{k} ", "Modal_x0020_Price": str(k), "Min Price": 7, "arrival_date": q["arrival_date"]} for k in range(total)]
        body = json.dumps({"total": str(total), "records": rows[int(q["offset"]) :][: int(q["limit"])]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def api(spark):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(files.DailyReports)
    yield {"url": f"http://127.0.0.1:{server.server_port}/", "page": "2", "pause": "0.01", "from": "2026-09-01", "to": "2026-09-03", "filter.state": "Goa"}
    server.shutdown()


def test_web_source(spark, api):
    Api.down = {"01/09/2026", "03/09/2026"}
    df = spark.read.format("daily_reports").options(**api).load()
    rows = df.collect()
    assert not Api.down  # both were asked again
    assert len(rows) == 9 and {r.state for r in rows} == {"Goa"} and {r.min_price for r in rows} == {"7"} and sorted(r.modal_price for r in rows) == ["0", "0", "1", "1", "2", "2", "3", "3", "4"]
    assert df.rdd.getNumPartitions() == 3
    raw = files.raw_records(df.filter("market = ' m4 '")).first()
    assert (raw.source_record_key, raw.price_date, raw.price_unit, raw.price_unit_assumed, raw.arrivals_quantity) == ("Goa||m4||||01/09/2026", "01/09/2026", "INR/quintal", True, None)


@pytest.mark.parametrize("most, days", [(7, {"03/09/2026": 4, "01/09/2026": 3}), (4, {"03/09/2026": 4}), (3, {"03/09/2026": 3}), (99, {"03/09/2026": 4, "01/09/2026": 5})])
def test_web_source_stops_after_the_newest_records(spark, api, most, days):
    rows = spark.read.format("daily_reports").options(max_records=str(most), **api).load().groupBy("arrival_date").count().collect()
    assert {r.arrival_date: r["count"] for r in rows} == days
    planned = files.planned_days({**api, "max_records": str(most)})
    assert [d.day.day for d in planned] == [3, 2, 1]
    assert [d.day.day for d in planned if d.partial] == {7: [1], 3: [3]}.get(most, [])
    assert [d.day.day for d in planned if d.skipped] == ([2, 1] if most < 5 else [])


def test_web_source_gives_up(spark, api):
    with pytest.raises(Exception, match="404|Not Found|refused"):
        files._answer({**api, "url": "http://127.0.0.1:9/", "retries": "1"}, "01/09/2026", 0, 1)


def write_events(spark, path, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, None, u, "click", v, None) for i, _, u, v in rows], schema).withColumn("ts", F.element_at(F.array(*[F.lit(t).cast("timestamp_ntz") for _, t, _, _ in rows]), (F.col("event_id") - rows[0][0] + 1).cast("int"))).coalesce(1).write.parquet(path)


def test_upserts_log_what_they_replace(spark, tmp_path):
    write_events(spark, str(tmp_path / "in/1"), [(1, "2026-01-01 10:00:00", 7, 10.0), (2, "2026-01-01 11:00:00", 7, 11.0)])
    sink = feeds.Upserts(str(tmp_path / "s"), ("market", "commodity"))
    run = lambda: feeds.run(feeds.reports(spark, str(tmp_path / "in/*")), str(tmp_path / "s"), "append", sink)
    run()
    assert [r.price for r in sink.state(spark).collect()] == [11.0]
    write_events(spark, str(tmp_path / "in/2"), [(3, "2026-01-01 09:00:00", 7, 9.0), (4, "2026-01-02 09:00:00", 8, 5.0)])
    run()
    assert sorted((r.market, r.price) for r in sink.state(spark).collect()) == [(7, 11.0), (8, 5.0)]  # the late report changes nothing
    write_events(spark, str(tmp_path / "in/3"), [(5, "2026-01-03 09:00:00", 7, 12.0)])
    run()
    assert [(r.previous_price, r.price) for r in spark.read.parquet(str(tmp_path / "s/revisions")).collect()] == [(11.0, 12.0)]


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
