"""Late data, replays and equality with the batch answer."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F, types as T

from tillstream.streaming import jobs

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("store", T.StringType()), ("product", T.StringType()), ("check_ts", T.TimestampType()),
    ("qty", T.DoubleType()), ("amount", T.DoubleType()))])


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    frame = pd.DataFrame([("s", "p", ts, 1.0, 2.0) for ts in rows], columns=SCHEMA.fieldNames())
    frame["check_ts"] = pd.to_datetime(frame["check_ts"], utc=True)
    frame.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")


def at(day, hour):
    return dt.datetime(2024, 1, day, hour, 30)


def test_append_closes_windows_and_drops_late_rows(spark, tmp_path):
    land, out, ckpt = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "ckpt")

    def step():
        events = jobs.read_landing(spark, str(land), SCHEMA)
        q = jobs.start_append(jobs.hourly_windows(events, late="1 hour"), out, ckpt)
        q.awaitTermination()
        return sorted((r.window_start.hour, r.qty) for r in spark.read.schema(
            "store string, product string, window_start timestamp, qty double, amount double, n_lines bigint"
        ).parquet(out).collect())

    drop(land, "a", [at(1, 8), at(1, 8), at(1, 9)])
    step()
    drop(land, "b", [at(1, 14)])  # moves the watermark to 13:30
    assert step() == [(8, 2.0), (9, 1.0)]
    drop(land, "c", [at(1, 8), at(1, 20)])  # 8:30 is too late; 20:30 closes 14:00
    assert step() == [(8, 2.0), (9, 1.0), (14, 1.0)]


def test_update_equals_batch_and_a_rerun_adds_nothing(spark, tmp_path):
    land, out, ckpt = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "ckpt")
    rows = [at(d, h) for d in (1, 2) for h in (9, 12, 12, 16)]
    for i, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        drop(land, f"f{i}", part)

    def stream():
        events = jobs.read_landing(spark, str(land), SCHEMA, files_per_trigger=1)
        got = jobs.run_update(jobs.last_sale_windows(events, late="2 days"), out, ckpt, ["store", "product", "date"])
        return sorted((str(r.date), r.last_hour, r.sold, r.is_early_stop) for r in got.collect())

    batch = [("2024-01-01", 16, 4.0, 0), ("2024-01-02", 16, 4.0, 0)]
    assert stream() == batch
    assert stream() == batch  # nothing new has landed
    drop(land, "late", [at(2, 20)])
    assert stream() == [batch[0], ("2024-01-02", 20, 5.0, 0)]


def test_a_retried_epoch_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "epochs")
    write = jobs.epoch_writer(path)
    df = spark.createDataFrame([("k", 1.0)], "k string, v double")
    write(df, 0)
    write(df.withColumn("v", F.lit(2.0)), 1)
    write(df.withColumn("v", F.lit(3.0)), 1)
    assert [(r.k, r.v) for r in jobs.latest_rows(spark, path, ["k"]).collect()] == [("k", 3.0)]
    assert spark.read.parquet(path).count() == 2


def history(spark, path, mean):
    spark.createDataFrame([("p", mean, 5.0)], "product string, hist_mean double, hist_std double").write.mode("overwrite").parquet(path)


def test_drift_uses_the_history_of_the_day(spark, tmp_path):
    land, known, out, ckpt = tmp_path / "land", str(tmp_path / "history"), str(tmp_path / "o"), str(tmp_path / "c")

    def step():
        log = jobs.read_landing(spark, str(land), SCHEMA).select("product", F.col("check_ts").alias("timestamp"), (F.col("qty") * 50).alias("prediction"))
        jobs.finish(jobs.start_drift(log, known, out, ckpt, ["product"]))
        return sorted((r.window_end.day, r.n_recent, r.hist_mean, r.is_drift) for r in spark.read.parquet(out).collect())

    history(spark, known, 10.0)
    drop(land, "a", [at(10, h) for h in range(12)])
    drop(land, "b", [at(14, 12)])  # the watermark reaches the 13th: windows that end by then are closed
    first = step()
    assert first == [(11, 12, 10.0, 1), (12, 12, 10.0, 1), (13, 12, 10.0, 1)]
    history(spark, known, 50.0)
    drop(land, "c", [at(16, 12)])
    assert step() == [*first, (14, 12, 50.0, 0), (15, 13, 50.0, 0)]
    assert step() == [*first, (14, 12, 50.0, 0), (15, 13, 50.0, 0)]  # nothing new has landed


def test_drift_without_history(spark):
    windows = spark.createDataFrame([("q", 12, 3.0), ("p", 12, 99.0), ("p", 9, 99.0)], "product string, n_recent long, recent_mean double")
    known = spark.createDataFrame([("p", 1.0, 2.0)], "product string, hist_mean double, hist_std double")
    got = {(r.product, r.n_recent): (r.drift_ratio, r.is_drift) for r in jobs.with_drift(windows, known, ["product"]).collect()}
    assert got["q", 12] == (None, 0) and got["p", 12][1] == 1 and got["p", 9][1] == 0


def batch_alerts(rows, until, quiet=3, min_days=3):
    """Alerts due by `until`, from all sales at once."""
    out, hours = [], []
    days = sorted({r.date() for r in rows})
    for day in days:
        sold = sorted({r.replace(second=0) for r in rows if r.date() == day})
        midnight = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1)
        usual = sum(hours) // len(hours) if len(hours) >= min_days else None
        for a, b in zip(sold, [*sold[1:], None]):
            due = a + dt.timedelta(hours=quiet)
            if due < midnight and (b is None or b > due) and usual is not None and a.hour < usual and due <= until:
                out.append((str(day), "open", a.hour, sum(r <= a for r in rows if r.date() == day)))
        if midnight <= until:
            out.append((str(day), "close", sold[-1].hour, len([r for r in rows if r.date() == day])))
            hours.append(sold[-1].hour)
    return sorted(out)


def test_alerts_come_once_whatever_the_batches(spark, tmp_path):
    days = [[8, 12, 18, 19], [9, 19], [8, 13, 18], [8, 10], [8, 12, 13, 19], [7, 19], [8]]
    rows = [at(d + 1, h) for d, hs in enumerate(days) for h in hs]
    until = max(rows) - dt.timedelta(hours=2)
    want = batch_alerts(rows, until)
    assert ("2024-01-04", "open", 10, 2) in want and [w for w in want if w[1] == "close"] == sorted(w for w in want if w[1] == "close")
    for name, cuts in (("one", [len(rows)]), ("many", [3, 5, 9, 10, 11, 14, len(rows)])):
        land, out, ckpt = tmp_path / f"land-{name}", str(tmp_path / f"out-{name}"), str(tmp_path / f"ckpt-{name}")
        start = 0
        for i, cut in enumerate(cuts):
            drop(land, f"f{i}", rows[start:cut])
            start = cut
            jobs.finish(jobs.start_append(jobs.early_stop_alerts(jobs.read_landing(spark, str(land), SCHEMA)), out, ckpt))
        jobs.finish(jobs.start_append(jobs.early_stop_alerts(jobs.read_landing(spark, str(land), SCHEMA)), out, ckpt))  # nothing new
        got = sorted((str(r.date), r.kind, r.last_hour, int(r.sold)) for r in spark.read.parquet(out).collect())
        assert got == want, name


def test_alerts_of_many_pairs_take_few_timers(spark, tmp_path):
    pick = random.Random(4)
    pairs = {(f"s{i}", p): sorted({dt.datetime(2024, 1, d, h, pick.choice((0, 30))) for d in range(1, 10) for h in pick.sample(range(6, 24), 4)})
             for i in range(20) for p in ("a", "b")}
    end = dt.datetime(2024, 1, 10, 20)
    pairs["last", "a"] = [end]
    want = sorted((*pair, *alert) for pair, sales in pairs.items() for alert in batch_alerts(sales, end - dt.timedelta(hours=2)))
    assert {w[3] for w in want} == {"open", "close"} and len(want) > 400
    days = [dt.datetime(2024, 1, d, 13) for d in (3, 4, 6, 9, 11)]
    # At most one timer when rows come and one when it fires, per batch and group; pairs may share a group.
    for name, cuts, groups, most in (("one", days[-1:], {}, 2 * 41), ("many", days, {}, 5 * 2 * 41), ("shared", days, {"groups": 3}, 5 * 2 * 3)):
        land, out, ckpt = tmp_path / f"land-{name}", str(tmp_path / f"out-{name}"), str(tmp_path / f"ckpt-{name}")
        land.mkdir()
        start, timers = dt.datetime(2024, 1, 1), 0
        for i, cut in enumerate(cuts):
            part = pd.DataFrame([(*pair, r, qty, 2.0) for pair, sales in pairs.items() for r in sales if start <= r < cut for qty in (1.0, None)],
                                columns=SCHEMA.fieldNames())
            part["check_ts"] = pd.to_datetime(part["check_ts"], utc=True)
            part.to_parquet(land / f"f{i}.parquet", coerce_timestamps="us")
            start = cut
            query = jobs.start_append(jobs.early_stop_alerts(jobs.read_landing(spark, str(land), SCHEMA), **groups), out, ckpt)
            jobs.finish(query)
            timers += sum(int(o.customMetrics["numRegisteredTimers"]) for p in query.recentProgress for o in p.stateOperators)
        got = sorted((r.store, r["product"], str(r.date), r.kind, r.last_hour, int(r.sold)) for r in spark.read.parquet(out).collect())
        assert got == want, name
        assert 0 < timers <= most, name
