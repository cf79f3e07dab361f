import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from conftest import SF
from tillstream import schemas
from tillstream.functions import text, weather as wx
from tillstream.operators import quality as q
from tillstream.session import cut_lineage, ensure_checkpoint_dir
from tillstream.sources import readers, sinks
from tillstream.sources.testdata import Tables, daily

HEADER = ["Дата продажи", "Дата время чека", "Вид события по кассе", "Касса.Торговая точка", "Категория",
          "Номенклатура", "Свежесть", "Цена", "Кол-во", "Сумма"]


def test_csv_with_byte_order_mark(spark, tmp_path):
    body = ",".join(HEADER) + "\n" + \
        '02.03.2026,02.03.2026 09:15:00,Продажа,Север 1,Хлеб,Багет,Свежий,"1 234,50",2,"2 469,00"\n' + \
        "плохая дата,,Возврат,Север 1,Хлеб,Багет,Вчерашний,x,1,1\n"
    (tmp_path / "a.csv").write_text(body, encoding="utf-8-sig")
    rows = readers.read_check_lines(spark, str(tmp_path / "a.csv")).orderBy(F.desc("qty")).collect()
    good, bad = rows
    assert good.date == dt.date(2026, 3, 2) and good.event_type == "sale" and good.freshness == "fresh"
    assert (good.price, good.qty, good.amount, good.check_ts.hour) == (1234.5, 2.0, 2469.0, 9)
    assert bad.date is None and bad.price is None and bad.event_type == "return"


def test_an_absent_header_is_an_error(spark, tmp_path):
    (tmp_path / "b.csv").write_text(",".join(HEADER[:8]) + "\n", encoding="utf-8-sig")
    with pytest.raises(ValueError, match="lacks"):
        readers.read_check_lines(spark, str(tmp_path / "b.csv"))


def test_unknown_headers_are_an_error(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        readers.canonicalise_columns(df)
    with pytest.raises(ValueError):
        readers.canonicalise_columns(spark.createDataFrame([(1,)], "store int"), required=["store", "qty"])


def test_drops_keep_bad_lines_apart(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.csv").write_text("k,v\n1,1.5\n2,2.5\n")
    (tmp_path / "x" / "b.csv").write_text("k,v\n2,2.5\n3,oops\n")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])
    good, bad = readers.split_drops(readers.read_drops(spark, str(tmp_path), schema).cache())
    assert sorted((r.k, r.v) for r in good.collect()) == [(1, 1.5), (2, 2.5)]
    assert [(r.source_file.rsplit("/", 1)[1], r._bad_line) for r in bad.collect()] == [("b.csv", "3,oops")]


def test_merge_at_cutoff_uses_common_columns(frame):
    old = frame("date date, k int, a int", [("2024-01-01", 1, 1), ("2024-02-01", 1, 1)])
    new = frame("date date, k int, b int", [("2024-01-15", 2, 1), ("2024-02-01", 2, 1)])
    out = readers.merge_at_cutoff(old, new, "2024-02-01")
    assert out.columns == ["date", "k"] and sorted(r.k for r in out.collect()) == [1, 2]


def test_mart_replaces_only_its_months(spark, tmp_path, frame):
    path = str(tmp_path / "mart")
    sinks.write_mart(frame("date date, v int", [("2024-01-01", 1), ("2024-02-01", 1)]), path)
    sinks.write_mart(frame("date date, v int", [("2024-02-03", 9)]), path)
    assert sorted((str(r.date), r.v) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-02-03", 9)]


def test_profiles_survive_the_nested_form(spark, frame):
    prof = frame("store string, product string, hour int, cum_share double", [("s", "p", 9, 0.25), ("s", "p", 18, 1.0)])
    back = sinks.unnest_profiles(sinks.nested_profiles(prof))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, prof.collect()))


def test_checkpoint_dir_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(daily(Tables(spark, SF)))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().toString() and df.count() > 0


def test_scan_reads_needed_columns_and_pushes_the_filter(spark):
    plan = daily(Tables(spark, SF))._jdf.queryExecution().toString()
    scan = plan[plan.rindex("== Physical Plan =="):]
    assert "l_returnflag" in scan and "CASE" not in scan
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,N)" in scan
    assert "l_discount" not in scan and "l_tax" not in scan and "p_retailprice" not in scan


def test_city_and_names(spark, frame):
    df = frame("n string", [("Магазин Наб Челны",), ("Центр Куюки",), ("Без города",), ("  ",), (None,), ("Челны 2",)])
    got = [r[0] for r in df.select(text.city_from_store(F.col("n"))).collect()]
    assert got == ["Набережные Челны", "Казань", "Казань", "Казань", "Казань", "Набережные Челны"]
    names = frame("n string", [("Центр 12 (3)",), ("Центр",), ("Центр (1)",)])
    assert {r[0] for r in names.select(text.normalise_store(F.col("n"))).collect()} == {"Центр"}


def test_word_filter_ignores_cyrillic_case(frame):
    df = frame("n string", [("КАПУЧИНО большой",), ("Хлеб",), (None,)])
    assert [r[0] for r in df.select(text.has_any_word(F.col("n"), text.NON_FOOD_WORDS)).collect()] == [True, False, False]


def test_weather_codes(frame):
    df = frame("c double", [(0.0,), (3.0,), (48.0,), (55.0,), (77.0,), (81.0,), (96.0,), (None,)])
    got = [r[0] for r in df.select(wx.category_code(wx.wmo_category(F.col("c")))).collect()]
    assert got == [0, 1, 2, 3, 5, 3, 6, 0]


def test_quality_issues_report_missing_columns_without_reading_them(frame):
    df = frame("date date, store string, sold double", [("2024-01-01", "s", -1.0), ("2024-01-01", "s", None)])
    got = {r.rule: r.value for r in q.issue_table(df, ["date", "store", "sold", "price"], ["store", "date"]).collect()}
    assert got == {"missing:price": 1.0, "null:sold": 1.0, "negative_target": 1.0, "row_floor": 2.0, "day_floor": 1.0,
                   "duplicate_keys": 1.0}


def test_schemas_have_the_documented_columns():
    assert schemas.PROFILE.fieldNames() == ["store", "product", "hour", "cum_share"]
    assert schemas.DAILY["sold"].dataType == T.DoubleType()
