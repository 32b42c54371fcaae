"""Files written and read back, the synthetic panel, and the rules that toy tables show exactly."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, portfolio, serving, xsection
from tidemark.sources import html, tables, text


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_files_round_trip(spark, tmp_path):
    prices = tables.synthetic_prices(spark, 5, 300)
    tables.write_panel(prices, f"{tmp_path}/panel")
    back = tables.price_scan(spark, f"{tmp_path}/panel", "T00001", "T00004")
    assert sorted(back.collect()) == sorted(prices.where("ticker in ('T00001', 'T00004')").collect())
    assert "PushedFilters: [In(ticker" in back._jdf.queryExecution().toString()
    tables.write_csv(prices.select("date", "ticker"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 1500


def test_synthetic_prices_repeat(spark):
    a, b = (sorted(tables.synthetic_prices(spark, 4, 50, partitions=n).collect()) for n in (1, 7))
    assert a == b and len(a) == 200 and all(r.low < r.close < r.high and r.date.weekday() < 5 for r in a)
    assert a != sorted(tables.synthetic_prices(spark, 4, 50, seed=1).collect())


def test_membership_rules(spark):
    events = [("a", day(1), 1), ("a", day(5), -1), ("b", day(2), -1), ("b", day(3), -1), ("c", day(4), 1), ("c", day(6), 1), ("d", day(7), 1), ("d", day(7), -1), ("e", day(1), 1), ("e", day(2), -1)]
    rows = joins.membership(spark.createDataFrame(events, "k string, date date, kind int"), "k", spark.createDataFrame([("e",), ("f",), ("c",)], "k string")).collect()
    got = sorted(map(tuple, rows), key=str)
    want = [("a", day(1), day(5)), ("b", None, day(2)), ("b", None, day(3)), ("c", day(4), None), ("d", day(7), day(7)), ("e", day(1), day(2)), ("e", day(2), None), ("f", None, None)]
    assert got == sorted(want, key=str)


def test_weights_wait_for_the_next_day_not_the_next_row(spark):
    weights = spark.createDataFrame([(day(0), "A", 1.0), (day(0), "B", 0.0)], "date date, ticker string, weight double")
    returns = spark.createDataFrame([(day(0), "A", 0.0), (day(1), "B", 0.0), (day(2), "B", 0.0), (day(3), "A", 0.02)], "date date, ticker string, r double")
    rows = {r.date: r for r in portfolio.backtest(weights, returns).collect()}
    assert rows[day(1)].turnover == 1.0 and rows[day(2)].turnover == 0 and abs(rows[day(3)].gross - 0.02) < 1e-12


@pytest.mark.parametrize("parts", [1, 3, 200])
def test_places_and_median(spark, parts):
    values = [None if i % 11 == 0 else float(i * 7 % 40) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, x double")
    for descending in (False, True):
        order = sorted(range(200), key=lambda i: (values[i] is None, (-1 if descending else 1) * (values[i] or 0), i))
        assert {r.k: r.place for r in xsection.places(df, "x", "k", descending=descending, parts=parts).collect()} == {i: n for n, i in enumerate(order, 1)}
    known = sorted(v for v in values if v is not None)
    assert xsection.median_of(df, "x", parts).first().m == (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert xsection.median_of(df.where("x is null"), "x").first().m is None


def test_runs_of_a_service(spark):
    runs = spark.createDataFrame([(1, day(1), "ok", False), (2, day(2), "failed", True), (3, day(3), "ok", False)], "run_id int, started date, status string, is_active boolean")
    assert serving.resolved_run(runs).first().run_id == 3 and serving.resolved_run(runs, 2).first().run_id == 2
    assert serving.resolved_run(serving.activated(runs, 1)).first().run_id == 1
    assert [r.is_active for r in serving.activated(runs, 2).orderBy("run_id").collect()] == [False, True, False]  # a failed run can't be active
    assert serving.resolved_run(runs.where("status = 'failed'")).collect() == []
    assert {r.status for r in serving.with_status(runs.withColumn("status", F.lit("running")), spark.createDataFrame([(1, "ok")], "run_id int, new_status string"), spark.createDataFrame([(2,)], "run_id int")).collect()} == {"ok", "running", "crashed"}


def test_text_forms(spark):
    assert text.quarters(dt.date(2019, 11, 5), dt.date(2020, 4, 1)) == [(2019, 4), (2020, 1), (2020, 2)]
    names = spark.createDataFrame([("Foo Holdings, Inc.",), ("The Co",), ("AB Corp",), (None,)], "n string")
    assert [r[0] for r in names.select(text.canonical_name(F.col("n"))).collect()] == [None, None, None, None]
    with pytest.raises(Exception, match="too short"):
        text.checked_companies(spark.createDataFrame([("A", "0000000001")], "ticker string, cik string")).collect()


def test_html_tables_of_odd_pages(spark):
    spans = "<table><tr><th rowspan=2>Day<th colspan=2>Both</tr><tr><th>L<th>R</tr><tr><td rowspan=2>x</td><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    pages = [(1, None), (2, ""), (3, "<p>none</p>"), (4, spans), (4, "<table><tr><td>a<table><tr><td>b</table>c</table>"), (None, "<table><tr><td rowspan=x>&lt;</table>")]
    rows = html.html_tables(spark.createDataFrame(pages, "k int, page string"), "k", "page").collect()
    got = sorted((r.k or 0, r.table, r.line, r.header, tuple(r.cells)) for r in rows)
    assert got == [
        (0, 0, 0, False, ("<",)),
        (4, 0, 0, False, ("ac",)),
        (4, 0, 0, True, ("Day", "Both", "Both")),
        (4, 0, 1, True, ("Day", "L", "R")),
        (4, 0, 2, False, ("x", "1", "2")),
        (4, 0, 3, False, ("x", "3")),
        (4, 1, 0, False, ("b",)),
    ]


def test_day_cache_marks_empty_days_once(spark):
    day = lambda *ds: spark.createDataFrame([(d,) for d in ds], "date string")
    schema = "date string, k int"
    cached = spark.createDataFrame([("d1", 1), ("d2", None)], schema)
    fetched = spark.createDataFrame([("d1", 9), ("d2", 9), ("d3", 3), ("d3", 4)], schema)
    once = tables.day_cache(day("d1", "d2", "d3", "d4"), cached, fetched)
    expected = [("d1", 1), ("d2", None), ("d3", 3), ("d3", 4), ("d4", None)]
    assert sorted((tuple(r) for r in once.collect()), key=str) == expected
    assert sorted((tuple(r) for r in tables.day_cache(day("d4"), once, fetched).collect()), key=str) == expected
    assert sorted(r.k for r in tables.held_rows(once, "k").collect()) == [1, 3, 4]


def test_trials_are_exact_at_ties(spark, tmp_path):
    from tidemark.plans import cross

    # 64 values whose mean, 59.5721875, lies between two sixth digits: sums of doubles lie on either side of it, by their order
    values = [round(17.31 + 1.37 * k % 83.17, 2) for k in range(63)]
    values.append(round((381262 - sum(round(100 * v) for v in values)) / 100, 2))
    rows = [(u, values[(i * (2 * u + 1)) % 64]) for u in range(40) for i in range(64)]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.sharpe for r in cross.trials(spark, str(tmp_path)).collect()} == {59.572188}
    plan = cross.trials(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" in plan
