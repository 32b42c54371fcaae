"""Tone archives, resumable ingest, file headers, page tables and documents on toy inputs written from the rules they follow."""

import datetime as dt
import io
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import any_date, bucket_of, without_leaks
from tidemark.operators import serving
from tidemark.sources import files, html, ingest, tables, text, tone

DAY = dt.date(2024, 1, 15)


def zipped(content, name="20240115.gkg.csv"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if content is not None:
            z.writestr(name, content)
    return out.getvalue()


def fixed(date="20240115", count="3", orgs="APPLE", value="2.5,1,2"):
    return "\t".join([date, count, "c", "t", "l", "p", orgs, value, "e"])


NAMES = [("APPLE", ["AAPL"]), ("ALPHABET", ["GOOG", "GOOGL"]), ("GOOGLE", ["GOOG"]), ("GE", ["GE"])]


def mentions(spark, content):
    names = spark.createDataFrame(NAMES, "name string, tickers array<string>")
    rows = tone.archived_lines(spark.createDataFrame([("f", bytearray(zipped(content)))], "path string, content binary"))
    return {(r.date, r.ticker): (r.mention_count, r.article_count, r.tone_mean, r.tone_std) for r in tone.mentions(tone.mention_rows(rows), names).collect()}


def test_tone_lines(spark):
    one = {(DAY, "AAPL"): (1, 3, 2.5, 0.0)}
    assert mentions(spark, fixed(orgs="apple,123;Nobody,5") + "\n") == one  # offsets, any case
    assert mentions(spark, fixed(date="20240115103000")) == one  # the first eight digits
    assert mentions(spark, fixed(orgs="APPLE;APPLE,9; Apple ")) == one  # one line counts once
    assert mentions(spark, fixed(count="") + "\n" + fixed(count="x")) == {(DAY, "AAPL"): (2, 2, 2.5, 0.0)}
    assert mentions(spark, fixed(orgs="ALPHABET;GOOGLE")) == {(DAY, "GOOG"): (1, 3, 2.5, 0.0), (DAY, "GOOGL"): (1, 3, 2.5, 0.0)}
    for bad in (fixed(orgs=""), fixed(orgs="GE"), fixed(value=""), fixed(value="n/a,1"), fixed(value="nan"), fixed(date="2024011"), fixed(date="20241399"), "short\tline", ""):
        assert mentions(spark, fixed() + "\n" + bad) == one, bad
    assert mentions(spark, "") == {} and mentions(spark, None) == {}
    both = mentions(spark, fixed(orgs="ALPHABET", value="1.0") + "\n" + fixed(orgs="GOOGLE", value="4.0") + "\n" + fixed(orgs="ALPHABET;GOOGLE", value="4.0"))
    assert both[DAY, "GOOG"][:3] == (3, 9, 3.0) and abs(both[DAY, "GOOG"][3] - statistics.pstdev([1, 4, 4])) < 1e-12 and both[DAY, "GOOGL"][:3] == (2, 6, 2.5)
    again = "\n".join([fixed(orgs="ALPHABET;GOOGLE")] * 5)  # equal lines are lines of their own
    assert mentions(spark, again)[DAY, "GOOG"] == (5, 15, 2.5, 0.0)


def test_tone_headers(spark):
    header = "TONE\tORGANIZATIONS\tX\tDATE\tNUMARTS\n"
    assert mentions(spark, header + '7.0\tApple\t"a\tb\nc"\t20240115\t2\n') == {(DAY, "AAPL"): (1, 2, 7.0, 0.0)}
    assert mentions(spark, "ORGANIZATIONS\tN\tTONE\tDATE\nApple\t4\t1\t20240115\n") == {(DAY, "AAPL"): (1, 4, 1.0, 0.0)}  # the second column counts
    assert mentions(spark, "DATE\tNUMARTS\tTONE\n20240115\t1\t2\n") == {}  # an unknown header
    assert mentions(spark, header) == {}


def test_merged_files_are_one_file(spark):
    values = [1.0, 2.0, 2.0, 7.0, 7.0, 7.5]
    names = spark.createDataFrame(NAMES, "name string, tickers array<string>")
    parts = spark.createDataFrame([(f"f{k % 3}", fixed(value=str(v))) for k, v in enumerate(values)], "file string, value string")
    row = tone.merged(tone.mentions(tone.mention_rows(tone.split_lines(parts), "file"), names, "file")).first()
    assert (row.mention_count, row.article_count) == (6, 18) and abs(row.tone_mean - statistics.mean(values)) < 1e-12 and abs(row.tone_std - statistics.pstdev(values)) < 1e-12


SCHEMA = "file string, ticker string, mention_count long"


def parse(files_):
    rows = tone.mention_rows(ingest.named(tone.archived_lines(files_)), "file")
    return rows.select("file", F.explode("names").alias("ticker")).groupBy("file", "ticker").agg(F.count(F.lit(1)).alias("mention_count"))


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    folder, cache, progress = (f"{tmp_path}/{n}" for n in ("in", "cache", "progress"))
    (tmp_path / "in").mkdir()
    put = lambda name, content: (tmp_path / "in" / name).write_bytes(zipped(content))
    run = lambda **k: ingest.ingest_files(spark, folder, cache, progress, parse, SCHEMA, **k)
    held = lambda: sorted((r.file, r.ticker, r.mention_count, r.batch) for r in ingest.cached_files(spark, cache, SCHEMA).collect())
    put("20240115.zip", fixed() + "\n" + fixed(orgs="BOEING;APPLE"))
    put("20240116.zip", "")
    assert run() == 1
    first = [("20240115.zip", "APPLE", 2, 0), ("20240115.zip", "BOEING", 1, 0), ("20240116.zip", None, None, 0)]
    assert held() == first
    assert run() == 0 and held() == first  # nothing new
    put("20240117.zip", fixed(orgs="CISCO"))
    (tmp_path / "in" / "notes.txt").write_text("no archive")
    assert run() == 1 and held() == [*first, ("20240117.zip", "CISCO", 1, 1)]
    assert sorted(map(tuple, ingest.ingested(spark, cache, SCHEMA, "ticker").collect())) == [(f, t, n) for f, t, n, _ in held() if t]


def test_ingest_after_a_cut(spark, tmp_path):
    folder, cache, progress = (f"{tmp_path}/{n}" for n in ("in", "cache", "progress"))
    (tmp_path / "in").mkdir()
    for d in range(10, 16):
        (tmp_path / "in" / f"202401{d}.zip").write_bytes(zipped(fixed(orgs=f"NAME{d}")))
    calls = []

    def failing(files_):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("cut off")
        return parse(files_)

    with pytest.raises(Exception, match="cut off"):
        ingest.ingest_files(spark, folder, cache, progress, failing, SCHEMA, files_per_batch=2)
    assert ingest.cached_files(spark, cache, SCHEMA).count() == 2
    # a batch whose rows were written but whose end wasn't noted is written over
    spark.createDataFrame([("20240112.zip", "WRONG", 9)], SCHEMA).write.parquet(f"{cache}/batch=1")
    assert ingest.ingest_files(spark, folder, cache, progress, parse, SCHEMA, files_per_batch=2) == 2
    rows = sorted((r.file, r.ticker, r.mention_count) for r in ingest.cached_files(spark, cache, SCHEMA).collect())
    assert rows == [(f"202401{d}.zip", f"NAME{d}", 1) for d in range(10, 16)]
    # progress that was lost adds nothing that the cache holds
    (tmp_path / "in" / "20240120.zip").write_bytes(zipped(fixed(orgs="LATE")))
    ingest.ingest_files(spark, folder, cache, progress + "2", parse, SCHEMA, files_per_batch=100)
    assert ingest.ingested(spark, cache, SCHEMA, "ticker").count() == 7


def test_index_files_with_their_own_headers(spark, tmp_path):
    a = ["Description: x", "", "  Form Type   Company Name     CIK    Date Filed  Filename", "---", "8-K           A  B   CO        320193 2024-01-25  edgar/a.txt", "8-K           C                x      2024-01-25  e", "8-K           D                12     soon        e", "8-K/A         D                12     2024-01-26  e", "8-K"]
    b = ["Form Type Company Name CIK        Date Filed File Name", "8-K       PROCTER  &   0000080424 3/5/2024   edgar/b.txt", "Form Type", "10-K      X            1          2024-01-01 e"]
    for name, lines in (("a.idx", a), ("b.idx", b)):
        (tmp_path / name).write_text("\n".join(lines))
    rows = text.index_rows(text.file_lines(spark, str(tmp_path))).collect()
    assert sorted((r.file[-5:], r.cik, str(r.filing_date)) for r in rows) == [("a.idx", "0000320193", "2024-01-25"), ("b.idx", "0000080424", "2024-03-05")]
    (tmp_path / "c.idx").write_text("8-K  no header\n")
    with pytest.raises(Exception, match="no header line in the filing index"):
        text.index_rows(text.file_lines(spark, str(tmp_path))).collect()


def test_rate_files_with_their_own_headers(spark, tmp_path):
    put = lambda name, *lines: (tmp_path / name).write_text("\n".join(lines))
    put("DGS10.csv", "DATE,DGS10", "2024-01-02,4.5", "2024-01-03,.", "bad,1", "1999-12-31,6.4")
    put("VIX.csv", "VIXCLS,observation_date", "13.2,2024-01-02", "NaN,2024-01-04")
    rates = tables.rate_files(text.file_lines(spark, str(tmp_path)))
    assert sorted(((r.series, str(r.date), r.value) for r in rates.collect()), key=str) == [("DGS10", "2024-01-02", 4.5), ("DGS10", "2024-01-03", None), ("VIX", "2024-01-02", 13.2), ("VIX", "2024-01-04", None)]
    assert {(str(r.date), r.DGS10, r.VIX) for r in tables.rate_series(rates, "DGS10", "VIX").collect()} == {("2024-01-02", 4.5, 13.2), ("2024-01-03", None, None), ("2024-01-04", None, None)}
    assert {str(r.date) for r in tables.rate_files(text.file_lines(spark, str(tmp_path)), None, "2024-01-02").collect()} == {"1999-12-31", "2024-01-02"}
    put("ODD.csv", "day,x", "2024-01-02,1")
    with pytest.raises(Exception, match="no date column"):
        tables.rate_files(text.file_lines(spark, str(tmp_path))).collect()


def test_pages_that_share_an_id(spark):
    page = lambda head, *cells: "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join(f"<tr><td>{'</td><td>'.join(c)}</td></tr>" for c in cells) + "</table>"
    changes = ["Date", "Added Ticker", "Removed Ticker"]
    rows = [(1, page(["Old symbols", "Symbol"], ["X", "A.B"])), (1, page(["Name", "The symbol"], ["n", "C"])), (None, page(["Z"], ["Q"])), (2, None), (3, "<p>no table")]
    found = html.html_tables(spark.createDataFrame(rows, "id int, html string"), "id", "html")
    assert sorted(((r.id, r.ticker) for r in html.current_members(found, "id").collect()), key=str) == [(1, "A-B"), (1, "C"), (None, "Q")]
    spelled = ["January 5, 2024", "Jan 5, 2024", "2024-01-05", "1/5/2024", "5 January 2024", "20240105", "2024-01-05 00:00:00"]
    two = page(["x"], ["y"]) + page(changes, *[[d, "A.B", ""] for d in spelled], ["no date", "C", "D"])
    got = html.index_changes(html.html_tables(spark.createDataFrame([(7, two)], "id int, html string"), "id", "html"), "id").collect()
    assert [(str(r.date), r.added, r.removed) for r in got] == [("2024-01-05", "A-B", None)] * len(spelled)
    tall = '<table><tr><th>a<th>b</tr><tr><td rowspan="1500">s<td>0</tr>' + "".join(f"<tr><td>{k}</td></tr>" for k in range(1, 1500)) + "</table>"
    cells = html.html_tables(spark.createDataFrame([(1, tall)], "id int, html string"), "id", "html").where("not header").collect()
    assert len(cells) == 1500 and all(r.cells == ["s", str(r.line - 1)] for r in cells)


def test_dates_and_buckets(spark):
    df = spark.createDataFrame([("2024-1-5",), (" 2024/01/05 ",), ("13/40/2024",), ("",), (None,)], "t string")
    assert [str(r.d) for r in df.select(any_date(F.col("t")).alias("d")).collect()] == ["2024-01-05", "2024-01-05", "None", "None", "None"]
    assert spark.range(1).select(bucket_of(F.lit("abc")).alias("b")).first().b == 0xBA


@pytest.mark.parametrize("name", ["primary", "primary_pred", "primary_score", "realised", "realised_return", "fwd_return", "fwd_vs", "label", "Label", "fwd_5", "tb_label"])
def test_names_that_leak(name):
    with pytest.raises(ValueError):
        without_leaks(["date", "x", name])
    if name.startswith(("fwd_5", "tb_")):
        assert without_leaks(["date", "x", name], drop_labels=True) == ["date", "x"]
    else:
        with pytest.raises(ValueError):
            without_leaks(["date", "x", name], drop_labels=True)
    assert without_leaks(["date", "x", name], name) == ["date", "x", name]


def test_equity_by_hand(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(5)]
    daily = spark.createDataFrame([(days[0], None, 0.0), (days[1], 0.1, 1.0), (days[2], -9.0, 0.5), (days[3], 0.5, 0.0), (days[4], 0.0, 0.0)], "date date, net double, turnover double")
    bars = spark.createDataFrame([(DAY - dt.timedelta(days=1), 1.0), (days[0], 2.0), (days[1], None), (days[3], 4.0)], "date date, adj_close double")
    rows = serving.equity_curve(daily, bars).orderBy("date").collect()
    curve = [1.0, 1.1, 1.1 * -4, 1.1 * -4 * 1.5, 1.1 * -4 * 1.5]
    assert [r.daily_return for r in rows] == [0, 0.1, -5, 0.5, 0] and all(abs(r.cumulative_return - (c - 1)) < 1e-12 for r, c in zip(rows, curve))
    assert all(abs(r.drawdown - (c / max(curve[: k + 1]) - 1)) < 1e-12 for k, (r, c) in enumerate(zip(rows, curve)))
    assert [round(r.benchmark_return, 6) for r in rows] == [0, 0, 0, 0.693147, 0]
    assert {r.benchmark_return for r in serving.equity_curve(daily, bars.where("date < '2024-01-15'")).collect()} == {None}


def test_ticker_document(spark):
    facts = spark.createDataFrame([("A", 1.5), ("B", 2.0)], "ticker string, cap double")
    prices = spark.createDataFrame([(DAY + dt.timedelta(days=k), "A", float(k)) for k in (40, 3, 2, 30)], "date date, ticker string, close double")
    preds = spark.createDataFrame([(1, DAY + dt.timedelta(days=39), "A", 0.5), (2, DAY + dt.timedelta(days=39), "A", 0.7), (1, DAY, "A", 0.1)], "run_id int, date date, ticker string, score double")
    one = spark.createDataFrame([(1,)], "run_id int")
    row = serving.ticker_document(facts, prices, preds, one, "A", 20).first()
    assert (row.cap, [p.close for p in row.prices], [p.score for p in row.predictions]) == (1.5, [30.0, 40.0], [0.5])
    empty = serving.ticker_document(facts, prices, preds, one, "B", 20).first()
    assert empty.prices == [] and empty.predictions == [] and serving.ticker_document(facts, prices, preds, one, "C", 20).collect() == []


def test_best_trial_and_diffs(spark):
    rows = [(3, '{"hold_sharpe": 1.5, "k": 5, "error": null}'), (1, '{"hold_sharpe": 1.5, "trial": 1, "k": 7, "sizing": "hrp", "dev_sharpe": 9}'), (2, '{"hold_sharpe": -99}'), (4, '{"k": 1}'), (5, "broken")]
    best = serving.best_trial(spark.createDataFrame(rows, "trial int, row string")).first()
    assert (best.trial, best.best_sharpe, best.best_params) == (1, 1.5, {"k": "7", "sizing": "hrp"})
    assert serving.best_trial(spark.createDataFrame(rows[2:], "trial int, row string")).collect() == []
    a, b = (spark.createDataFrame([(x,)], "c string") for x in ('{"same": {"x": 1, "y": [1, 2]}, "n": 1.0, "t": "1", "gone": null, "l": [2, 1]}', '{"n": 1, "same": {"y":[1,2],"x":1}, "t": 1, "l": [1, 2], "new": true}'))
    assert sorted(map(tuple, serving.config_diff(a, b, "c").collect())) == [("gone", "null", None), ("l", "[2,1]", "[1,2]"), ("new", None, "true"), ("t", '"1"', "1")]


def test_synthetic_service(spark):
    prices = tables.synthetic_prices(spark, 13, 90)
    facts, preds, daily = tables.synthetic_facts(prices), tables.synthetic_predictions(prices), tables.synthetic_daily(prices)
    assert sorted(facts.collect()) == sorted(tables.synthetic_facts(prices.repartition(7)).collect()) and facts.count() == 13
    assert all(0.4 < r.beta < 1.9 and r.fifty_two_week_low < r.fifty_two_week_high for r in facts.collect())
    book = preds.groupBy("date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.count_if(F.col("side") == "long").alias("n")).collect()
    assert len(book) == 60 and all(abs(r.net) < 1e-12 and abs(r.gross - 2 * 0.5) < 1e-12 and r.n == 2 for r in book)
    curve = serving.equity_curve(daily, prices.where("ticker = 'T00000'"))
    assert curve.count() == 90 and curve.where("drawdown > 0 or benchmark_return is null").count() == 0


def test_texts_are_written_whole(spark, tmp_path):
    lines = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, None), ("b", 2, "x")], "file string, place int, value string")
    for _ in range(2):
        assert {r.file for r in files.write_texts(lines, f"file://{tmp_path}").collect()} == {"a", "b"}
    assert sorted((p.name, p.read_text()) for p in tmp_path.iterdir() if not p.name.startswith(".")) == [("a", "one\ntwo\n"), ("b", "x\n")]


def join_rows(df):
    """The most rows that a join of the executed plan gives."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        kind, metric = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        if kind.endswith("JoinExec") and metric.isDefined():
            most = max(most, metric.get().value())
        own = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        nodes += own + [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_lines_do_not_meet_tickers_of_several_names(spark):
    tickers = {f"T{k:02}": {"ACME", f"NAME {k}", *([f"OTHER {k}"] if k % 3 == 0 else [])} for k in range(40)}
    names = {}
    for t, own in tickers.items():
        for n in own:
            names.setdefault(n, []).append(t)
    lines = [(("ACME",) if i % 4 else ()) + (f"NAME {i % 45}",) * (i % 2) + (f"OTHER {i % 45}", "ZZZ") for i in range(200)]
    rows = tone.mention_rows(tone.split_lines(spark.createDataFrame([(fixed(count=str(i), orgs=";".join(o), value=str(i * i % 17)),) for i, o in enumerate(lines)], "value string")))
    found = tone.mentions(rows, spark.createDataFrame(sorted(names.items()), "name string, tickers array<string>"))
    got = {r.ticker: r for r in found.collect()}
    for t, own in tickers.items():
        ids = [i for i, o in enumerate(lines) if own & set(o)]
        values = [i * i % 17 for i in ids]
        assert (got[t].mention_count, got[t].article_count) == (len(ids), sum(ids))
        assert abs(got[t].tone_mean - statistics.mean(values)) < 1e-12 and abs(got[t].tone_std - statistics.pstdev(values)) < 1e-12
    assert join_rows(found) < 400  # and not 150 lines x 40 tickers


def test_archives_are_packed_batch_by_batch(spark, tmp_path):
    lines = spark.range(30000).selectExpr("id % 2 || '.csv.zip' AS file", "IF(id % 2 = 0, 'head', NULL) AS header", "-id AS place", "'line ' || id AS value")
    assert {r.file for r in tone.write_archives(lines, f"file://{tmp_path}").collect()} == {"0.csv.zip", "1.csv.zip"}
    for k in (0, 1):
        with zipfile.ZipFile(tmp_path / f"{k}.csv.zip") as z:
            assert z.infolist()[0].compress_size < z.infolist()[0].file_size / 2
            assert z.read(f"{k}.csv").decode().split("\n") == ["head"] * (not k) + [f"line {i}" for i in range(29998 + k, -1, -2)] + [""]


def test_ingested_rows_stay_where_they_are(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "20240115.zip").write_bytes(zipped(fixed(orgs=";".join(f"NAME{k}" for k in range(30)))))
    (tmp_path / "in" / "20240116.zip").write_bytes(zipped(""))
    ingest.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/cache", f"{tmp_path}/progress", lambda f: parse(f).repartition(3), SCHEMA)
    rows = ingest.cached_files(spark, f"{tmp_path}/cache", SCHEMA).withColumn("part", F.input_file_name()).collect()
    assert sum(r.ticker is None for r in rows) == 1 and len(rows) == 31
    assert len({r.part for r in rows if r.ticker}) == 3  # and not dealt anew by file


def test_merged_files_keep_sums_alone(spark):
    parts = [(DAY, f"T{k}", n, 2 * n, m, s) for k in range(3) for n, m, s in ((5, 0.1 + k, 0.0), (7, 0.1 + k, 0.0), (1, 0.1 + k + (k == 2), 0.5 * k))]
    found = tone.merged(spark.createDataFrame(parts, "date date, ticker string, mention_count long, article_count long, tone_mean double, tone_std double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r.ticker: r for r in found.collect()}
    assert got["T0"].tone_std == 0 and {r.mention_count for r in got.values()} == {13} and {r.article_count for r in got.values()} == {26}
    assert abs(got["T1"].tone_std - (0.25 / 13) ** 0.5) < 1e-12
    mean = 2.1 + 1 / 13
    assert abs(got["T2"].tone_mean - mean) < 1e-12 and abs(got["T2"].tone_std - ((12 * (2.1 - mean) ** 2 + (3.1 - mean) ** 2 + 1) / 13) ** 0.5) < 1e-12


def test_no_task_holds_a_whole_text(spark, tmp_path):
    lines = spark.range(25000).selectExpr("'a' AS file", "-id AS place", "'line ' || id AS value")
    assert "FlatMapGroups" not in files.write_texts(lines, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    files.write_groups(lines, f"file://{tmp_path}", lambda out, name, own: out.write(str(max(b.num_rows for b in own)).encode()), "file", "place").collect()
    assert int((tmp_path / "a").read_text()) <= 10000


def test_headers_are_read_once_a_file_and_lines_stay_where_they_are(spark, tmp_path):
    head = "Form Type Company Name CIK        Date Filed File Name"
    (tmp_path / "a.idx").write_text("\n".join(["x", head, "8-K       A  &  B      12         2024-03-05 e", "8-K       C            7          3/6/2024   e"]))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for files of any size
    try:
        rows = text.index_rows(text.file_lines(spark, str(tmp_path)))
        assert sorted((r.cik, str(r.filing_date)) for r in rows.collect()) == [("0000000007", "2024-03-06"), ("0000000012", "2024-03-05")]
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan
        for_lines = plan[: plan.index("FileScan")]  # what lines go through, down to where they are read
        assert "BroadcastHashJoin" in for_lines and "locate(" not in for_lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    lines = spark.createDataFrame([(head, "8-K       A  &  B      12         2024-03-05 e")], "header string, value string")
    assert text.fixed_width(lines, *text.INDEX_FIELDS).drop("header", "value").collect() == [("8-K", "A  &  B", "12", "2024-03-05")]
    (tmp_path / "b.idx").write_text("Form Type CIK\n8-K       1\n")
    with pytest.raises(Exception, match="no header of these fields"):
        text.index_rows(text.file_lines(spark, str(tmp_path))).collect()
