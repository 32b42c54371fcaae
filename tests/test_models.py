"""Fitted models, gates and parity books against plain numpy and pandas on small panels."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, hierarchy, models, xsection

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """24 names x 60 days: y follows x1, x2 has gaps, x3 is empty, the score is right where x1 is large."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        for j in range(24):
            x1, x2 = rng.normal(), rng.normal()
            y = 0.5 * x1 - 0.2 * x2 + rng.normal() * 0.1
            right = x1 > 0 if rng.random() < 0.9 else x1 <= 0
            rows.append((DAY + dt.timedelta(days=i), f"T{j:02}", "AB"[j % 2] if j < 20 else "C" if j < 22 else None, float(x1), None if rng.random() < 0.1 else float(x2), None, float(y) if rng.random() > 0.05 else None, float(np.sign(y) * (1 if right else -1))))
    return spark.createDataFrame(rows, "date date, ticker string, sector string, x1 double, x2 double, x3 double, y double, score double").cache()


def test_folds_by_hand(spark):
    dates = [DAY + dt.timedelta(days=i) for i in range(100)]
    df = spark.createDataFrame([(d, t) for d in dates for t in "ab"], "date date, ticker string")
    got = lambda *a, **k: sorted(map(tuple, models.folds_table(df, *a, **k).collect()))
    assert got(DAY + dt.timedelta(days=30), months=1, embargo=5, least=20) == [(0, dates[0], dates[25], dates[31], dates[59], 26, 29), (1, dates[0], dates[54], dates[60], dates[90], 55, 31), (2, dates[0], dates[85], dates[91], dates[99], 86, 9)]
    assert got(dates[-1]) == [] and got(DAY, 1, 5, 1000) == [] and models.folds_table(df.limit(0), DAY).collect() == []
    assert [r[3:] for r in got(dates[49], days=20, embargo=3, least=1)] == [(dates[50], dates[69], 47, 20), (dates[70], dates[89], 67, 20), (dates[90], dates[99], 87, 10)]
    gaps = df.where((F.col("date") < F.lit(dates[40])) | (F.col("date") > F.lit(dates[75])))  # a test without dates is no fold
    assert [(r.fold, r.test_start, r.n_test) for r in models.folds_table(gaps, dates[39], days=15, embargo=0, least=1).collect()] == [(0, dates[70], 9), (1, dates[85], 15)]


@pytest.mark.parametrize("parts", [2, 7, 200])
def test_medians_up_to_each_end(spark, panel, parts):
    ends = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in (-1, 0, 17, 17, 40, 59, 99)], "end date")
    df = panel.withColumns({"flat": F.when(F.col("x1") > -2, 3.0), "few": F.round("x1", 1), "x3": F.lit(None).cast("double")})
    got = {r.end: r for r in xsection.medians_so_far(df, ["x1", "x2", "flat", "few", "x3"], ends, parts).collect()}
    pdf = df.toPandas()
    assert len(got) == 6
    for end, r in got.items():
        own = pdf[pdf["date"] <= end]
        for c in ("x1", "x2", "flat", "few", "x3"):
            want = own[c].astype(float).median()
            assert (getattr(r, c) is None) if want != want else abs(getattr(r, c) - want) < 1e-12


def test_premia_of_all_folds_are_one_plan(panel):
    folds = models.folds_table(panel, DAY + dt.timedelta(days=20), 1, 3, 10).cache()
    xs = ["x1", "x2", "x3"]
    got = {(r.fold, r.date, r.ticker): r.score for r in models.premia_folds(panel, folds, xs, "y").collect()}
    want = {}
    for f in folds.collect():
        train, test = panel.where(F.col("date") <= F.lit(f.train_end)), panel.where(F.col("date").between(f.test_start, f.test_end))
        want |= {(f.fold, r.date, r.ticker): r.score for r in models.fama_macbeth(train, test, xs, "y").collect()}
    assert got.keys() == want.keys() and len(got) > 500 and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_split_covers_tests_once_and_never_trains_on_them(panel):
    parts = models.split_rows(panel.select("date", "ticker"), models.folds_table(panel, DAY + dt.timedelta(days=30), 1, 3, 10))
    tested = parts.where("part = 'test'")
    assert tested.count() == tested.select("date", "ticker").distinct().count() == 29 * 24
    by = parts.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("date"))).alias("a"), F.min(F.when(F.col("part") == "test", F.col("date"))).alias("b"))
    assert all((r.b - r.a).days > 3 for r in by.collect())


def test_premia_as_numpy(panel):
    got = {r.date: (r.x1, r.x2, r.x3) for r in models.premia_by_date(panel, ["x1", "x2", "x3"], "y").collect()}
    pdf = panel.toPandas()
    for d, g in pdf.groupby("date"):
        x = g[["x1", "x2"]].astype(float)
        x = x.fillna(x.median()).to_numpy()[g["y"].notna()]
        y = g["y"].dropna().to_numpy()
        slopes = np.linalg.solve(x.T @ x + 1e-4 * np.eye(2), x.T @ y)
        assert np.allclose(got[d], [*slopes, 0.0])
    scores = models.fama_macbeth(panel, panel, ["x1", "x2", "x3"], "y", 0.5).toPandas().merge(pdf, on=["date", "ticker"])
    mean = np.mean(list(got.values()), axis=0) * 0.5
    assert np.allclose(scores["score_x"], scores["x1"] * mean[0] + scores["x2"].fillna(pdf["x2"].median()) * mean[1])
    none = models.fama_macbeth(panel.where("date < '2000-01-01'"), panel, ["x1"], "y")
    assert none.where("score <> 0").count() == 0 and none.count() == 60 * 24


def test_logistic_finds_the_signal_and_needs_two_classes(panel):
    df = panel.withColumn("up", (F.col("y") > 0).cast("int"))
    for fit in (models.logistic, models.boosted):
        got = fit(df.where("date < '2020-02-10'"), df.where("date >= '2020-02-10'").drop("score"), ["x1", "x2", "x3"], "up")
        pdf = got.join(df.drop("score"), ["date", "ticker"]).where("up is not null").toPandas()
        assert len(pdf) > 400 and pdf["score"].between(0, 1).all() and ((pdf["score"] > 0.5) == (pdf["up"] == 1)).mean() > 0.85
        one = fit(df.where("up = 1"), df, ["x1"], "up")
        assert one.where("score is not null").count() == 0 and one.count() == 60 * 24
        assert fit(df, df, ["x3"], "up").where("score is not null").count() == 0


def test_meta_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (0.0, 1.0), (1.0, 0.0), (None, 1.0), (1.0, None)], "score double, realised double")
    assert [(r.score, r.hit, r.primary_abs) for r in models.meta_rows(df).collect()] == [(1.0, 1, 1.0), (-1.0, 0, 1.0), (0.0, 0, 0.0)]
    with pytest.raises(ValueError, match="leak"):
        models.meta_rows(df.withColumn("fwd_return_1", F.lit(1)))


def test_gates(panel):
    df = panel.withColumnRenamed("y", "realised")
    pdf = models.meta_gate(df, ["x1", "x2"], slices=2).toPandas().merge(panel.toPandas(), on=["date", "ticker"])
    early = pdf["date"] < DAY + dt.timedelta(days=30)
    assert len(pdf) == 60 * 24 and pdf[early]["gate"].isna().all() and (pdf[early]["score_x"] == pdf[early]["score_y"]).all()
    late = pdf[~early]
    assert late["gate"].notna().all() and ((late["score_x"] == 0) == (late["gate"] < 0.5)).all()
    known = late[late["y"].notna()]
    right = np.sign(known["score_y"]) == np.sign(known["y"])
    assert right[known["score_x"] != 0].mean() > right.mean() + 0.2
    by = models.sector_gate(df, ["x1"], slices=1, model="logistic").toPandas().merge(panel.toPandas(), on=["date", "ticker"])
    assert len(by) == 60 * 24 and by[by["sector"].isna() | (by["sector"] == "C")]["gate"].isna().all() and by[by["sector"] == "A"]["gate"].notna().any()
    assert models.sector_gate(df.limit(0), ["x1"]).count() == 0
    with pytest.raises(ValueError, match="gate"):
        models.meta_gate(df, ["x1"], mode="other", model="logistic")


def test_walk_forward_scores_on_no_folds(panel):
    none = models.folds_table(panel.limit(0), DAY)
    assert models.walk_forward_scores(panel, none, ["x1"], "y").count() == 0
    with pytest.raises(ValueError, match="model"):
        models.walk_forward_scores(panel, none, ["x1"], "y", "other")


def test_verdicts(spark):
    df = spark.createDataFrame([(1.0, 0.6), (1.0, 0.3), (1.0, 0.1), (1.0, -0.9), (None, 1.0)], "a double, b double")
    assert [r.v for r in df.select(models.leak_verdict("a", "b").alias("v")).collect()] == ["OK", "PARTIAL", "SUSPECT", "PARTIAL", None]


def test_parameter_grid_keeps_failures(spark):
    def run(a, b):
        if a == 2:
            raise ValueError("no two")
        return spark.createDataFrame([(a * b,)], "c double")

    got = evaluation.parameter_grid({"a": [1, 2], "b": [0.5, 1.5]}, run).orderBy("a", "b").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, 0.5, None), (1, 1.5, 1.5, None), (2, 0.5, None, "no two"), (2, 1.5, None, "no two")]


def test_shrinkage_by_its_definition():
    x = np.random.default_rng(5).normal(size=(40, 6)) * [1, 2, 3, 1, 1, 5]
    c = x - x.mean(axis=0)
    s = c.T @ c / 40
    target = np.trace(s) / 6 * np.eye(6)
    noise = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in c]) / 40
    share = min(1.0, noise / ((s - target) ** 2).sum())
    assert np.allclose(hierarchy.shrunk_covariance(x), (1 - share) * s + share * target)


def all_pairs_order(distance):
    """Clusters merge along all pairs in the order of their distance, then their places."""
    n = len(distance)
    members, cluster = {i: [i] for i in range(n)}, list(range(n))
    pairs = sorted(((distance[a, b] if distance[a, b] == distance[a, b] else np.inf), a, b) for a in range(n) for b in range(a + 1, n))
    for _, a, b in pairs:
        old, new = sorted((cluster[a], cluster[b]))
        if old != new:
            at = max(members) + 1
            members[at] = members.pop(old) + members.pop(new)
            for name in members[at]:
                cluster[name] = at
    return members[max(members)]


@pytest.mark.parametrize("values", [2, 4, 50, 0])
def test_cluster_order_as_over_all_pairs(values):
    rng = np.random.default_rng(8 + values)
    for n in (1, 2, 3, 9, 20, 41):
        for _ in range(6):
            d = rng.integers(0, values, (n, n)) / 8.0 if values else rng.random((n, n))
            d = np.triu(d, 1) + np.triu(d, 1).T
            if values == 4:
                d[rng.random((n, n)) < 0.1] = np.nan
                d = np.triu(d, 1) + np.triu(d, 1).T
            assert hierarchy.cluster_order(d) == all_pairs_order(d)


def test_parity_weights():
    assert np.allclose(hierarchy.parity_weights(np.diag([1.0, 4.0])), [0.8, 0.2])
    assert np.allclose(hierarchy.parity_weights(np.zeros((4, 4))), 0.25)
    assert hierarchy.parity_weights(np.ones((1, 1))).tolist() == [1.0]
    twins = np.array([[1, 0.99, 0], [0.99, 1, 0], [0, 0, 1.0]])
    w = hierarchy.parity_weights(twins)
    assert abs(w.sum() - 1) < 1e-12 and w[2] > 0.45 and (w > 0).all()


def test_parity_book_as_a_loop(spark):
    rng = np.random.default_rng(9)
    days = [DAY + dt.timedelta(days=i) for i in range(30)]
    names = [f"N{i}" for i in range(12)]
    rows = [(d, n, float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal() * 0.01)) for d in days for n in names if rng.random() > 0.05]
    df = spark.createDataFrame(rows, "date date, ticker string, score double, r double")
    got = {(r.date, r.ticker): r.weight for r in hierarchy.parity_book(df, df.select("date", "ticker", "r"), share=0.34, days=8).collect()}
    pdf = df.toPandas()
    wide = pdf.pivot(index="date", columns="ticker", values="r").reindex(days)
    expected = {}
    for d, g in pdf.groupby("date"):
        past = wide[wide.index < d].tail(8)
        g = g.sort_values(["score", "ticker"])
        k = max(1, min(int(len(g) * 0.34), len(g) // 2))
        for sign, side in ((-1, g.head(k)), (1, g.tail(k))):
            own = sorted(side["ticker"])
            if len(past):
                for n, w in zip(own, hierarchy.side_weights(past[own].to_numpy(float).T), strict=True):
                    if w == w:
                        expected[d, n] = sign * w
    assert got.keys() == expected.keys() and len(got) > 150 and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    sides = pd.Series(got).groupby([pd.Series(got).index.get_level_values(0), np.sign(pd.Series(got))]).sum()
    assert np.allclose(sides.abs(), 1.0)
    assert hierarchy.parity_book(df.limit(0), df.select("date", "ticker", "r")).count() == 0


def test_noise_stops_the_trees_early(spark):
    rng = np.random.default_rng(4)
    noise = [(DAY + dt.timedelta(days=i), f"T{j}", float(rng.normal()), float(rng.integers(0, 2))) for i in range(60) for j in range(10)]
    signal = [(d, t, x, float(x > 0)) for d, t, x, _ in noise]
    kind = "date date, ticker string, x double, up double"
    kept = {}
    for name, rows in (("noise", noise), ("signal", signal)):
        df = spark.createDataFrame(rows, kind)
        test = df.where(F.col("date") >= F.lit(DAY + dt.timedelta(days=55)))
        got = models.boosted(df, test, ["x"], "up", trees=30).collect()
        assert len(got) == 50 and len({r.trees for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)
        kept[name] = got[0].trees
        assert models.boosted(df, test, ["x"], "up", trees=5, tail=0).first().trees == models.boosted(df.limit(150), test, ["x"], "up", trees=5).first().trees == 5
    assert kept["noise"] < 15 < kept["signal"], kept


def test_gate_with_more_slices_than_dates(spark, panel):
    df = panel.where(F.col("date") < F.lit(DAY + dt.timedelta(days=20))).select("date", "ticker", "score", F.col("y").alias("realised"), "x1")
    n = df.count()
    rows = models.meta_gate(df, ["x1"], slices=12, threshold=0.0, model="logistic").collect()
    was = {(r.date, r.ticker): r.score for r in df.collect()}
    assert len(rows) == n and all(was[r.date, r.ticker] == r.score for r in rows)  # a threshold of 0 keeps everything
    assert sum(r.gate is not None for r in rows) > n / 3


def ic_ir(pdf, score, r):
    ics = pdf.dropna(subset=[score, r]).groupby("date").apply(lambda g: g[score].rank().corr(g[r].rank()) if len(g) >= 5 else np.nan, include_groups=False).dropna()
    return ics.mean() / ics.std() * 252**0.5


def test_feature_audits_as_pandas(spark, panel):
    df = panel.withColumn("y2", F.col("y") * 0.5 + F.col("x1") * F.col("x1"))
    pdf = df.toPandas().sort_values(["ticker", "date"])
    got = {(r.feature, r.horizon): r for r in models.feature_audits(df, ["x1", "x2"], ["y", "y2"]).collect()}
    assert len(got) == 4
    for (x, y), r in got.items():
        pdf["old"] = pdf.groupby("ticker")[x].shift(1)
        a, b = ic_ir(pdf, x, y), ic_ir(pdf, "old", y)
        assert abs(r.as_is - a) < 1e-9 and abs(r.shifted - b) < 1e-9 and abs(r.delta - (b - a)) < 1e-9
        assert r.pct_drop is None if abs(a) < 0.05 else abs(r.pct_drop + (b - a) / abs(a) * 100) < 1e-6
    assert got["x1", "y"].verdict == "SUSPECT"


def test_retrained_audits_as_single_runs(spark, panel):
    folds = models.folds_table(panel, DAY + dt.timedelta(days=20), 1, 3, 10).cache()
    got = {r.feature: r for r in models.retrained_audits(panel, folds, ["x1", "x2"], "y").collect()}
    truth = panel.select("date", "ticker", "y").toPandas()
    run = lambda df: ic_ir(models.walk_forward_scores(df, folds, ["x1", "x2"], "y").toPandas().merge(truth, on=["date", "ticker"]), "score", "y")
    base = run(panel)
    for x in ("x1", "x2"):
        pdf = panel.select("date", "ticker", "x1", "x2", "y").toPandas().sort_values(["ticker", "date"])
        pdf[x] = pdf.groupby("ticker")[x].shift(1)
        pdf = pdf.dropna(subset=[x]).astype(object).where(lambda d: d.notna(), None)
        again = run(spark.createDataFrame(pdf, "date date, ticker string, x1 double, x2 double, y double"))
        assert abs(got[x].as_is - base) < 1e-9 and abs(got[x].shifted - again) < 1e-9
    assert got["x1"].pct_drop > 50


def test_grid_with_base_arguments_is_one_plan(spark):
    seen = []

    def run(scale, a):
        seen.append(a)
        return spark.range(a).agg((F.count(F.lit(1)) * scale).alias("n"))

    df = evaluation.parameter_grid({"a": [3, 5]}, run, {"scale": 10})
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(3, 30, None), (5, 50, None)] and seen == [3, 5]


def test_gates_and_folds_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), f"T{k}", f"S{k % 2}", float((d * 7 + k * 3) % 11 - 5), float((d * 5 + k) % 7 - 3), float(d * k % 13)) for d in range(30) for k in range(10)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, score double, realised double, x1 double").withColumn("x1", counted("x1"))
    assert len(models.sector_gate(df, ["x1"], slices=1, mode="confidence", model="logistic").collect()) == 300 and read.value == 300
    assert len(models.meta_gate(df, ["x1"], slices=2, model="logistic").collect()) == 300 and read.value == 600
    folds = models.folds_table(df.select("date"), dt.date(2020, 1, 20), least=5, days=5)
    up = df.select("date", "ticker", "x1", (F.col("realised") > 0).cast("int").alias("up"))
    assert models.walk_forward_scores(up, folds, ["x1"], "up", "logistic").count() == 100 and read.value == 900
