"""Fitted models over the long panel: folds, cross-sectional premia, a linear classifier, gates on a second model, audits.

Models are fitted by Spark ML or from per-date sums; a loop on the driver runs over folds or slices, a few dozen at most.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import without_leaks
from ..sources.files import held
from .evaluation import ic_by, information_coefficient
from .portfolio import confident, gated
from .timeaxis import shifted
from .xsection import medians_so_far

Fit = Callable[[DataFrame, DataFrame, list[str], str], DataFrame]


def folds_table(df: DataFrame, first: dt.date, months: int = 6, embargo: int = 5, least: int = 500, *, days: int | None = None) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end, n_train, n_test over df's distinct dates, one row a fold.

    A test starts a day after the end of the one before (first, for the first one) and lasts `months`, or `days`; training
    has all dates up to `embargo` dates before it. A fold counts with at least `least` of them and a date to test. Tests follow
    each other in a recursive table; the dates are one row, an array over the calendar.
    """
    spark = df.sparkSession
    line = df.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    length = f"date_add(test_end, {int(days)})" if days else f"date_sub(add_months(date_add(test_end, 1), {int(months)}), 1)"
    tests = spark.sql(
        f"""WITH RECURSIVE tests (test_start, test_end, hi) MAX RECURSION LEVEL 100000 AS (
         SELECT CAST(NULL AS DATE), DATE '{first}', array_max(dates) FROM {{line}}
         UNION ALL SELECT date_add(test_end, 1), least({length}, hi), hi FROM tests WHERE test_end < hi)
         SELECT test_start, test_end FROM tests WHERE test_start IS NOT NULL""",
        line=line,
    )
    both = tests.join(F.broadcast(line), F.lit(True))  # one row
    before = F.size(F.filter("dates", lambda d: d < F.col("test_start")))
    tested = F.size(F.filter("dates", lambda d: d.between(F.col("test_start"), F.col("test_end"))))
    sized = both.withColumns({"n_train": F.greatest(before - embargo, F.lit(0)).cast("long"), "n_test": tested.cast("long")}).where(f"n_train >= {max(least, 1)} and n_test > 0")
    fold = (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("test_start")) - 1).alias("fold")  # one row a fold
    return sized.select(fold, F.col("dates")[0].alias("train_start"), F.element_at("dates", F.col("n_train").cast("int")).alias("train_end"), "test_start", "test_end", "n_train", "n_test")


def split_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """df's rows by fold and part, train or test: a row is in every fold that trains or tests on it."""
    own = F.array_compact(F.array(F.when(F.expr("date <= train_end"), F.lit("train")), F.when(F.expr("date between test_start and test_end"), F.lit("test"))))
    both = df.join(F.broadcast(folds), F.expr("date <= train_end or date between test_start and test_end"))  # a row for each fold
    return both.select("fold", *df.columns, F.explode(own).alias("part"))


def premia_by_date(df: DataFrame, xs: list[str], y: str, ridge: float = 1e-4, least: int = 10) -> DataFrame:
    """date and a slope for each of xs: ridge regression of y through the origin over the date's rows.

    Missing x take their date's median, and a column without values on the date gets slope 0. A date needs `least` rows
    with y. Products are summed by date before any row is solved, so what is solved is one small matrix a date.
    """
    own = W.partitionBy("date")
    filled = df.select("date", y, *[F.coalesce(F.col(x).cast("double"), F.median(x).over(own), F.lit(0.0)).alias(x) for x in xs]).where(F.col(y).isNotNull())
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)] + [F.sum(F.col(a) * F.col(y)).alias(f"t{i}") for i, a in enumerate(xs)]
    daily = filled.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)
    k = len(xs)
    at = {pair: i for i, pair in enumerate(pairs)}
    places = [at.get((a, b), at.get((b, a))) for a in xs for b in xs]

    def solve(batches):
        for b in batches:
            left = b[[f"s{i}" for i in places]].to_numpy(float).reshape(-1, k, k) + ridge * np.eye(k)
            right = b[[f"t{i}" for i in range(k)]].to_numpy(float)[:, :, None]
            out = pd.DataFrame(np.linalg.solve(left, right)[:, :, 0], columns=xs)
            yield out.assign(date=b["date"].to_numpy())[["date", *xs]]

    return daily.mapInPandas(solve, "date date, " + ", ".join(f"`{x}` double" for x in xs))


def fama_macbeth(train: DataFrame, test: DataFrame, xs: list[str], y: str, shrinkage: float = 0.0) -> DataFrame:
    """date, ticker, score of test: its columns times the mean of train's daily slopes, less the share `shrinkage`.

    Missing x of test take train's median (0 without one). Without a usable training date every score is 0.
    """
    end = train.agg(F.max("date").alias("end"))
    mean = premia_by_date(train, xs, y).agg(*[F.avg(x).alias(f"_b_{x}") for x in xs])
    both = test.join(F.broadcast(mean), F.lit(True)).join(F.broadcast(medians_so_far(train, xs, end).toDF("_end", *[f"_m_{x}" for x in xs])), F.lit(True), "left")  # one row each
    return both.select("date", "ticker", _premium_score(xs, shrinkage).alias("score"))


def _premium_score(xs: list[str], shrinkage: float) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(x), F.col(f"_m_{x}"), F.lit(0.0)) * F.coalesce(F.col(f"_b_{x}") * (1 - shrinkage), F.lit(0.0)) for x in xs])


def premia_folds(df: DataFrame, folds: DataFrame, xs: list[str], y: str, shrinkage: float = 0.0) -> DataFrame:
    """fold, date, ticker, score: fama_macbeth of every fold in one plan, however many folds and columns there are.

    Daily slopes are computed once; their running means by date are read at each fold's training end, and so are the medians
    (see medians_so_far). Test rows of each fold join both, one row a fold.
    """
    slopes = premia_by_date(df, xs, y).select("date", F.lit(None).cast("int").alias("fold"), *xs)
    marks = folds.select(F.col("train_end").alias("date"), "fold", *[F.lit(None).cast("double").alias(x) for x in xs])
    so_far = W.partitionBy(F.lit(0)).orderBy("date").rangeBetween(W.unboundedPreceding, 0)  # one row a date, and one a fold
    premia = slopes.unionByName(marks).select("fold", *[F.avg(x).over(so_far).alias(f"_b_{x}") for x in xs]).where("fold is not null")
    medians = medians_so_far(df, xs, folds.select(F.col("train_end").alias("end"))).toDF("train_end", *[f"_m_{x}" for x in xs])
    known = folds.select("fold", "train_end", "test_start", "test_end").join(premia, "fold").join(medians, "train_end", "left")
    tested = df.join(F.broadcast(known), F.col("date").between(F.col("test_start"), F.col("test_end")))  # a row for each fold
    return tested.select("fold", "date", "ticker", _premium_score(xs, shrinkage).alias("score"))


def _assembled(train: DataFrame, test: DataFrame, xs: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with a vector of xs, gaps at train's medians; columns without values in train go. None without columns."""
    seen = train.agg(*[F.count(x).alias(x) for x in xs]).first()
    usable = [x for x in xs if seen[x]]
    if not usable:
        return None
    doubles = lambda df: df.withColumns({f"_x{i}": F.col(x).cast("double") for i, x in enumerate(usable)})
    names = [f"_x{i}" for i in range(len(usable))]
    imputer = Imputer(inputCols=names, outputCols=[f"{n}f" for n in names], strategy="median", relativeError=1e-4).fit(doubles(train))
    vector = VectorAssembler(inputCols=[f"{n}f" for n in names], outputCol="_v")
    return tuple(vector.transform(imputer.transform(doubles(df))).drop(*names, *[f"{n}f" for n in names]) for df in (train, test))


def _classes(train: DataFrame, y: str) -> tuple[int, int]:
    """How many rows have y, and how many values it has (2 at most are counted)."""
    found = train.where(F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("a"), F.max(y).alias("b")).first()
    return found.n, 0 if not found.n else 1 if found.a == found.b else 2


def _unscored(test: DataFrame) -> DataFrame:
    return test.select("date", "ticker", F.lit(None).cast("double").alias("score"))


def logistic(train: DataFrame, test: DataFrame, xs: list[str], y: str) -> DataFrame:
    """date, ticker, score: probability of y = 1 by logistic regression with an L2 penalty, on standardised columns.

    Training rows without y go. Scores are NULL where train has one class only or no usable column.
    """
    train = train.where(F.col(y).isNotNull())
    n, classes = _classes(train, y)
    sides = _assembled(train, test, xs) if classes == 2 else None
    if sides is None:
        return _unscored(test)
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True).fit(sides[0])
    model = LogisticRegression(featuresCol="_z", labelCol=y, regParam=1 / n, elasticNetParam=0.0, standardization=False, probabilityCol="_p")
    fitted = model.fit(scaler.transform(sides[0]).withColumn(y, F.col(y).cast("double")))
    return fitted.transform(scaler.transform(sides[1])).select("date", "ticker", vector_to_array("_p")[1].alias("score"))


def boosted(train: DataFrame, test: DataFrame, xs: list[str], y: str, trees: int = 20, depth: int = 4, seed: int = 7, tail: float = 0.1, least: int = 200, patience: float = 0.01) -> DataFrame:
    """date, ticker, score, trees: probability of y = 1 by gradient-boosted trees, and how many trees were kept; NULL where logistic gives NULL.

    The last share `tail` of the training dates isn't trained on: trees are added until its error falls by less than
    `patience` of itself, at most `trees`. With fewer than `least` training rows, or no tail, all rows train and all trees stay.
    """
    train = train.where(F.col(y).isNotNull())
    n, classes = _classes(train, y)
    sides = _assembled(train, test, xs) if classes == 2 else None
    if sides is None:
        return _unscored(test).withColumn("trees", F.lit(None).cast("int"))
    model = GBTClassifier(featuresCol="_v", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    rows = sides[0].withColumn(y, F.col(y).cast("double"))
    if n >= least and tail > 0:
        days = F.sort_array(F.collect_set("date"))
        cut = train.agg(F.element_at(days, (F.floor(F.size(days) * (1 - tail)) + 1).cast("int")).alias("_cut"))
        rows = rows.join(F.broadcast(cut), F.lit(True)).withColumn("_tail", F.coalesce(F.col("date") >= F.col("_cut"), F.lit(False)))  # one row
        model = model.setValidationIndicatorCol("_tail").setParams(validationTol=patience)
    fitted = model.fit(rows)
    return fitted.transform(sides[1]).select("date", "ticker", vector_to_array("probability")[1].alias("score"), F.lit(fitted.getNumTrees).alias("trees"))


MODELS: dict[str, Fit] = {"logistic": logistic, "fama_macbeth": fama_macbeth, "boosted": boosted}


def walk_forward_scores(df: DataFrame, folds: DataFrame, xs: list[str], y: str, model: str = "fama_macbeth") -> DataFrame:
    """fold, date, ticker, score out of sample: the model fitted on each fold's training rows scores its test rows (boosted trees: and trees).

    Premia are one plan for all folds. Other models are fitted one fold after the other, a few dozen at most, on rows that are
    written once; what fails raises.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model!r}")
    if model == "fama_macbeth":
        return premia_folds(df, folds, xs, y)
    df, out = held(df.select("date", "ticker", *xs, y), "folds"), []
    for f in folds.orderBy("fold").collect():
        train, test = df.where(F.col("date") <= F.lit(f.train_end)), df.where(F.col("date").between(f.test_start, f.test_end))
        out.append(MODELS[model](train, test, xs, y).withColumn("fold", F.lit(f.fold)))
    none = df.sparkSession.createDataFrame([], "date date, ticker string, score double, fold int")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out, none)
    return found.select("fold", "date", "ticker", "score", *[c for c in ("trees",) if c in found.columns])


def meta_rows(df: DataFrame, score: str = "score", realised: str = "realised") -> DataFrame:
    """df's rows with a score and a realised return other than 0, with hit (1 where their signs agree) and primary_abs. Other columns
    are features; a name that would leak is an error (see without_leaks)."""
    without_leaks(df.columns, score, realised)
    known = df.where(F.col(score).isNotNull() & (F.col(realised) != 0))
    return known.withColumns({"hit": (F.signum(score) == F.signum(realised)).cast("int"), "primary_abs": F.abs(score)})


def _weighed(probability: str, mode: str, threshold: float, floor: float, cap: float) -> Column:
    if mode not in ("binary", "confidence"):
        raise ValueError(f"unknown gate: {mode!r}")
    return gated("score", probability, threshold) if mode == "binary" else confident("score", probability, floor, cap)


def meta_gate(df: DataFrame, xs: list[str], *, slices: int = 3, mode: str = "binary", threshold: float = 0.5, floor: float = 0.4, cap: float = 0.85, model: str = "boosted", written: bool = False) -> DataFrame:
    """date, ticker, score, gate of df (date, ticker, score, realised, xs): scores gated by a model of when they are right.

    The first half of the dates passes as it is (gate NULL); the rest is cut into `slices` equal runs of dates, the last
    one with what remains, each gated by a model of all dates before it. A slice whose past has one class passes as well, and
    with more slices than dates the last ones are empty. df is written once, as each model reads it many times; not so if the caller
    says that it is a written table (written).
    """
    df = df if written else held(df.select("date", "ticker", "score", "realised", *xs), "gate")
    dates = [r.date for r in df.select("date").distinct().orderBy("date").collect()]  # bounded by the calendar
    half = max(1, len(dates) // 2)
    step = max(1, (len(dates) - half) // slices)
    passed = lambda part: part.select("date", "ticker", "score", F.lit(None).cast("double").alias("gate"))
    if len(dates) < 20:
        return passed(df)
    out = [passed(df.where(F.col("date") < F.lit(dates[half])))]
    for k in range(slices):
        low = half + k * step
        high = low + step if k < slices - 1 else len(dates)
        if low >= len(dates):
            break
        part = df.where(F.col("date").between(dates[low], dates[high - 1]))
        known = meta_rows(df.where(F.col("date") < F.lit(dates[low])).select("date", "ticker", "score", "realised", *xs))
        found = MODELS[model](known, part.withColumn("primary_abs", F.abs("score")), [*xs, "primary_abs"], "hit").withColumnRenamed("score", "gate")
        both = part.join(found, ["date", "ticker"], "left")
        own = F.when(F.col("gate").isNull(), F.col("score")).otherwise(_weighed("gate", mode, threshold, floor, cap))
        out.append(both.select("date", "ticker", own.alias("score"), "gate"))
    return reduce(DataFrame.unionByName, out)


def sector_gate(df: DataFrame, xs: list[str], *, least: int = 5, pooled: str = "__OTHER__", **how) -> DataFrame:
    """meta_gate for each sector by itself; rows without a sector are one, and a sector under `least` tickers passes as it is.

    Sectors are few (a loop on the driver), each with its own model; at most 64, more raise. df is written once for all of them.
    """
    df = held(df.select("date", "ticker", F.coalesce("sector", F.lit(pooled)).alias("sector"), "score", "realised", *xs), "gate")
    sizes = df.groupBy("sector").agg(F.countDistinct("ticker").alias("n")).orderBy("sector").limit(65).collect()
    if len(sizes) > 64:
        raise ValueError("more than 64 sectors")
    none = df.sparkSession.createDataFrame([], "date date, ticker string, score double, gate double")
    small = [r.sector for r in sizes if r.n < least]
    out = [none, df.where(F.col("sector").isin(small)).select("date", "ticker", "score", F.lit(None).cast("double").alias("gate"))]
    out += [meta_gate(df.where(F.col("sector") == r.sector), xs, written=True, **how) for r in sizes if r.n >= least]
    return reduce(DataFrame.unionByName, out)


# The share of a figure that has to stay, that below which it is gone, and a figure that is next to nothing.
_STAYS, _GONE, _NOTHING = 0.5, 0.25, 0.05


def leak_verdict(as_is: str, shifted: str) -> Column:
    """OK if the figure keeps its sign and over half its size on features a day older, SUSPECT if under a quarter remains,
    else PARTIAL; NULL where one is missing."""
    a, b = F.col(as_is), F.col(shifted)
    kept = (F.abs(b) > _STAYS * F.abs(a)) & (F.signum(a) == F.signum(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(kept, "OK").when(F.abs(b) < _GONE * F.abs(a), "SUSPECT").otherwise("PARTIAL"))


def _audited(found: DataFrame, *keys: str) -> DataFrame:
    """keys, as_is, shifted, delta, pct_drop, verdict from ic_ir by keys and `older`: what a day less of a feature costs. The share lost is NULL
    where there was next to nothing to lose."""
    own = lambda old: F.max(F.when(F.col("older") == old, F.col("ic_ir")))
    both = found.groupBy(*keys).agg(own(0).alias("as_is"), own(1).alias("shifted")).withColumn("delta", F.col("shifted") - F.col("as_is"))
    drop = F.when(F.abs("as_is") >= _NOTHING, -F.col("delta") / F.abs("as_is") * 100)
    return both.select(*keys, "as_is", "shifted", "delta", drop.alias("pct_drop"), leak_verdict("as_is", "shifted").alias("verdict"))


def feature_audits(df: DataFrame, xs: list[str], ys: list[str], days: int = 1) -> DataFrame:
    """feature, horizon, as_is, shifted, delta, pct_drop, verdict: the information ratio of each of xs with each of ys (returns of several
    horizons), and that of the feature as it was `days` rows before. All features and horizons are one plan."""
    old = shifted(df.select("date", "ticker", *xs), xs, days).withColumnsRenamed({x: f"_{x}" for x in xs})
    both = df.select("date", "ticker", *xs, *ys).join(old, ["date", "ticker"])
    features = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(k).alias("older"), F.col(c).cast("double").alias("score")) for x in xs for k, c in ((0, x), (1, f"_{x}"))]))
    horizons = F.explode(F.array(*[F.struct(F.lit(y).alias("horizon"), F.col(y).cast("double").alias("r")) for y in ys]))
    long = both.select("date", *ys, features.alias("_f")).select("date", "_f.*", horizons.alias("_h")).select("date", "feature", "older", "score", "_h.*")
    keys = ("feature", "horizon", "older")
    return _audited(ic_by(information_coefficient(long, keys=(*keys, "date")), *keys), "feature", "horizon")


def retrained_audits(df: DataFrame, folds: DataFrame, xs: list[str], y: str, model: str = "fama_macbeth") -> DataFrame:
    """feature, as_is, shifted, delta, pct_drop, verdict: the information ratio of the model's scores out of sample, and that of the model trained
    again with the feature a row older for each ticker (rows without the older value go). One model for each feature, dozens at most."""
    truth = df.select("date", "ticker", F.col(y).alias("r"))

    def ratio_of(rows: DataFrame, feature: str, older: int) -> DataFrame:
        scored = walk_forward_scores(rows, folds, xs, y, model).select("date", "ticker", "score").join(truth, ["date", "ticker"])
        return ic_by(information_coefficient(scored)).select(F.lit(feature).alias("feature"), F.lit(older).alias("older"), "ic_ir")

    base = ratio_of(df, "", 0).select(F.explode(F.array(*map(F.lit, xs))).alias("feature"), "older", "ic_ir")
    own = df.select("date", "ticker", *xs, y)
    again = [ratio_of(shifted(own, [x]).where(F.col(x).isNotNull()), x, 1) for x in xs]
    return _audited(reduce(DataFrame.unionByName, again, base), "feature")
