"""Queries of readers and parsers: rows of the star schema written in each text form and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins as j
from ..sources import html as ht, tables as tb, text as tx, tone as tn
from ..sources.files import archives, shared_folder, write_texts
from ..sources.ingest import cached_files, ingest_files, named
from ..sources.panel import price_panel, table
from .cross import add
from .sql import PANEL, r6

_ENDS = ("", ", Inc.", " Holdings Corp", " Group Ltd.", " Co")
_TITLE = "CASE p_partkey % 5 WHEN 1 THEN p_name || ', Inc.' WHEN 2 THEN p_name || ' Holdings Corp' WHEN 3 THEN p_name || ' Group Ltd.' WHEN 4 THEN p_name || ' Co' ELSE p_name END"
_NAME = rf"trim(regexp_replace(trim(upper({_TITLE})), '(,*\s+({'|'.join(s.replace('.', chr(92) + '.') for s in tx.SUFFIXES)}))+$', ''))"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as companies: ticker, title."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("ticker"), F.concat("p_name", end).alias("title"), "p_partkey")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


add("s2_normalised_prices", f"WITH {PANEL} SELECT date, ticker, close, close AS adj_close, volume FROM panel", lambda s, sf: tb.normalised_prices(price_panel(s, sf).toDF("Date", "Ticker", "Sector", "Close", "Volume")), None)
_THREE = ("NATION_1", "NATION_2", "NATION_7")
#: The names that a panel can have: a nation each.
_ALL = tuple(f"NATION_{k}" for k in range(25))
add("s4_wide_panel", f"WITH {PANEL} SELECT date, " + ", ".join(f"max(CASE WHEN ticker = '{t}' THEN close END) AS \"{t}\"" for t in _ALL) + " FROM panel GROUP BY 1", lambda s, sf: tb.wide(price_panel(s, sf), "close", list(_ALL)), None)


def written_panel(spark: SparkSession, sf: str) -> str:
    """The folder of the price panel as Parquet by year."""
    folder = shared_folder(spark, "panel")
    tb.write_panel(price_panel(spark, sf).select("date", "ticker", "close", "volume"), folder)
    return folder


def long_panel(spark: SparkSession, sf: str) -> DataFrame:
    """One table of all tickers' own tables; that of one lacks the volume."""
    folder = written_panel(spark, sf)
    frames = {t: tb.price_scan(spark, folder, t).select("date", "close", *["volume"][: t != "NATION_7"]) for t in _ALL}
    return tb.long(frames).select("date", "ticker", "close", "volume")


add("s5_long_panel", f"WITH {PANEL} SELECT date, ticker, close, CASE WHEN ticker <> 'NATION_7' THEN volume END AS volume FROM panel", long_panel, None)
add("s24_written_panel", f"WITH {PANEL} SELECT date, ticker, close, close AS adj_close, volume FROM panel", lambda s, sf: tb.price_scan(s, written_panel(s, sf)), None)
add("s1_one_ticker", f"WITH {PANEL} SELECT date, ticker, close, close AS adj_close, volume FROM panel WHERE ticker = 'NATION_7'", lambda s, sf: tb.price_scan(s, written_panel(s, sf), "NATION_7"), None)


def rate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three rate files (file, place, value): orders and events by day, the value after and before the date, and one of the events' mean value."""
    orders = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    seen = events(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("m"))
    line = lambda file, value: (lambda df: df.select(F.lit(file).alias("file"), F.col("d").cast("string").alias("place"), value.alias("value")))
    files = [
        line("ORDERS.csv", F.concat_ws(",", F.col("d").cast("string"), F.when(F.col("n") % 7 != 0, F.col("n").cast("string")).otherwise(".")))(orders),
        line("EVENTS.csv", F.concat_ws(",", F.col("n").cast("string"), F.lit("x"), F.date_format("d", "M/d/yyyy")))(seen),
        line("MEANS.csv", F.concat_ws(",", F.date_format("d", "yyyyMMdd"), F.concat(F.lit('"'), F.col("m").cast("string"), F.lit('"'))))(seen),
    ]
    heads = spark.createDataFrame([("ORDERS.csv", "", "DATE,ORDERS"), ("EVENTS.csv", "", "EVENTS,note,observation_date"), ("EVENTS.csv", "z", "5,x,never"), ("MEANS.csv", "", '"Observation_Date","MEANS"')], "file string, place string, value string")
    return heads.unionByName(files[0]).unionByName(files[1]).unionByName(files[2])


def text_folder(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A shared folder with the rows (file, place, value) as text files in it."""
    folder = shared_folder(spark, name)
    write_texts(rows, folder).agg(F.count(F.lit(1))).first()
    return folder


_RATES = (
    "a AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN count(*) % 7 <> 0 THEN CAST(count(*) AS DOUBLE) END AS \"ORDERS\" FROM orders GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS \"EVENTS\", round(avg(value), 4) AS \"MEANS\" FROM events GROUP BY 1), "
    "r AS (SELECT 'ORDERS' AS series, date, \"ORDERS\" AS value FROM a UNION ALL SELECT 'EVENTS', date, \"EVENTS\" FROM b UNION ALL SELECT 'MEANS', date, \"MEANS\" FROM b)"
)
add("s8_rate_series", f"WITH {_RATES} SELECT coalesce(a.date, b.date) AS date, \"ORDERS\" AS orders, \"EVENTS\" AS events FROM a FULL JOIN b ON a.date = b.date", lambda s, sf: tb.rate_series(tb.rate_files(tx.file_lines(s, text_folder(s, rate_lines(s, sf), "rates")), None), "ORDERS", "EVENTS").toDF("date", "orders", "events"))
add("s8_rate_files", f"WITH {_RATES} SELECT * FROM r WHERE date BETWEEN DATE '1995-03-01' AND DATE '2024-01-20'", lambda s, sf: tb.rate_files(tx.file_lines(s, text_folder(s, rate_lines(s, sf), "rates")), "1995-03-01", dt.date(2024, 1, 20)))
_CACHED, _FETCHED = "SELECT o_custkey AS k, max(o_orderkey) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", "SELECT o_custkey AS k, max(o_orderkey) AS at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"


def keyed(spark: SparkSession, sf: str, status: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"))


add("s9_incremental_cache", f"WITH c AS ({_CACHED}), f AS ({_FETCHED}) SELECT c_custkey AS k, coalesce(c.at, f.at) AS at FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN f ON f.k = c_custkey", lambda s, sf: tb.refreshed(table(s, sf, "customer").select(F.col("c_custkey").alias("k")), keyed(s, sf, "F").groupBy("k").agg(F.max("at").alias("at")), keyed(s, sf, "O"), "k", "at"))
add("s9_missing_keys", f"WITH c AS ({_CACHED}) SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)", lambda s, sf: tb.missing_keys(table(s, sf, "customer").select(F.col("c_custkey").alias("k")), keyed(s, sf, "F"), "k"))
add("s10_sector_map", "SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'", lambda s, sf: tb.sector_map(table(s, sf, "nation").join(table(s, sf, "region"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("ticker"), F.when(F.col("r_name") != "ASIA", F.col("r_name")).alias("sector"))))


def company_json(spark: SparkSession, sf: str) -> DataFrame:
    one = F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_partkey").alias("cik_str"), F.lower("ticker").alias("ticker"), "title")))
    return titles(spark, sf).select(one.alias("j"))


add("s11_companies", f"SELECT 'P' || p_partkey AS ticker, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, {_TITLE} AS title FROM part", lambda s, sf: tx.checked_companies(tx.companies(company_json(s, sf), "j"), 100))


def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the lines of a filing index for each quarter (file, place, value): columns of several widths, two spellings of the last
    field, dates of two forms, a preamble, a separator, and lines that are cut off or have no number."""
    filed = F.to_date("o_orderdate")
    odd = F.quarter(filed) % 2 == 1
    file = F.concat(F.year(filed), F.lit("Q"), F.quarter(filed), F.lit(".idx"))
    form = F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "8-K/A").otherwise("10-K")
    wide = lambda a, b, c, d: F.concat(F.rpad(a, 12, " "), F.when(odd, F.rpad(b, 40, " ")).otherwise(F.rpad(b, 25, " ")), F.when(odd, F.rpad(c, 12, " ")).otherwise(F.rpad(c, 9, " ")), F.rpad(d, 12, " "))
    day = F.when(odd, F.date_format(filed, "yyyy-MM-dd")).otherwise(F.date_format(filed, "M/d/yyyy"))
    number = F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.col("o_custkey").cast("string"))
    rows = table(spark, sf, "orders").select(file.alias("file"), F.col("o_orderkey").alias("place"), F.concat(wide(form, F.concat(F.lit("A  &  B  "), F.col("o_custkey")), number, day), F.lit("edgar/data/x.txt")).alias("value"), odd.alias("odd"))
    files = rows.groupBy("file").agg(F.first("odd").alias("odd"))
    head = F.concat(F.rpad(F.lit("Form Type"), 12, " "), F.when(F.col("odd"), F.rpad(F.lit("Company Name"), 40, " ")).otherwise(F.rpad(F.lit("Company Name"), 25, " ")), F.when(F.col("odd"), F.rpad(F.lit("CIK"), 12, " ")).otherwise(F.rpad(F.lit("CIK"), 9, " ")), F.rpad(F.lit("Date Filed"), 12, " "), F.when(F.col("odd"), "File Name").otherwise("Filename"))
    extra = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("place"), v.alias("value")) for k, v in ((-5, F.lit("Description:  8-K by form")), (-4, F.lit("")), (-3, head), (-2, F.lit("-" * 90)), (1 << 40, F.lit("8-K         cut off")))]))
    return rows.select("file", "place", "value").unionByName(files.select("file", extra.alias("x")).select("file", "x.place", "x.value"))


add(
    "s12_fixed_width_index",
    "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) || '.idx' AS file, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 9 <> 0",
    lambda s, sf: tx.index_rows(tx.file_lines(s, text_folder(s, index_lines(s, sf), "index"))).withColumn("file", F.element_at(F.split("file", "/"), -1)),
)
add("s13_wide_gaps", "SELECT event_id, event_type AS a, CAST(user_id AS VARCHAR) AS b FROM events", lambda s, sf: events(s, sf).select("event_id", tx.wide_gaps(F.concat(F.lit("  "), "event_type", F.lit("    "), F.col("user_id"), F.lit("  x y"))).alias("f")).select("event_id", F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b")))
_FIRST, _LAST = dt.date(1995, 2, 10), dt.date(1995, 8, 5)
add("s15_filings_between", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-02-10' AND DATE '1995-08-05'", lambda s, sf: tx.filed_between(table(s, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filing_date")).withColumns({"year": F.year("filing_date"), "quarter": F.quarter("filing_date")}), _FIRST, _LAST).select("o_orderkey", "filing_date"))


def filing_json(spark: SparkSession, sf: str) -> DataFrame:
    form = F.when(F.col("event_type") == "error", "8-K").when(F.col("event_type") == "signup", "8-K/A").otherwise("10-K")
    rows = events(spark, sf).select("user_id", "event_id", form.alias("form"), F.date_format("ts", "yyyy-MM-dd").alias("filed"), F.concat(F.lit("2.0"), F.col("event_id") % 5, F.lit(",9.01")).alias("items"))
    return rows.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list("form").alias("form"), F.collect_list("filed").alias("filingDate"), F.collect_list("items").alias("items"))).alias("j"))


add("s16_company_filings", "SELECT user_id, CAST(ts AS DATE) AS filing_date, '2.0' || CAST(event_id % 5 AS VARCHAR) || ',9.01' AS items FROM events WHERE event_type IN ('error', 'signup')", lambda s, sf: tx.filings(filing_json(s, sf), "user_id", "j"))


def tone_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tone lines; each names one part's company twice and one that nobody knows."""
    org = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    rows = events(spark, sf).withColumn("k", F.col("user_id") + 1).join(org, "k")
    orgs = F.concat_ws(";", F.lower("p_name"), F.lit("Nobody Ltd"), F.col("p_name"))
    return rows.select(F.concat_ws("\t", F.date_format("ts", "yyyyMMdd"), F.get_json_object("props", "$.k"), F.lit("c"), F.lit("t"), F.lit("l"), F.lit("p"), orgs, F.concat(F.col("value").cast("string"), F.lit(",1,2,3"))).alias("value"))


add(
    "s17_tone_mentions",
    f"WITH nm AS (SELECT 'P' || p_partkey AS ticker, {_NAME} AS name FROM part WHERE length({_NAME}) >= 4), e AS (SELECT event_id, CAST(ts AS DATE) AS date, CAST(json_extract(props, '$.k') AS INT) AS k, value, upper(p_name) AS name FROM events JOIN part ON p_partkey = user_id + 1) "
    f"SELECT date, ticker, count(*) AS mention_count, CAST(sum(k) AS BIGINT) AS article_count, {r6('avg(value)', 'tone_mean')}, {r6('stddev_pop(value)', 'tone_std')} FROM e JOIN nm USING (name) GROUP BY 1, 2",
    lambda s, sf: tn.mentions(tn.mention_rows(tn.split_lines(tone_lines(s, sf).unionByName(s.createDataFrame([("too\tshort",)], "value string")))), tx.names_to_tickers(titles(s, sf))),
)


def tone_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the lines of three files a day (file, header, place, value): without a header and with times in their dates; with one of
    its own order; and, on Mondays, with one that lacks a field.

    Organizations have offsets, are named twice, and some by another name too; counts are missing or no numbers, some tones are no numbers.
    """
    org = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    e = events(spark, sf).withColumn("k", F.col("user_id") + 1).join(org, "k")
    part, place = F.col("event_id") % 3, F.col("event_id")
    date = F.when(place % 2 == 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(F.date_format("ts", "yyyyMMdd"))
    count = F.when(place % 5 == 0, "").when(place % 7 == 1, "x").otherwise(F.get_json_object("props", "$.k"))
    tone = F.when(place % 11 == 3, "bad").otherwise(F.concat(F.col("value").cast("string"), F.lit(",1,2,3")))
    orgs = F.concat_ws(";", F.concat(F.lower("p_name"), F.lit(",17")), F.lit("Nobody Ltd,4"), F.concat(F.lit(" "), "p_name"), F.when(F.col("k") % 50 == 0, F.concat(F.lit("alias "), "k", F.lit(",9"))))
    fixed = F.concat_ws("\t", date, count, F.lit("c"), F.lit("t"), F.lit("l"), F.lit("p"), orgs, tone)
    own = F.concat_ws("\t", tone, F.lit('"two\twords"'), date, orgs, count)
    header = F.when(part == 1, "TONE\tTHEMES\tDATE\tORGANIZATIONS\tNUMARTS").when((part == 2) & (F.dayofweek("ts") == 2), "DATE\tNUMARTS\tTHEMES")
    file = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("."), part, F.lit(".csv.zip"))
    return e.select(file.alias("file"), header.alias("header"), place.alias("place"), F.when(part == 1, own).otherwise(fixed).alias("value"))


def company_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all parts, every fiftieth by a second one too."""
    more = table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.concat(F.lit("Alias "), "p_partkey", F.lit(" Co")).alias("title"))
    return tx.names_to_tickers(titles(spark, sf).select("ticker", "title").union(more))


def tone_folder(spark: SparkSession, rows: DataFrame, folder: str) -> str:
    """The folder, with the rows' archives in it."""
    tn.write_archives(rows, folder).agg(F.count(F.lit(1))).first()
    return folder


def archived_mentions(spark: SparkSession, sf: str) -> DataFrame:
    lines = tn.archived_lines(archives(spark, tone_folder(spark, tone_files(spark, sf), shared_folder(spark, "tone"))))
    return tn.mentions(tn.mention_rows(lines), company_names(spark, sf))


_MENTIONS = (
    f"nm AS (SELECT 'P' || p_partkey AS ticker, {_NAME} AS name FROM part WHERE length({_NAME}) >= 4 UNION ALL SELECT 'P' || p_partkey, 'ALIAS ' || p_partkey FROM part WHERE p_partkey % 50 = 0), "
    "e AS (SELECT event_id, CAST(ts AS DATE) AS date, strftime(ts, '%Y%m%d') || '.' || (event_id % 3) || '.csv.zip' AS file, event_id % 3 = 2 AND dayofweek(ts) = 1 AS unknown, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 1 THEN 1 ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 11 <> 3 THEN value END AS value, "
    "unnest([upper(p_name), CASE WHEN p_partkey % 50 = 0 THEN 'ALIAS ' || p_partkey END]) AS name FROM events JOIN part ON p_partkey = user_id + 1), "
    "ln AS (SELECT DISTINCT event_id, date, file, k, value, ticker FROM e JOIN nm USING (name) WHERE NOT unknown AND value IS NOT NULL)"
)
_STATS = f"count(*) AS mention_count, CAST(sum(k) AS BIGINT) AS article_count, {r6('avg(value)', 'tone_mean')}, {r6('stddev_pop(value)', 'tone_std')}"
add("s17_tone_archives", f"WITH {_MENTIONS} SELECT date, ticker, {_STATS} FROM ln GROUP BY 1, 2", archived_mentions)
_TONE = "file string, date date, ticker string, mention_count long, article_count long, tone_mean double, tone_std double"


def ingested_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Files up to the 20th of a month, then all of them, ingested into one cache: its rows, markers included, with their batches."""
    folder, cache, progress = (shared_folder(spark, name) for name in ("arrivals", "cache", "progress"))
    rows, names = tone_files(spark, sf), company_names(spark, sf)
    parse = lambda files: tn.mentions(tn.mention_rows(named(tn.archived_lines(files)), "file"), names, "file")
    early = F.substring("file", 7, 2).cast("int") <= 20
    for arrived in (early, ~early):
        ingest_files(spark, tone_folder(spark, rows.where(arrived), folder), cache, progress, parse, _TONE)
    return cached_files(spark, cache, _TONE)


def batches_of_files(held: DataFrame) -> DataFrame:
    """The cache's rows and how many batches hold their file."""
    return held.join(F.broadcast(held.groupBy("file").agg(F.count_distinct("batch").alias("batches"))), "file").drop("batch")  # a row a file


add("s20_resumable_ingest", f"WITH {_MENTIONS}, f AS (SELECT DISTINCT file FROM e) SELECT f.file, date, ticker, CASE WHEN ticker IS NOT NULL THEN mention_count END AS mention_count, article_count, tone_mean, tone_std, 1 AS batches FROM f LEFT JOIN (SELECT file, date, ticker, {_STATS} FROM ln GROUP BY 1, 2, 3) g ON f.file = g.file", lambda s, sf: batches_of_files(ingested_mentions(s, sf)))
add("s20_merged_mentions", f"WITH {_MENTIONS} SELECT date, ticker, {_STATS} FROM ln GROUP BY 1, 2", lambda s, sf: tn.merged(ingested_mentions(s, sf).where("ticker is not null")))
add("s18_canonical_names", f"SELECT p_partkey, CASE WHEN length({_NAME}) >= 4 THEN {_NAME} END AS name FROM part", lambda s, sf: titles(s, sf).select("p_partkey", tx.canonical_name(F.col("title")).alias("name")))


def news_json(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    flat = F.to_json(F.struct(F.col("event_type").alias("title"), F.lit("wire").alias("publisher"), F.lit("https://a.example/x").alias("link"), F.lit("STORY").alias("type"), key.alias("uuid"), F.unix_timestamp("ts").alias("providerPublishTime")))
    content = F.struct(F.col("event_type").alias("title"), F.struct(F.lit("desk").alias("displayName")).alias("provider"), F.struct(F.lit("javascript:x()").alias("url")).alias("canonicalUrl"), F.lit("VIDEO").alias("contentType"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"))
    deep = F.to_json(F.struct(F.lit("").alias("title"), F.concat(F.lit("n"), key).alias("id"), content.alias("content")))
    timeless = F.to_json(F.struct(F.lit("soon").alias("providerPublishTime"), content.alias("content")))
    return events(spark, sf).select("event_id", F.when(F.col("event_type") == "view", deep).when(F.col("event_type") == "click", timeless).otherwise(flat).alias("j"))


add(
    "s21_news_items",
    "SELECT event_id, event_type AS title, CASE WHEN event_type IN ('view', 'click') THEN 'desk' ELSE 'wire' END AS publisher, CASE WHEN event_type NOT IN ('view', 'click') THEN 'https://a.example/x' END AS link, CASE WHEN event_type IN ('view', 'click') THEN 'VIDEO' ELSE 'STORY' END AS type, CASE event_type WHEN 'view' THEN 'n' || event_id WHEN 'click' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS uuid, CASE WHEN event_type <> 'click' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS published FROM events",
    lambda s, sf: tx.news_items(news_json(s, sf), "event_id", "j").withColumn("published", F.unix_timestamp("published")),
)
_STATE = (
    "e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS kind FROM events WHERE event_type IN ('signup', 'error')), cur AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 50), "
    "m AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS nx FROM e WINDOW w AS (PARTITION BY user_id ORDER BY date, kind DESC)), s AS (SELECT *, last_value(CASE WHEN kind = 1 AND b IS DISTINCT FROM 1 THEN date END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date, kind DESC ROWS UNBOUNDED PRECEDING) AS opened FROM m)"
)
add(
    "p15_membership",
    f"WITH {_STATE} SELECT user_id, CASE WHEN b = 1 THEN opened END AS start_date, date AS end_date FROM s WHERE kind = -1 UNION ALL SELECT user_id, opened, NULL FROM s WHERE kind = 1 AND nx IS NULL UNION ALL SELECT user_id, date, NULL FROM s JOIN cur USING (user_id) WHERE kind = -1 AND nx IS NULL UNION ALL SELECT user_id, NULL, NULL FROM cur WHERE user_id NOT IN (SELECT user_id FROM e)",
    lambda s, sf: j.membership(
        events(s, sf).where("event_type in ('signup', 'error')").select("user_id", F.to_date("ts").alias("date"), F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("kind")).distinct(),
        "user_id",
        events(s, sf).where("event_type = 'purchase' and value > 50").select("user_id").distinct(),
    ),
)


def change_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each user: a table of members, and one of changes under two lines of headers with spans."""
    spelled = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "MMMM d, yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    who = F.concat(F.lit("E."), "event_id")
    line = lambda *cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    named = lambda kind: F.when(F.col("event_type") == kind, who).otherwise("")
    changed = F.when(F.col("event_type").isin("signup", "error"), line(spelled, named("signup"), F.lit("a &amp; b"), named("error"), F.lit("-")))
    rows = events(spark, sf).select("user_id", line(F.col("event_type"), who).alias("member"), changed.alias("changed"))
    pages = rows.groupBy("user_id").agg(F.concat_ws("", F.collect_list("member")).alias("m"), F.concat_ws("", F.collect_list("changed")).alias("c"))
    first, second = "<p>x<table><tr><th>Kind<th>Symbol</tr>", '</table><table><tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>'
    return pages.select("user_id", F.concat(F.lit(first), "m", F.lit(second), "c", F.lit("<tr><td>no date</td></tr></table>")).alias("html"))


add("s7_index_changes", "SELECT user_id, CAST(ts AS DATE) AS date, CASE WHEN event_type = 'signup' THEN 'E-' || event_id END AS added, CASE WHEN event_type = 'error' THEN 'E-' || event_id END AS removed FROM events WHERE event_type IN ('signup', 'error')", lambda s, sf: ht.index_changes(ht.html_tables(change_pages(s, sf), "user_id", "html"), "user_id"))
add("s7_current_members", "SELECT DISTINCT user_id, 'E-' || event_id AS ticker FROM events", lambda s, sf: ht.current_members(ht.html_tables(change_pages(s, sf), "user_id", "html"), "user_id"))


def lateral_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each table of each page by the table function in SQL; page ids repeat, and some are missing."""
    spark.udtf.register("page_tables", ht.page_tables)
    pages = change_pages(spark, sf).select(F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 3).alias("page"), "html")
    return spark.sql("SELECT page, t.table, t.header, CAST(size(t.cells) AS BIGINT) AS width, count(*) AS n FROM {pages} p, LATERAL page_tables(p.html) t GROUP BY ALL", pages=pages)


add(
    "s7_lateral_tables",
    "WITH p AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN user_id % 3 END AS page, count(*) AS m, count(CASE WHEN event_type IN ('signup', 'error') THEN 1 END) AS c FROM events GROUP BY 1), t AS (SELECT page, 0 AS \"table\", true AS header, 2 AS width, 1 AS n FROM p UNION ALL SELECT page, 0, false, 2, m FROM p UNION ALL SELECT page, 1, true, 5, 2 FROM p UNION ALL SELECT page, 1, false, 5, c FROM p WHERE c > 0 UNION ALL SELECT page, 1, false, 1, 1 FROM p) "
    "SELECT page, CAST(\"table\" AS INT) AS \"table\", header, CAST(width AS BIGINT) AS width, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL",
    lateral_tables,
)


def day_rows(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type").isin(*kinds)).groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("n"))


_DAYS = "SELECT CAST(ts AS DATE) AS date, user_id, count(*) AS n FROM events WHERE event_type = '{}' AND {} GROUP BY 1, 2"
add(
    "s19_day_cache",
    f"WITH w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(ts AS DATE) FROM events), c AS ({_DAYS.format('error', 'value > 50')}), f AS ({_DAYS.format('signup', 'true')}) "
    "SELECT * FROM c UNION ALL SELECT w.date, f.user_id, f.n FROM (SELECT date FROM w WHERE date NOT IN (SELECT date FROM c)) w LEFT JOIN f ON f.date = w.date",
    lambda s, sf: tb.day_cache(
        table(s, sf, "orders").select(F.to_date("o_orderdate").alias("date")).union(events(s, sf).select(F.to_date("ts"))),
        events(s, sf).where("event_type = 'error' and value > 50").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("n")),
        day_rows(s, sf, "signup"),
    ),
)
