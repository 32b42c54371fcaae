"""Column and table functions that read filings, news and company lists from their text forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import any_date

# Endings of company names that say nothing about the company.
SUFFIXES = ("INC.", "INC", "CORPORATION", "CORP.", "CORP", "COMPANY", "CO.", "CO", "LTD.", "LTD", "LIMITED", "LP", "PLC", "HOLDINGS", "HOLDING", "GROUP", "THE")


def canonical_name(name: Column, least: int = 4) -> Column:
    """The upper-case name without its legal endings, however many; NULL under `least` characters."""
    ends = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    short = F.trim(F.regexp_replace(F.trim(F.upper(name)), rf"(,*\s+({ends}))+$", ""))
    return F.when(F.length(short) >= least, short)


def companies(df: DataFrame, json_col: str) -> DataFrame:
    """ticker (upper case), cik (ten digits), title from JSON objects {any key: {"cik_str", "ticker", "title"}}; malformed
    JSON gives no rows, entries without a ticker or number are left out."""
    rows = df.select(F.explode(F.from_json(json_col, "map<string, struct<cik_str:bigint, ticker:string, title:string>>")).alias("k", "v"))
    rows = rows.select(F.upper(F.trim("v.ticker")).alias("ticker"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("cik"), F.col("v.title").alias("title"))
    return rows.where("ticker is not null and ticker <> '' and cik is not null")


def checked_companies(rows: DataFrame, least: int = 1000) -> DataFrame:
    """rows, or an error where there are fewer than `least` or a cik isn't ten digits: one aggregated row decides."""
    seen = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("cik").rlike("^[0-9]{10}$")).alias("_bad"))
    good = F.assert_true((F.col("_n") >= least) & (F.col("_bad") == 0), F.lit("the company list is too short or malformed"))
    return rows.join(F.broadcast(seen.where(good.isNull()).select("_n")), F.lit(True)).drop("_n")


def names_to_tickers(rows: DataFrame) -> DataFrame:
    """name, tickers (sorted): companies (ticker, title) by canonical name; one name has a handful of tickers."""
    named = rows.select("ticker", canonical_name(F.col("title")).alias("name")).where("name is not null")
    return named.groupBy("name").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))


# The fields of a filing index in order; the last one is spelled in two ways.
INDEX_FIELDS = ("Form Type", "Company Name", "CIK", "Date Filed")
_LAST_FIELDS = ("Filename", "File Name")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (what a line's place in its file is ordered by), value: the lines of text files."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def below_header(lines: DataFrame, is_header: Column, missing: str, **of_header: Column) -> DataFrame:
    """lines with `header`, the first line of their file for which is_header holds, below which they are, and with columns of that header;
    an error (missing) where a file has none. A row a file decides, and lines meet it by broadcast: they aren't shuffled, however long a
    file is."""
    found = lines.groupBy("file").agg(F.min(F.when(is_header, F.struct("at", "value"))).alias("_h"))
    header = F.when(F.col("_h").isNull(), F.raise_error(F.concat(F.lit(missing + ": "), F.col("file")))).otherwise(F.col("_h"))
    heads = found.select("file", header.alias("_h")).select("file", F.col("_h.at").alias("_at"), F.col("_h.value").alias("header")).withColumns(of_header)
    return lines.join(F.broadcast(heads), "file").where(F.col("at") > F.col("_at")).drop("_at")


def field_places(header: Column, *names: str) -> Column:
    """Where each of the names begins in a header, each after the one before it, and where the last field ends: at one of the spellings of a
    file's name, or with the line. NULL where a name is missing."""
    place = lambda name, start: F.call_function("locate", F.lit(name), header, start)
    begin = [place(names[0], F.lit(1))]
    for name in names[1:]:
        begin.append(place(name, begin[-1] + 1))
    after = F.greatest(*[place(n, begin[-1] + 1) for n in _LAST_FIELDS])
    return F.when(F.least(*begin) > 0, F.array(*begin, F.when(after > 0, after).otherwise(1 << 20)))


def fixed_width(lines: DataFrame, *names: str, header: str = "header", line: str = "value", places: str | None = None) -> DataFrame:
    """lines with the named fields, trimmed: each goes from where the header has its name, after the name before it, to where the next
    one begins, the last one to the end of the line or to one of the spellings of a file's name. A column of the header's field_places
    saves finding them for each line."""
    placed = lines if places else lines.withColumn("_places", field_places(F.col(header), *names))
    at = F.col(places or "_places")
    # the first field begins with the line, wherever its name stands
    begin = lambda k: F.get(at, F.lit(k)) if k else F.lit(1)
    cut = lambda k: F.trim(F.substring(F.col(line), begin(k), F.get(at, F.lit(k + 1)) - begin(k)))
    checked = F.when(at.isNull(), F.raise_error(F.concat(F.lit("no header of these fields: "), F.col(header))).cast("string"))
    return placed.select(*lines.columns, *[F.coalesce(checked, cut(k)).alias(n) for k, n in enumerate(names)])


def wide_gaps(line: Column) -> Column:
    """Fields of a line that two or more blanks part."""
    return F.split(F.trim(line), " {2,}")


def index_rows(lines: DataFrame, form: str = "8-K") -> DataFrame:
    """file, cik (ten digits), filing_date of the lines of fixed-width filing indexes (see file_lines): those of one form whose number and date
    can be read. Each file's own header, found among its lines, says where the fields are; what stands before it, separators
    and malformed lines go, and a file without a header is an error."""
    below = below_header(lines, F.col("value").rlike(r"^\s*Form Type"), "no header line in the filing index", places=field_places(F.col("header"), *INDEX_FIELDS))
    rows = fixed_width(below.where(F.col("value").rlike(r"^[\p{L}\p{N}]")), *INDEX_FIELDS, places="places")
    number = F.when(F.col("CIK").rlike("^[0-9]+$"), F.col("CIK").try_cast("long"))
    date = F.get(F.transform(F.array("Date Filed"), any_date), 0)  # the field is cut out once, not for each form of a date
    return rows.where((F.col("Form Type") == form) & number.isNotNull() & date.isNotNull()).select("file", F.lpad(number.cast("string"), 10, "0").alias("cik"), date.alias("filing_date"))


def quarters(first: dt.date, last: dt.date) -> list[tuple[int, int]]:
    """(year, quarter) of every quarter that overlaps first..last: the partitions that a scan needs."""
    a, b = first.year * 4 + (first.month - 1) // 3, last.year * 4 + (last.month - 1) // 3
    return [(q // 4, q % 4 + 1) for q in range(a, b + 1)]


def filed_between(rows: DataFrame, first: dt.date, last: dt.date, on: str = "filing_date") -> DataFrame:
    """Rows filed from first to last, both included; a table partitioned by year and quarter is read for those alone."""
    if {"year", "quarter"} <= set(rows.columns):
        some = F.lit(False)
        for y, q in quarters(first, last):
            some = some | ((F.col("year") == y) & (F.col("quarter") == q))
        rows = rows.where(some)
    return rows.where(F.col(on).between(F.lit(first), F.lit(last)))


def filings(df: DataFrame, id_col: str, json_col: str, forms: tuple[str, ...] = ("8-K", "8-K/A")) -> DataFrame:
    """id_col, filing_date, items of a company's filings from JSON of parallel arrays {"form": [], "filingDate": [], "items": []}."""
    parsed = F.from_json(json_col, "form array<string>, filingDate array<string>, items array<string>")
    rows = df.select(id_col, parsed.alias("p")).select(id_col, F.inline(F.arrays_zip(F.col("p.form").alias("form"), F.col("p.filingDate").alias("filed"), F.col("p.items").alias("items"))))
    return rows.where(F.col("form").isin(*forms)).select(id_col, F.try_to_timestamp("filed", F.lit("yyyy-MM-dd")).cast("date").alias("filing_date"), "items")


def news_items(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id_col, title, publisher, link, type, uuid, published of news items in either of the two JSON layouts, flat or under "content"; an empty
    text of the flat one gives way to the other's.

    A link that isn't http or https becomes NULL; the time is epoch seconds where the item has them, else an ISO time, NULL if that
    can't be read.
    """
    field = lambda path: F.get_json_object(json_col, "$." + path)
    either = lambda flat, deep: F.coalesce(F.nullif(field(flat), F.lit("")), field(deep))
    link, seconds = either("link", "content.canonicalUrl.url"), field("providerPublishTime")
    read = F.timestamp_seconds(seconds.try_cast("double").cast("long"))
    return df.select(
        id_col,
        either("title", "content.title").alias("title"),
        either("publisher", "content.provider.displayName").alias("publisher"),
        F.when(F.startswith(link, F.lit("http://")) | F.startswith(link, F.lit("https://")), link).alias("link"),
        either("type", "content.contentType").alias("type"),
        either("uuid", "id").alias("uuid"),
        F.when(seconds.isNotNull(), read).otherwise(F.try_to_timestamp(field("content.pubDate"))).alias("published"),
    )
