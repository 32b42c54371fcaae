"""Mentions of companies in daily tone files: lines or zip archives to one row a day and ticker."""

from __future__ import annotations

import csv
import io
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .files import write_groups

# The columns of a tone file without a header, in order.
FIELDS = ("DATE", "NUMARTS", "COUNTS", "THEMES", "LOCATIONS", "PERSONS", "ORGANIZATIONS", "TONE")
#: The fields that mentions are counted from; a header may lack NUMARTS, which then stands in its fixed place.
USED = ("DATE", "NUMARTS", "ORGANIZATIONS", "TONE")
_RAW = pa.schema([(c, pa.string()) for c in ("path", *USED)])


def places(first: list[str]) -> tuple[dict[str, int] | None, bool]:
    """Where the used fields are by a file's first row, and whether that row is data: it is if it begins with a date. None for
    a header that lacks a field."""
    fixed = {c: FIELDS.index(c) for c in USED}
    if first and len(first[0]) >= 8 and first[0].isdigit():
        return fixed, True
    found = {c: first.index(c) for c in USED if c in first}
    found.setdefault("NUMARTS", fixed["NUMARTS"])
    return (found if len(found) == len(USED) else None), False


def archived_rows(content: bytes) -> Iterator[list[str]]:
    """The used fields of every row of an archive's first member, streamed; nothing from an empty archive or an unknown header."""
    csv.field_size_limit(sys.maxsize)
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist()[:1]:
            with archive.open(name) as member:
                rows = csv.reader(io.TextIOWrapper(member, "utf-8", "replace"), delimiter="\t")
                first = next(rows, [])
                at, data = places(first)
                if at is None:
                    return
                if data:
                    yield [first[at[c]] if at[c] < len(first) else None for c in USED]
                for row in rows:
                    yield [row[at[c]] if at[c] < len(row) else None for c in USED]


def archived_lines(files: DataFrame, rows: int = 8192) -> DataFrame:
    """path and the used fields, as text, of the lines of zip archives (path, content); each task holds one archive and `rows` lines."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held = []
                for row in archived_rows(content.as_py()):
                    held.append([path.as_py(), *row])
                    if len(held) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=_RAW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=_RAW)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"{c} string" for c in _RAW.names))


def split_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The used fields of tab-separated lines without a header, beside the lines' other columns."""
    cut = F.split(line, "\t")
    others = [c for c in lines.columns if c != line]
    return lines.select(*others, *[F.get(cut, F.lit(FIELDS.index(c))).alias(c) for c in USED])


def mention_rows(fields: DataFrame, *keys: str) -> DataFrame:
    """The keys, then date, articles, tone and names (distinct organizations of 3 letters or more, upper case) of each line that counts.

    The first eight digits of DATE are the date. An empty or unreadable NUMARTS counts as one article. TONE is the number
    before the first comma, an organization the name before its first comma. Lines that lack a field, an organization, a date or a finite
    tone are left out.
    """
    name = lambda o: F.upper(F.trim(F.split(o, ",", 2)[0]))
    tone = F.get(F.split("TONE", ","), F.lit(0)).try_cast("double")
    rows = fields.where("DATE is not null and NUMARTS is not null and ORGANIZATIONS <> '' and TONE <> ''").select(
        *keys,
        F.try_to_timestamp(F.regexp_extract("DATE", "^[0-9]{8}", 0), F.lit("yyyyMMdd")).cast("date").alias("date"),
        F.coalesce(F.col("NUMARTS").try_cast("long"), F.lit(1)).alias("articles"),
        F.when(~F.isnan(tone) & (F.abs(tone) < float("inf")), tone).alias("tone"),
        F.array_distinct(F.filter(F.transform(F.split("ORGANIZATIONS", ";"), name), lambda o: F.length(o) >= 3)).alias("names"),
    )
    return rows.where("date is not null and tone is not null")


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("mention_count"),
        F.sum("articles").alias("article_count"),
        F.avg("tone").alias("tone_mean"),
        F.coalesce(F.var_pop("tone"), F.lit(0.0)).alias("tone_var"),
    ]


def mentions(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """The keys, date, ticker, mention_count, article_count, tone_mean, tone_std (over lines, of the population) of mention_rows.

    names: name, tickers. A line counts once for a ticker, however many of its names it has. Lines are summed by date and name, and
    again those that have two of a ticker's names next to each other in order, which were counted once too often; both are
    merged for each set of names that tickers have, and only then are the tickers listed. So no line meets a ticker: work
    grows with lines and with the result.
    """
    pairs = names.select("name", F.explode("tickers").alias("ticker")).distinct()
    known = pairs.groupBy("ticker").agg(F.sort_array(F.collect_set("name")).alias("own"))  # a ticker's names: a few titles of a company
    sets = known.select("own").distinct()
    each = rows.select(*keys, "date", "articles", "tone", F.explode("names").alias("name")).groupBy(*keys, "date", "name").agg(*_stats())
    each = each.join(sets.select("own", F.explode("own").alias("name")), "name").withColumn("sign", F.lit(1))
    above = lambda a: F.transform(F.filter("own", lambda b: b > a), lambda b: F.struct(a.alias("low"), b.alias("high")))
    both = sets.where(F.size("own") > 1).select("own", F.explode(F.flatten(F.transform("own", above))).alias("_p")).select("own", "_p.*")
    line = [*keys, "date", "articles", "tone", "names"]
    twice = rows.where(F.size("names") > 1).select(*line, F.explode("names").alias("low")).join(both.select("low").distinct(), "low", "left_semi")
    twice = twice.select(*line, "low", F.explode(F.filter("names", lambda n: n > F.col("low"))).alias("high")).join(both, ["low", "high"])
    between = F.exists("own", lambda o: (o > F.col("low")) & (o < F.col("high")) & F.array_contains("names", o))
    twice = twice.where(~between).groupBy(*keys, "date", "own").agg(*_stats()).withColumn("sign", F.lit(-1))
    n = F.col("sign") * F.col("mention_count")
    parts = each.select(*twice.columns).unionByName(twice).groupBy(*keys, "date", "own").agg(
        F.sum(n).alias("mention_count"), F.sum(F.col("sign") * F.col("article_count")).alias("article_count"), (F.sum(n * F.col("tone_mean")) / F.sum(n)).alias("tone_mean"), F.collect_list(F.struct(n.alias("n"), F.col("tone_mean").alias("m"), F.col("tone_var").alias("v"))).alias("_p")
    )
    squares = F.aggregate("_p", F.lit(0.0), lambda s, q: s + q["n"] * (q["v"] + (q["m"] - F.col("tone_mean")) * (q["m"] - F.col("tone_mean"))))
    parts = parts.select(*keys, "date", "own", "mention_count", "article_count", "tone_mean", F.sqrt(F.greatest(squares, F.lit(0.0)) / F.col("mention_count")).alias("tone_std"))
    return parts.join(known, "own").select(*keys, "date", "ticker", "mention_count", "article_count", "tone_mean", "tone_std")


def merged(parts: DataFrame) -> DataFrame:
    """One row a date and ticker from mentions of several files: counts add up, tones merge by their means and deviations.

    The parts are dealt by date and ticker before they are summed, as few of them meet in a task that reads them; sums alone
    are kept of them. What the means add to the variance is at most what their range allows, and nothing where they are equal.
    """
    n, mean = F.col("mention_count"), F.col("tone_mean")
    own = parts.select("date", "ticker", "mention_count", "article_count", "tone_mean", "tone_std").repartition("date", "ticker").groupBy("date", "ticker").agg(
        F.sum(n).alias("_n"), F.sum("article_count").alias("_a"), (F.sum(n * mean) / F.sum(n)).alias("_m"), (F.sum(n * mean * mean) / F.sum(n)).alias("_s"), (F.sum(n * F.col("tone_std") * F.col("tone_std")) / F.sum(n)).alias("_v"), ((F.max(mean) - F.min(mean)) / 2).alias("_half")
    )
    spread = F.least(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0)), F.col("_half") * F.col("_half"))
    return own.select("date", "ticker", F.col("_n").alias("mention_count"), F.col("_a").alias("article_count"), F.col("_m").alias("tone_mean"), F.sqrt(F.col("_v") + spread).alias("tone_std"))


def write_archives(lines: DataFrame, folder: str, file: str = "file", header: str = "header", order: str = "place", line: str = "value") -> DataFrame:
    """Lines as zip archives of one member each, in the given order, under their file's header (none if that is NULL): the names of the
    files written."""

    def write(out, name, batches):
        member_ = zipfile.ZipInfo(name.removesuffix(".zip"))
        member_.compress_type = zipfile.ZIP_DEFLATED
        with zipfile.ZipFile(out, "w") as archive, archive.open(member_, "w", force_zip64=True) as member:
            for k, rows in enumerate(batches):
                first = rows.column(header)[0].as_py() if not k else None
                texts = ([] if first is None else [first]) + rows.column(line).drop_null().to_pylist()
                member.write("".join(t + "\n" for t in texts).encode())

    return write_groups(lines, folder, write, file, order)
