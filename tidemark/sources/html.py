"""Tables in web pages: their cells as rows, and index changes read from them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from ..functions.columns import any_date

# The largest spans that the HTML standard allows; larger ones count as these.
_ROWS, _COLUMNS = 65_534, 1_000


def _span(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and value.isascii() and value.isdigit() else 1


class _Tables(HTMLParser):
    """The tables of one page in the order of their tags; a row is a list of (texts, is a header, row span, column span)."""

    def __init__(self):
        super().__init__()
        self.found, self._open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.found.append([])
            self._open.append(self.found[-1])
        elif self._open and tag == "tr":
            self._open[-1].append([])
        elif self._open and self._open[-1] and tag in ("td", "th"):
            a = dict(attrs)
            self._open[-1][-1].append(([], tag == "th", _span(a.get("rowspan"), _ROWS), _span(a.get("colspan"), _COLUMNS)))
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data):
        if self._open and self._open[-1] and self._open[-1][-1]:
            self._open[-1][-1][-1][0].append(data)


def _grid(rows: list) -> Iterator[tuple[bool, list[str]]]:
    """Header or not, and the cells of each row; a cell stands in every place that its spans cover."""
    below: dict[int, tuple[int, str]] = {}
    for row in rows:
        cells, left, lower = [], list(row), {}
        while left or any(c >= len(cells) for c in below):
            at = len(cells)
            if at in below:
                more, text = below.pop(at)
                cells.append(text)
                if more > 1:
                    lower[at] = (more - 1, text)
            elif left:
                parts, _, down, across = left.pop(0)
                text = " ".join("".join(parts).split())
                for c in range(at, at + across):
                    below.pop(c, None)
                    cells.append(text)
                    if down > 1:
                        lower[c] = (down - 1, text)
            else:
                cells.append("")
        below = lower
        if cells:
            yield bool(row) and all(head for _, head, _, _ in row), cells


@udtf(returnType="table int, line int, header boolean, cells array<string>, names array<string>")
class page_tables:  # noqa: N801  (called like a function)
    """A table function of a page's text: a row for every row of every table, numbered from 0. header: all its cells are headers;
    names: the header names of its table by column, those of several header lines joined by _. Nothing for a null page."""

    def eval(self, html: str):
        if html is None:
            return
        reader = _Tables()
        reader.feed(html)
        reader.close()
        for t, found in enumerate(reader.found):
            rows = list(_grid(found))
            heads = [cells for head, cells in rows if head]
            names = ["_".join(h[c] for h in heads if c < len(h) and h[c]) for c in range(max(map(len, heads), default=0))]
            for i, (head, cells) in enumerate(rows):
                yield t, i, head, cells, names


def html_tables(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col and the columns of page_tables for every page: a lateral join, so a page is read where it lies and rows of pages that
    share an id, or have none, never meet.

    Pages without a table and null pages give no rows. Pages are read whole, one at a time.
    """
    pages = df.select(F.col(id_col).alias(id_col), F.col(html_col).cast("string").alias("_html"))
    return pages.lateralJoin(page_tables(F.col("_html").outer())).drop("_html")


def _named(rows: DataFrame, table: int) -> DataFrame:
    """The lines of one table of each page below its headers; tables without a header give none."""
    return rows.where((F.col("table") == table) & ~F.col("header") & (F.size("names") > 0))


def _place(*words: str) -> Column:
    """The place from 0 of the first name that holds all words in either case; -1 without one."""
    hit = lambda n: sum((F.contains(F.lower(n), F.lit(w)).cast("int") for w in words), F.lit(0)) == len(words)
    return F.array_position(F.transform("names", hit), F.lit(True)).cast("int") - 1


def _cell(place: Column) -> Column:
    return F.when(place >= 0, F.get("cells", place))


def _ticker(cell: Column) -> Column:
    text = F.replace(F.trim(cell), F.lit("."), F.lit("-"))
    return F.when(~text.isin("", "nan", "None"), text)


def current_members(rows: DataFrame, id_col: str, table: int = 0) -> DataFrame:
    """id_col, ticker: distinct members of a page's first table, from the column named "Symbol", else the first whose name holds
    that word, else the first."""
    exact = F.array_position("names", "Symbol").cast("int") - 1
    place = F.when(exact >= 0, exact).otherwise(F.greatest(_place("symbol"), F.lit(0)))
    return _named(rows, table).select(id_col, _ticker(_cell(place)).alias("ticker")).where("ticker is not null").distinct()


def index_changes(rows: DataFrame, id_col: str, table: int = 1) -> DataFrame:
    """id_col, date, added, removed of a page's second table, its columns found by words in their headers.

    Lines without a date that can be read (see any_date) go, and so do tables without all three columns; tickers have "-" for ".".
    """
    date, added, removed = _place("date"), _place("added", "ticker"), _place("removed", "ticker")
    named = _named(rows, table).where((date >= 0) & (added >= 0) & (removed >= 0))
    return named.select(id_col, any_date(_cell(date)).alias("date"), _ticker(_cell(added)).alias("added"), _ticker(_cell(removed)).alias("removed")).where("date is not null")
