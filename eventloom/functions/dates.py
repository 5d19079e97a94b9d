"""Date functions: year inference and durations as columns, the position-bound scanner of dated text as an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from eventloom.functions import vocab as V

# The weekdays from Monday, and periods.
WEEKDAYS = "月火水木金土日"
DURATION = r"(\d{1,2})\s*(週間|日間|ヶ月|か月|カ月)"


def weekday_matches(day: Column, mark: Column) -> Column:
    """The weekday's sign equals the mark; a null mark matches."""
    return mark.isNull() | (F.substring(F.lit(WEEKDAYS), F.weekday(day) + 1, F.lit(1)) == mark)


def infer_year(month: Column, day: Column, ref: Column, mark: Column) -> Column:
    """The year nearest to ref in which the date exists, at most 300 days away; a weekday mark decides first and must fit."""

    def near(step: Column) -> Column:
        year = F.year(ref) + step
        d = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))
        fits = weekday_matches(d, mark)
        return F.struct(F.when(fits, 0).otherwise(1).alias("off"), F.abs(F.datediff(d, ref)).alias("away"), F.when(step == 0, 0).otherwise(1).alias("other"), year.alias("year"))

    best = F.array_min(F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), near), lambda x: x.away <= V.INFER_DAYS))
    return F.when(mark.isNull() | (best["off"] == 0), best["year"])


def duration_end(start: Column, tail: Column) -> Column:
    """The last day of a period of weeks, days or 30-day months that the 20 characters after a date name."""
    near = F.substring(tail, 1, 20)
    n, unit = F.try_to_number(F.nullif(F.regexp_extract(near, DURATION, 1), F.lit("")), F.lit("99")).cast("int"), F.regexp_extract(near, DURATION, 2)
    return F.date_add(start, n * F.when(unit == "週間", 7).when(unit == "日間", 1).otherwise(30) - 1)


def parse_published(text: Column) -> Column:
    """The date part of the five known formats, in the offset of its source; null for others."""
    t = F.trim(text)
    rfc = F.regexp_extract(t, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{1,2} [A-Z][a-z]{2} \d{4}) \d{2}:\d{2}:\d{2} (?:[+-]\d{2}:?\d{2}|Z)$", 1)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})(?:T\d{1,2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2}))?$", 1)
    slash = F.regexp_extract(t, r"^(\d{4}/\d{1,2}/\d{1,2})$", 1)
    return F.coalesce(F.try_to_date(iso, "yyyy-M-d"), F.try_to_date(slash, "yyyy/M/d"), F.try_to_date(rfc, "d MMM yyyy"))


class DateScanner:
    """Reads dates and ranges off a text in compatibility form, position by position.

    A date that can't be resolved is left and the scan goes on one character later; nothing is guessed without a
    reference date.
    """

    # Patterns.
    DATE = re.compile(r"(?:(\d{4})\s*[年/／.]\s*)?(\d{1,2})\s*[月/／.]\s*(\d{1,2})\s*日?")
    MARK = re.compile(r"\s*[（(]([日月火水木金土])[）)]")
    JOINER = re.compile(r"\s*(?:[~〜～\-‐‑‒–—―]|から|より)\s*")
    DAY = re.compile(r"\s*(\d{1,2})\s*日")
    PERIOD = re.compile(DURATION)
    MONTH = re.compile(r"(?:(20\d{2})\s*年\s*)?(\d{1,2})\s*月(?!\s*\d{1,2}\s*日)(?!\s*[/／.]\s*\d)")
    UNIT_DAYS = {"週間": 7, "日間": 1}

    def __init__(self, text: str | None):
        self.text = unicodedata.normalize("NFKC", text or "")

    @staticmethod
    def day(year: int, month: int, day: int) -> date | None:
        try:
            return date(year, month, day)
        except ValueError:
            return None

    @classmethod
    def near(cls, month: int, day: int, ref: date | None, mark: str | None = None) -> date | None:
        options = [d for y in (0, -1, 1) if ref and (d := cls.day(ref.year + y, month, day)) and abs((d - ref).days) <= V.INFER_DAYS]
        if mark:
            options = [d for d in options if WEEKDAYS[d.weekday()] == mark]
        return min(options, key=lambda d: abs((d - ref).days), default=None)

    def at(self, pos: int, ref: date | None) -> tuple[date, bool, int] | None:
        """The date that begins here: value, whether its year is written, where it ends."""
        m = self.DATE.match(self.text, pos)
        if not m:
            return None
        mark = self.MARK.match(self.text, m.end())
        sign = mark[1] if mark else None
        month, day = int(m[2]), int(m[3])
        value = self.day(int(m[1]), month, day) if m[1] else self.near(month, day, ref, sign)
        if value is None or sign and WEEKDAYS[value.weekday()] != sign:
            return None
        return value, m[1] is not None, (mark or m).end()

    def _last(self, start: date, pos: int) -> tuple[date | None, int]:
        """The end of a range that starts before pos, and where its text ends."""
        joiner = self.JOINER.match(self.text, pos)
        if joiner:
            read = self.at(joiner.end(), start)
            if read:
                last, end = read[0], read[2]
            elif day := self.DAY.match(self.text, joiner.end()):
                last, end = self.day(start.year, start.month, int(day[1])), day.end()
            else:
                last, end = None, pos
            if last and last >= start:
                return last, end
        period = self.PERIOD.search(self.text[pos : pos + 20])
        if period:
            days = int(period[1]) * self.UNIT_DAYS.get(period[2], 30) - 1
            return (start + timedelta(days=days) if days <= (date.max - start).days else None), pos
        return None, pos

    def ranges(self, ref: date | None) -> Iterator[tuple[date, date | None, str, bool]]:
        pos = 0
        while m := self.DATE.search(self.text, pos):
            read = self.at(m.start(), ref)
            if read is None:
                pos = m.start() + 1
                continue
            last, end = self._last(read[0], read[2])
            yield read[0], last, self.text[m.start() : end].strip(), read[1]
            pos = end

    def bare(self) -> str | None:
        """The first date without a year."""
        return next((m[0].strip() for m in self.DATE.finditer(self.text) if not m[1] and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31), None)

    def month(self, ref: date | None) -> tuple[str, bool] | None:
        """The first month without a day, and whether its year is written."""
        for m in self.MONTH.finditer(self.text):
            month = int(m[2])
            if 1 <= month <= 12:
                if m[1]:
                    return f"{int(m[1])}年{month}月", True
                found = self.near(month, 1, ref)
                return (f"{found.year}年{month}月" if found else f"{month}月"), False
        return None


RANGE = T.StructType([T.StructField("start", T.DateType()), T.StructField("end", T.DateType()), T.StructField("raw", T.StringType()), T.StructField("year_explicit", T.BooleanType())])
MONTH_FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("year_explicit", T.BooleanType())])


def _date(value) -> date | None:
    return None if value is None or value is pd.NaT else value


@pandas_udf(T.ArrayType(RANGE))
def extract_ranges(texts: pd.Series, refs: pd.Series) -> pd.Series:
    """All dates and ranges of a text in order; refs: the date of publication or null."""
    return pd.Series([[{"start": a, "end": b, "raw": c, "year_explicit": d} for a, b, c, d in DateScanner(t).ranges(_date(r))] for t, r in zip(texts, refs, strict=True)])


DATES_READ = T.StructType([T.StructField("published", T.DateType()), *RANGE.fields, T.StructField("bare", T.StringType()), T.StructField("month", T.StringType()), T.StructField("month_explicit", T.BooleanType())])
# Fixed value: what a publication date without a year is read against.
LOOSE_REF = date(2000, 1, 1)


@pandas_udf(DATES_READ)
def read_dates(texts: pd.Series, refs: pd.Series, loose: pd.Series) -> pd.DataFrame:
    """All that a run needs of a text, in one pass: its first range, else its first date without a year, else its first month
    without a day. The reference is refs, or where that is null the first date of ``loose``; it is returned as published."""
    out = []
    for text, ref, other in zip(texts, map(_date, refs), loose, strict=True):
        if ref is None and other:
            ref = next((r[0] for r in DateScanner(other).ranges(LOOSE_REF)), None)
        scanner = DateScanner(text)
        found = next(scanner.ranges(ref), None)
        bare = None if found else scanner.bare()
        month = None if found or bare else scanner.month(ref)
        out.append((ref, *(found or (None,) * 4), bare, *(month or (None, None))))
    return pd.DataFrame(out, columns=DATES_READ.names, dtype=object)


# not to be evaluated again for each filter that could be pushed below it
read_dates = read_dates.asNondeterministic()


@pandas_udf(StringType())
def mentions_bare_date(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: DateScanner(t).bare())


@pandas_udf(MONTH_FOUND)
def mentions_month(texts: pd.Series, refs: pd.Series) -> pd.DataFrame:
    found = [DateScanner(t).month(_date(r)) or (None, None) for t, r in zip(texts, refs, strict=True)]
    return pd.DataFrame(found, columns=["text", "year_explicit"])


# Fixed value: a month and day.
MONTH_DAY = r"(\d{1,2})\s*[月/／]\s*(\d{1,2})"


def month_days(text: Column) -> Column:
    """The distinct valid (m, d) of a text in compatibility form."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(MONTH_DAY), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(MONTH_DAY), F.lit(2)).alias("d"))
    pairs = F.transform(both, lambda x: F.struct(x.m.cast("int").alias("m"), x.d.cast("int").alias("d")))
    return F.array_distinct(F.filter(pairs, lambda x: x.m.between(1, 12) & x.d.between(1, 31)))
