"""Column jobs on text, dates and numbers; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import col

#: Month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def occurrences(s: str | Column, c: str) -> Column:
    return F.length(col(s)) - F.length(F.replace(col(s), F.lit(c), F.lit("")))


def n_words(s: str | Column) -> Column:
    return F.size(F.split(col(s), " "))


def swap_case(s: str | Column) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col(s), low + up, up + low)


def title_case(s: str | Column) -> Column:
    """Every word with a capital, the rest of it small; words are parted by spaces."""
    return F.initcap(col(s))


def is_palindrome(s: str | Column) -> Column:
    return F.lower(col(s)) == F.reverse(F.lower(col(s)))


def valid_password(s: str | Column) -> Column:
    return (F.length(col(s)) >= 8) & col(s).rlike("[A-Z]") & col(s).rlike("[0-9]")


def valid_name(s: str | Column) -> Column:
    return (col(s) != "") & ~col(s).rlike("^[0-9]+$")


def day_of(s: str | Column) -> Column:
    """The date of a `dd/mm/yyyy` text; null if there is no such day."""
    return F.try_to_date(col(s), "d/M/yyyy")


def is_leap(year: str | Column) -> Column:
    y = col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def month_name(d: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(col(d)))


def hms(seconds: str | Column) -> Column:
    s = col(seconds).cast("long")
    part = lambda e: F.floor(e).cast("long")
    return F.struct(part(s / 3600).alias("h"), part((s % 3600) / 60).alias("m"), (s % 60).alias("s"))


def seconds(h: str | Column, m: str | Column, s: str | Column) -> Column:
    return col(h) * 3600 + col(m) * 60 + col(s)


def sign_band(x: str | Column) -> Column:
    return F.when(col(x) > 0, "positivo").when(col(x) < 0, "negativo").otherwise("cero")


def range_band(x: str | Column, low: float = 0, high: float = 10) -> Column:
    """0-10, above or below it."""
    return F.when(col(x) > high, "mayor").when(col(x) < low, "menor").when(col(x).isNotNull(), "0-10")


def age_band(x: str | Column) -> Column:
    return F.when(col(x) < 12, "infantil").when(col(x) <= 18, "joven").otherwise("adulto")


def divides(a: str | Column, b: str | Column) -> Column:
    """Whether either number divides the other; false if one is 0."""
    a, b = col(a), col(b)
    return F.when((a == 0) | (b == 0), False).otherwise((a % F.nullif(b, F.lit(0)) == 0) | (b % F.nullif(a, F.lit(0)) == 0))


def age_or_default(s: str | Column, default: int = 18) -> Column:
    """A whole non-negative age; the default for anything else."""
    age = col(s).try_cast("int")
    return F.when(age.isNull() | (age < 0), default).otherwise(age)
