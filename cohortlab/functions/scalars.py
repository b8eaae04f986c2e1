"""Scalar functions over Columns. A null argument gives null, and so does what would not be a finite number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.missing import number


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def round_half_away(x: Column, digits: Column | int = 0) -> Column:
    """Half away from zero on the binary value, so 1.005 to two digits is 1.0."""
    scale = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def step(x: Column, threshold: Column) -> Column:
    return F.when(x.isNotNull() & threshold.isNotNull(), F.when(x < threshold, 0.0).otherwise(1.0))


def find_text(needle: Column, text: Column) -> Column:
    """Place of the first occurrence, whatever the case, from 1; 0 if there is none."""
    return F.instr(F.lower(text), F.lower(needle))


def substring(text: Column, start: Column, length: Column | None = None) -> Column:
    whole = F.length(text)
    out = F.substr(text, start.cast("int"), (whole if length is None else length).cast("int"))
    return F.when((start >= 1) & ((length >= 0) if length is not None else F.lit(True)), out)


def text_to_number(x: Column) -> Column:
    return number(x)


def full_year(y: Column) -> Column:
    """0 to 29 is 2000 on, 30 to 99 is 1930 on."""
    return F.when((y >= 0) & (y < 30), y + 2000).when((y >= 30) & (y < 100), y + 1900).otherwise(y)


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp(full_year(y).cast("int"), m.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")


def text_to_date(text: Column) -> Column:
    """m/d/yyyy, m/d/yy or yyyy-mm-dd."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$", i).try_cast("int")
    slashed = make_date(part(3), part(1), part(2))
    return F.coalesce(slashed, F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.trim(text).try_cast("date")))


def time_text(h: Column, m: Column, s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int"))


def _seconds(a: Column, b: Column) -> Column:
    return F.unix_micros(b.cast("timestamp")) / 1e6 - F.unix_micros(a.cast("timestamp")) / 1e6


def days(a: Column, b: Column) -> Column:
    return trunc(_seconds(a, b) / 86_400).cast("long")


def hours(a: Column, b: Column) -> Column:
    """Whole hours, less whole days."""
    return (trunc(_seconds(a, b) / 3600) % 24).cast("long")


def minutes(a: Column, b: Column) -> Column:
    return _seconds(a, b) / 60


def seconds(a: Column, b: Column) -> Column:
    return _seconds(a, b)


def months(a: Column, b: Column) -> Column:
    """Whole months, towards zero."""
    gap = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    early = F.dayofmonth(b) < F.dayofmonth(a)
    late = F.dayofmonth(b) > F.dayofmonth(a)
    return F.when((gap > 0) & early, gap - 1).when((gap < 0) & late, gap + 1).otherwise(gap)


def years(a: Column, b: Column) -> Column:
    """Completed years, towards zero."""
    return trunc(months(a, b) / 12).cast("int")


def age_in_years(birth: Column, at: Column) -> Column:
    """Completed years; before birth there is no age."""
    before = (F.month(at) < F.month(birth)) | ((F.month(at) == F.month(birth)) & (F.dayofmonth(at) < F.dayofmonth(birth)))
    age = F.year(at) - F.year(birth) - before.cast("int")
    return F.when(age >= 0, age)


def epi_week(day: Column, first_day: int = 1) -> Column:
    """The week of a surveillance year: weeks start on ``first_day`` (1 is Sunday), and the first has at least four of
    the year's days, so the week belongs to the year of its fourth day."""
    into = F.pmod(F.dayofweek(day) - first_day, F.lit(7))
    fourth = F.date_add(F.date_sub(day, into), 3)
    return F.floor((F.dayofyear(fourth) - 1) / 7).cast("int") + 1


def percentile_of_z(z: Column) -> Column:
    """Percent of a normal distribution below z, two digits, at most 99.99; by the upper tail's rational forms."""
    x = F.abs(z)
    near = 0.5 - x * (
        0.398942280444 - 0.399903438504 * (x * x / 2) / (x * x / 2 + 5.75885480458 - 29.8213557808 / (x * x / 2 + 2.62433121679 + 48.6959930692 / (x * x / 2 + 5.92885724438)))
    )
    far = 0.398942280385 * F.exp(-x * x / 2) / (
        x - 3.8052e-8 + 1.00000615302 / (x + 3.98064794e-4 + 1.98615381364 / (x - 0.151679116635 + 5.29330324926 / (x + 4.8385912808 - 15.1508972451 / (x + 0.742380924027 + 30.789933034 / (x + 3.99019417011)))))
    )
    tail = F.when(x <= 1.28, near).otherwise(far)
    p = F.when(z > 0, 1 - tail).otherwise(tail) * 100
    return F.least(round_half_away(p, 2), F.lit(99.99))


def z_score(x: Column, l: Column, m: Column, s: Column) -> Column:  # noqa: E741
    """Of a measurement under a reference's power, median and variation, which a join on sex and age or length brings."""
    return _finite(F.when(F.abs(l) > 1e-9, (F.pow(x / m, l) - 1) / (l * s)).otherwise(F.ln(x / m) / s))


def random_between(low: float, high: float, seed: int, row: Column) -> Column:
    """A whole number from low to high, the same for a row and seed wherever it is computed."""
    return low + F.pmod(F.xxhash64(F.lit(seed), row), F.lit(int(high - low + 1)))


FORMATS: dict[str, Callable[[Column], Column]] = {
    "General Number": lambda v: v.cast("string"),
    "Fixed": lambda v: F.format_string("%.2f", v),
    "Standard": lambda v: F.format_number(v, 2),
    "Percent": lambda v: F.concat(F.format_string("%.2f", v * 100), F.lit("%")),
    "Scientific": lambda v: F.format_string("%.2E", v),
    "Yes/No": lambda v: F.when(v.cast("boolean"), "Yes").otherwise("No"),
    "True/False": lambda v: F.when(v.cast("boolean"), "True").otherwise("False"),
    "On/Off": lambda v: F.when(v.cast("boolean"), "On").otherwise("Off"),
    "General Date": lambda v: F.date_format(v, "M/d/yyyy h:mm:ss a"),
    "Long Date": lambda v: F.date_format(v, "EEEE, MMMM d, yyyy"),
    "Medium Date": lambda v: F.date_format(v, "dd-MMM-yy"),
    "Short Date": lambda v: F.date_format(v, "M/d/yyyy"),
    "Long Time": lambda v: F.date_format(v, "h:mm:ss a"),
    "Short Time": lambda v: F.date_format(v, "HH:mm"),
}


def format_value(v: Column, name: str = "General Number") -> Column:
    return F.when(v.isNotNull(), FORMATS[name](v))


def _told(value: float | None = None) -> Column:
    return F.lit(value).cast("double")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ABS": F.abs, "COS": F.cos, "SIN": F.sin, "TAN": F.tan, "EXP": lambda x: _finite(F.exp(x)), "SQRT": lambda x: F.when(x >= 0, F.sqrt(x)), "TRUNC": trunc,
    "LN": lambda x: F.when(x > 0, F.ln(x)), "LOG": lambda x: F.when(x > 0, F.log10(x)), "ROUND": round_half_away, "STEP": step,
    "FINDTEXT": find_text, "STRLEN": F.length, "UPPERCASE": F.upper, "SUBSTRING": substring, "TXTTONUM": text_to_number, "LINEBREAK": lambda: F.lit("\n"),
    "TXTTODATE": text_to_date, "NUMTODATE": make_date, "NUMTOTIME": time_text, "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth,
    "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DAYS": days, "HOURS": hours, "MINUTES": minutes, "SECONDS": seconds, "MONTHS": months, "YEARS": years,
    "EPIWEEK": epi_week, "FORMAT": format_value, "PFROMZ": percentile_of_z, "ZSCORE": z_score, "RND": random_between,
    "SYSTEMDATE": F.current_date, "SYSTEMTIME": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"), "CURRENTUSER": F.current_user,
    # What a device would tell is a parameter.
    "SYSLATITUDE": _told, "SYSLONGITUDE": _told, "SYSALTITUDE": _told,
}
