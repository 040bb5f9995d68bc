"""Text functions as Column expressions: titles, tokens, addresses, dates. Patterns name their classes, so that every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
# Names of months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    return extract_all(F.lower(F.coalesce(text, F.lit(""))), TOKEN)


def upper(text: Column) -> Column:
    """Upper case, character by character: one whose capital form is two (ß) stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def title(text: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([^\n]*)", 1))


def body(text: Column) -> Column:
    """What follows the title's line, trimmed of white space at both ends."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*[^\n]*", "")
    return F.regexp_replace(F.regexp_replace(rest, r"^\s+", ""), r"\s+$", "")


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(extract_all(F.coalesce(text, F.lit("")), EMAIL), F.lower))


def derived_date(stated: Column, text: Column) -> Column:
    """The stated date, else the latest ISO date in the text, else ''."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.array_max(extract_all(F.coalesce(text, F.lit("")), ISO_DATE)), F.lit(""))


def normal_date(raw: Column) -> Column:
    """The first ISO date; else 'D Mon YYYY' as one; else ''."""
    iso = F.regexp_extract(raw, ISO_DATE, 0)
    parts = [F.regexp_extract(raw, r"(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})", i) for i in (1, 2, 3)]
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(parts[1]))
    spelled = F.when(month > 0, F.concat_ws("-", parts[2], F.lpad(month.cast("string"), 2, "0"), F.lpad(parts[0], 2, "0"))).otherwise("")
    return F.coalesce(F.when(iso != "", iso).otherwise(spelled), F.lit(""))
