"""Column forms of the reference-sheet cell cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date spellings accepted in reference sheets.
DATE_FORMATS = ("MMM d yyyy", "MMMM d yyyy", "MM/dd/yyyy", "yyyy-MM-dd")


def clean_ticker(raw: Column) -> Column:
    """Leading run of letters, digits and dots; '' when there is none."""
    return F.regexp_extract(F.trim(raw), r"^([A-Za-z0-9.]+)", 1)


def clean_percent(raw: Column) -> Column:
    """Number of a percent cell; '-' and blanks are NULL."""
    text = F.trim(F.regexp_replace(F.trim(raw), r"%+$", ""))
    return F.when(text.isin("", "-"), F.lit(None)).otherwise(text).try_cast("double")


def clean_date(raw: Column) -> Column:
    """First of the accepted spellings that parses, else NULL."""
    text = F.trim(raw)
    shapes = {
        "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$",
        "MMMM d yyyy": r"^[A-Za-z]{3,9} \d{1,2} \d{4}$",
        "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
        "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    }
    parsed = [F.when(text.rlike(shapes[f]), F.try_to_timestamp(text, F.lit(f)).cast("date")) for f in DATE_FORMATS]
    return F.coalesce(*parsed)
