"""Reading attribute values out of note documents, with "null, never throw" casts.

A value that does not fit the wanted type reads as null. An empty
string counts as absent. A string is a date only in the exact form ``yyyy-MM-dd``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the one written form of a date.
DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"
DATE_FORM_SQL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
NUMBER = "decimal(38,18)"


def as_date(text: Column) -> Column:
    return F.when(text.rlike(DATE_FORM), text.try_cast("date"))


def as_number(text: Column) -> Column:
    return text.try_cast(NUMBER)


def present(text: Column) -> Column:
    """The text, with the empty string read as absent."""
    return F.nullif(text, F.lit(""))


def written_scale(text: str, key: str) -> str:
    """SQL of the decimals written after ``"key":`` in a section's text, trailing zeros included.

    Parsed JSON drops the zeros, so the raw text is the only place they survive. An exponent
    shifts the point: 1.5e-3 has three decimals more than 1.5.
    """
    number = f'"{key}"[ ]*:[ ]*"?-?[0-9]+(?:[.]([0-9]+))?(?:[eE]([+-]?[0-9]+))?'
    mantissa = f"length(regexp_extract({text}, '{number}', 1))"
    # An empty text is no number; a cast would raise, word and drop an error for each.
    exponent = f"coalesce(try_cast(nullif(regexp_extract({text}, '{number}', 2), '') AS INT), 0)"
    return f"greatest({mantissa} - {exponent}, 0)"
