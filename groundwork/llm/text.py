"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of the plain kind: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters and digits: ASCII letters, ASCII digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def terms(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({TERM})"), F.lit(1))
