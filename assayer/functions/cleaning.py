"""Cleaning and parsing expressions with the semantics of the source warehouse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space code points; plain TRIM strips all of them, Spark's default only the blank.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Fixed value: characters after which title case starts a new word, besides whitespace.
TITLE_DELIMITERS = r"""[](){}/|\<>!?@"^#$&~_,.:;*%+-"""

# A code point that is no character, so no text holds it.
MARK = "\uffff"

CLEAN_ENDS = r"\A[!-~](?s:.*[!-~])?\z"
DATE_FORM = r"\d{4}-\d{1,2}-\d{1,2}"
TIMESTAMP_FORM = (
    r"\d{4}-\d{1,2}-\d{1,2}"
    r"(?:[ Tt]\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)?"
    r"(?: ?(?:[Zz]|UTC|[+-]\d{1,2}(?::\d{1,2})?|[A-Za-z]+/[A-Za-z_/+-]+))?"
)


def text(c: Column) -> Column:
    """Trimmed text; blank becomes NULL.

    Trimming a set of characters walks the whole value several times; most values begin and end in visible
    ASCII and need none of it, which one look by a pattern tells.
    """
    return F.when(c.rlike(CLEAN_ENDS), c).otherwise(F.nullif(F.trim(c, F.lit(WHITESPACE)), F.lit("")))


def lower_text(c: Column) -> Column:
    return F.lower(text(c))


def upper_text(c: Column) -> Column:
    return F.upper(text(c))


def safe_date(c: Column) -> Column:
    """A full ``yyyy-m-d`` date, else NULL. Spark alone would also take '2026-04' and date-times."""
    return _of_form(c, DATE_FORM).try_cast("date")


def safe_timestamp(c: Column) -> Column:
    """A timestamp with a full date, else NULL. Spark alone would read '12:30:00' as today."""
    return _of_form(c, TIMESTAMP_FORM).try_cast("timestamp")


def _of_form(c: Column, form: str) -> Column:
    """The text between outer whitespace if it has the form, else the empty string, which no cast accepts."""
    return F.regexp_extract(c, rf"\A[{WHITESPACE}]*({form})[{WHITESPACE}]*\z", 1)


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every delimiter, lower-case the rest.

    Spark's ``initcap`` starts words at blanks only, so a marked blank follows each delimiter meanwhile. Plain
    string functions keep the projection inside generated code, which an array transform would not.
    """
    escaped = "".join("\\" + ch for ch in TITLE_DELIMITERS)
    marked = F.regexp_replace(c, rf"([\s{escaped}])", f"$1{MARK} ")
    return F.replace(F.initcap(marked), F.lit(f"{MARK} "), F.lit(""))
