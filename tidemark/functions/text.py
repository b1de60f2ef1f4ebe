"""Text clean-up, typed readings of text, and masks, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.date_grammar import to_timestamp_mixed
from tidemark.functions.fixed_values import (
    EMAIL,
    FALSE_WORDS,
    NULL_TOKENS,
    NUMBER_SYMBOLS,
    PHONE,
    TRUE_WORDS,
)
from tidemark.functions.numbers import parse_number

# Every character that counts as white space at the ends of a value.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """Stripped text, null when it is a token for a missing value."""
    stripped = strip(text)
    return F.when(~stripped.isin(NULL_TOKENS), stripped)


def quoted(text: str) -> str:
    """A SQL string literal of plain text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_number(text: Column) -> Column:
    """A number with currency, percent and grouping signs dropped; ``(x)`` means ``-x``."""
    bare = F.translate(text, NUMBER_SYMBOLS, "")
    signed = F.when(
        bare.startswith("(") & bare.endswith(")"), F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    ).otherwise(bare)
    return parse_number(signed)


def to_boolean(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def has_phone_length(text: Column) -> Column:
    return F.length(digits(text)).between(7, 15)


def is_phone(text: Column) -> Column:
    return text.rlike(PHONE)


def mask_email(text: Column) -> Column:
    """First two characters of the name, stars for the rest, the domain kept."""
    at = F.instr(text, "@")
    name = F.substring(text, F.lit(1), at - 1)
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(2), F.length(name) - 2))
    masked = F.concat(F.substring(name, 1, 2), stars, F.substring(text, at, F.length(text)))
    return F.when(at > 0, masked).otherwise(F.concat(F.substring(text, 1, 1), F.lit("***")))


def mask_phone(text: Column) -> Column:
    """Stars for all but the last four digits."""
    only = digits(text)
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(only) - 4))
    return F.when(only == "", F.lit("***")).otherwise(F.concat(stars, F.right(only, F.lit(4))))


def mask(text: Column, kind: str, width: int = 80) -> Column:
    """Masked by meaning; text that is not sensitive is cut to ``width``."""
    if kind == "email":
        return mask_email(text)
    if kind == "phone":
        return mask_phone(text)
    return F.substring(text, 1, width)


def mask_by(text: Column, kind: Column, width: int = 80) -> Column:
    """As :func:`mask`, with the meaning in a column."""
    return (
        F.when(kind == "email", mask_email(text))
        .when(kind == "phone", mask_phone(text))
        .otherwise(F.substring(text, 1, width))
    )


def mask_middle(text: Column) -> Column:
    """First and last two characters around stars; only stars up to four characters."""
    ends = F.concat(F.substring(text, 1, 2), F.lit("***"), F.right(text, F.lit(2)))
    return F.when(F.length(text) > 4, ends).when(text.isNotNull(), "***")


def escape_formula(text: Column) -> Column:
    """A leading quote for text that a spreadsheet would run as a formula."""
    first = F.substring(F.ltrim(text, F.lit(WHITESPACE)), 1, 1)
    return F.when(first.isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)).otherwise(text)
