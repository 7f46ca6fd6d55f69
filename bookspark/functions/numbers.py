"""Number parsing and the number-token rules used by text verification."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   number token in generated text:  \d[\d,]*(?:\.\d+)?%?
#   characters kept by the money parser: 0-9 . -
NUMBER_TOKEN = r"(\d[\d,]*(?:\.\d+)?%?)"
KEEP_NUMERIC = r"[^0-9.\-]"


def to_number(c: Column) -> Column:
    """``'NGN1,800' -> 1800.0``, ``'' / '-' / '.' -> NULL``, garbage -> NULL.

    Keep digits, dot and minus, then a failing cast is NULL (``try_cast``).
    A plain numeric string passes through unchanged by the same rule."""
    return F.regexp_replace(c.cast("string"), KEEP_NUMERIC, "").try_cast("double")


# How a CSV reader writes whole numbers, numbers and truth values.
WHOLE = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"^(?i)[+-]?inf(?:inity)?$"
TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]
# A whole number that no other text equals, and anything a reader would type.
PLAIN_WHOLE = r"^(?:0|-?[1-9]\d{0,17})$"
TYPED = r"^ *(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:[+-]?inf(?:inity)?)|True|TRUE|true|False|FALSE|false) *$"

# What a value can be, as bits: a column is what all of its values are.
INT, NEGATIVE, UINT, DOUBLE, BOOL, TEXT, RESPELT = 1, 2, 4, 8, 16, 32, 64
EXACT_DIGITS = 15  # a double keeps any number of so many digits
MAX_LONG, MAX_UNSIGNED = "9223372036854775807", "18446744073709551615"


def is_plain_number(c: Column) -> Column:
    """True where the text is already a number as a CSV reader would type it
    (not ``12D`` or ``0x1p3``, which a cast would take)."""
    t = F.trim(c)
    return t.rlike(DECIMAL) | t.rlike(INFINITE)


def _digits(whole: Column) -> Column:
    """A whole number without sign and leading zeros."""
    return F.regexp_replace(whole, r"^[+-]?0*(?=\d)", "")


def _at_most(digits: Column, limit: str) -> Column:
    return (F.length(digits) < len(limit)) | ((F.length(digits) == len(limit)) & (digits <= limit))


def canonical_whole(c: Column) -> Column:
    """One text per whole number, of any length."""
    digits = _digits(F.trim(c))
    return F.when(c.rlike(PLAIN_WHOLE), c).when(F.trim(c).startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def canonical_decimal(c: Column) -> Column:
    """One text per number: that of its double if it has few enough digits for one, else its own digits.
    Few characters hold few digits, so only long texts have theirs counted."""
    t = F.trim(c)
    x = t.try_cast("double")
    short = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.try_cast("bigint").cast("string")).otherwise(x.cast("string"))
    mantissa = F.regexp_replace(t, r"[eE].*$", "")
    long_ = F.length(F.regexp_replace(F.regexp_replace(mantissa, r"[^0-9]", ""), r"^0+|0+$", "")) > EXACT_DIGITS
    spelt = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    spelt = F.when(spelt.rlike(r"^-?\d*\.\d*$"), F.regexp_replace(spelt, r"\.?0*$", "")).otherwise(F.lower(spelt))
    return F.when((F.length(t) > EXACT_DIGITS) & long_, spelt).otherwise(short)


def spelling(c: Column) -> Column:
    """0: missing or a whole number in its one plain spelling; 1: another number or truth value; 2: text."""
    return F.when(c.isNull() | c.rlike(PLAIN_WHOLE), 0).when(c.rlike(TYPED), 1).otherwise(2)


def value_bits(c: Column) -> Column:
    """The bits of one value; 0 for a missing one."""
    t = F.trim(c)
    digits = _digits(t)
    respelt = lambda canonical: F.when(canonical != c, RESPELT).otherwise(0)
    whole = (F.when(F.length(t) < len(MAX_LONG) - 1, INT).when(_at_most(digits, MAX_LONG), INT)
             .when(~t.startswith("-") & _at_most(digits, MAX_UNSIGNED), UINT).otherwise(TEXT))
    return (F.when(c.isNull(), 0)
             .when(c.rlike(PLAIN_WHOLE), F.when(c.startswith("-"), INT | NEGATIVE).otherwise(INT))
             .when(t.rlike(WHOLE), whole + F.when(t.startswith("-"), NEGATIVE).otherwise(0) + respelt(canonical_whole(c)))
             .when(is_plain_number(c), F.lit(DOUBLE) + respelt(canonical_decimal(c)))
             .when(c.isin(TRUTH), F.lit(BOOL) + respelt(F.initcap(c)))
             .otherwise(TEXT))


def column_kind(bits: Column) -> Column:
    """``int``, ``double``, ``bool`` or ``text`` for the bits of all values of a column.

    Whole numbers fit 64 bits, signed or unsigned, or are text, as a reader
    types them; they are compared by their digits, so none is rounded."""
    has = lambda b: bits.bitwiseAND(F.lit(b)) != 0
    whole = ~has(DOUBLE | BOOL | TEXT) & ~(has(UINT) & has(NEGATIVE))
    return (F.when(has(TEXT) | bits.isNull(), "text").when(has(BOOL), F.when(has(INT | UINT | DOUBLE), "text").otherwise("bool"))
             .when(has(DOUBLE), "double").when(whole & has(INT | UINT), "int").otherwise("text"))


def canonical(c: Column, kind: Column) -> Column:
    """One text per value of a column of that kind."""
    return (F.when(kind == "int", canonical_whole(c)).when(kind == "double", canonical_decimal(c))
             .when(kind == "bool", F.initcap(c)).otherwise(c))


def extract_numbers(c: Column) -> Column:
    """All number tokens, in order, duplicates kept."""
    return F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), 1)


def normalise_number(x: Column) -> Column:
    """Drop a trailing ``%``, every comma, then one trailing ``.0``."""
    y = F.regexp_replace(F.regexp_replace(x, "%$", ""), ",", "")
    return F.regexp_replace(y, r"\.0$", "")


def is_small_count(x: Column) -> Column:
    """A bare single digit is prose scaffolding, never checked."""
    return x.rlike(r"^\d$")
