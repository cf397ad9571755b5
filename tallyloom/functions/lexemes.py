"""Strict typing of lexemes: a value only where it is exact, else a code; raw text always stays."""

from __future__ import annotations

import math
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_number_text

#: Longest integer lexeme that is looked at (fixed value).
MAX_INTEGER_LEXEME = 4_096
MAX_DIGITS = 1_000


def stripped(lexeme: Column) -> Column:
    return F.trim(lexeme, F.lit(" \t\n\x0b\f\r"))


def mapped_text(lexeme: Column) -> Column:
    """``value, code``: empty text is absent; text of white space alone is absent with a code."""
    blank = (lexeme != "") & (stripped(lexeme) == "")
    return F.struct(
        F.when(stripped(lexeme) != "", lexeme).alias("value"), F.when(blank, "MAPPED_TEXT_WHITESPACE_ONLY").alias("code"),
    )


def parse_lexeme(lexeme: Column) -> Column:
    """``value, code``: trimmed for parsing, with a code where that changed anything."""
    trimmed = stripped(lexeme)
    return F.struct(F.when(trimmed != "", trimmed).alias("value"), F.when((trimmed != lexeme) & (trimmed != ""), "PARSE_LEXEME_WHITESPACE_TRIMMED").alias("code"))


def _mantissa(text: Column) -> Column:
    return F.substring_index(F.translate(text, "E", "e"), "e", 1)


def _power(text: Column) -> Column:
    """The power of ten of a number; the cast is tried only on digits, since its failure is slow."""
    tail = F.substring_index(F.translate(text, "E", "e"), "e", -1)
    return F.when(text.contains("e") | text.contains("E"), F.when(tail.rlike(r"^[+\-]?[0-9]{1,9}$"), tail.cast("int"))).otherwise(0)


def _slow_float(text: str | None) -> tuple[float | None, str | None]:
    if text is None:
        return None, None
    try:
        number, exact = float(text), Decimal(text)
    except (ValueError, InvalidOperation):
        return None, "INVALID_NUMBER"
    if not math.isfinite(number):
        return (None, "LOSSY_FLOAT_REJECTED") if exact.is_finite() else (number, "NONFINITE_NUMBER")
    return (number, None) if exact == Decimal(repr(number)) else (None, "LOSSY_FLOAT_REJECTED")


#: Plain numbers of 15 digits at most, without a power.
_USUAL = r"\A[+\-]?(?:[0-9]{1,15}|(?=[0-9.]{3,16}\z)[0-9]+\.[0-9]+)\z"


def exact_float(lexeme: Column) -> Column:
    """``value, code``: a double only if its shortest decimal form equals the lexeme.

    Plain numbers of up to 15 digits and moderate size are exact and are cast, and what can be no
    number gets its code at once; the others go through an Arrow function with decimals.
    """

    @F.arrow_udf("struct<value:double,code:string>")
    def slow(values: pa.Array) -> pa.Array:
        kind = pa.struct([("value", pa.float64()), ("code", pa.string())])
        if values.null_count == len(values):
            return pa.nulls(len(values), kind)
        found = [_slow_float(v) for v in values.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.float64()), pa.array([c for _, c in found], pa.string())], ["value", "code"])

    def sorted_out(text: Column) -> Column:
        """The trimmed text where only decimals tell, else its double or its code."""
        digits = F.length(F.ltrim(F.translate(_mantissa(text), "+-.", ""), F.lit("0")))
        number = is_number_text(text)
        plain = (F.length(text) <= 40) & number & (digits <= 15) & F.coalesce(_power(text), F.lit(999)).between(-200, 200)
        # Underscores between digits and digits of other scripts count too: those are for the slow way.
        none = ~number & text.rlike("^[ -^`-~]+$") & ~text.rlike("(?i)nan|inf")
        return F.struct(F.when((text != "") & ~plain & ~none, text).alias("odd"), F.when(plain, text.try_cast("double")).alias("value"), F.when(none, "INVALID_NUMBER").alias("code"))

    # Most are plain digits with or without a point: one look and a cast.
    usual = lexeme.isNull() | lexeme.rlike(_USUAL)
    # The bound variable keeps the text from being trimmed again for each use.
    found = F.when(~usual, F.transform(F.array(stripped(lexeme)), sorted_out)[0])
    odd = F.when(~usual, found["odd"])
    quick = F.struct(found["value"].alias("value"), found["code"].alias("code"))
    cast = F.struct(lexeme.try_cast("double").alias("value"), F.lit(None).cast("string").alias("code"))
    return F.when(usual, cast).when(odd.isNull(), quick).otherwise(slow(odd))


def integer_key(whole: Column) -> Column:
    """A text that sorts as the integer does, for plain digits with or without a minus: sign, number of
    digits, digits; for negative ones the latter two complemented."""
    digits = F.ltrim(F.translate(whole, "-", ""), F.lit("0"))
    body = F.when(digits == "", "0").otherwise(digits)
    up = F.concat(F.lit("1"), F.lpad(F.length(body).cast("string"), 4, "0"), body)
    down = F.concat(F.lit("0"), F.lpad((9999 - F.length(body)).cast("string"), 4, "0"), F.translate(body, "0123456789", "9876543210"))
    return F.when(whole.startswith("-") & (body != "0"), down).otherwise(up)


def whole_integer(lexeme: Column) -> Column:
    """``whole, key, value, code``: an integer of up to a thousand digits from forms such as 3, 3.0 or 3e2.

    ``whole`` has its plain digits, ``key`` sorts and compares as the integer, and ``value`` is it as decimal(38,0)
    where it has 38 digits or less. No integer within the limits gets a code.
    """
    read = F.transform(F.array(_integer_parts(lexeme)), _read_integer)[0]
    made = F.transform(F.array(read), lambda p: F.struct(p["whole"].alias("whole"), F.when(p["whole"].isNotNull(), integer_key(p["whole"])).alias("key"), p["whole"].try_cast("decimal(38,0)").alias("value"), p["code"].alias("code")))
    return made[0]


def _integer_parts(lexeme: Column) -> Column:
    bare = stripped(lexeme)
    text = F.when(bare.contains("_"), F.regexp_replace(bare, "(?<=[0-9])_(?=[0-9])", "")).otherwise(bare)
    mantissa = _mantissa(text)
    fraction = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    return F.struct(
        F.when(text != "", text).alias("text"),
        is_number_text(text).alias("number"),
        F.when(mantissa.startswith("-"), "-").otherwise("").alias("sign"),
        F.ltrim(F.translate(mantissa, "+-.", ""), F.lit("0")).alias("digits"),
        (F.coalesce(_power(text), F.lit(0)) - F.length(fraction)).alias("exponent"),
        (F.length(lexeme) > MAX_INTEGER_LEXEME).alias("long"),
    )


def _read_integer(p: Column) -> Column:
    """``whole, code`` of an integer's parts."""
    digits, exponent = p["digits"], p["exponent"]
    zero = digits == ""
    too_big = (F.abs(exponent) > MAX_DIGITS) | (~zero & (F.length(digits) - 1 + exponent >= MAX_DIGITS))
    trailing = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    is_whole = zero | (exponent >= 0) | (trailing >= -exponent)
    special = ~p["number"] & p["text"].rlike(r"^(?i)[+\-]?(nan|snan|inf|infinity)[0-9]*$")
    code = (
        F.when(p["text"].isNull(), None)
        .when(p["long"], "INTEGER_LIMIT_EXCEEDED")
        .when(special, "NONFINITE_NUMBER")
        .when(~p["number"], "INVALID_NUMBER")
        .when(too_big, "INTEGER_LIMIT_EXCEEDED")
        .when(~is_whole, "INVALID_INTEGER")
    )
    zeros = F.repeat(F.lit("0"), F.greatest(exponent, F.lit(0)))
    shifted = F.when(exponent >= 0, F.concat(digits, zeros)).otherwise(F.substring(digits, 1, F.greatest(F.length(digits) + exponent, F.lit(0))))
    value = F.when(code.isNull() & p["text"].isNotNull(), F.when(zero, "0").otherwise(F.concat(p["sign"], shifted)))
    return F.struct(value.alias("whole"), code.alias("code"))


def bounded_integer(lexeme: Column) -> Column:
    """``value, code``: an integer from forms such as 3, 3.0 or 3e2, as decimal(38,0).

    Integers beyond 38 digits and up to a thousand have no such value and ``INTEGER_BEYOND_DECIMAL``;
    ``whole_integer`` has them exactly, in order.
    """

    def typed(p: Column) -> Column:
        value = p["whole"].try_cast("decimal(38,0)")
        return F.struct(value.alias("value"), F.coalesce(p["code"], F.when(p["whole"].isNotNull() & value.isNull(), "INTEGER_BEYOND_DECIMAL")).alias("code"))

    # Most integers are plain digits: one look and a cast.
    plain = F.struct(lexeme.try_cast("decimal(38,0)").alias("value"), F.lit(None).cast("string").alias("code"))
    return F.when(lexeme.isNull() | lexeme.rlike("^-?[0-9]{1,18}$"), plain).otherwise(F.transform(F.transform(F.array(_integer_parts(lexeme)), _read_integer), typed)[0])


_DATE = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_TIME = r"([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?)?"
_ZONE = r"(Z|[+\-]([01][0-9]|2[0-3]):?[0-5][0-9](:[0-5][0-9])?)?"


def iso_timestamp(lexeme: Column) -> Column:
    """``value, reliable, code``: extended ISO 8601 dates and times; reliable ones have an offset.

    Basic (``20260101T010000``) and week (``2026-W01-1``) dates are read too. A time without an
    offset is read as UTC and marked unreliable. Values that leave the years 1 to 9999 in UTC are
    not orderable.
    """
    text = stripped(lexeme)
    text = F.when(text != "", text)
    basic = text.rlike(r"^[0-9]{8}(T[0-9]{6}" + _ZONE + ")?$")
    spelled = F.when(basic, F.regexp_replace(F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3"), r"T([0-9]{2})([0-9]{2})([0-9]{2})", "T$1:$2:$3")).otherwise(text)
    week = text.rlike(r"^[0-9]{4}-W(0[1-9]|[1-4][0-9]|5[0-3])-[1-7]$")
    year = F.substring(text, 1, 4).try_cast("int")
    fourth = F.try_to_date(F.concat(F.substring(text, 1, 4), F.lit("-01-04")))
    monday = F.date_sub(fourth, F.weekday(fourth))
    of_week = F.date_add(monday, (F.substring(text, 7, 2).try_cast("int") - 1) * 7 + F.substring(text, 10, 1).try_cast("int") - 1)
    grammar = spelled.rlike(f"^{_DATE}([T ]{_TIME}{_ZONE})?$")
    offset = spelled.rlike(r"[T ].*(Z|[+\-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)$")
    full = F.regexp_replace(F.regexp_replace(spelled, ",", "."), r"([T ][0-9]{2})(Z|[+\-]|$)", "$1:00$2")
    parsed = F.when(week & (year > 0), of_week.cast("timestamp")).when(grammar & (year > 0), full.try_cast("timestamp"))
    outside = (F.year(parsed) < 1) | (F.year(parsed) > 9999)
    reliable = F.coalesce(parsed.isNotNull() & offset & ~outside, F.lit(False))
    code = (
        F.when(text.isNull(), None)
        .when(parsed.isNull(), "INVALID_TIMESTAMP")
        .when(offset & outside, "ACQUIRED_AT_UTC_RANGE_UNORDERABLE")
        .when(~offset, "TIMESTAMP_TIMEZONE_MISSING")
    )
    none = F.struct(F.lit(None).cast("timestamp").alias("value"), F.lit(False).alias("reliable"), F.lit(None).cast("string").alias("code"))
    return F.when(lexeme.isNull(), none).otherwise(F.struct(F.when(~outside, parsed).alias("value"), reliable.alias("reliable"), code.alias("code")))


def strict_text(lexeme: Column, required: bool = False) -> Column:
    """``value, code`` of a user-mapped text field, where any fault fails the file."""
    blank = stripped(F.coalesce(lexeme, F.lit(""))) == ""
    code = F.when(blank & (F.lit(required) | (F.coalesce(lexeme, F.lit("")) != "")), "PEAK_MAPPING_VALUE_MISSING" if required else "PEAK_MAPPING_TEXT_INVALID")
    return F.struct(F.when(~blank, lexeme).alias("value"), code.alias("code"))


_STRICT = {"INVALID_NUMBER": "PEAK_MAPPING_NUMBER_INVALID", "NONFINITE_NUMBER": "PEAK_MAPPING_NUMBER_NONFINITE", "LOSSY_FLOAT_REJECTED": "PEAK_MAPPING_NUMBER_LOSSY"}


def strict_number(lexeme: Column, required: bool = False) -> Column:
    """``value, code`` of a user-mapped number; non-finite values are faults too."""
    read = exact_float(lexeme)
    code = F.create_map(*[F.lit(x) for kv in _STRICT.items() for x in kv])[read["code"]]
    missing = F.when(stripped(F.coalesce(lexeme, F.lit(""))) == "", "PEAK_MAPPING_VALUE_MISSING") if required else F.lit(None)
    return F.struct(F.when(code.isNull(), read["value"]).alias("value"), F.coalesce(missing, code).alias("code"))


def strict_integer(lexeme: Column) -> Column:
    read = bounded_integer(lexeme)
    return F.struct(read["value"].alias("value"), F.when(read["code"].isNotNull(), "PEAK_MAPPING_INTEGER_INVALID").alias("code"))


def vendor_decimal(lexeme: Column, longest: int = 128) -> Column:
    """``value, code`` of a nonnegative decimal in a vendor's result table."""
    grammar = lexeme.rlike(r"^[0-9]+(\.[0-9]+)?$") & (F.length(lexeme) <= longest)
    read = exact_float(F.when(grammar, lexeme))
    return F.struct(read["value"].alias("value"), F.when(lexeme.isNotNull() & ~grammar, "INVALID_NUMBER").otherwise(read["code"]).alias("code"))
